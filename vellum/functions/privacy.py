"""Removing personal data from medical letters (survey rows PI1, PI3, PI5 to PI8, PI11 to PI14, PI25, PI28): letterhead, ordered passes of expressions, dates by their context, clean-up.

Every pass is one JVM-side replacement over the text that the pass before left, in a column of its own: the pass's
count and the next pass both read it, so Spark evaluates it once and compiles its literal pattern once. A pass is run only on texts that
hold what its matches hold, and counted only where it changed something. Expressions use
Unicode classes, as the fixed values are written for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.folds import bound

# Kind, whether case matters not, pattern; the German passes in order, names first.
GERMAN = [
    ("doctor_title_name", False, r"\b(?:[Dd]r\.[\s]*(?:[Mm]ed\.?|[Rr]er\.?\s*[Nn]at\.?|[Pp]hil\.?|[Jj]ur\.?|[Hh]\.?\s*[Cc]\.?)?[\s\.]*|[Pp]rof\.[\s]*(?:[Dd]r\.[\s]*(?:[Mm]ed\.?|[Hh]\.?\s*[Cc]\.?)?[\s\.]*)?|[Dd]ipl\.[\s\-]?(?:[Mm]ed\.?|[Ii]ng\.?|[Pp]sych\.?)\s*|OA\s+|[Oo]berarzt\s+|[Oo]berärztin\s+|CA\s+|[Cc]hefarzt\s+|[Cc]hefärztin\s+|FA\s+|[Ff]acharzt\s+|[Ff]achärztin\s+)([A-ZÄÖÜ][a-zäöüß]+(?:[\s\-][A-ZÄÖÜ][a-zäöüß]+)?)\b"),
    ("honorific_name", False, r"\b(?:[Hh]err|[Ff]rau|[Ff]räulein|[Hh]r\.?|[Ff]r\.?)\s+([A-ZÄÖÜ][a-zäöüß]+)(?:[\s\-]([A-ZÄÖÜ][a-zäöüß]+))?"),
    ("name_comma_format", True, r"(?:Patient(?:in)?|Name|Versicherte[rn]?)[:\s]*([A-ZÄÖÜ][a-zäöüß]+)\s*,\s*([A-ZÄÖÜ][a-zäöüß]+)"),
    ("labeled_name", False, r"(?:[Pp]atient(?:in)?|[Vv]ersicherte[rn]?|[Aa]uftraggeber|[Ee]insender|[Aa]nsprechpartner|[Ee]mpfänger|[Aa]bsender):\s*([A-ZÄÖÜ][a-zäöüß]+(?:\s+[A-ZÄÖÜ][a-zäöüß]+)?)"),
    ("name_in_header_block", True, r"(?:\]|[a-zäöüß])\s*,\s*([A-ZÄÖÜ][a-zäöüß]+)\s*,\s*,?\s*(?:Status|$)"),
    ("doctor_initial_name", False, r"(?<!Vitamin )(?<!Typ )(?<![a-zäöü]\.)\b([A-Z]\.)\s*([A-ZÄÖÜ][a-zäöüß]+(?:-[A-ZÄÖÜ][a-zäöüß]+)?)\b"),
    ("date_german_month", True, r"\b(\d{1,2})\.\s*(Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\s+(\d{4})\b"),
    ("case_reference", True, r"(?:DS|Dossier|Fall|Akte|Az\.?|Aktenzeichen|Vorgangs?(?:nummer|nr\.?)?|Geschäftszeichen)[\s/\-:]*(?:Nr\.?[\s/\-:]*)?([A-Z]{0,3}\d{2,4}[\s/\-]\d{3,6})"),
    ("document_reference", True, r"(?:Unser\s+Zeichen|Ihr\s+Zeichen|Zeichen|Ref\.?)[:\s]*([A-Z]{1,3}[\s/\-]?\d{2,4}[\s/\-]?\d{2,6})"),
    ("birthdate", True, r"(?:geb(?:oren|\.)?|geboren am|geburtsdatum|geb\.-datum|\*|birth(?:date)?)\s*[:.]?\s*(\d{1,2}[./]\d{1,2}[./]\d{2,4})"),
    ("tax_id", True, r"(?:steuer[- ]?(?:id|identifikationsnummer|nummer)|tin|steuernummer)\s*[:.]?\s*(\d{11})"),
    ("social_security", True, r"(?:sozialversicherung(?:snummer)?|sv[- ]?nr?\.?|rentenversicherung(?:snummer)?)\s*[:.]?\s*(\d{2}\s?\d{6}\s?[A-Z]\s?\d{3})"),
    ("phone", True, r"(?:tel(?:efon)?|phone|fon|ruf)\s*[:.]?\s*((?:\+49|0049|0)\s*[\d\s/\-]{8,15})"),
    ("fax", True, r"(?:fax|telefax)\s*[:.]?\s*((?:\+49|0049|0)?\s*[\d\s/\-]{8,15})"),
    ("phone_spaced", False, r"\b(\d{4,5})\s+(\d{3})\s*[-–]\s*(\d{4})\b"),
    ("phone_extension", False, r"\s*/\s*-?\s*\d{2,5}\b"),
    ("phone_orphan", False, r"\[PHONE\]\s*/?\s*-?\s*\d{2,5}"),
    ("email", True, r"(?:e[- ]?mail|mail)\s*[:.]?\s*([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"),
    ("address", True, r"([A-ZÄÖÜ][a-zäöüß]+(?:stra(?:ß|ss)e|str\.|weg|platz|allee|gasse|ring|damm|ufer|chaussee|promenade)\s*\d+[a-zA-Z]?)"),
    ("address_no_suffix", True, r"([A-ZÄÖÜ][a-zäöüß-]+)\s+(\d{1,4}\s*[a-zA-Z]?)\s*,\s*(?=\d{5}\s)"),
    ("plz_city", True, r"(\d{5}\s+[A-ZÄÖÜ][a-zäöüß]+(?:\s+[A-ZÄÖÜ][a-zäöüß]+)?)"),
    ("insurance", True, r"(?:Versichert(?:en)?[\-\s]?(?:nummer|nr\.?)?|Vers\.?[\s\-]?Nr\.?|VN|Krankenkasse(?:n)?[\-\s]?(?:nummer|nr\.?)?|KK[\s\-]?(?:Nr\.?)?|Mitglieds?[\-\s]?(?:nummer|nr\.?)?|Kassen[\-\s]?(?:nummer|nr\.?))[:\s\-]*([A-Z]?\d{8,12})"),
    ("insurance_company", True, r"\b(?:AOK|TK|Barmer|DAK|BKK|IKK|KKH|HEK|hkk|Techniker|KNAPPSCHAFT|Viactiv|Mobil\s*Oil|SBK|mhplus|Novitas|Pronova|Big\s*direkt|Audi\s*BKK|BMW\s*BKK|Bosch\s*BKK)\b[^,\n]{0,40}?(?:Nr\.?|Nummer|Versicherten)?[:\s]*([A-Z]?\d{9,12})"),
    ("insurance_standalone", True, r"(?<=,\s)[A-Z]\d{9,10}(?=,|\s|$)"),
    ("insurance_status", True, r",?\s*Status\s+[MPFRK]\b"),
    ("patient_id", True, r"(?:patient(?:en)?[- ]?(?:nr\.?|nummer|id)|fall(?:nummer|nr\.?)|aktenzeichen)\s*[:.]?\s*([A-Z0-9\-]{5,20})"),
    ("case_number", True, r"(?:Fallnummer|Fall[- ]?Nr\.?|Aufnahme[- ]?Nr\.?)\s*[:.]?\s*(\d{8,15})"),
    ("date_standalone", False, r"\b(\d{1,2}\.\d{1,2}\.\d{4})\b"),
    ("named_email_domain", True, r"(?:www\.)?(?:dr[\.\-]|prof[\.\-])?[a-zäöüß]+(?:[\.\-][a-zäöüß]+)*(?:[\.\-](?:praxis|klinik|med|arzt|medizin|zahnarzt|ortho))?\.(?:de|at|ch)\b"),
    ("email_full", True, r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"),
    ("email_split", True, r"[a-zA-ZäöüÄÖÜß0-9]+(?:[.\-_][a-zA-ZäöüÄÖÜß0-9]+)+\s*\n\s*@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("email_local_part", True, r"[a-zA-ZäöüÄÖÜß]+(?:[.\-_][a-zA-ZäöüÄÖÜß]+)+\s*\n?\s*@\[EMAIL_DOMAIN\]"),
    ("company_registration", True, r"\b(HRB|HRA|GnR|PR|VR)\s*\d{3,8}\b"),
    ("bank_location", True, r"\b(Sparkasse|Volksbank|Raiffeisenbank|Commerzbank|Deutsche\s+Bank|Postbank|Hypovereinsbank|Targobank|Santander|ING|DKB|N26|Sparda[-\s]?Bank)\s+[A-ZÄÖÜ][a-zäöüß]+(?:\s+[A-ZÄÖÜ][a-zäöüß]+)?\b"),
    ("iban", True, r"\b[A-Z]{2}\d{2}\s*\d{4}\s*\d{4}\s*\d{4}\s*\d{4}\s*\d{2}\b"),
    ("bic", False, r"\b(?!KEIMZAHL|IMMUNOASSAY|ANTIBIOGRAMM|KULTURBEFUND|ANTIGENNACHWEIS|MOLEKULAR|DIREKTNACHWEIS|RESISTENZ|PATHOLOGIE|HISTOLOGIE|ZYTOLOGIE|SCREENING|DIAGNOSTIK|SEROLOGIE|VIROLOGIE|BAKTERIEN|ERREGERN)[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b"),
    ("hospital_letterhead", True, r"(?:Unternehmensgruppe|Rheinland\s+Klinikum|Lukaskrankenhaus|Universitätsklinikum|Städtisches\s+Klinikum|Kreiskrankenhaus|Marienhospital|St\.\s*[\w\-]+\s*(?:Hospital|Krankenhaus)|Maria\s+Hilf\s+Kliniken?|Bethesda\s+(?:Krankenhaus|Klinik)|[A-ZÄÖÜ][a-zäöüß]+\s+Hilf\s+Kliniken?|Klinikum\s+\w+|Krankenhaus\s+\w+)\b[^.]*?(?:GmbH|gGmbH|AG|e\.V\.)?"),
    ("hospital_management", True, r"(?:Geschäftsführung|Ärztlicher\s+Direktor|Pflegedirektor|Verwaltungsdirektor|Vorstand|Aufsichtsrat)[:\s]*[A-ZÄÖÜ][a-zäöüß]+(?:\s+[A-ZÄÖÜ][a-zäöüß]+)*"),
    ("hospital_department", True, r"(?:Klinik\s+für|Abteilung\s+für|Institut\s+für|Zentrum\s+für)\s+[A-ZÄÖÜ][a-zäöüß]+(?:\s+(?:und|u\.)\s+[A-ZÄÖÜ][a-zäöüß]+)*"),
    ("hospital_with_city", True, r"(?:Maria\s+Hilf\s+Kliniken?|Universitätsklinikum|Städtisches\s+Klinikum|[A-ZÄÖÜ][a-zäöüß]+(?:hospital|klinik|kliniken|krankenhaus))\s+([A-ZÄÖÜ][a-zäöüß]+(?:\s+[A-ZÄÖÜ][a-zäöüß]+)?)"),
]
# The passes for all other languages.
ENGLISH = [
    ("doctor_title_name", False, r"(?:[Dd]r\.?|[Pp]rof\.?|[Pp]rofessor|MD|M\.D\.|PhD|Ph\.D\.|RN|NP|PA|[Aa]ttending|[Rr]esident)\s+([A-Z][a-z]+(?:[\s\-][A-Z][a-z]+)*)"),
    ("honorific_name", True, r"(?:Mr\.?|Mrs\.?|Ms\.?|Miss|Sir|Madam|Dame)\s+([A-Z][a-z]+(?:[\s\-][A-Z][a-z]+)*)"),
    ("labeled_name", False, r"(?:[Pp]atient|[Nn]ame|[Ff]irst\s*[Nn]ame|[Ll]ast\s*[Nn]ame|[Ss]urname|[Ii]nsured|[Pp]olicyholder|[Cc]lient|[Cc]ustomer):\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"),
    ("date_english_month", True, r"\b(?:(\d{1,2})\s+)?(January|February|March|April|May|June|July|August|September|October|November|December)(?:\s+(\d{1,2}))?,?\s+(\d{4})\b"),
    ("birthdate", True, r"(?:born|dob|date of birth|birth(?:date)?)\s*[:.]?\s*(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}|\d{4}[/\-]\d{1,2}[/\-]\d{1,2})"),
    ("ssn", True, r"(?:ssn|social security)\s*[:.]?\s*(\d{3}[- ]?\d{2}[- ]?\d{4})"),
    ("phone", True, r"(?:phone|tel|call)\s*[:.]?\s*((?:\+1|1)?[\s.-]?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4})"),
    ("email", True, r"(?:e[- ]?mail|mail)\s*[:.]?\s*([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"),
    ("email_full", True, r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"),
    ("address", True, r"(\d+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Drive|Dr\.?|Lane|Ln\.?|Boulevard|Blvd\.?|Way|Court|Ct\.?))"),
    ("zipcode", False, r"\b(\d{5}(?:-\d{4})?)\b"),
    ("patient_id", True, r"(?:patient\s*(?:id|number|#)|mrn|medical record)\s*[:.]?\s*([A-Z0-9\-]{5,20})"),
]
# Placeholders by kind; any other kind is its name in capitals and brackets.
PLACEHOLDERS = {
    "doctor_title_name": "[DOCTOR_NAME]", "honorific_name": "[NAME]", "name_comma_format": "[PATIENT_NAME]", "labeled_name": "[PATIENT_NAME]", "doctor_initial_name": "[DOCTOR_NAME]", "name_in_header_block": "[NAME]",
    "date_standalone": "[DATE]", "date_german_month": "[DATE]", "date_english_month": "[DATE]", "case_reference": "[REFERENCE_ID]", "document_reference": "[REFERENCE_ID]", "insurance": "[INSURANCE_ID]",
    "insurance_company": "[INSURANCE_ID]", "insurance_standalone": "[INSURANCE_ID]", "insurance_status": "", "case_number": "[CASE_ID]", "phone_spaced": "[PHONE]", "phone_extension": "", "phone_orphan": "[PHONE]",
    "email_full": "[EMAIL]", "email_split": "[EMAIL]", "email_local_part": "[EMAIL]", "named_email_domain": "[EMAIL_DOMAIN]", "address_no_suffix": "[ADDRESS]", "company_registration": "[COMPANY_ID]",
    "bank_location": "[BANK_INFO]", "hospital_letterhead": "[HOSPITAL_INFO]", "hospital_with_city": "[ORGANIZATION]",
}
# What before a date speaks of a birth, of treatment, or of a letter's head.
BIRTH = [r"geb(?:oren|\.|\s)", r"geburtsdatum", r"geboren\s+am", r"\*\s*$"]
TREATMENT = [
    r"(?:vom|am|bis|seit|ab|nach|vor|zwischen)\s*$", r"(?:vom|am|bis|seit|ab)\s+\d",
    r"(?:ct|mrt|pet|röntgen|sonographie|ultraschall|echo|ekg|op|operation|punktion|untersuchung|kontrolle|wiedervorstellung|therapie|behandlung|aufnahme|entlassung|revision|dilatation|drainage|transfusion|infusion|gastroskopie|koloskopie|bronchoskopie|ögd|ercp|tipss|biopsie|szintigraphie)\s*(?:vom|am)?\s*$",
    r"stationär\s*(?:vom|bis|am)", r"ambulant\s*(?:vom|bis|am)", r"\d{1,2}\.\d{1,2}\.\s*[-–]\s*$", r"(?:abstinent|clean|nüchtern|symptomfrei)\s+seit", r"ed\s+", r"erstdiagnose",
]
HEAD = [r"[a-zäöü]+,\s*$", r"stand:?\s*$", r"datum:?\s*$"]
# Names that mark a letterhead, and where it ends.
HOSPITALS = [
    r"rheinland\s*klinikum", r"lukaskrankenhaus", r"universitätsklinikum", r"städtisches\s*klinikum", r"kreiskrankenhaus", r"marienhospital", r"st\.\s*\w+[-\s]*(?:hospital|krankenhaus)",
    r"klinikum\s+\w+", r"krankenhaus\s+\w+", r"unternehmensgruppe", r"medizinisches\s+zentrum", r"kliniken\s+\w+",
]
LETTERHEAD_ENDS = [r"\n\s*[-─═]{3,}\s*\n", r"\n\s*\n\s*(?:Sehr geehrte|Betr(?:eff|\.)|Patient|Diagnose)", r"\n\s*\n\s*\n"]
# Units behind a number that make it a measure.
UNITS = [
    "hz", "khz", "mhz", "ghz", "mmhg", "cmh2o", "kpa", "pa", "mg", "µg", "ng", "pg", "g", "kg", "ml", "µl", "dl", "l", "mm", "cm", "m", "µm", "nm", "mmol", "µmol", "mol", "u", "iu", "ie", "mv", "µv", "v", "ma", "µa", "a",
    "bq", "mbq", "gbq", "gy", "mgy", "bpm", "/min", "pg/ml", "ng/ml", "µg/ml", "mg/dl", "mmol/l", "g/dl", "u/l", "iu/l", "%", "‰", "jahre", "years", "j",
]
# Units of a reference range, and words before a laboratory value.
RANGE_UNITS = [
    "g/l", "mg/l", "µg/l", "ng/l", "pg/l", "g/dl", "mg/dl", "µg/dl", "ng/dl", "pg/dl", "mmol/l", "µmol/l", "nmol/l", "pmol/l", "u/l", "iu/l", "mu/l", "ml", "µl", "nl", "pl", "%", "‰", "10^3/µl", "10^6/µl", "10^9/l",
    "10^12/l", "/µl", "/ml", "/l",
]
LAB_WORDS = [
    "haptoglobin", "haptogobin", "ferritin", "transferrin", "albumin", "hämoglobin", "hemoglobin", "hämatokrit", "hematocrit", "kreatinin", "creatinine", "bilirubin", "glucose", "glukose", "cholesterin", "triglyceride",
    "eisen", "iron", "kupfer", "copper", "calcium", "kalium", "natrium", "magnesium", "phosphat", "leukozyten", "erythrozyten", "thrombozyten", "quick", "inr", "ptt", "aptt", "tsh", "ft3", "ft4", "t3", "t4", "crp", "bsg",
    "ldh", "ggt", "got", "gpt", "ast", "alt",
]
# Medical words that a redaction should keep, and the share that must stay.
KEYWORDS = [
    "diagnose", "befund", "labor", "medikament", "therapie", "mg", "ml", "mmol", "icd", "ops", "untersuchung", "hämoglobin", "leukozyten", "erythrozyten", "thrombozyten", "glucose", "kreatinin", "cholesterin",
]
OLD_DATE = r"\b[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19[2-9][0-9]|200[0-9]|2010)\b"
DATED = ("date_standalone", "date_german_month", "date_english_month")


_MONTHS = ["januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember", "january", "february", "march", "may", "june", "july", "october", "december"]
#: Of a kind: whether a match holds a digit, and what of which it holds one piece: lower case where case matters not. A
#: text without is not searched; kinds that are missing always are. Languages that share a kind share its pieces.
NEEDS: dict[str, tuple[bool, list[str]]] = {
    "doctor_title_name": (False, ["Dr", "dr", "Prof", "prof", "Dipl", "dipl", "OA", "CA", "FA", "berarzt", "berärztin", "hefarzt", "hefärztin", "acharzt", "achärztin", "MD", "M.D.", "PhD", "Ph.D.", "RN", "NP", "PA", "ttending", "esident"]),
    "name_comma_format": (False, ["patient", "name", "versicherte"]), "labeled_name": (False, [":"]), "name_in_header_block": (False, [","]), "doctor_initial_name": (False, ["."]), "date_german_month": (True, _MONTHS), "date_english_month": (True, _MONTHS),
    "case_reference": (True, ["ds", "dossier", "fall", "akte", "az", "vorgang", "geschäftszeichen"]), "document_reference": (True, ["zeichen", "ref"]), "birthdate": (True, ["geb", "*", "birth", "born", "dob"]), "tax_id": (True, ["steuer", "tin"]),
    "social_security": (True, ["versicherung", "sv"]), "ssn": (True, ["ssn", "social security"]), "phone": (True, ["tel", "phone", "fon", "ruf", "call"]), "fax": (False, ["fax"]), "phone_spaced": (True, []), "phone_extension": (True, ["/"]), "phone_orphan": (True, ["[PHONE]"]),
    "email": (False, ["@"]), "address": (True, []), "address_no_suffix": (True, [","]), "plz_city": (True, []), "zipcode": (True, []), "insurance": (True, ["vers", "vn", "krankenkasse", "kk", "mitglied", "kassen"]), "insurance_company": (True, []), "insurance_standalone": (True, [","]),
    "insurance_status": (False, ["status"]), "patient_id": (False, ["patient", "fall", "aktenzeichen", "mrn", "medical record"]), "case_number": (True, ["fall", "aufnahme"]), "date_standalone": (True, ["."]), "named_email_domain": (False, [".de", ".at", ".ch"]), "email_full": (False, ["@"]),
    "email_split": (False, ["@"]), "email_local_part": (False, ["@[email_domain]"]), "company_registration": (True, ["hrb", "hra", "gnr", "pr", "vr"]),
    "bank_location": (False, ["sparkasse", "bank", "santander", "ing", "dkb", "n26"]), "iban": (True, []),
    "hospital_letterhead": (False, ["unternehmensgruppe", "klini", "krankenhaus", "hospital"]), "hospital_management": (False, ["geschäftsführung", "direktor", "vorstand", "aufsichtsrat"]), "hospital_department": (False, ["klinik", "abteilung", "institut", "zentrum"]), "hospital_with_city": (False, ["klini", "krankenhaus", "hospital"]),
}


#: Letters of other code points that match without case.
_ODD = {"s": "ſ", "i": "ıİ", "k": "\u212a"}


def entered(first: str, second: str, ignore_case: bool = True) -> str:
    """A look ahead at the first two characters that a match can have (lower case where case matters not): a position is left
    after one cheap test, and what is found is the same."""
    cases = lambda xs: "".join(dict.fromkeys(x for c in xs for x in (c, c.upper(), *_ODD.get(c, "")))) if ignore_case else xs
    return "(?=" + "".join(f"(?-i:[{cases(xs)}])" for xs in (first, second) if xs) + ")"


#: By language and kind what the first two characters of all matches are among.
ENTRIES = {
    "de": {
        "doctor_title_name": ("DdPpOoCcFf", "riAbha"), "honorific_name": ("HhFf", "er"), "name_comma_format": ("pnv", "ae"), "labeled_name": ("PpVvAaEe", "aeuinmb"), "case_reference": ("dfavg", "soakze"), "document_reference": ("uizr", "nhe"),
        "birthdate": ("g*b", ""), "tax_id": ("st", "ti"), "social_security": ("sr", "ove"), "phone": ("tpfr", "ehou"), "fax": ("ft", "ae"), "insurance": ("vkm", "enrkia"), "insurance_company": ("atbdikhvmsnp", "okaenibhrum"),
        "patient_id": ("pfa", "ak"), "case_number": ("fa", "au"), "bank_location": ("svrcdphtin", "poaeynk2"),
    },
    "en": {
        "doctor_title_name": ("DdPpMRNAar", "rD.hNPAte"), "honorific_name": ("msd", "rsia"), "labeled_name": ("PpNnFfLlSsIiCc", "aiunol"), "birthdate": ("bd", "oai"), "ssn": ("s", "so"), "phone": ("ptc", "hea"), "patient_id": ("pm", "are"),
    },
}
# a run of letters is entered at its first one or behind a match only: what a later letter leads to, an earlier one leads to as well
_RUN = r"(?:\G|(?<!(?-i:[A-ZÄÖÜa-zäöüſıİ\u212a])))"
#: The same matches by other means: of a German kind, what goes before its expression.
BEFORE = {"address": _RUN + r"(?=\p{L}++\.?\s*+\d)", "address_no_suffix": _RUN, "doctor_initial_name": r"(?=[A-Z]\.)", "bic": r"(?=[A-Z]{4})"}


def quick(language: str, kind: str, ignore_case: bool, text: str) -> str:
    """An expression of a kind with the same matches that leaves most positions early."""
    if kind in ENTRIES[language]:
        return entered(*ENTRIES[language][kind], ignore_case) + text
    return (BEFORE.get(kind, "") if language == "de" else "") + text


def folded(text: Column) -> Column:
    """The text in lower case, and so that letters which match each other without case are equal."""
    odd = F.contains(text, F.lit("ſ")) | F.contains(text, F.lit("ı")) | F.contains(text, F.lit("İ"))
    return F.when(odd, F.lower(F.translate(text, "ſıİ", "sii"))).otherwise(F.lower(text))


#: Where German asks for more than the shared pieces.
GERMAN_NEEDS = {"address": (True, ["straße", "strasse", "str.", "weg", "platz", "allee", "gasse", "ring", "damm", "ufer", "chaussee", "promenade"])}


def may_match(kind: str, language: str, ignore_case: bool, text: Column, low: Column, has_digit: Column) -> Column:
    """Whether a text, folded in `low`, holds what every match of a kind holds."""
    needs = {**NEEDS, **GERMAN_NEEDS} if language == "de" else NEEDS
    digit, pieces = needs.get(kind, (False, []))
    some = F.lit(True)
    if pieces:
        some = reduce(lambda x, y: x | y, [F.contains(low if ignore_case else text, F.lit(piece)) for piece in pieces])
    if kind == "name_in_header_block":
        # what it ends with
        some = some & (F.contains(low, F.lit("status")) | text.rlike(r"(?U),\s*$"))
    return has_digit & some if digit else some


def passes(language: str) -> list[tuple[str, bool, str]]:
    """German for de, English for any other language."""
    return GERMAN if language == "de" else ENGLISH


def placeholder(kind: str) -> str:
    return PLACEHOLDERS.get(kind, f"[{kind.upper()}]")


def pattern(ignore_case: bool, text: str) -> str:
    return ("(?iU)" if ignore_case else "(?U)") + text


def keeps_date(before: Column, start: Column) -> Column:
    """Whether a date stays, by the lower-case 80 characters before it and its place: births go, treatment stays, dates
    of a letter's head go, others stay."""
    any_of = lambda xs: before.rlike("(?U)" + "|".join(f"(?:{x})" for x in xs))
    return F.when(any_of(BIRTH), False).when(any_of(TREATMENT), True).when((start < 500) & any_of(HEAD), False).otherwise(True)


def _dates(text: Column, expression: str) -> Column:
    """struct<out, gone, kept> of one date pass."""
    pairs = F.zip_with(F.split(text, expression, -1), F.regexp_extract_all(text, F.lit(expression), F.lit(0)), lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))

    def step(acc, p):
        start = acc["at"] + F.length(p["gap"])
        before = F.lower(F.substr(text, F.greatest(start - 80, F.lit(0)) + 1, F.least(start, F.lit(80))))
        stays = keeps_date(before, start)
        return F.when(p["match"].isNull(), F.struct(acc["at"].alias("at"), F.concat(acc["out"], p["gap"]).alias("out"), acc["gone"].alias("gone"), acc["kept"].alias("kept"))).otherwise(
            F.struct(
                (start + F.length(p["match"])).alias("at"), F.concat(acc["out"], p["gap"], F.when(stays, p["match"]).otherwise("[DATE]")).alias("out"),
                (acc["gone"] + F.when(stays, 0).otherwise(1)).alias("gone"), (acc["kept"] + F.when(stays, 1).otherwise(0)).alias("kept"),
            )
        )

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(0).alias("gone"), F.lit(0).alias("kept")), step)


def without_letterhead(df: DataFrame, text: str) -> DataFrame:
    """Adds `letterhead_removed`, how many of the names the head held, and replaces the head of a text of 100 characters or more."""
    low = F.lower(F.substring(text, 1, 800))
    named = low.rlike("(?U)" + "|".join(f"(?:{h})" for h in HOSPITALS))
    ends = [F.regexp_instr(F.substring(text, 1, 1000), F.lit("(?iU)" + e)) - 1 for e in LETTERHEAD_ENDS]
    end = F.when(ends[0] >= 0, ends[0]).when(ends[1] >= 0, ends[1]).when(ends[2] >= 0, ends[2]).otherwise(0)
    df = df.withColumn("_end", F.when((F.length(text) >= 100) & named, end).otherwise(0))
    head = F.lower(F.substring(F.col(text), F.lit(1), F.col("_end")))
    items = sum((head.rlike("(?U)" + h).cast("int") for h in HOSPITALS), F.lit(0))
    df = df.withColumn("letterhead_removed", F.when(F.col("_end") > 0, items).otherwise(0))
    rest = F.regexp_replace(F.substr(text, F.col("_end") + 1), r"(?U)^\s+", "")
    return df.withColumn(text, F.when(F.col("letterhead_removed") > 0, F.concat(F.lit("[HOSPITAL_LETTERHEAD]\n"), rest)).otherwise(F.col(text))).drop("_end")


def removed(df: DataFrame, language: str = "de", column: str = "text") -> DataFrame:
    """Adds `redacted`, `removals`, `dates_kept`, `kinds` (joined, in order), `letterhead_removed`, `fixes`, `suspicious`
    (placeholders before a unit) and `error` (true for blank texts, which stay as they are)."""
    from vellum.functions.redaction import cleaned, fixes

    out = without_letterhead(df.withColumn("_t", F.coalesce(F.col(column), F.lit(""))), "_t").withColumns({"_n": F.lit(0), "_kept": F.lit(0), "_kinds": F.lit("")})
    # placeholders hold no digit, so one look tells for all passes
    out = out.withColumns({"_digit": F.col("_t").rlike(r"\p{Nd}"), "_low": folded(F.col("_t"))})
    for kind, ignore_case, text in passes(language):
        expression = pattern(ignore_case, quick("de" if language == "de" else "en", kind, ignore_case, text))
        some = may_match(kind, language, ignore_case, F.col("_t"), F.col("_low"), F.col("_digit"))
        if kind in DATED:
            as_it_is = F.struct(F.lit(0).alias("at"), F.col("_t").alias("out"), F.lit(0).alias("gone"), F.lit(0).alias("kept"))
            out = out.withColumn("_d", F.when(some, _dates(F.col("_t"), expression)).otherwise(as_it_is)).withColumn("_new", F.col("_d.out"))
            out = out.withColumns({"_m": F.col("_d.gone"), "_kept": F.col("_kept") + F.col("_d.kept")})
        else:
            out = out.withColumn("_new", F.when(some, F.regexp_replace("_t", expression, placeholder(kind))).otherwise(F.col("_t")))
            out = out.withColumn("_m", F.when(F.col("_new") == F.col("_t"), 0).otherwise(F.regexp_count("_t", F.lit(expression))))
        # the folded text is kept, and made anew only where the text has changed
        out = out.withColumns({"_low": F.when(F.col("_new") == F.col("_t"), F.col("_low")).otherwise(folded(F.col("_new"))), "_t": F.col("_new")})
        out = out.withColumns({"_n": F.col("_n") + F.col("_m"), "_kinds": F.when(F.col("_m") > 0, F.concat("_kinds", F.lit(kind + ","))).otherwise(F.col("_kinds"))})
    out = out.withColumn("redacted", cleaned(F.col("_t")))
    units = "|".join(sorted((u for u in UNITS if u[0] not in "%‰/"), key=len, reverse=True))
    return out.withColumns(
        {
            "removals": F.col("_n"), "dates_kept": F.col("_kept"), "kinds": F.rtrim(F.col("_kinds"), F.lit(",")), "fixes": fixes(F.col("_t"), F.col("redacted")),
            "suspicious": F.regexp_count("redacted", F.lit(rf"(?i)\[(?:PHONE|FAX|INSURANCE_ID|PATIENT_ID|REFERENCE_ID)\][\s\-/]*(?:{units}|%|‰)")), "error": F.trim(F.coalesce(column, F.lit(""))) == "",
        }
    ).drop("_t", "_n", "_kept", "_kinds", "_m", "_d", "_new", "_digit", "_low")


def with_contexts(df: DataFrame, column: str, expression: str, reach: int, least: int) -> DataFrame:
    """df with `found`: array<struct<before, match, after>>, the matches with `reach` characters on either side, other matches among them.

    `least` is how many characters a match and the gap behind it have together at least: so many pieces make up a side. Pieces
    are looked up by place and clipped, so the cost grows with the matches, not with their offsets."""
    df = df.withColumns({"_gaps": F.split(column, expression, -1), "_found": F.regexp_extract_all(column, F.lit(expression), F.lit(0))})
    steps = range(-(-reach // least) + 1)

    def sides(match, i):
        gap = lambda j: F.get("_gaps", j)
        after = F.concat_ws("", *[x for k in steps for x in (F.left(gap(i + 1 + k), F.lit(reach)), F.get("_found", i + 1 + k))])
        before = F.concat_ws("", *[x for k in reversed(steps) for x in (F.get("_found", i - 1 - k), F.right(gap(i - k), F.lit(reach)))])
        return F.struct(F.right(before, F.lit(reach)).alias("before"), match.alias("match"), F.left(after, F.lit(reach)).alias("after"))

    return df.withColumn("found", F.transform("_found", sides)).drop("_gaps", "_found")


def is_measure(after: Column) -> Column:
    """Whether the 15 characters behind a number begin with a unit, a hyphen before it allowed."""
    low = F.lower(F.trim(F.substring(after, 1, 15)))
    return F.exists(F.array(*[F.lit(u) for u in UNITS]), lambda u: low.startswith(u) | low.startswith(F.concat(F.lit("-"), u)))


def is_lab_range(before: Column, after: Column) -> Column:
    """Whether dotted numbers are a range: an open bracket before and a unit behind, or a laboratory word before, within 30 characters."""
    low = F.lower(F.trim(after))
    bracket = F.contains(before, F.lit("(")) & F.exists(F.array(*[F.lit(u) for u in RANGE_UNITS]), lambda u: low.startswith(u))
    return bracket | F.exists(F.array(*[F.lit(w) for w in LAB_WORDS]), lambda w: F.contains(F.lower(before), w))


def preserved(original: Column, clean: Column) -> Column:
    """Whether at least 80 % of the medical words of a text are still there."""
    count = lambda t: bound(F.lower(t), lambda low: sum((F.contains(low, F.lit(k)).cast("int") for k in KEYWORDS), F.lit(0)))
    counts = F.struct(count(original).alias("all"), count(clean).alias("left"))
    return bound(counts, lambda n: F.when(n["all"] > 0, n["left"] / n["all"] >= 0.8).otherwise(True))


def without_old_dates(text: Column) -> Column:
    return F.regexp_replace(text, OLD_DATE, "[DATUM ENTFERNT]")


# What a client does to a text that a removal service gave back, in order; flags, expression, what stands in its place.
POST_PASSES = [
    ("i", r"[a-zA-ZäöüÄÖÜß]+(?:[.\-_][a-zA-ZäöüÄÖÜß]+)+\s*\n?\s*@\[EMAIL_DOMAIN\]", "[EMAIL]"), ("i", r"[a-zA-ZäöüÄÖÜß]+(?:[.\-_][a-zA-ZäöüÄÖÜß]+)+\s*\n\s*@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL]"),
    ("i", r"[a-zA-ZäöüÄÖÜß]+(?:[.\-_][a-zA-ZäöüÄÖÜß]+)+\s*@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL]"), ("", r"\b[A-Z]\d{9,10}\b", "[INSURANCE_ID]"), ("i", r",?\s*Status\s+[A-Z]\b", ""), ("", r"\s*/\s*-?\s*\d{2,5}\b", ""),
    ("", r"\[PHONE\]\s*/?\s*-?\s*\d{2,5}", "[PHONE]"), ("i", r"Fallnummer:?\s*\d{8,12}", "Fallnummer: [CASE_ID]"), ("", r"/[A-ZÄÖÜ][a-zäöüß]+(?=,|\s|$)", ""), ("i", r"([A-ZÄÖÜ][a-zäöüß-]+)\s+(\d{1,4}\s*[a-zA-Z]?)\s*,\s*(?=\d{5}\s|\[PLZ)", "[ADDRESS], "),
    ("i", r"\(\[IP_ADDRESS\]\s*(g/l|mg/dl|mmol/l|µmol/l|u/l|iu/l|%|/µl|/ml)\)", "([REF_RANGE] $1)"),
]
#: What a text must hold for a pass to find anything, by place; null: nothing in particular.
POST_NEEDS = ["@", "@", "@", None, "tatus", "/", "[PHONE]", "allnummer", "/", ",", "[IP_ADDRESS]"]


def post_processed(df: DataFrame, column: str) -> DataFrame:
    """df with the column run through the client's passes."""
    for (flags, expression, instead), needs in zip(POST_PASSES, POST_NEEDS, strict=True):
        after = F.regexp_replace(column, f"(?{flags}U){expression}", instead)
        some = F.contains(F.translate(F.lower(column), "ſ", "s"), F.lit(needs.lower())) if needs else None
        df = df.withColumn(column, after if some is None else F.when(some, after).otherwise(F.col(column)))
    return df
