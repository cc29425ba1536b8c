"""Removing personal data without a model: protect, ordered passes, names by their shape, restore, tidy, validate, score.

Protection is reversible: what a letter must keep (vitamins, codes, laboratory values, abbreviations, drugs) leaves the text for
a ledger, in order, and a sentinel with its number stays: private-use characters, digits included, that no later pass can
read. Restoring puts every entry back at its number, so a text from which nothing is removed comes back byte for byte, and
removals between entries never shift them. Sentinel characters that the text itself holds are protected like the rest.

All of it is column expressions over one row: no shuffle, each pass compiled once and run only on texts that hold a
literal it needs. Term lists go into hashed sets of literals; they are bounded by `MOST_TERMS`, larger
dictionaries are joined (operators/terms.py).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import terms as T
from vellum.functions.privacy import entered, folded

MOST_TERMS = 5_000
OPEN, CLOSE, DIGITS = "", "", ""
MARK = "\ue7ff"

# Abbreviations that stay, whatever their case.
ABBREVIATIONS = [
    "BMI", "EKG", "MRT", "CT", "ICD", "OPS", "DRG", "GOÄ", "EBM", "PET", "SPECT", "EF", "LAD", "RCA", "RCX", "RIVA", "CK", "CK-MB", "HDL", "LDL", "VLDL", "BNP", "NT-proBNP", "ANP", "AVK", "KHK", "NYHA", "TAVI", "PCI", "CABG",
    "TSH", "fT3", "fT4", "T3", "T4", "TPO", "TRAK", "TG", "TAK", "MAK", "ACTH", "ADH", "FSH", "LH", "HCG", "PTH", "STH", "GH", "IGF-1", "DHEA-S", "HbA1c", "HOMA", "OGTT", "BZ", "C-Peptid", "INR", "PTT", "aPTT", "AT3", "Quick",
    "CRP", "PCT", "BSG", "IL-6", "TNF", "AFP", "CEA", "CA19-9", "CA125", "CA15-3", "PSA", "fPSA", "NSE", "SCC", "S100", "GFR", "eGFR", "GPT", "GOT", "GGT", "AP", "ALP", "LDH", "MCH", "MCV", "MCHC", "RDW", "MPV", "PLT", "WBC", "RBC", "HGB", "HCT",
    "IgG", "IgM", "IgA", "IgE", "ANA", "ANCA", "RF", "CCP", "ENA", "AST", "ALT", "CHE", "CKD-EPI", "MDRD", "ACR", "PCR", "BUN", "Na", "Ca", "Mg", "Fe", "Zn", "Cu", "pO2", "pCO2", "pH", "HCO3", "SaO2", "SpO2", "COPD", "ARDS", "SIRS", "DIC", "HIT", "TTP", "HUS",
]
# Vitamins, laboratory names of vitamin D, diagnosis, procedure and laboratory codes.
CODES = [
    r"(?i:(?:Vitamin|Vit\.?)\s*(?:[A-Z][0-9]*|[0-9]+[-,]?[0-9]*-?OH-?[A-Z]?[0-9]*))\b", r"(?i:[0-9]+[,.]?[0-9]*-?OH[0-9]*-?[A-Z]?[0-9]*)\b", r"[A-Z]\d{2}(?:\.\d{1,2})?\b", r"\d-\d{3}(?:\.\d{1,2})?\b", r"\d{1,7}-\d\b",
]
# The passes in order: type, flags beside (?U), expression, what stands in its place; and literals of which a match holds one (lower case).
PASSES = [
    ("birthdate", "i", r"\b(?:geb(?:oren)?\.?:?\s*(?:am\s*)?|geboren\s+am\s+|geburtsdatum:?\s*)(?:\d{1,2}[\.\/-]\d{1,2}[\.\/-]\d{2,4}|\d{4}[\.\/-]\d{1,2}[\.\/-]\d{1,2})", "[GEBURTSDATUM ENTFERNT]", ["geb"]),
    ("insurance_number", "i", r"\b(?:versicherungs?|versichert\w*|kassen|patienten\w*|fall|akte)[\-\s]*(?:nr\.?|nummer)?[:\s]*[A-Z0-9][\w\-\/]*\b", "[NUMMER ENTFERNT]", ["versicher", "kassen", "patienten", "fall", "akte"]),
    ("patient_name", "i", r"\b(?:patient(?:in)?|name|versicherte[rn]?|nachname|vorname)[:\s]*([A-ZÄÖÜ][a-zäöüß]+(?:[\s,]+[A-ZÄÖÜ][a-zäöüß]+)*)", "[NAME ENTFERNT]", ["patient", "name", "versicherte"]),
    ("patient_name", "i", r"\b(?:patient|name)[:\s]+([A-ZÄÖÜ][a-zäöüß]+)\s*,\s*([A-ZÄÖÜ][a-zäöüß]+)", "[NAME ENTFERNT]", ["patient", "name"]),
    ("street_address", "i", r"\b[A-ZÄÖÜ][a-zäöüß]+(?:straße|str\.?|weg|allee|platz|ring|gasse|damm)\s+\d+[a-z]?\b", "[ADRESSE ENTFERNT]", ["str", "weg", "allee", "platz", "ring", "gasse", "damm"]),
    ("postal_code_city", "", r"\b\d{5}\s+[A-ZÄÖÜ][a-zäöüß]+(?:\s+[A-ZÄÖÜ][a-zäöüß]+)*\b", "[PLZ/ORT ENTFERNT]", []),
    ("phone_number", "", r"(?:^|\s)(?:(?:\+49|0049)\s*\d+(?:[\s\-\(\)\/]\d+)*|0\d{2,}(?:[\s\-\(\)\/]\d+)*)", "[TELEFON ENTFERNT]", ["+49", "0"]),
    ("email_address", "", r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", "[EMAIL ENTFERNT]", ["@"]),
    ("salutation", "im", r"^(?:sehr\s+geehrte[rns]?\s+.*?[,!]|(?:mit\s+)?(?:freundlichen|besten|herzlichen)\s+grüßen.*?$|hochachtungsvoll.*?$)", "", ["geehrte", "grüßen", "hochachtungsvoll"]),
    ("tax_id", "i", r"\b(?:steuer[-\s]?(?:id|identifikations?nummer)|steuernummer|st\.?[-\s]?nr\.?)[:\s]*\d{2}[\s\-]?\d{3}[\s\-]?\d{3}[\s\-]?\d{3}\b", "[STEUER-ID ENTFERNT]", ["steuer", "st"]),
    ("social_security_number", "i", r"\b(?:sozial[-\s]?versicherungs?nummer|renten[-\s]?versicherungs?nummer|sv[-\s]?nummer|rvn)[:\s]*\d{2}[\s\-]?\d{6}[\s\-]?[A-Z][\s\-]?\d{3}\b", "[SOZIALVERSICHERUNGSNUMMER ENTFERNT]", ["versicherung", "sv", "rvn"]),
    ("passport_number", "i", r"\b(?:reisepass|pass|passport)[\-\s]*(?:nr\.?|nummer)?[:\s]*C[\s\-]?[A-Z0-9]{8}\b", "[REISEPASSNUMMER ENTFERNT]", ["pass"]),
    ("id_card_number", "i", r"\b(?:personal?ausweis|ausweis|perso)[\-\s]*(?:nr\.?|nummer)?[:\s]*(?:[A-Z][\s\-]?[A-Z0-9]{8}|\d{10})\b", "[PERSONALAUSWEIS ENTFERNT]", ["ausweis", "perso"]),
    ("patient_id", "i", r"\b(?:patienten?[-\s]?(?:id|nr|nummer|kennzeichen)|fall[-\s]?(?:nr|nummer)|akten[-\s]?(?:nr|nummer|zeichen)|krankenakte)[:\s]*[\dA-Z][\dA-Z\-\/]*\b", "[PATIENTEN-ID ENTFERNT]", ["patient", "fall", "akte"]),
    ("hospital_id", "i", r"\b(?:behandlungs?|aufnahme|station|bett)[\-\s]*(?:nr|nummer)[:\s]*[\dA-Z][\dA-Z\-\/]*\b", "[KRANKENHAUS-NR ENTFERNT]", ["nr", "nummer"]),
    ("insurance_policy", "i", r"\b(?:versicherten|kranken?kassen?)[\-\s]*nummer[:\s]*[A-Z]?\d{9,12}\b", "[VERSICHERTENNUMMER ENTFERNT]", ["nummer"]),
    ("mobile_phone", "i", r"\b(?:mobil|handy|tel\.?|telefon)[:\s]*(?:(?:\+49|0049)[\s\-]?(?:15|16|17)\d[\s\-]?\d+|0(?:15|16|17)\d[\s\-]?\d+)\b", "[MOBILTELEFON ENTFERNT]", ["mobil", "handy", "tel"]),
    ("fax_number", "i", r"\b(?:fax|telefax)[:\s]*(?:(?:\+49|0049)\s*\d+(?:[\s\-\(\)\/]\d+)*|0\d{2,}(?:[\s\-\(\)\/]\d+)*)", "[FAX ENTFERNT]", ["fax"]),
    ("url", "i", r"\b(?:https?://|www\.)[a-zA-Z0-9\-\.]+\.[a-zA-Z]{2,}(?:/[^\s]*)?\b", "[URL ENTFERNT]", ["http", "www."]),
    ("street_address_extended", "i", r"\b[A-ZÄÖÜ][a-zäöüß]+(?:straße|str\.?|weg|allee|platz|ring|gasse|damm|pfad|steig)\s+\d+[-/]?\d*[a-z]?(?:\s+(?:Etage|Stock|OG|EG)\s+\d+)?\b", "[ADRESSE ENTFERNT]", ["str", "weg", "allee", "platz", "ring", "gasse", "damm", "pfad", "steig"]),
    ("gender", "i", r"\b(?:geschlecht)[:\s]*(?:männlich|weiblich|divers|m|w|d)\b", "[GESCHLECHT ENTFERNT]", ["geschlecht"]),
]
#: The pass before which the folded text is made again for all removals so far; later ones, which are few, make it at once.
FRESH = 9
#: By kind what the first two characters of all matches are among: the same matches, but most positions are left at once. In a street a
#: word of letters, a point perhaps, is before white space and a digit.
_STREET = r"(?<!(?-i:[A-Za-z0-9_]))(?=\p{L}++\.?\s++\d)"
#: What the folded text of any street holds, also where it was folded before other removals: these end with a bracket.
NUMBERED = r"(?U)(?=[swaprgd][tealifrd])(?:str(?:aße|\.)?|weg|allee|platz|ring|gasse|damm|pfad|steig)\s+\d"
ENTRIES = {
    "birthdate": ("g", "e"), "insurance_number": ("vkpfa", "eak"), "patient_name": ("pnv", "aeo"), "tax_id": ("s", "t"), "social_security_number": ("sr", "oev"), "passport_number": ("rp", "ea"), "id_card_number": ("pa", "eu"),
    "patient_id": ("pfak", "akr"), "hospital_id": ("bas", "eut"), "insurance_policy": ("vk", "er"), "mobile_phone": ("mht", "oae"), "fax_number": ("ft", "ae"), "url": ("hw", "tw"), "gender": ("g", "e"),
}
#: By kind a second list of literals (lower case) of which all matches hold one as well.
ALSO = {
    "tax_id": ["steuer", "nr"], "patient_id": ["patiente", "fall", "akte"], "hospital_id": ["behandlung", "aufnahme", "station", "bett"], "insurance_policy": ["versicherten", "kranke"],
    "mobile_phone": ["+49", "0049", "015", "016", "017"],
}
# Names by title, lines that a title leads, and what before a date speaks of a birth or of treatment.
TITLED = r"\b(?:Dr\.?|Prof\.?)\s+(?:med\.?\s+|Dr\.?\s+)?[A-ZÄÖÜ][a-zäöüß]+\b"
LED = r"^\s*(?:Dr\.?|Prof\.?|Herr|Frau)\s+[A-ZÄÖÜ]"
BIRTH = ["geb.", "geboren", "geburtsdatum", "geb:", "* ", "*datum"]
TREATMENT = ["untersuchung", "labor", "befund", "datum", "op-datum", "op datum", "operation", "aufnahme", "entlassung", "kontrolle", "termin", "vom", "am"]
# What a cleaned letter holds at least one of.
INDICATORS = [
    "diagnose", "befund", "therapie", "medikament", "behandlung", "untersuchung", "labor", "patient", "klinik", "arzt", "mg", "ml", "mg/dl", "mmol", "g/dl", "wert", "ergebnis", "normal", "erhöht", "erniedrigt", "mrt", "ct", "ekg", "röntgen",
    "[name entfernt]", "[geburtsdatum entfernt]", "[adresse entfernt]",
]
#: Runs of two or three capitalised words on a line.
RUN = rf"(?U)(?=[A-ZÄÖÜ])\b{T.NAME_WORD}(?:[^\S\n]+{T.NAME_WORD}){{1,2}}\b"


def _escaped(word: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in word)


#: Beginnings of words that are tried one after another.
FORK = 5


def _any_of(words) -> str:
    """An expression of words that shares their beginnings, the longest first: a position is left after one character in most cases."""
    tree: dict = {}
    for word in words:
        node = tree
        for c in word.lower():
            node = node.setdefault(c, {})
        node[""] = {}

    def text(node: dict) -> str:
        found = {c: _escaped(c) + text(below) for c, below in sorted(node.items()) if c}
        rest, letters = list(found.values()), "".join(found)
        if not rest:
            return ""
        if len(rest) > FORK and letters.isalnum():
            # words that begin alike are asked for together, not one after another
            rest = [f"{entered(letters[i : i + FORK], '')}(?:{'|'.join(rest[i : i + FORK])})" for i in range(0, len(rest), FORK)]
        body = rest[0] if len(rest) == 1 and "" not in node else f"(?:{'|'.join(rest)})"
        return body + "?" if "" in node else body

    return text(tree)


def protection(terms: Sequence[str] = (*T.TERMS, *T.DRUGS)) -> str:
    """The expression of all that is protected, first alternatives first: codes, a term with its number, abbreviations, drugs and sentinel characters."""
    if len(terms) > MOST_TERMS:
        raise ValueError("join larger dictionaries: operators/terms.py")
    valued = rf"(?i:(?:{_any_of(w for w in terms if len(w) > 3)})\s*:?\s*[0-9]+[,.]?[0-9]*\s*[a-zA-Z/%]*)\b"
    alone = rf"(?i:{_any_of([*ABBREVIATIONS, *(d for d in T.DRUGS if len(d) > 3)])})\b"
    # one range first: a class of twelve characters is twelve tests a position
    return rf"(?U)(?=[{OPEN}-{DIGITS[-1]}])[{OPEN}{CLOSE}{DIGITS}]|(?<![A-Za-z0-9_])\b(?:{'|'.join([*CODES, valued, alone])})"


def turns(text: Column, expression: str) -> Column:
    """What stands between the matches and the matches by turns, from one search; a text that holds the mark itself is searched twice."""
    marked = F.split(F.regexp_replace(text, expression, f"{MARK}$0{MARK}"), MARK, -1)
    gaps, found = F.split(text, expression, -1), F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    searched = F.flatten(F.zip_with(gaps, found, lambda gap, match: F.when(match.isNotNull(), F.array(gap, match)).otherwise(F.array(gap))))
    return F.when(F.contains(text, F.lit(MARK)), searched).otherwise(marked)


def protected(df: DataFrame, column: str, expression: str | None = None) -> DataFrame:
    """df with `masked` (sentinels for what is protected) and `ledger` (that, in order)."""
    out = df.withColumn("_pieces", turns(F.coalesce(column, F.lit("")), expression or protection()))
    sentinel = lambda i: F.concat(F.lit(OPEN), F.translate(((i + 1) / 2).cast("int").cast("string"), "0123456789", DIGITS), F.lit(CLOSE))
    masked = F.array_join(F.transform("_pieces", lambda piece, i: F.when(i % 2 == 1, sentinel(i)).otherwise(piece)), "")
    return out.withColumns({"ledger": F.filter("_pieces", lambda piece, i: i % 2 == 1), "masked": masked}).drop("_pieces")


def restored(masked: Column, ledger: Column) -> Column:
    """The masked text with every sentinel's entry in its place."""
    mark = f"{OPEN}([{DIGITS}]+){CLOSE}"
    numbers = F.transform(F.regexp_extract_all(masked, F.lit(mark), F.lit(1)), lambda d: F.translate(d, DIGITS, "0123456789").cast("int"))
    pieces = F.zip_with(F.split(masked, mark, -1), F.concat(F.array(F.lit(0)), numbers), lambda gap, i: F.when(i > 0, F.concat(F.get(ledger, i - 1), gap)).otherwise(gap))
    return F.array_join(pieces, "")


def expression_of(flags: str, pattern: str) -> str:
    """A pass's expression for Spark: Unicode classes, lines end at \\n alone."""
    return f"(?{flags}dU){pattern}"


def quick(kind: str, pattern: str) -> str:
    """A pass's pattern with the same matches that leaves most positions early."""
    if kind == "postal_code_city":
        return r"(?=\d{5}\s)" + pattern
    if kind.startswith("street_address"):
        return _STREET + pattern
    return entered(*ENTRIES[kind]) + pattern if kind in ENTRIES else pattern


def removed(df: DataFrame, column: str) -> DataFrame:
    """df with the column run through all passes, `types` (distinct, in order, comma-joined) and `pattern_removals` (passes that found something)."""
    out = df.withColumns({"types": F.lit(""), "pattern_removals": F.lit(0), "_low": folded(F.col(column)), "_stale": F.lit(False)})
    left: list[str] = []
    for at, (kind, flags, pattern, instead, literals) in enumerate(PASSES):
        if at == FRESH:
            left = []
            out = out.withColumns({"_low": F.when(F.col("_stale"), folded(F.col(column))).otherwise(F.col("_low")), "_stale": F.lit(False)})
        # what the folded text holds too much opens a gate in vain; what passes have put in since it was made is in `left`
        holds = lambda words: F.lit(True) if any(w in m for w in words for m in left) else reduce(lambda x, y: x | y, [F.contains("_low", F.lit(w)) for w in words] or [F.lit(True)])  # noqa: E731, B023
        some = holds(literals) & holds(ALSO.get(kind, [])) & (F.col("_low").rlike(NUMBERED) if kind.startswith("street_address") else F.lit(True))
        after = F.when(some, F.regexp_replace(column, expression_of(flags, quick(kind, pattern)), instead)).otherwise(F.col(column))
        out = out.withColumn("_after", after)
        hit = F.col("_after") != F.col(column)
        known = F.contains(F.concat(F.lit(","), "types", F.lit(",")), F.lit(f",{kind},"))
        found = {"types": F.when(hit & ~known, F.concat_ws(",", F.nullif("types", F.lit("")), F.lit(kind))).otherwise(F.col("types")), "pattern_removals": F.col("pattern_removals") + hit.cast("int"), column: F.col("_after")}
        if at < FRESH:
            left.append(instead.lower())
            out = out.withColumns(found | {"_stale": F.col("_stale") | hit})
        else:
            out = out.withColumns(found | {"_low": F.when(hit, folded(F.col("_after"))).otherwise(F.col("_low"))})
    return out.drop("_after", "_low", "_stale")


def _listed(word: Column, terms: Sequence[str]) -> Column:
    return F.lower(word).isin(*terms) if terms else F.lit(False)


def without_runs(text: Column, kept: Sequence[str]) -> Column:
    """Runs of two or three capitalised words leave the text unless one of their words is listed."""
    keeps = lambda run: F.exists(F.split(run, r"(?U)\s+"), lambda w: _listed(w, kept))
    return F.array_join(F.transform(turns(text, RUN), lambda piece, i: F.when((i % 2 == 1) & ~keeps(piece), F.lit("")).otherwise(piece)), "")


def without_names(df: DataFrame, column: str, terms: Sequence[str], eponyms: Sequence[str]) -> DataFrame:
    """Names by their shape: titled ones are marked, lines that a title leads go unless they hold a term, runs go unless listed."""
    medical = lambda line: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(line), t)) if terms else F.lit(False)
    text = F.col(column)
    df = df.withColumn(column, F.when(F.contains(text, F.lit("Dr")) | F.contains(text, F.lit("Prof")), F.regexp_replace(text, "(?U)" + TITLED, "[NAME ENTFERNT]")).otherwise(text))
    lines = F.filter(F.split(text, "\n", -1), lambda line: ~line.rlike("(?U)" + LED) | medical(line))
    df = df.withColumn(column, F.when(text.rlike("(?mdU)" + LED), F.array_join(lines, "\n")).otherwise(text))
    return df.withColumn(column, without_runs(text, [*terms, *eponyms]))


def date_context(before: Column) -> Column:
    """pii or medical, by the 50 characters before a date; pii if they tell nothing."""
    low = F.lower(before)
    holds = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    return F.when(holds(BIRTH), "pii").when(holds(TREATMENT), "medical").otherwise("pii")


def has_content(text: Column) -> Column:
    """False for a text of over 200 characters without any indicator."""
    low = F.lower(text)
    return (F.length(text) <= 200) | reduce(lambda x, y: x | y, [F.contains(low, F.lit(w)) for w in INDICATORS])


def quality(pattern: Column, high: Column, medium: Column, low: Column) -> Column:
    """Removals weighted by confidence (100, 100, 80, 50), one decimal; 100 without any."""
    total = pattern + high + medium + low
    return F.when(total == 0, 100.0).otherwise(F.bround((pattern * 100 + high * 100 + medium * 80 + low * 50) / total, 1))


def filtered(df: DataFrame, column: str = "text", terms: Sequence[str] = (*T.TERMS, *T.DRUGS), eponyms: Sequence[str] = tuple(T.EPONYMS)) -> DataFrame:
    """df with `clean`, `types`, `pattern_removals`, `n_protected`, `content_kept`, `review`, `quality`, `reduction` (percent of characters, 2 decimals).

    Null and empty texts stay empty, with nothing found."""
    out = protected(df, column, protection(terms)).withColumn("n_protected", F.size("ledger"))
    out = removed(out, "masked")
    out = without_names(out, "masked", terms, eponyms).withColumn("masked", restored(F.col("masked"), F.col("ledger")))
    lines = F.when(F.contains("masked", F.lit("\n\n\n")), F.regexp_replace("masked", "\n{3,}", "\n\n")).otherwise(F.col("masked"))
    # a blank alone stays as it is
    tidy = F.when(F.contains(lines, F.lit("  ")) | F.contains(lines, F.lit("\t")), F.regexp_replace(lines, " [ \t]+|\t[ \t]*", " ")).otherwise(lines)
    out = out.withColumn("clean", F.regexp_replace(tidy, r"(?U)^\s+|\s+$", ""))
    n = F.length(F.coalesce(column, F.lit("")))
    none = F.lit(0)
    return out.withColumns(
        {
            "content_kept": has_content(F.col("clean")), "quality": quality(F.col("pattern_removals"), none, none, none),
            "reduction": F.when(n > 0, F.bround((n - F.length("clean")) / n * 100, 2)).otherwise(0.0),
        }
    ).withColumn("review", ~F.col("content_kept")).drop("masked", "ledger")
