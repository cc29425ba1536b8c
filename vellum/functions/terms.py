"""Medical terms: the forms under which a word is looked up, a compact default dictionary, the verifier's rules as data."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of declined German forms, tried in this order.
SUFFIXES = [
    "ischen", "ische", "ischer", "ungen", "liche", "lichen", "licher", "liches", "alen", "aler", "ales", "enen", "ener", "enes", "igen", "iger", "iges", "ung", "en", "er", "es", "em", "e", "n", "s",
]
#: Characters that must be left before an ending.
STEM = 3
# Words around a name that make it the name of a disease.
DISEASE_WORDS = ["morbus", "disease", "syndrome", "syndrom", "erkrankung", "krankheit", "disorder", "condition", "diagnose"]

#: A compact dictionary of our own; larger ones are passed as a table.
TERMS = [
    "abdomen", "allergie", "anamnese", "aorta", "arterie", "atmung", "auge", "befund", "bein", "blut", "blutdruck", "bronchus", "darm", "dosis", "embolie", "entzündung", "fieber", "fraktur", "gefäß", "gehirn",
    "gelenk", "gewebe", "haut", "herz", "herzinsuffizienz", "husten", "hypertonie", "impfung", "infarkt", "infektion", "insuffizienz", "kardial", "knie", "knochen", "koronar", "leber", "lunge", "magen", "medikament", "metastase",
    "milz", "muskel", "nächtlich", "narbe", "nerv", "niere", "ödem", "operation", "organ", "pankreas", "parameter", "pneumonie", "puls", "renal", "schmerz", "sepsis", "stenose", "therapie", "thrombose", "tumor", "ulkus",
    "untersuchung", "vene", "vitamin", "wirbel", "wunde", "zelle", "zyste",
]
DRUGS = [
    "amlodipin", "apixaban", "aspirin", "atorvastatin", "bisoprolol", "candesartan", "cefuroxim", "ciprofloxacin", "citalopram", "clopidogrel", "diclofenac", "digitoxin", "furosemid", "gabapentin", "heparin", "ibuprofen", "insulin", "levothyroxin",
    "marcumar", "metformin", "metoprolol", "pantoprazol", "paracetamol", "prednisolon", "ramipril", "simvastatin", "torasemid", "tramadol",
]
EPONYMS = [
    "addison", "alzheimer", "babinski", "basedow", "bechterew", "behçet", "barrett", "crohn", "cushing", "down", "dupuytren", "fabry", "gilbert", "hashimoto", "hodgkin", "horner", "huntington", "kawasaki", "lyme", "marfan",
    "menière", "parkinson", "raynaud", "reiter", "scheuermann", "sjögren", "tourette", "turner", "wilson",
]

# The verifier's tables.
_TEMPORAL = [("nächtlich", ["", "e", "er", "en", "es"]), ("paroxysmal", ["", "e", "er", "en"]), ("intermittierend", ["", "e", "er"]), ("persistierend", ["", "e", "er"]), ("rezidivierend", ["", "e", "er"]), ("progredient", ["", "e", "er"])]
TEMPORAL = [stem + end for stem, ends in _TEMPORAL for end in ends]
SCORES = [
    "child", "child-pugh", "meld", "meld-na", "sofa", "apache", "saps", "tiss", "nyha", "killip", "timi", "grace", "chads2", "cha2ds2-vasc", "has-bled", "asa", "mallampati", "forrest", "rockall", "blatchford", "glasgow-blatchford",
    "ranson", "bisap", "ctsi", "marshall", "curb-65", "curb", "psi", "fine", "baveno", "paquet", "los angeles", "savary-miller", "savary", "miller", "siewert", "dagradi", "glasgow", "gcs", "nihss", "hunt-hess", "fisher",
    "tnm", "figo", "dukes", "clark", "breslow", "gleason", "apgar", "bishop", "karnofsky", "ecog", "rankin", "barthel",
]
ABBREVIATIONS = [
    "ögd", "oegd", "ösophagogastroduodenoskopie", "ercp", "mrcp", "ptcd", "erc", "koloskopie", "gastroskopie", "bronchoskopie", "zystoskopie", "laparoskopie", "thorakoskopie", "arthroskopie", "rektoskopie",
    "ct", "mrt", "pet", "pet-ct", "spect", "szintigraphie", "fibroscan", "elastographie", "sono", "sonographie", "doppler", "pcr", "elisa", "western-blot", "western blot", "immunblot",
    "ena", "ana", "anca", "p-anca", "c-anca", "asma", "ama", "lkm", "sma", "tipss", "tips", "tace", "rfa", "mwa", "prt", "sirt", "erythrozytenkonzentrat", "ek", "ffp", "tk", "sbp", "los angeles", "la klassifikation",
    "hfe", "h63d", "c282y", "s65c", "hep", "hcv", "hbv", "hav", "hev", "hdv", "hiv", "ogtt", "ltt", "tsh", "thrombozytenkonzentrat", "mcv", "mch", "mchc", "rdw", "mpv", "pdw", "pct", "plt", "wbc", "rbc", "hct", "hgb",
    "pef", "mef", "pif", "tlc", "frc", "vc", "ivc", "evc", "fev1", "fvc", "dlco", "kco", "raw", "sraw", "gaw", "sgaw", "lvef", "rvef", "lvedv", "lvesv", "lvedp", "tapse", "mapse", "gls", "tdi", "abi", "tbi", "pwv", "aix", "cfpwv",
    "bia", "bsa", "ffm", "tbw", "ecw", "icw", "na", "k", "cl", "mg", "fe", "zn", "cu", "po4",
]
_GRADES = [f"{grade}gradig{end}" for grade in ("höchst", "hoch", "mittel", "gering", "höher") for end in ("", "e", "er", "es")]
_LOBES = [f"{lobe}{part}" for lobe in ("haupt", "mittellappen", "oberlappen", "unterlappen") for part in ("karina", "carina", "bronchus")]
_LEARNED = [f"{stem}{end}" for stem in ("zyto", "histo", "patho") for end in ("logie", "logisch", "logische", "logischer")]
_DECLINED = [f"{stem}{end}" for stem in ("exokrin", "endokrin") for end in ("", "er", "e", "en")] + [f"{stem}{end}" for stem in ("heterozygot", "homozygot") for end in ("er", "e", "en")] + [f"az-reduziert{end}" for end in ("", "e", "er", "en")]
_VITAMINS = ["vitamin"] + [f"vitamin {letter}" for letter in ("a", "b", "b1", "b2", "b6", "b12", "c", "d", "d3", "e", "k")]
ANATOMY = [
    "unterlappen", "oberlappen", "mittellappen", "lingula", "unterlappenatelektase", "oberlappenatelektase", "liegetechnik", "stehendtechnik", "stehend", "liegend", "seitaufnahme", "p.a.", "ap", "a.p.", "stauungsdermatitis", "anasarka", "aszites",
    "kardiorenal", "hepatorenal", "kardiopulmonal", "caput", "corpus", "cauda", "truncus", "coeliacus", "mesenterica", "renalis", "vena", "arteria", "ductus", "nervus", "lobus", "segmentum", "regio", "apex", "basis", "fundus", "antrum",
    "cortex", "medulla", "parenchym", "hilus", "hilum", "collum", "isthmus", "pylorus", "cardia", "bulbus", "duodenum", "jejunum", "ileum", "colon", "rectum", "sigmoid", "vesica", "ureter", "urethra", "pelvis", "cervix", "ovarium", "tuba",
    "corona", "covid", "covid-19", "sars", "sars-cov-2", "mers", "steatosis", "hepatis", "nash", "nafld", "afld", "ery", "erys", "leuko", "leukos", "thrombo", "thrombos", "lympho", "lymphos", "mono", "monos", "granu", "granus", "neutro", "neutros",
    "eosino", "basophil", "z.b.", "d.h.", "u.a.", "bzw.", "ggf.", "evtl.", "etc.", "li.", "re.", "bds.", "neg.", "pos.", "körperwasseranteil", "körperfettanteil", "muskelmasse", "viszeralfett", "subkutanfett",
    "solarien", "solarium", "uv-faktor", "uv-index", "lsf", "spf", "bifurkation", "trifurkation", "anastomose", "grundumsatz", "stoffwechselumsatz", "ruheumsatz", "knöchel-arm-index", "ankle-brachial-index", "leukozyten", "erythrozyten", "thrombozyten",
    "hämatokrit", "hämoglobin", "patient", "patientin", "patienten", "patientinnen", "pat", "pat.", "allgemeinzustand", "allgemeinzustandes", "allgemeinzustandsreduziert", "blutungsstigmata", "stigmata", "voraufnahme", "voraufnahmen",
    "voruntersuchung", "voruntersuchungen", "cannabisabusus", "cannabis", "drogenabusus", "medikamentenabusus", "polytoxikomanie", "nikotinabusus", "alkoholabusus", "abusus", "stauungsleber", "trikuspidalsuffizienz", "karina", "carina",
    "segmentbronchus", "segmentbronchien", "trachealbifurkation", "sprunggelenk", "sprunggelenke", "sprunggelenken", "vorfuß", "vorfüße", "fußgelenk", "fußgelenke", "lungenbeteiligung", "leberbeteiligung", "nierenbeteiligung", "appendektimie", "appendektomie",
]
_VALVES = [f"{valve}insuffizienz" for valve in ("trikuspidal", "trikuspidalklappen", "mitralklappen", "aortenklappen", "pulmonalklappen", "klappen", "herz", "rechtsherz", "linksherz")]
ANATOMY_ALL = [*ANATOMY, *_GRADES, *_LOBES, *_LEARNED, *_DECLINED, *_VITAMINS, *_VALVES]
GENERA = [
    "staphylococcus", "staph", "streptococcus", "strep", "pseudomonas", "klebsiella", "enterococcus", "enterobacter", "escherichia", "e. coli", "e.coli", "salmonella", "shigella", "campylobacter", "helicobacter", "h. pylori", "h.pylori",
    "clostridium", "clostridioides", "c. diff", "c.diff", "haemophilus", "neisseria", "listeria", "legionella", "bordetella", "corynebacterium", "mycobacterium", "mycoplasma", "chlamydia", "treponema", "borrelia", "rickettsia", "candida", "aspergillus", "cryptococcus",
]
SPECIES = [
    "aureus", "epidermidis", "haemolyticus", "saprophyticus", "hominis", "pneumoniae", "pyogenes", "agalactiae", "viridans", "mutans", "aeruginosa", "coli", "difficile", "perfringens", "botulinum", "tetani", "faecalis", "faecium", "pylori", "jejuni",
    "influenzae", "meningitidis", "gonorrhoeae", "monocytogenes", "pneumophila", "pertussis", "tuberculosis", "leprae", "albicans", "glabrata", "tropicalis", "krusei", "auris", "fumigatus", "niger", "flavus", "neoformans",
]
ENDINGS = [
    "itis", "ose", "osis", "pathie", "penie", "zytose", "amie", "emie", "urie", "algie", "asthenie", "plegie", "parese", "spasmus", "ektomie", "tomie", "plastik", "skopie", "graphie", "gramm", "zentese", "stase", "lyse", "ostomie", "furkation", "bifurkation",
    "trifurkation", "umsatz", "stomose", "anastomose", "pulmonal", "pulmonale", "pulmonaler", "pulmonalen", "kardial", "kardiale", "kardialer", "kardialen", "renal", "renale", "renaler", "renalen", "hepatisch", "hepatische", "hepatischer", "hepatischen",
    "zerebral", "zerebrale", "zerebraler", "zerebralen", "intestinal", "intestinale", "intestinaler", "vaskular", "vaskulare", "vaskularer", "vaskularen", "neural", "neurale", "neuraler", "neuralen", "muskular", "muskulare", "muskularer", "muskularen",
    "kardiopulmonal", "kardiopulmonale", "kardiopulmonaler", "kardiorenal", "kardiorenale", "kardiorenaler", "hepatorenal", "hepatorenale", "hepatorenaler", "pathologisch", "physiologisch", "chronisch", "akut", "systemisch", "lokal", "diffus", "fokal",
]
BEGINNINGS = [
    "hyper", "hypo", "tachy", "brady", "poly", "oligo", "an", "dys", "para", "peri", "endo", "exo", "intra", "extra", "trans", "sub", "supra", "infra", "retro", "ante", "post", "neo", "pseudo", "hemi", "mono", "bi", "tri", "multi", "pan",
]
BEGUN_ENDS = ["ie", "isch", "al", "ar", "ose", "itis"]
COMPOUNDS = [r"^st[-\s]?strecke", r"^st[-\s]?hebung", r"^st[-\s]?senkung", r"^t[-\s]?welle", r"^p[-\s]?welle", r"^qrs[-\s]?komplex", r"^qt[-\s]?zeit", r"^pq[-\s]?intervall", r"veränderung(en)?$", r"störung(en)?$", r"insuffizienz$", r"stenose$"]
ROOTS = ["kardio", "pulmono", "hepato", "nephro", "neuro", "gastro", "dermato", "onko", "hamat", "endo", "bifurk", "anastom", "stenos", "thromb", "metabol", "umsatz", "vitamin"]
ANTIBODIES = (
    r"\banti[-\s]?(?:jo[-\s]?1|nxp[-\s]?2|sma|lkm|slc|mi[-\s]?2|dsdna|ds[-\s]?dna|centromere|scl[-\s]?70|ssa|ssb|rnp|smith|sm|cardiolipin|phospholipid|gad|tpo|tg|tsh[-\s]?rezeptor|"
    r"ccp|mda[-\s]?5|sae|tif1[-\s]?gamma|pm[-\s]?scl|ku|synthetase|srp|hmgcr|signal[-\s]?recognition|hcv|hiv|hbv|hbs|hbc|hbe)\b"
)
# End of the fixed values.
#: A genus, then possibly a species, anywhere in a term.
BACTERIA = r"\b(?:%s)\.?\s*(?:%s)?\b" % ("|".join(g.replace(".", r"\.") for g in GENERA), "|".join(SPECIES))

EQUAL, END, BEGINNING, PART, EXPRESSION = "equal", "end", "beginning", "part", "expression"
#: The verifier's rules: (priority, way, value, reason); `{}` in a reason is the value. Priority is that of the group, then by value.
RULES = (
    [(2, EQUAL, v, "german_temporal_medical") for v in TEMPORAL]
    + [(3, EQUAL, v, "scoring_system:{}") for v in SCORES]
    + [(4, EQUAL, v, "medical_abbrev:{}") for v in ABBREVIATIONS]
    + [(5, EQUAL, v, "anatomical:{}") for v in ANATOMY_ALL]
    + [(6, EQUAL, v, "bacterial:{}") for v in GENERA + SPECIES]
    + [(7, EXPRESSION, "(?iU)" + BACTERIA, "bacterial_species"), (8, EXPRESSION, "(?iU)" + ANTIBODIES, "autoantibody")]
    + [(9, END, v, "german_suffix:{}") for v in ENDINGS]
    + [(10, BEGINNING, v, "german_prefix:{}") for v in BEGINNINGS]
    + [(11, EXPRESSION, "(?iU)" + "|".join(COMPOUNDS), "compound_medical_term")]
    + [(12, PART, v, "german_root:{}") for v in ROOTS]
)


def forms(word: Column) -> Column:
    """The lower-case word and what is left of it before every ending of SUFFIXES that leaves more than STEM characters."""
    low = F.lower(word)
    stems = [F.when((F.length(low) > len(s) + STEM) & low.endswith(s), F.left(low, F.length(low) - len(s))) for s in SUFFIXES]
    return F.array_distinct(F.array_compact(F.array(low, *stems)))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, hyphens inside allowed, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


TOKEN = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"
#: A capitalised word, and runs of up to three.
NAME_WORD = "[A-ZÄÖÜ][a-zäöüß]+"
NAME_RUN = rf"(?U)\b{NAME_WORD}(?:\s+{NAME_WORD}){{0,2}}\b"


def plain(pattern: str) -> str:
    """A pattern without Spark's flag for Unicode classes, for engines that have none."""
    return re.sub(r"^\(\?(i?)U\)", lambda m: "(?i)" if m[1] else "", pattern)
