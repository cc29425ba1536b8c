"""Recognised text put right: character confusions, spelling of terms with their case, laboratory lines as Markdown tables, the union of
several passes. Column expressions over one row; a text's lines are an array, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.folds import bound, clusters

# Corrections in order, all without regard to case.
CORRECTIONS = [
    (r"\b0(?=[a-zäöüß])", "O"), (r"(?<=[a-zäöüß])0\b", "o"), (r"\b1(?=[a-zäöüß]{2,})", "I"), (r"(?<=[a-zäöüß])1(?=[a-zäöüß])", "i"), (r"(?<=[a-zäöüß])1\b", "l"), (r"\bI(?=\d)", "1"), (r"(?<=\d)O(?=\d)", "0"), (r"(?<=\d)o(?=\d)", "0"),
    ("ii", "ü"), ("ae", "ä"), ("oe", "ö"), ("ue", "ü"), ("ss", "ß"),
    (r"\bHamoglobin\b", "Hämoglobin"), (r"\bErythrozyten\b", "Erythrozyten"), (r"\bLeukozyten\b", "Leukozyten"), (r"\bThrombocyten\b", "Thrombozyten"), (r"\bKreatinin\b", "Kreatinin"), (r"\bBilirubin\b", "Bilirubin"), (r"\bCholesterin\b", "Cholesterin"),
    (r"\bGlukose\b", "Glucose"), (r"\bNatrium\b", "Natrium"), (r"\bKalium\b", "Kalium"), (r"\bCalcium\b", "Calcium"), (r"\bPhosphat\b", "Phosphat"),
    (r"\bmg/d1\b", "mg/dl"), (r"\bmmol/1\b", "mmol/l"), (r"\bµmol/1\b", "µmol/l"), (r"\bg/d1\b", "g/dl"), (r"\bU/1\b", "U/l"), (r"\bmU/1\b", "mU/l"), (r"\bpg/m1\b", "pg/ml"), (r"\bng/m1\b", "ng/ml"), (r"\bµg/m1\b", "µg/ml"),
    (r"(\d)\s*mg\b", "$1 mg"), (r"(\d)\s*ml\b", "$1 ml"), (r"(\d)\s*mmol\b", "$1 mmol"), (r"(\d)\s*%", "$1%"), (r"(\d)\.(\d{3})\b", "$1,$2"), (r"(\d{1,3}),(\d{3})", "$1.$2"),
]
# What follows the corrections, with regard to case.
SPACING = [(r"(\d+)([a-zA-Z]+)", "$1 $2"), (r"(\d+)\s*-\s*(\d+)", "$1-$2"), (r"(\d+,\d+)\s*-\s*(\d+,\d+)", "$1-$2"), (" {2,}", " "), ("\n{3,}", "\n\n")]
# Terms in their spelling.
SPELLINGS = [
    "Herz", "Lunge", "Leber", "Niere", "Magen", "Darm", "Gehirn", "Pankreas", "Milz", "Schilddrüse", "Nebenniere", "Hypophyse", "Diabetes", "Hypertonie", "Hypotonie", "Anämie", "Leukämie", "Pneumonie", "Bronchitis", "Gastritis", "Hepatitis", "Nephritis",
    "Arthritis", "Arthrose", "Osteoporose", "Thrombose", "Embolie", "Infarkt", "Apoplex", "Epilepsie", "Migräne", "Depression", "Hämoglobin", "Hämatokrit", "Erythrozyten", "Leukozyten", "Thrombozyten", "Kreatinin", "Harnstoff", "Harnsäure", "Bilirubin",
    "Albumin", "Globulin", "Cholesterin", "Triglyzeride", "Glucose", "Lactat", "Pyruvat", "Amylase", "Lipase", "Aspirin", "Paracetamol", "Ibuprofen", "Diclofenac", "Metamizol", "Omeprazol", "Pantoprazol", "Simvastatin", "Atorvastatin", "Metformin", "Insulin",
    "Levothyroxin", "Prednisolon", "Amoxicillin", "Ciprofloxacin", "Metoprolol", "Bisoprolol", "Ramipril", "Enalapril", "Amlodipine", "Hydrochlorothiazid", "Endoskopie", "Koloskopie", "Gastroskopie", "Bronchoskopie", "Biopsie", "Punktion", "Sonographie",
    "Echokardiographie", "Angiographie", "Szintigraphie", "Elektrokardiogramm", "Elektroenzephalogramm", "Spirometrie", "Ergometrie",
]
# Parameters of a laboratory line, units, words of a table's head, parameters whose value may stand on the next line.
PARAMETERS = [
    "hämoglobin", "hämatokrit", "erythrozyten", "leukozyten", "thrombozyten", "glucose", "kreatinin", "harnstoff", "natrium", "kalium", "chlorid", "tsh", "ft3", "ft4", "cholesterin", "triglyceride", "bilirubin", "albumin", "protein",
]
UNITS = ["mg/dl", "mmol/l", "g/dl", "g/l", "µg/l", "ng/ml", "pg/ml", "u/l", "iu/l", "mU/l", "/µl", "%", "mg", "ml", "g", "µg", "ng"]
HEADS = ["parameter", "test", "untersuchung", "wert", "messwert", "ergebnis", "resultat", "result", "value", "einheit", "unit", "maßeinheit", "referenz", "normalwert", "norm", "reference", "referenzbereich", "grenzwert"]
NAMES = [
    "Hämoglobin", "Hämatokrit", "Erythrozyten", "Leukozyten", "Thrombozyten", "MCV", "MCH", "MCHC", "RDW", "MPV", "Neutrophile", "Lymphozyten", "Monozyten", "Eosinophile", "Basophile", "Glucose", "Kreatinin", "Harnstoff", "Harnsäure", "Natrium", "Kalium",
    "Chlorid", "Calcium", "Phosphat", "Magnesium", "Eisen", "Ferritin", "Transferrin", "Bilirubin", "GOT", "GPT", "GGT", "AP", "LDH", "CK", "CK-MB", "Troponin", "BNP", "D-Dimer", "INR", "PTT", "Fibrinogen", "CRP", "BSG", "Procalcitonin",
]
TABLE_HEAD = ["\n### Laboratory Results\n", "| Parameter | Value | Unit | Reference Range |", "| --- | --- | --- | --- |"]
#: White space that strips from lines.
SPACE = " \t\r\x0b\f"
NUMBER = r"[0-9]+[.,]?[0-9]*"
#: Runs of letters, digits and underscores.
WORD = r"[\p{L}\p{N}_]+"


def corrected(text: Column) -> Column:
    """All corrections in order, each over what the one before left."""
    for pattern, instead in CORRECTIONS:
        text = F.regexp_replace(text, "(?iU)" + pattern, instead)
    for pattern, instead in SPACING:
        text = F.regexp_replace(text, "(?U)" + pattern, instead)
    return text


def respelled(text: Column, terms: list[str] | None = None) -> Column:
    """Every word that is a term, whatever its case, in the term's spelling: all capitals stay so, a capital first gives the
    spelling, else lower case. What lies between words stays as it is."""
    known = F.create_map(*[F.lit(x) for t in (terms or SPELLINGS) for x in (t.lower(), t)])

    def case(word):
        found = F.try_element_at(known, F.lower(word))
        first = F.left(word, F.lit(1))
        return F.when(found.isNull(), word).when((F.upper(word) == word) & (F.lower(word) != word), F.upper(found)).when(F.upper(first) == first, found).otherwise(F.lower(found))

    return F.array_join(F.zip_with(F.split(text, WORD, -1), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda gap, word: F.when(word.isNull(), gap).otherwise(F.concat(gap, case(word)))), "")


def _holds(text: Column, words: list[str]) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        out = out | F.contains(text, F.lit(word))
    return out


def stripped_lines(text: Column, least: int = 1) -> Column:
    """The lines of a text without white space around them, those of `least` characters or more."""
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE))), lambda x: F.length(x) >= least)


def is_lab_line(line: Column) -> Column:
    """A parameter or a unit, and a number."""
    low = F.lower(line)
    return (_holds(low, PARAMETERS) | _holds(low, UNITS)) & line.rlike(NUMBER)


def lab_cells(line: Column) -> Column:
    """Four cells of a laboratory line, split at wide gaps, padded or cut; null for fewer than two."""
    parts = F.filter(F.transform(F.split(line, r"\s{2,}|\t+", -1), lambda x: F.btrim(x, F.lit(SPACE))), lambda x: x != "")
    return F.when(F.size(parts) >= 2, F.slice(F.concat(parts, F.array_repeat(F.lit(""), 4)), 1, 4))


def lab_tables(lines: Column) -> Column:
    """Lines with runs of laboratory lines as Markdown tables: a run opens one, a line without two cells leaves no row in it, the
    first other line closes it with an empty one."""
    labs = F.transform(lines, is_lab_line)
    # every line's mark beside the one before it; the array of the latter is one longer
    marked = F.zip_with(F.zip_with(lines, labs, lambda x, lab: F.struct(x.alias("line"), lab.alias("lab"))), F.concat(F.array(F.lit(False)), labs), lambda x, before: F.struct(x.alias("x"), before.alias("before")))

    def out(m):
        line, head, cells = m["x"]["line"], F.array(*[F.lit(h) for h in TABLE_HEAD]), lab_cells(m["x"]["line"])
        row = F.when(cells.isNotNull(), F.array(F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |")))).otherwise(F.array().cast("array<string>"))
        lab = m["x"]["lab"]
        return F.when(m["x"].isNull(), F.array().cast("array<string>")).when(lab & m["before"], row).when(lab, F.concat(head, row)).when(m["before"], F.array(F.lit(""), line)).otherwise(F.array(line))

    return F.array_join(F.flatten(F.transform(marked, out)), "\n")


def is_header(cells: Column) -> Column:
    """Whether half the cells or more hold a word of a table's head."""
    return (F.size(cells) > 0) & (2 * F.size(F.filter(cells, lambda c: _holds(F.lower(c), HEADS))) >= F.size(cells))


def united(passes: list[Column]) -> Column:
    """The lines of all passes, three characters or more, once each and in order; a parameter's line takes the line behind it along
    if that holds a number and was not taken itself."""
    lines = F.sort_array(F.array_distinct(F.concat(*[stripped_lines(F.coalesce(p, F.lit("")), 3) for p in passes])))
    named = "|".join(n.lower() for n in NAMES)

    def joined(lines):
        pairs = F.zip_with(lines, F.slice(lines, F.lit(2), F.size(lines)), lambda x, behind: F.struct(x.alias("line"), behind.alias("behind")))
        # few lines hold a number, so only those before one are searched for names
        may = F.transform(pairs, lambda p: F.when(F.coalesce(p["behind"].rlike("[0-9]"), F.lit(False)), F.when(F.lower(p["line"]).rlike(named), "1").otherwise("0")).otherwise("0"))
        # from the left, a line that may pair takes the one behind it, whatever that may
        marks = F.split(F.regexp_replace(F.array_join(may, ""), "1[01]", "+-"), "")
        out = F.zip_with(pairs, marks, lambda p, m: F.when(m == "+", F.concat(p["line"], F.lit(": "), p["behind"])).when(m != "-", p["line"]))
        return F.array_join(F.filter(out, lambda x: x.isNotNull()), "\n")

    return bound(lines, lambda x: F.when(F.size(x) > 0, joined(x)).otherwise(""))


# Spellings of terms and units, names of parameters with the words for them, words of a diagnosis.
ENHANCED = [
    (r"\bHamoglobin\b", "Hämoglobin"), (r"\bHamatokrit\b", "Hämatokrit"), (r"\bLeuko[sz]yten\b", "Leukozyten"), (r"\bErythro[sz]yten\b", "Erythrozyten"), (r"\bThrombo[sz]yten\b", "Thrombozyten"), (r"\bmg/d[lI]\b", "mg/dl"), (r"\bmmol/[lI]\b", "mmol/l"),
    (r"\b[uμ]g/[lI]\b", "μg/l"), (r"\bpmo[lI]/[lI]\b", "pmol/l"),
]
VARIATIONS = {
    "hemoglobin": ["hämoglobin", "hb", "hemoglobin"], "hematocrit": ["hämatokrit", "hkt", "hct"], "erythrocytes": ["erythrozyten", "ery", "rbc"], "leukocytes": ["leukozyten", "leuko", "wbc"], "thrombocytes": ["thrombozyten", "thrombo", "plt"],
    "glucose": ["glukose", "glucose", "blutzucker"], "creatinine": ["kreatinin", "crea", "krea"], "urea": ["harnstoff", "urea"], "sodium": ["natrium", "na", "sodium"], "potassium": ["kalium", "k", "potassium"], "chloride": ["chlorid", "cl"],
    "tsh": ["tsh", "thyreotropin"], "ft3": ["ft3", "freies t3"], "ft4": ["ft4", "freies t4"],
}
FINDINGS = ["diagnose", "befund", "beurteilung"]
SECTIONS = ["laborwerte", "befund", "diagnose", "medikation"]
VALUE = r"(?U)(\b\w+[\w\s\-]*?)[\s:]+(\d+[,.]?\d*)\s*([A-Za-z/%]+)?"
LINE_VALUE = r"(?U)^([A-Za-zÄÖÜäöüß\-\s]+?)[\s:]+(\d+[,.]?\d*)\s*([A-Za-z/%]+)?(?:\s*\(?([\d,.\-\s]+)\)?)?"
CLEAN_ROW = r"(?U)([A-Za-zÄÖÜäöüß\-]+)\s*\|\s*([\d,\.]+)\s*\|\s*([A-Za-z/%]+)\s*\|\s*([\d,\.\-\s]+)"
# End of the fixed values.
#: The matches of CLEAN_ROW: a name is entered at its first character or behind a match, and no part of a row is given up
#: but white space before the last cell, which may be all of it.
QUICK_ROW = r"(?U)(?:\G|(?<![A-Za-zÄÖÜäöüß\-]))([A-Za-zÄÖÜäöüß\-]++)\s*+\|\s*+([\d,\.]++)\s*+\|\s*+([A-Za-z/%]++)\s*+\|\s*([\d,\.\-\s]+)"


def pipe_table(text: Column) -> Column:
    """Gaps of two spaces or more as pipes, lines stripped, empty ones left out, rows of four cells as name: value unit (Referenz: range)."""
    # a gap lies within a line
    text = F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, "  +", " | ")).otherwise(text)
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)))
    return F.regexp_replace(F.array_join(F.filter(lines, lambda x: x != ""), "\n"), QUICK_ROW, r"$1: $2 $3 (Referenz: $4)")


def has_columns(lefts: Column, tolerance: int = 20, least: int = 10, columns: int = 3, members: int = 3) -> Column:
    """Whether words' left edges, in order, fall into three clusters of three: an edge joins the first cluster whose first member is nearer than the tolerance."""
    return (F.size(lefts) >= least) & (clusters(lefts, tolerance, members) >= columns)


def _canonical(name: Column) -> Column:
    """The parameter that a name holds a word of, capitalised; the name if there is none."""
    low, out = F.lower(name), F.lit(None).cast("string")
    for standard, words in reversed(VARIATIONS.items()):
        out = F.when(_holds(low, words), standard.capitalize()).otherwise(out)
    return F.coalesce(out, name)


def enhanced(df: DataFrame, column: str) -> DataFrame:
    """df with the column's terms and units spelt right, every `name value unit` rewritten by its canonical name, and a heading
    before the first line of laboratory words and the first of a diagnosis."""
    text = F.col(column)
    for pattern, instead in ENHANCED:
        text = F.regexp_replace(text, "(?iU)" + pattern, instead)
    df = df.withColumn(column, text)
    # a name may run on over many words, so the text is searched for matches once and only those are taken apart
    parts = lambda m: F.struct(*[F.regexp_extract(m, VALUE, g).alias(n) for g, n in ((1, "name"), (2, "value"), (3, "unit"))])
    found = F.transform(F.regexp_extract_all(column, F.lit(VALUE), F.lit(0)), parts)
    df = df.withColumns({"_gaps": F.split(column, VALUE, -1), "_found": found})
    written = lambda m: F.concat(_canonical(F.regexp_replace(m["name"], r"(?U)^\s+|\s+$", "")), F.lit(": "), m["value"], F.when(F.coalesce(m["unit"], F.lit("")) != "", F.concat(F.lit(" "), m["unit"])).otherwise(""))
    df = df.withColumn("_lines", F.split(F.array_join(F.zip_with("_gaps", "_found", lambda gap, m: F.when(m.isNull(), gap).otherwise(F.concat(gap, written(m)))), ""), "\n", -1))
    words = [w for ws in VARIATIONS.values() for w in ws]
    first = lambda ws: F.coalesce(F.array_position(F.transform("_lines", lambda x: _holds(F.lower(x), ws)), True), F.lit(0))
    df = df.withColumns({"_lab": first(words), "_finding": first(FINDINGS)})
    head = lambda i, at, name: F.when(i + 1 == F.col(at), F.array(F.lit(f"\n=== {name} ==="))).otherwise(F.array().cast("array<string>"))
    lines = F.flatten(F.transform("_lines", lambda x, i: F.concat(head(i, "_lab", "LABORWERTE"), head(i, "_finding", "DIAGNOSE/BEFUND"), F.array(x))))
    return df.withColumn(column, F.array_join(lines, "\n")).drop("_gaps", "_found", "_lines", "_lab", "_finding")


def structured(text: Column) -> Column:
    """Headings in capitals, lines that begin with `name value unit (range)` written out by the known name, other lines as they are."""

    def line(x):
        part = lambda g: F.regexp_extract(x, LINE_VALUE, g)
        strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
        name = F.lit(None).cast("string")
        for known in reversed(NAMES):
            name = F.when(F.contains(F.lower(part(1)), F.lit(known.lower())), known).otherwise(name)
        unit = F.when(part(3) != "", F.concat(F.lit(" "), part(3))).otherwise("")
        reference = F.when(part(4) != "", F.concat(F.lit(" (Referenz: "), strip(part(4)), F.lit(")"))).otherwise("")
        value = F.concat(F.coalesce(name, strip(part(1))), F.lit(": "), part(2), unit, reference)
        return F.when(_holds(F.lower(x), SECTIONS), F.concat(F.lit("\n=== "), F.upper(x), F.lit(" ==="))).when(x.rlike(LINE_VALUE), value).otherwise(x)

    return F.array_join(F.transform(stripped_lines(text), line), "\n")


def scan_confidence(text: Column, regions: Column, methods: Column) -> Column:
    """0.5, and 0.2 for a table, for a length over 500, for more than five parameters, 0.1 for three methods; 0.95 at most."""
    terms = F.size(F.filter(F.array(*[F.lit(n.lower()) for n in NAMES]), lambda n: F.contains(F.lower(text), n)))
    bonus = lambda test, by: F.when(test, by).otherwise(0.0)
    return F.round(F.least(F.lit(0.5) + bonus(regions > 0, 0.2) + bonus(F.length(text) > 500, 0.2) + bonus(methods >= 3, 0.1) + bonus(terms > 5, 0.2), F.lit(0.95)), 2)
