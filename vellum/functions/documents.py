"""Rule-based classification, quality scores and rewriting of document texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.folds import bound

# Class, strong indicators (3 points), weak indicators (1 point); ties go to the first class.
CLASSES = [
    (
        "ARZTBRIEF",
        ["sehr geehrte", "liebe kollegin", "lieber kollege", "mit freundlichen grüßen", "hochachtungsvoll", "gez.", "entlassung", "entlassen", "überweisung", "überweisen", "vorstellung", "konsil", "therapiebericht"],
        ["patient wurde", "anamnese", "diagnose", "therapie", "empfehlung", "weiteres vorgehen", "rückfragen"],
    ),
    (
        "BEFUNDBERICHT",
        ["befund", "befundbericht", "untersuchung vom", "röntgen", "ct", "mrt", "mri", "ultraschall", "sonographie", "szintigraphie", "pet", "angiographie", "mammographie", "darstellung", "kontrastmittel", "schnittbild", "aufnahme"],
        ["auffällig", "unauffällig", "verdacht", "hinweis", "tumor", "metastase", "zyste", "knoten", "herd", "fraktur", "läsion", "infiltrat", "erguss"],
    ),
    (
        "LABORWERTE",
        ["laborwerte", "blutwerte", "blutbild", "hämatologie", "mg/dl", "mmol/l", "µg/l", "u/l", "g/dl", "pg/ml", "referenzbereich", "normalbereich", "norm", "referenz", "hba1c", "cholesterin", "ldl", "hdl", "triglyceride", "kreatinin", "gfr", "tsh", "psa", "ck", "troponin"],
        ["erhöht", "erniedrigt", "normal", "pathologisch", "urin", "urinstatus", "urinkultur", "bakterien", "keime", "resistenz", "antibiogramm"],
    ),
]
# Terms of the quality scores.
FRIENDLY = ["Sie", "Ihr", "Ihnen", "bedeutet", "heißt das", "einfach"]
MARKERS = ["→", "•", "-", "**", "📋", "🎯", "✅"]
PLAIN = ["this means", "simply put", "in other words", "das bedeutet", "einfach gesagt", "mit anderen worten"]
LAB_TERMS = [
    "laborwerte", "blutwerte", "laborergebnisse", "befund", "referenzbereich", "normalwert", "grenzwert", "hämoglobin", "leukozyten", "thrombozyten", "erythrozyten", "glukose",
    "cholesterin", "kreatinin", "harnstoff", "bilirubin", "albumin", "protein", "calcium",
]
UNIT = r"[0-9]+[.,][0-9]*\s*(?:mg/dl|mmol/l|µg/l|ng/ml|u/l|iu/l|g/l|%|/µl)"
RANGE = r"[0-9]+[.,][0-9]*\s*[-–]\s*[0-9]+[.,][0-9]*"


def hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms a text contains."""
    return bound(text, lambda x: F.size(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(x, t))))


def classified(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds `document_class` and `confidence` by indicators found in the lower-cased text."""
    low = F.lower(F.coalesce(F.col(column), F.lit("")))
    # counted once per text: later columns refer to these
    counted = df.withColumn("_low", low)
    counted = counted.withColumn("_s", F.array(*[hits(F.col("_low"), s) for _, s, _ in CLASSES])).withColumn("_w", F.array(*[hits(F.col("_low"), w) for _, _, w in CLASSES]))
    scores = F.zip_with("_s", "_w", lambda s, w: 3 * s + w)
    best = counted.withColumn("_scores", scores).withColumn("_top", F.array_max("_scores")).withColumn("_at", F.array_position("_scores", F.col("_top")).cast("int"))
    most = F.element_at(F.array(*[F.lit(3 * len(s) + len(w)) for _, s, w in CLASSES]), F.col("_at"))
    strong = F.element_at("_s", F.col("_at"))
    ratio = F.col("_top") / most
    confidence = F.when(strong > 0, F.least(0.5 + ratio * 0.5 + strong * 0.1, F.lit(1.0))).otherwise(F.least(ratio * 0.6, F.lit(0.6)))
    second = F.element_at(F.reverse(F.array_sort("_scores")), 2)
    close = F.when(F.col("_top") - second < 2, 0.7).otherwise(1.0)
    name = F.element_at(F.array(*[F.lit(c) for c, _, _ in CLASSES]), F.col("_at"))
    return best.withColumn("document_class", name).withColumn("confidence", F.round(confidence * close, 6)).drop("_low", "_s", "_w", "_scores", "_top", "_at")


def cascade(pattern_class: Column, pattern_confidence: Column, other_class: Column, other_confidence: Column, accept: float = 0.7) -> Column:
    """The pattern's class if confident enough, else the other's where that is more confident."""
    return F.when((pattern_confidence >= accept) | F.coalesce(other_confidence <= pattern_confidence, F.lit(True)), pattern_class).otherwise(other_class)


def text_quality(text: Column) -> Column:
    """0 to 1 by length, share of letters and number of words."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    visible = F.length(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))
    words = F.regexp_count(text, F.lit(r"(?<![\p{L}\p{N}_])[a-zA-ZäöüÄÖÜß]{3,}(?![\p{L}\p{N}_])"))
    score = F.when(F.length(text) > 100, 0.2).otherwise(0.0) + F.when(F.length(text) > 500, 0.2).otherwise(0.0)
    score = score + F.coalesce(F.try_divide(letters.cast("double"), visible.cast("double")), F.lit(0.0)) * 0.4 + F.when(words > 10, 0.2).otherwise(0.0)
    return F.when(F.coalesce(F.length(F.trim(text)), F.lit(0)) < 10, 0.0).otherwise(F.round(F.least(score, F.lit(1.0)), 6))


def output_quality(text: Column) -> Column:
    """0.5 and 0.1 each for headings, formatting, a fair length, line feeds and friendly terms."""
    parts = [F.contains(text, F.lit("#")), hits(text, MARKERS) > 0, F.length(text).between(500, 5000), F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) > 10, hits(text, FRIENDLY) >= 3]
    return F.round(F.least(F.lit(0.5) + sum((F.when(p, 0.1).otherwise(0.0) for p in parts), F.lit(0.0)), F.lit(1.0)), 6)


def table_score(text: Column) -> Column:
    """How much a text looks like a table of laboratory values."""
    separators = F.length(text) - F.length(F.translate(text, "|\t", "")) + F.regexp_count(text, F.lit(r"\s{3,}"))
    score = bound(F.lower(text), lambda low: F.least(hits(low, LAB_TERMS) * 0.15, F.lit(0.6)) + F.least(F.regexp_count(low, F.lit(UNIT)) * 0.1, F.lit(0.4)))
    score = score + F.least(separators * 0.02, F.lit(0.2)) + F.least(F.regexp_count(text, F.lit(RANGE)) * 0.05, F.lit(0.2))
    return F.round(F.least(F.coalesce(score, F.lit(0.0)), F.lit(1.0)), 6)


def changes(original: Column, modified: Column) -> Column:
    """struct<change_count, length_diff, significant>: lines that differ place by place."""
    pairs = F.zip_with(F.split(original, "\n", -1), F.split(modified, "\n", -1), lambda a, b: (F.coalesce(a, F.lit("")) != F.coalesce(b, F.lit(""))).cast("int"))
    n, diff = F.aggregate(pairs, F.lit(0), lambda s, x: s + x), F.length(modified) - F.length(original)
    return F.struct(n.alias("change_count"), diff.alias("length_diff"), ((n > 5) | (F.abs(diff) > 100)).alias("significant"))


def quality_gate(kind: Column, coverage: Column, quality: Column, image: Column, threshold: float = 0.5) -> Column:
    """struct<score, accepted>: 0.6 coverage + 0.4 text quality for PDFs, the image's quality else."""
    score = F.round(F.when(kind == "pdf", 0.6 * coverage + 0.4 * quality).otherwise(image), 6)
    return F.struct(score.alias("score"), (score >= threshold).alias("accepted"))


def file_type(name: Column) -> Column:
    suffix = F.regexp_extract(F.lower(name), r"\.([a-z0-9]+)$", 1)
    return F.when(suffix == "pdf", "pdf").when(suffix.isin("jpg", "jpeg", "png"), "image").otherwise("unknown")


def formatted(text: Column) -> Column:
    """Bullets to dashes, indented arrows to items, at most one empty line, trimmed."""
    text = F.regexp_replace(F.regexp_replace(text, "(?m)^•", "-"), "(?m)^  →", "  - →")
    return F.trim(F.regexp_replace(text, "\n{3,}", "\n\n"))


def merge_pages(pages: DataFrame, key: str, page: str = "page", text: str = "text", smart: bool = False) -> DataFrame:
    """One text per key of its pages in order, with page markers; the smart way leaves out the marker
    where the page before ends in a comma, a hyphen or a conjunction."""
    marker = F.concat(F.lit("--- Seite "), F.col(page).cast("string"), F.lit(" ---"))
    if smart:
        order = Window.partitionBy(key).orderBy(page)
        last = F.rtrim(F.lag(F.trim(F.col(text))).over(order))
        part = F.when(last.isNull() | last.rlike("(?:,|-|und|oder|sowie)$"), F.trim(F.col(text))).otherwise(F.concat(F.lit("\n"), marker, F.lit("\n\n"), F.trim(F.col(text))))
    else:
        part = F.concat(marker, F.lit("\n"), F.col(text), F.lit("\n"))
    rows = pages.withColumn("_part", part)
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col("_part").alias("t")))), lambda x: x.t), "\n").alias("merged"))


NAME = r"(?i)^([0-9]{3}-[0-9]{3})([a-z])?_(S[123][ek]?)?_?(.+?)_([0-9]{4}-[0-9]{2})(?:-([a-z]+))?\.pdf$"
DATED = r"(?i)_([0-9]{4}-[0-9]{2})(?:-([a-z]+))?\.pdf$"


def registry_entry(url: Column) -> Column:
    """struct<filename, registry_number, variant, classification, title, version, suffix> of a registry file's address."""
    name = F.element_at(F.split(url, "/"), -1)
    whole, part = name.rlike(NAME), lambda i: F.regexp_extract(name, NAME, i)
    head = lambda i: F.regexp_extract(name, "^([0-9]{3}-[0-9]{3})([a-z])?", i)
    date = lambda i: F.regexp_extract(name, DATED, i)
    suffix = F.when(whole, part(6)).otherwise(date(2))
    return F.struct(
        name.alias("filename"), F.when(whole, part(1)).otherwise(head(1)).alias("registry_number"), F.when(whole, part(2)).otherwise(head(2)).alias("variant"),
        F.when(whole, part(3)).otherwise("").alias("classification"), F.when(whole, part(4)).otherwise(F.replace(name, F.lit(".pdf"), F.lit(""))).alias("title"),
        F.when(whole, part(5)).otherwise(date(1)).alias("version"), F.nullif(suffix, F.lit("")).alias("suffix"),
    )


def base_key(name: Column) -> Column:
    """A file name without its version, under which versions meet."""
    return F.when(name.rlike(DATED), F.regexp_replace(name, DATED, "")).otherwise(F.replace(name, F.lit(".pdf"), F.lit("")))


def links(html: Column, keep: tuple[str, ...] = ()) -> Column:
    """The distinct anchor addresses of a page, in page order; only those that hold one of `keep`, if any is named."""
    found = F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1)))
    return F.filter(found, lambda x: F.exists(F.array(*map(F.lit, keep)), lambda k: F.contains(x, k))) if keep else found


def branch_value(output: Column, classes: list[str]) -> Column:
    """The first known class in a branching step's answer, else its first word."""
    plain = F.upper(F.trim(F.regexp_replace(output, r"(?i)^\s*(?:class|klasse|classification|dokumenttyp|antwort|answer)\s*:\s*", "")))
    found = F.filter(F.array(*[F.lit(c) for c in classes]), lambda c: F.contains(plain, c))
    return F.coalesce(F.get(found, 0), F.element_at(F.split(plain, r"\s+"), 1))


def stops(output: Column, values: list[str]) -> Column:
    """Whether the first word of a step's output is one of its stop values, in any case."""
    return F.upper(F.element_at(F.split(F.trim(output), r"\s+"), 1)).isin(*[v.upper() for v in values])
