"""Order of pages that came as separate files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Page number patterns in the order in which they are tried, and section patterns.
PAGE_NUMBERS = [r"seite\s*([0-9]+)", r"page\s*([0-9]+)", r"([0-9]+)\s*/\s*[0-9]+", r"blatt\s*([0-9]+)", r"-\s*([0-9]+)\s*-", r"^\s*([0-9]+)\s*$"]
SECTIONS = {
    "patient_info": [r"patient.*(?:name|nummer)", r"(?:vor|nach)name", "geburtsdatum", r"versicherten.*nummer", "krankenversicherung", "adresse"],
    "header": [r"(?:arzt|kranken|klinik).*brief", "entlassungsbrief", "befundbericht", "laborwerte", "blutwerte", "befund", "diagnose"],
    "lab_values": ["laborwerte", "blutwerte", "laborergebnis", "parameter", r"[0-9]+[.,][0-9]*\s*(?:mg/dl|mmol/l|µg/ml|ng/ml|u/l|iu/l)", "referenzbereich", "normwert"],
    "diagnosis": ["diagnose", "verdachtsdiagnose", "hauptdiagnose", "nebendiagnose", r"icd.*[0-9]+", "befund", "beurteilung"],
    "medication": ["medikation", "therapie", "verschreibung", "einnahme", r"[0-9]+\s*mg", "täglich", "morgens", "abends"],
    "continuation": ["fortsetzung", r"siehe.*(?:nächste|folgende)", "weiter auf", "anhang", "anlage", r"siehe.*(?:rückseite|blatt)"],
}
#: What a text must hold for a pattern that is no plain word.
NEEDS = {
    r"patient.*(?:name|nummer)": "patient", r"(?:vor|nach)name": "name", r"versicherten.*nummer": "versicherten", r"(?:arzt|kranken|klinik).*brief": "brief", r"[0-9]+[.,][0-9]*\s*(?:mg/dl|mmol/l|µg/ml|ng/ml|u/l|iu/l)": "/",
    r"icd.*[0-9]+": "icd", r"[0-9]+\s*mg": "mg", r"siehe.*(?:nächste|folgende)": "siehe", r"siehe.*(?:rückseite|blatt)": "siehe",
}
#: Share of numbered pages from which numbers decide.
NUMBERED = 0.7


def page_number(text: Column) -> Column:
    """The first number by the first pattern that matches."""
    return F.coalesce(*[F.regexp_extract(text, "(?i)" + p, 1).try_cast("int") for p in PAGE_NUMBERS])


def has_section(low: Column, name: str) -> Column:
    """Whether a lower-case text has a section's words, searched as such, or its patterns, searched only where their words are."""
    tests = [F.contains(low, F.lit(NEEDS[p])) & low.rlike(p) if p in NEEDS else F.contains(low, F.lit(p)) for p in SECTIONS[name]]
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def sections(low: Column) -> Column:
    return F.filter(F.array(*[F.when(has_section(low, n), F.lit(n)) for n in SECTIONS]), lambda x: x.isNotNull())


def dates(text: Column) -> Column:
    """Valid dates written day first, then those written year first."""
    dotted = F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}"), F.lit(0)), lambda x: F.try_to_date(F.translate(x, "/", "."), "d.M.yyyy"))
    dashed = F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"), F.lit(0)), lambda x: F.try_to_date(x, "yyyy-M-d"))
    return F.filter(F.concat(dotted, dashed), lambda x: x.isNotNull())


def priority(low: Column) -> Column:
    """Where a page without a usable number stands: 1 first page .. 6 continuation, 2 if nothing tells."""
    tail = F.right(low, F.lit(200))
    return (
        F.when(has_section(low, "patient_info") | has_section(F.substring(low, 1, 200), "header"), 1)
        .when(has_section(low, "lab_values"), 3).when(has_section(low, "diagnosis"), 4).when(has_section(low, "medication"), 5).when(has_section(tail, "continuation"), 6).otherwise(2)
    )


def analysis_confidence(text: Column) -> Column:
    low = F.lower(text)
    score = F.lit(0.5) + F.when(F.coalesce(page_number(text), F.lit(0)) != 0, 0.3).otherwise(0.0) + F.when(F.size(dates(text)) > 0, 0.1).otherwise(0.0)
    return F.round(F.least(score + F.size(sections(low)) * 0.05 + F.when(F.length(text) > 500, 0.1).otherwise(0.0), F.lit(1.0)), 6)


def has_table(text: Column) -> Column:
    """A line of at least three parts between pipes or tabs."""
    return F.exists(F.split(text, "\n", -1), lambda x: F.size(F.split(x, r"[|\t]", -1)) >= 3)


def ordered(pages: DataFrame, batch: str = "batch_id", index: str = "idx", text: str = "text") -> DataFrame:
    """(batch, index, page_number, position): pages by number where at least 70 % of a batch have one
    (unnumbered ones after, by index), else by structure, then index. Windows run within a batch."""
    rows = pages.select(batch, index, page_number(F.col(text)).alias("page_number"), priority(F.lower(F.col(text))).alias("_priority"))
    share = F.avg(F.col("page_number").isNotNull().cast("int")).over(Window.partitionBy(batch))
    rows = rows.withColumn("_by_number", share >= NUMBERED)
    key = F.when(F.col("_by_number"), F.struct(F.col("page_number").isNull().cast("int").alias("a"), F.coalesce("page_number", F.lit(0)).alias("b"), F.col(index).cast("long").alias("c"))).otherwise(
        F.struct(F.col("_priority").alias("a"), F.lit(0).alias("b"), F.col(index).cast("long").alias("c"))
    )
    position = F.row_number().over(Window.partitionBy(batch).orderBy(key))
    return rows.withColumn("position", position).drop("_by_number", "_priority")


def moved_share(ordered_pages: DataFrame, batch: str = "batch_id", index: str = "idx") -> DataFrame:
    """Per batch how many pages moved, and their share."""
    first = F.row_number().over(Window.partitionBy(batch).orderBy(index))
    rows = ordered_pages.withColumn("_first", first)
    return rows.groupBy(batch).agg(F.count_if(F.col("_first") != F.col("position")).alias("moves"), F.round(F.count_if(F.col("_first") != F.col("position")) / F.count("*"), 4).alias("share"))
