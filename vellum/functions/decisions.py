"""Decision tables and heuristic scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases of plain language.
PLAIN = ["this means", "simply put", "in other words", "das bedeutet", "einfach gesagt", "mit anderen worten"]
# Terms that a scanned medical text holds.
SCAN_TERMS = [
    "laborwerte", "befund", "diagnose", "patient", "arzt", "blutbild", "urin", "röntgen", "mrt", "ct", "ultraschall", "mg/dl", "mmol/l", "µg/ml", "ng/ml", "u/l", "iu/l", "normal", "pathologisch",
    "auffällig", "unauffällig",
]
# A number with a unit.
MEASURE = r"(?i)[0-9]+[.,]?[0-9]*[ \t\n\f\r]*(?:mg/dl|mmol/l|µg/l|ng/ml|u/l|iu/l|g/l|%|/µl)"
# Emoji ranges.
EMOJI = "[\U0001f300-\U0001f5ff\U0001f600-\U0001f64f\U0001f680-\U0001f6ff]"
# Lab values by name, with the unit that they get.
LAB_VALUES = [
    (r"(?i)(Hämoglobin|Hb):?[ \t\n\f\r]*([0-9]+[,.]?[0-9]*)[ \t\n\f\r]*(g/dl)?", "Hämoglobin: $2 g/dl"),
    (r"(?i)(Leukozyten|Leukos?):?[ \t\n\f\r]*([0-9]+)[ \t\n\f\r]*(/µl)?", "Leukozyten: $2 /µl"),
    (r"(?i)(Glucose|Glukose|BZ):?[ \t\n\f\r]*([0-9]+)[ \t\n\f\r]*(mg/dl)?", "Glucose: $2 mg/dl"),
    (r"(?i)(Kreatinin|Krea):?[ \t\n\f\r]*([0-9]+[,.]?[0-9]*)[ \t\n\f\r]*(mg/dl)?", "Kreatinin: $2 mg/dl"),
    (r"(?i)(Cholesterin|Chol):?[ \t\n\f\r]*([0-9]+)[ \t\n\f\r]*(mg/dl)?", "Cholesterin: $2 mg/dl"),
    (r"(?i)(TSH):?[ \t\n\f\r]*([0-9]+[,.]?[0-9]*)[ \t\n\f\r]*(mU/l)?", "TSH: $2 mU/l"),
    (r"(?i)(CRP|C-reaktives? Protein):?[ \t\n\f\r]*([0-9]+[,.]?[0-9]*)[ \t\n\f\r]*(mg/l)?", "CRP: $2 mg/l"),
    (r"([0-9]+[,.]?[0-9]*[ \t\n\f\r]*[a-z/]+)[ \t\n\f\r]*\(([0-9]+[,.]?[0-9]*[ \t\n\f\r]*-[ \t\n\f\r]*[0-9]+[,.]?[0-9]*)\)", "$1 (Referenz: $2)"),
]


def _held(terms: list[str], text: Column) -> Column:
    return sum((F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0))


def _count(text: Column, x: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(x), F.lit("")))


def narrative(text: Column) -> Column:
    """Prose: 100 characters, three long sentences or two breaks, few decimals and few separators."""
    long = F.size(F.filter(F.split(text, r"[.!?]+[ \t\n\f\r]+", -1), lambda s: F.length(F.trim(s)) > 30))
    breaks = (F.length(text) - F.length(F.replace(text, F.lit("\n\n"), F.lit("")))) / 2
    few = (F.regexp_count(text, F.lit(r"[0-9]+[.,][0-9]+")) < 5) & (_count(text, "|") < 3) & (_count(text, "\t") < 5)
    return (F.length(F.trim(text)) >= 100) & ((long >= 3) | (breaks >= 2)) & few


def _row(strategy: str, complexity: str, reason: str) -> Column:
    return F.struct(F.lit(strategy).alias("strategy"), F.lit(complexity).alias("complexity"), F.lit(reason).alias("reason"))


def pdf_strategy(coverage: Column, quality: Column, tables: Column, images: Column, ocr: bool = True) -> Column:
    """struct<strategy, complexity, reason>: tables first, then embedded text by coverage and quality, then scans."""
    scan = _row("local_ocr" if ocr else "vision_llm", "moderate", "poor_or_no_embedded_text")
    return (
        F.when(tables & (coverage >= 0.8) & (quality >= 0.6), _row("vision_llm", "moderate", "tables_detected_require_vision_llm"))
        .when(tables, _row("vision_llm", "complex", "tables_detected_require_vision_llm"))
        .when((coverage >= 0.9) & (quality >= 0.7), _row("local_text", "simple", "high_quality_embedded_text_no_tables"))
        .when((coverage >= 0.7) & (quality >= 0.6), _row("local_text", "simple", "good_embedded_text_no_tables"))
        .when((quality >= 0.9) & (coverage >= 0.6), _row("local_text", "moderate", "very_high_quality_text_cost_optimization"))
        .when((quality >= 0.8) & (coverage >= 0.5), _row("local_text", "moderate", "high_quality_moderate_coverage_cost_optimization"))
        .when((coverage >= 0.5) & (quality >= 0.4), _row("local_ocr" if ocr else "local_text", "moderate", "moderate_embedded_text"))
        .when(images, _row("vision_llm", "very_complex", "complex_layout_detected"))
        .otherwise(scan)
    )


def image_strategy(quality: Column, density: Column, tables: Column, forms: Column, ocr: bool = True) -> Column:
    return (
        F.when(tables | forms, _row("vision_llm", "very_complex", "complex_medical_layout"))
        .when((quality >= 0.7) & (density >= 0.05), _row("local_ocr" if ocr else "vision_llm", "simple", "high_quality_with_text"))
        .when((quality >= 0.4) & (density >= 0.02), _row("vision_llm", "moderate", "moderate_quality"))
        .otherwise(_row("vision_llm", "complex", "poor_quality_or_low_text"))
    )


def quality_issues(kind: Column, image: Column, density: Column, coverage: Column, text: Column) -> Column:
    """The names of what is wrong with an upload, in order."""
    is_image, is_pdf = kind == "image", kind == "pdf"
    found = [
        F.when(is_image & (image < 0.4), "poor_image_quality"), F.when(is_image & (image >= 0.4) & (image < 0.7), "moderate_quality"), F.when(is_image & (density < 0.02), "low_text_density"),
        F.when(is_pdf & (coverage < 0.3), "low_text_coverage"), F.when(is_pdf & (text < 0.4), "poor_text_quality"),
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _failed(translated: Column) -> Column:
    return (F.coalesce(translated, F.lit("")) == "") | translated.startswith("Error")


def _within(original: Column, translated: Column, low: float, high: float) -> Column:
    return F.when((F.length(translated) / F.greatest(F.length(original), F.lit(1))).between(low, high), 0.1).otherwise(0.0)


def translation_quality(original: Column, translated: Column) -> Column:
    """0 for none or an error; else 0.6 and more for length, ratio and plain phrases."""
    long = F.when(F.length(translated) > 500, 0.2).when(F.length(translated) > 100, 0.1).otherwise(0.0)
    plain = F.least(_held(PLAIN, F.lower(translated)) * 0.05, F.lit(0.1))
    return F.when(_failed(translated), 0.0).otherwise(F.round(F.least(0.6 + long + _within(original, translated, 0.5, 2.0) + plain, F.lit(1.0)), 6))


def language_quality(original: Column, translated: Column) -> Column:
    """0 for none or an error; else 0.6 and more for length, ratio and emojis that stayed."""
    before, after = F.regexp_count(original, F.lit(EMOJI)), F.regexp_count(translated, F.lit(EMOJI))
    kept = F.when(before > 0, F.least(after / before, F.lit(1.0)) * 0.1).otherwise(0.0)
    long = F.when(F.length(translated) > 50, 0.1).otherwise(0.0)
    return F.when(_failed(translated), 0.0).otherwise(F.round(F.least(0.6 + long + _within(original, translated, 0.7, 1.5) + kept, F.lit(1.0)), 6))


def scan_confidence(text: Column) -> Column:
    """0 for less than ten characters; else 0.7 with length, terms, table rows, marks and measures, less for breaks; at most 0.95."""
    long = sum((F.when(F.length(text) > n, 0.05).otherwise(0.0) for n in (100, 500, 1000)), F.lit(0.0))
    rows = F.regexp_count(text, F.lit(r"\|[^\n]*\|[^\n]*\|"))
    table = F.when(rows >= 2, F.least(rows * 0.01, F.lit(0.1))).otherwise(0.0)
    marks = F.when(F.contains(text, F.lit("|")) | F.contains(text, F.lit("- ")) | F.contains(text, F.lit("## ")), 0.02).otherwise(0.0)
    measures = F.least(F.regexp_count(text, F.lit(MEASURE)) * 0.008, F.lit(0.08))
    breaks = F.least(F.regexp_count(text, F.lit(r"\n[ \t\n\f\r]*\n[ \t\n\f\r]*\n")) * 0.02, F.lit(0.05))
    total = 0.7 + long + F.least(_held(SCAN_TERMS, F.lower(text)) * 0.01, F.lit(0.1)) + table + marks + measures - breaks
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) < 10, 0.0).otherwise(F.round(F.least(total, F.lit(0.95)), 6))


def lab_values(text: Column) -> Column:
    """Lab values with one spelling and their unit; a range in brackets behind a value becomes a reference."""
    for pattern, value in LAB_VALUES:
        text = F.regexp_replace(text, pattern, value)
    return text


def truncated(text: Column, most: int, marker: str) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(marker))).otherwise(text)
