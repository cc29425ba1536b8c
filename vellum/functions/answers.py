"""Answers of models and forms: JSON in any wrapping, classes and their hints, validity of feedback, routing, prompts, tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What to attend to by class.
FOCUS = {
    "ARZTBRIEF": ["treatment_recommendations", "medication_changes", "follow_up_appointments", "diagnoses"],
    "BEFUNDBERICHT": ["examination_findings", "abnormalities", "size_descriptions", "follow_up_examinations"],
    "LABORWERTE": ["abnormal_values", "reference_ranges", "trends", "critical_values"],
}
HANDLING = {
    "ARZTBRIEF": ["preserve_doctor_recommendations", "highlight_patient_actions"],
    "BEFUNDBERICHT": ["use_visual_comparisons", "explain_medical_imaging_terms"],
    "LABORWERTE": ["preserve_all_numbers", "maintain_table_structure", "use_color_coding_analogies"],
}
RATING_KEYS = ["clarity", "accuracy", "formatting", "speed"]
FAST_WORDS = ["grammar", "formatting", "format", "structure", "layout", "final check", "validation", "template", "language_translation"]
LANGUAGES = {"en": "English", "fr": "Français", "es": "Español", "it": "Italiano", "pt": "Português", "nl": "Nederlands", "pl": "Polski"}
# End of the fixed values.

ANALYSIS = "struct<pii_issues:array<string>,translation_issues:array<string>,recommendations:array<string>,overall_quality_score:double,detailed_analysis:string>"


def parsed(text: Column) -> Column:
    """struct<pii_issues, translation_issues, recommendations, overall_quality_score, detailed_analysis, parse_error> of an answer: the whole
    text as JSON, else from its first to its last curly bracket, else an error that quotes the first 1,000 characters."""
    inner = F.regexp_extract(text, r"\{[\s\S]*\}", 0)
    # a parser stops behind the first value; in brackets, what follows it is an error
    valid = lambda t: (F.trim(t) != "") & F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))).isNotNull()
    json = F.when(valid(text), text).when(valid(inner), inner)
    good = F.from_json(json, ANALYSIS.removeprefix("struct<").removesuffix(">").replace(":", " "))
    error = F.struct(
        F.expr("cast(array() as array<string>)").alias("pii_issues"), F.array(F.lit("Failed to parse AI analysis response")).alias("translation_issues"), F.array(F.lit("Check AI response format")).alias("recommendations"),
        F.lit(0.0).alias("overall_quality_score"), F.concat(F.lit("Raw response: "), F.left(F.coalesce(text, F.lit("")), F.lit(1000))).alias("detailed_analysis"),
    )
    return F.when(json.isNotNull(), good).otherwise(error).withField("parse_error", json.isNull())


def class_of_answer(text: Column) -> Column:
    """struct<document_class, confidence>: the class that an answer names, 0.9; else the first class, 0.5."""
    up = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    named = F.when(F.contains(up, F.lit("ARZTBRIEF")), "ARZTBRIEF").when(F.contains(up, F.lit("BEFUNDBERICHT")), "BEFUNDBERICHT").when(F.contains(up, F.lit("LABOR")), "LABORWERTE")
    return F.struct(F.coalesce(named, F.lit("ARZTBRIEF")).alias("document_class"), F.when(named.isNotNull(), 0.9).otherwise(0.5).alias("confidence"))


def hints(document_class: Column) -> Column:
    """struct<focus_areas, special_handling>; empty for an unknown class."""
    none = F.expr("cast(array() as array<string>)")
    of = lambda table: F.coalesce(F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), document_class), none)
    return F.struct(of(FOCUS).alias("focus_areas"), of(HANDLING).alias("special_handling"))


def feedback_faults(rating: Column, details: Column) -> Column:
    """What is wrong with feedback, in order: rating, key:<name> or value:<name> of its detailed ratings (map<string,int>)."""
    entries = F.map_entries(F.coalesce(details, F.expr("cast(map() as map<string,int>)")))
    wrong = F.transform(entries, lambda e: F.when(~e["key"].isin(*RATING_KEYS), F.concat(F.lit("key:"), e["key"])).when(~e["value"].between(1, 5), F.concat(F.lit("value:"), e["key"])))
    first = F.when(F.coalesce(~rating.between(1, 5), F.lit(True)), "rating")
    return F.array_compact(F.concat(F.array(first), F.array_sort(wrong)))


def uses_fast_model(task: Column) -> Column:
    low = F.lower(F.coalesce(task, F.lit("")))
    return F.exists(F.array(*map(F.lit, FAST_WORDS)), lambda w: F.contains(low, w))


def is_table(rows: Column) -> Column:
    """Whether cells (array of rows) are a table: two rows, two cells in the first, 30 % of all filled."""
    filled = F.aggregate(rows, F.lit(0), lambda a, r: a + F.size(F.filter(r, lambda c: F.trim(c) != "")))
    every = F.aggregate(rows, F.lit(0), lambda a, r: a + F.size(r))
    return (F.size(rows) >= 2) & (F.size(F.get(rows, F.lit(0))) >= 2) & (filled >= 0.3 * every)


def bilingual(german: Column, translated: Column, language: Column, heading: str) -> Column:
    """A German answer and its translation under a heading, the language by its name or, if that is unknown, its code in capitals."""
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), language), F.upper(language))
    return F.concat(F.lit(f"\n\n---\n\n{heading}\n\n### Deutsch (Original)\n\n"), german, F.lit("\n\n### "), label, F.lit(" (Translation)\n\n"), translated)
