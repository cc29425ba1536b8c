"""Masking contact data, tidying placeholders, and judging what a redaction removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.folds import bound

#: Contact data that a step masks whatever the language: kind, pattern, placeholder. Personal data of letters is removed by functions/privacy.
CONTACTS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "[EMAIL]"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?:\s?[0-9]{4}){4,6}(?:\s?[0-9]{1,3})?\b", "[IBAN]"),
    ("phone", r"\+[0-9]{1,3}[\s-]?(?:\([0-9]{2,5}\)|[0-9]{2,5})[\s-]?[0-9]{3,}(?:[\s-]?[0-9]{2,})*", "[PHONE]"),
    ("ip", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "[IP]"),
    ("card", r"\b[0-9]{13,16}\b", "[CARD]"),
]
#: What every match of a kind holds.
_NEEDS = {"email": "@", "phone": "+", "ip": "."}
#: The same matches: a local part is entered at its first character or behind a match, and never given up in part.
_QUICK = {"email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"}
# Clean-up of placeholders that passes left side by side, in order.
CLEANUP = [
    (r"\[NAME\]\s*\[NAME\]", "[NAME]"), (r"\[DOCTOR_NAME\]\s*\[DOCTOR_NAME\]", "[DOCTOR_NAME]"), (r"\[PATIENT_NAME\]\s*\[PATIENT_NAME\]", "[PATIENT_NAME]"), (r"\[NAME\]\[PATIENT_NAME\]", "[PATIENT_NAME]"),
    (r"\[NAME\]\[DOCTOR_NAME\]", "[DOCTOR_NAME]"), (r"\[DOCTOR_NAME\]\[NAME\]", "[DOCTOR_NAME]"), (r"\[PATIENT_ID\]\[PLZ_CITY\]", "[PATIENT_ID] [PLZ_CITY]"), (r"\[REFERENCE_ID\]\[PLZ_CITY\]", "[REFERENCE_ID] [PLZ_CITY]"),
    (r"\b[0-9]{5,}\[PLZ_CITY\]", "[PHONE]"), (r"\b[0-9]{5,}\[LOCATION\]", "[PHONE]"), (r"\[\]\s*", ""),
]


def _may(kind: str, text: Column) -> Column:
    return F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else F.lit(True)


def masked(text: Column) -> Column:
    """The text with all contact data masked, kind after kind; each pattern is compiled once and run only on texts that hold what its matches hold."""

    def one(kind, pattern, placeholder):
        return lambda x: F.when(_may(kind, x), F.regexp_replace(x, _QUICK.get(kind, pattern), placeholder)).otherwise(x)

    for contact in CONTACTS:
        text = bound(text, one(*contact))
    return text


def with_counts(df: DataFrame, column: str = "text") -> DataFrame:
    """df with `masked` and `n_<kind>`, each kind counted where the kinds before left it."""
    out = df.withColumn("masked", F.coalesce(F.col(column), F.lit("")))
    for kind, pattern, placeholder in CONTACTS:
        pattern, some = _QUICK.get(kind, pattern), _may(kind, F.col("masked"))
        out = out.withColumn("_after", F.when(some, F.regexp_replace("masked", pattern, placeholder)).otherwise(F.col("masked")))
        out = out.withColumns({f"n_{kind}": F.when(F.col("_after") == F.col("masked"), 0).otherwise(F.regexp_count("masked", F.lit(pattern))), "masked": F.col("_after")})
    return out.drop("_after")


def cleaned(text: Column) -> Column:
    """Placeholders side by side merged or spaced."""

    def all_passes(x):
        for pattern, placeholder in CLEANUP:
            x = F.regexp_replace(x, pattern, placeholder)
        return x

    # every match of every pass holds a placeholder behind another or a digit, or an empty one
    some = lambda x: F.contains(x, F.lit("[")) & (F.contains(x, F.lit("[]")) | x.rlike(r"[\]0-9]\s*\["))
    return bound(text, lambda x: F.when(some(x), all_passes(x)).otherwise(x))


def fixes(before: Column, after: Column) -> Column:
    """How many placeholders a clean-up took away; 1 if it only added some."""
    count = lambda t: F.length(t) - F.length(F.replace(t, F.lit("["), F.lit("")))
    return F.when(before == after, 0).when(count(before) < count(after), 1).otherwise(count(before) - count(after))


def evaluation(df: DataFrame, must_go: str, must_stay: str, text: str, clean: str) -> DataFrame:
    """Per row: terms that are still there, and terms of the text that are gone."""
    left = F.filter(F.col(must_go), lambda t: F.contains(F.col(clean), t))
    gone = F.filter(F.col(must_stay), lambda t: F.contains(F.col(text), t) & ~F.contains(F.col(clean), t))
    return df.withColumns({"false_negatives": F.size(left), "false_positives": F.size(gone)})
