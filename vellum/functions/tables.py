"""Cleaning of recognised text and structuring of laboratory tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.folds import column_starts

__all__ = ["clean_line", "clean_text", "column_starts", "is_noise", "lab_row", "looks_like_lab", "markdown_row", "mean_confidence"]


def is_noise(line: Column) -> Column:
    """Under three characters, only symbols, or more than three symbols to a letter, digit or underscore."""
    alnum = F.length(F.regexp_replace(line, r"[^\p{L}\p{N}_]", ""))
    symbols = F.length(F.regexp_replace(line, r"[\p{L}\p{N}_\s]", ""))
    return (F.length(line) < 3) | line.rlike(r"^[^\p{L}\p{N}_\s]+$") | line.rlike(r"^[_\-=]+$") | ((alnum > 0) & (symbols > 3 * alnum))


def lab_row(parts: Column) -> Column:
    """name: value unit (Referenz: range) of the parts that there are."""
    at = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
    lead = F.concat(at(0), F.lit(": "), at(1))
    unit = F.when(at(2) != "", F.concat(F.lit(" "), at(2))).otherwise("")
    reference = F.when(at(3) != "", F.concat(F.lit(" (Referenz: "), at(3), F.lit(")"))).otherwise("")
    return F.when(F.size(parts) >= 4, F.concat(lead, unit, reference)).when(F.size(parts) == 3, F.concat(lead, F.lit(" "), at(2))).otherwise(lead)


def looks_like_lab(parts: Column) -> Column:
    """A name first, a number in one of the other parts."""
    first = F.get(parts, 0)
    number = F.exists(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.rlike("[0-9]"))
    return (F.size(parts) >= 2) & number & (F.length(first) > 1) & ~first.rlike("^[0-9]+$") & ~first.rlike(r"^[.\-_=><]+$")


def clean_line(line: Column) -> Column:
    """One line with its pipes resolved and white space collapsed."""
    line = F.regexp_replace(F.regexp_replace(line, r"\|\s*\|+", "|"), r"^\|\s*|\s*\|$", "")
    parts = F.filter(F.transform(F.split(line, r"\|", -1), lambda x: F.trim(x)), lambda x: x != "")
    joined = F.when(F.size(parts) == 2, F.concat(F.get(parts, 0), F.lit(": "), F.get(parts, 1))).when((F.size(parts) > 2) & looks_like_lab(parts), lab_row(parts)).when(F.size(parts) > 2, F.array_join(parts, "  ")).otherwise(line)
    return F.trim(F.regexp_replace(F.when(F.contains(line, F.lit("|")), joined).otherwise(line), r"\s+", " "))


def clean_text(text: Column) -> Column:
    """All lines cleaned, noise and empty lines left out."""
    lines = F.transform(F.split(text, "\n", -1), clean_line)
    return F.array_join(F.filter(lines, lambda x: ~is_noise(x) & (x != "")), "\n")


def mean_confidence(scores: Column) -> Column:
    """The mean of line scores, missing or zero ones counting 0.9; 0 without lines."""
    filled = F.transform(scores, lambda s: F.coalesce(F.nullif(s, F.lit(0.0)), F.lit(0.9)))
    return F.coalesce(F.round(F.try_divide(F.aggregate(filled, F.lit(0.0), lambda a, x: a + x), F.size(scores).cast("double")), 6), F.lit(0.0))


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
