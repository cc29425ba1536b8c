"""Screening texts for prompt injection, sanitising, and leakage of prompts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Name, pattern (any case, ^ at every line), category.
INJECTIONS = [
    ("ignore_previous", r"\bignore\s+(all\s+)?(above|previous|prior)\s+(instructions?|prompts?|text)\b", "role_manipulation"),
    ("new_instructions", r"\b(new|updated|revised)\s+instructions?\b", "role_manipulation"),
    ("system_role", r"^(system|assistant|user)\s*:", "role_manipulation"),
    ("act_as", r"\b(you\s+are\s+now|act\s+as|pretend\s+to\s+be|roleplay\s+as)\b", "role_manipulation"),
    ("forget_everything", r"\b(forget|disregard|override)\s+(everything|all|previous|above)\b", "role_manipulation"),
    ("instead_do", r"\binstead[,\s]+(do|output|respond|write|say)\b", "instruction_override"),
    ("boundary_end", r"---\s*END", "boundary_attack"),
    ("boundary_delimiters", r"={5,}", "boundary_attack"),
    ("repeat_prompt", r"\b(repeat|output|show|display|print)\s+(the\s+|your\s+)?(system\s+prompt|instructions?|prompt)\b", "data_exfiltration"),
    ("what_told", r"\bwhat\s+(were\s+you|are\s+your)\s+(told|instructions?)\b", "data_exfiltration"),
    ("base64_instruction", r"\b(base64|decode|eval)\s*[:(]", "encoding_evasion"),
    ("unicode_escape", r"\\u[0-9a-fA-F]{4}", "encoding_evasion"),
    ("format_string_dunder", r"\{__\w+__", "format_string_attack"),
    ("format_string_globals", r"__globals__", "format_string_attack"),
]
# Categories that make a text at least of medium severity.
SEVERE = ("data_exfiltration", "format_string_attack")
# Code points that don't show.
INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\uffa0"
FLAGS = "(?im)"


def detections(text: Column) -> Column:
    """array<struct<name, category, matched>>: at most one per pattern; matched is its first group, cut to 100."""
    found = []
    for name, pattern, category in INJECTIONS:
        group = 1 if "(" in pattern else 0
        found.append(F.when(text.rlike(FLAGS + pattern), F.struct(F.lit(name).alias("name"), F.lit(category).alias("category"), F.substring(F.regexp_extract(text, FLAGS + pattern, group), 1, 100).alias("matched"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def severity(found: Column) -> Column:
    """0 none, 1 low, 2 medium (two or more, or a severe category), 3 high (four or more)."""
    n = F.size(found)
    return F.when(n >= 4, 3).when((n >= 2) | F.exists(found, lambda x: x.category.isin(*SEVERE)), 2).when(n == 1, 1).otherwise(0)


def screened(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds `detections` and `severity`; patterns run once per text."""
    return df.withColumn("detections", detections(F.coalesce(F.col(column), F.lit("")))).withColumn("severity", severity(F.col("detections")))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which SQL functions lack."""
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def without_invisible(text: Column) -> Column:
    """Braces doubled, then code points that don't show removed."""
    doubled = F.replace(F.replace(text, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))
    return F.translate(doubled, INVISIBLE, "")


def sanitized(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds `clean` and `was_modified`. ASCII texts don't reach Python's normaliser."""
    clean = nfkc(without_invisible(F.col(column)))
    return df.withColumn("clean", clean).withColumn("was_modified", ~F.col("clean").eqNullSafe(F.col(column)))


def word_list(text: Column) -> Column:
    """The white-space separated words in lower case."""
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def grams(df: DataFrame, key: str, n: int = 4, least_words: int = 0) -> DataFrame:
    """(key, gram): the runs of n words of every text of df(key, text) with n and `least_words` words.

    The words are a column below the explosion, so a text is split once, not once per run.
    """
    words = df.select(F.col(key), word_list(F.col("text")).alias("_words"))
    starts = F.when(F.size("_words") >= max(n, least_words), F.sequence(F.lit(1), F.size("_words") - n + 1))
    return words.select(key, "_words", F.explode(starts).alias("_at")).select(key, F.array_join(F.slice("_words", F.col("_at"), n), " ").alias("gram"))


def leaks(prompts: DataFrame, outputs: DataFrame, prompt_key: str, output_key: str, n: int = 4, least_words: int = 5, broadcast_chars: int = 50_000_000) -> DataFrame:
    """Pairs of keys where an output holds n consecutive words of a prompt of at least `least_words` words.

    Both sides are exploded to runs of words and joined on them; the prompts' side is broadcast while
    their texts are measured small (a text has fewer runs than characters), so that outputs aren't shuffled.
    """
    left = grams(prompts, prompt_key, n, least_words).distinct()
    small = (prompts.agg(F.sum(F.length("text"))).first()[0] or 0) <= broadcast_chars
    return grams(outputs, output_key, n).join(F.broadcast(left) if small else left, "gram").select(output_key, prompt_key).distinct()


def validated(output: Column, expected: list[str] | None = None) -> Column:
    """ok, or what is wrong with a step's output: empty, or its first word is none of those expected."""
    first = F.upper(F.element_at(F.split(F.trim(output), r"\s+"), 1))
    wrong = F.when(F.coalesce(F.trim(output), F.lit("")) == "", "empty")
    return F.coalesce(wrong if expected is None else wrong.when(~first.isin(*expected), "unexpected"), F.lit("ok"))
