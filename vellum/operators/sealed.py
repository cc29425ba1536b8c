"""Encrypted columns: sealed values with a key's version, key rotation, equality by a search hash, substring search after opening.

A sealed value is `version:base64(AES-256-GCM)` bound to its column's name, so that it opens in no other column. The search hash
is deterministic (SHA-256 of the value): an equality joins on it, and only what it finds is opened. Substrings can't be pushed
below the encryption: every value is opened where it lies.

Edge cases: null and blank values seal to null; a value without a known version is a legacy plain value and is returned as it is;
a value that no key opens (another key, another column, a cut value) opens to null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_of(secret: str) -> Column:
    """The 32 bytes of a key from a secret; pass secrets from the session's configuration, not from code."""
    return F.unhex(F.sha2(F.lit(secret), 256))


def sealed(value: Column, name: str, version: str, secret: str) -> Column:
    box = F.aes_encrypt(value.cast("binary"), key_of(secret), F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.lit(name))
    return F.when(F.trim(value) != "", F.concat(F.lit(version + ":"), F.base64(box)))


def is_legacy(value: Column, versions: Sequence[str]) -> Column:
    """Whether a value bears none of the versions."""
    return ~F.coalesce(F.split(value, ":", 2)[0].isin(*versions) & F.contains(value, F.lit(":")), F.lit(True))


def opened(value: Column, name: str, keys: Mapping[str, str]) -> Column:
    """The value behind a sealed one, by the key of its version."""
    out = F.when(is_legacy(value, list(keys)), value)
    for version, secret in keys.items():
        box = F.try_to_binary(F.substr(value, F.lit(len(version) + 2)), F.lit("base64"))
        out = out.when(value.startswith(version + ":"), F.try_aes_decrypt(box, key_of(secret), F.lit("GCM"), F.lit("DEFAULT"), F.lit(name)).cast("string"))
    return out


def rotated(value: Column, name: str, keys: Mapping[str, str], version: str) -> Column:
    """A value sealed anew under a version; one that bears it already stays, one that no key opens stays as well."""
    inner = opened(value, name, keys)
    return F.when(value.startswith(version + ":") | inner.isNull(), value).otherwise(sealed(inner, name, version, keys[version]))


def search_hash(value: Column) -> Column:
    """The deterministic hash by which an encrypted column is looked up; null for null and empty."""
    return F.when(value != "", F.sha2(value, 256))


def seal_columns(df: DataFrame, columns: Sequence[str], version: str, secret: str) -> DataFrame:
    """df with the columns sealed and `<column>_search` beside each."""
    return df.withColumns({**{f"{c}_search": search_hash(F.col(c)) for c in columns}, **{c: sealed(F.col(c), c, version, secret) for c in columns}})


def open_columns(df: DataFrame, columns: Sequence[str], keys: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: opened(F.col(c), c, keys) for c in columns}).drop(*[f"{c}_search" for c in columns])


def look_up(df: DataFrame, column: str, wanted: DataFrame, columns: Sequence[str], keys: Mapping[str, str]) -> DataFrame:
    """Rows whose encrypted column equals one of wanted(value): met by hash, then opened, then compared."""
    asked = wanted.where("value <> ''").select("value", search_hash(F.col("value")).alias(f"{column}_search")).distinct()
    found = open_columns(df.join(asked, f"{column}_search").withColumn("_asked", F.col("value")).drop("value"), columns, keys)
    return found.where(F.col(column) == F.col("_asked")).drop("_asked")


def search(df: DataFrame, term: str, columns: Sequence[str], keys: Mapping[str, str], order: str, limit: int = 50) -> DataFrame:
    """The first rows in which a column holds the term, whatever its case, after opening."""
    plain = open_columns(df, columns, keys)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False))
    return plain.where(hit).orderBy(order).limit(limit)
