"""Reconciling two sets: registries, schemas, term lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.documents import base_key


def sync_plan(registry: DataFrame, store: DataFrame, name: str = "name") -> DataFrame:
    """(action, name, replaces): add, update or delete that brings the store to the registry.

    Names on one side only, joined on their version-less key: a key on both sides is an update.
    """
    wanted, have = registry.select(F.col(name)).distinct(), store.select(F.col(name)).distinct()
    new = wanted.join(have, name, "left_anti").withColumn("key", base_key(F.col(name)))
    old = have.join(wanted, name, "left_anti").withColumn("key", base_key(F.col(name)))
    both = new.join(old.withColumnRenamed(name, "_old"), "key", "full")
    action = F.when(F.col("_old").isNull(), "add").when(F.col(name).isNull(), "delete").otherwise("update")
    return both.select(action.alias("action"), F.coalesce(name, "_old").alias("name"), F.when(action == "update", F.col("_old")).alias("replaces"))


def schema_diff(old: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """(name, outcome): new, removed, modified or common columns, compared null-safely."""
    values = [c for c in old.columns if c != key]
    both = old.withColumn("_a", F.lit(True)).alias("a").join(new.withColumn("_b", F.lit(True)).alias("b"), key, "full")
    same = F.lit(True)
    for c in values:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return both.select(key, F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "removed").when(same, "common").otherwise("modified").alias("outcome"))


def merge_terms(current: DataFrame, more: DataFrame, column: str = "term") -> DataFrame:
    """Current terms, and of the others those not there in any case, one spelling each."""
    low = more.withColumn("_low", F.lower(column)).groupBy("_low").agg(F.min(column).alias(column))
    added = low.join(current.select(F.lower(column).alias("_low")), "_low", "left_anti").select(column)
    return current.select(column).union(added)


def without_terms(terms: DataFrame, excluded: DataFrame, column: str = "term") -> DataFrame:
    return terms.join(excluded.select(F.lower(column).alias("_low")).distinct(), F.lower(F.col(column)) == F.col("_low"), "left_anti")
