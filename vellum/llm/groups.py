"""Groups of near-duplicates: one row of each group stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import broadcast_within, materialize, spread_join


def text_key() -> Column:
    """A 64-bit hash of the text; equal texts have equal shingles."""
    return F.xxhash64(F.col("text").cast("string"))


def keep_least(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that hold the least (doc_id, text_key) of their root in found(doc_id, text_key, root); of
    equal ones, one row. Rows without a doc_id stay, as nothing tells which of a group they are."""
    found = materialize(found.where("doc_id is not null").groupBy("doc_id", "text_key", "root").count(), "groups")
    least = found.groupBy("root").agg(F.count("*").alias("n"), F.sum("count").alias("m"), F.min(F.struct("doc_id", "text_key")).alias("least")).where("m > 1")
    marked = materialize(spread_join(found, least, "root", "text_key").withColumn("is_least", (F.col("doc_id") == F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key"))), "marked")
    keys = [F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")]
    dropped = marked.where("not is_least").select(*keys)
    same = (F.col("doc_id").cast("long") == F.col("__id")) & (text_key() == F.col("__key"))
    kept = docs.join(broadcast_within(dropped), same, "left_anti")
    twice = marked.where("is_least and count > 1").select(*keys)
    if twice.isEmpty():
        return kept
    side = broadcast_within(twice)
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    again = kept.join(side, same, "left_semi").select(F.col("doc_id").alias("__id"), text_key().alias("__key"), every.alias("__row"), order.alias("__order"))
    one = again.groupBy("__id", "__key").agg(F.min_by("__row", "__order").alias("__row")).select("__row.*")
    return kept.join(side, same, "left_anti").union(one)
