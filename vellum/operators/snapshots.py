"""Inserts, updates and deletes on a snapshot by a keyed merge: the next snapshot and a log of what each key's changes came to.

changes(op, seq, key, columns...): `insert` sets all columns of a key (also of one that is there), `update` those of its
columns that are not null, `delete` takes the row away; updates and deletes of a missing row do nothing. Changes of a key
count in the order of seq, equal ones the later the greater their op and columns. The changes of a key are aggregated, partly before the shuffle, to its last full
change and the last value of each column since, so a key of very many changes meets nowhere as rows. Running the same changes on the
result gives the result again.

Edge cases: null keys, ops other than those three and null seqs are ignored; a snapshot's own repeated keys all change alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPS = ("insert", "update", "delete")


def _net(changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per key: the last insert or delete, and of each column its last value from there on."""
    good = changes.where(F.col("op").isin(*OPS) & F.col(key).isNotNull() & F.col("seq").isNotNull())
    place = F.struct("seq", "op", *columns)
    full = F.when(F.col("op") != "update", place)
    base = good.groupBy(key).agg(F.max(full).alias("_base"))
    # the values that a full change leaves behind are cut off by its place; both aggregations share the key's partitioning
    later = good.join(base, key).where(F.col("_base").isNull() | (place >= F.col("_base")))
    last = [F.max_by(c, F.when(F.col(c).isNotNull() | (F.col("op") == "insert"), place)).alias(f"_new_{c}") for c in columns]
    touched = F.max((F.col("op") == "update").cast("int")).alias("_updates")
    return later.groupBy(key).agg(F.first("_base.op").alias("_base"), touched, *last, *[F.max(F.when(F.col("op") == "insert", 1).when(F.col(c).isNotNull(), 1).otherwise(0)).alias(f"_has_{c}") for c in columns])


def _merged(snapshot: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    columns = [c for c in snapshot.columns if c != key]
    return snapshot.withColumn("_old", F.lit(True)).join(_net(changes, key, columns), key, "full_outer")


def applied(snapshot: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The next snapshot."""
    both = _merged(snapshot, changes, key)
    there = (F.col("_base") == "insert") | (F.col("_base").isNull() & F.col("_old"))
    columns = [F.when(F.col(f"_has_{c}") == 1, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c != key else F.col(c) for c in snapshot.columns]
    return both.where(there).select(*columns)


def change_log(snapshot: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """(key, action) of every changed key: inserted, replaced, updated, deleted or ignored."""
    both = _merged(snapshot, changes, key).where(F.col("_updates").isNotNull())
    old = F.coalesce("_old", F.lit(False))
    action = F.when(F.col("_base") == "insert", F.when(old, "replaced").otherwise("inserted")).when(F.col("_base") == "delete", F.when(old, "deleted").otherwise("ignored")).when(old, "updated").otherwise("ignored")
    return both.select(key, action.alias("action")).distinct()


def newest(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """Each key's newest n rows. Spark keeps n rows a key in every task before the shuffle, so a key of most rows is cut down where it lies."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])))
    return ranked.where(F.col("_rank") <= n).drop("_rank")
