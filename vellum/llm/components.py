"""Connected components of a link table by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every round is two joins on
node keys. The nodes' minima are broadcast while the links are counted few; beyond that, links of one node are spread over
tasks by their other end. Either way a node with very many links is neither one task nor one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import BROADCAST_ROWS, materialize, new_path, remove, spread_join


#: Rounds are logarithmic in the longest path; more than these mean a fault.
ROUNDS = 200


def _minimum(links: DataFrame) -> DataFrame:
    """For each node `u` the least of itself and its neighbours `v`."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _met(edges: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    """The links with `m` of their `u`; there are at most 2 * rows nodes."""
    return edges.join(F.broadcast(least), "u") if 2 * rows <= BROADCAST_ROWS else spread_join(edges, least, "u", "v")


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _met(both, _minimum(both), rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = _met(down, least, rows).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links of longs -> (node, root): the least node that each linked node reaches.

    Self links and nulls are ignored, repeated links count once, an empty table gives an empty one.
    """
    spark = edges.sparkSession
    old, seen = "", None
    edges = edges.where("u <> v").select("u", "v")
    rows = edges.count()
    for _ in range(ROUNDS):
        path, between = new_path(spark, "links"), new_path(spark, "stars")
        # stored, as the small star reads them three times
        large = materialize(_large_star(edges, rows), "stars", between)
        edges = materialize(_small_star(large, rows).where("u <> v").distinct(), "links", path)
        remove(spark, between)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if old:
            remove(spark, old)
        if (now.n, now.h) == seen:
            break
        old, seen, rows = path, (now.n, now.h), now.n
    else:
        raise RuntimeError(f"components are not final after {ROUNDS} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(roots.select(F.col("root").alias("node"), "root").distinct())
