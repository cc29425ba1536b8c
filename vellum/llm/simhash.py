"""SimHash near-duplicates under a Hamming limit by the generalised pigeonhole principle.

A document's fingerprint has a bit where over half of its shingle hashes have it. Fingerprints link
at `limit` or fewer differing bits. Search (Qin et al., "GPH: Similarity Search in Hamming Space"):
the 64 bits are dealt to m partitions, correlated bits together; partition i gets a threshold T_i
with sum(T_i) = limit - m + 1, so that a pair within the limit is within T_i in some partition. Dynamic
programming picks the T_i (and m) of least estimated cost: probes plus candidates, estimated on a
bounded sample of fingerprints. Each distinct fingerprint is indexed under its bits of each partition,
probes all values within T_i of its own, and every candidate is verified on all 64 bits.

Equal fingerprints are one node, so copies make no pairs. A partition value shared by more than
`hot_bucket` distinct fingerprints makes no pairs either: its members and probers go to the exact
linear way, where each emits every point within limit // 2 bits and fingerprints that meet at a point
are linked to the least of them. That reaches the same components for an even limit.

Edge cases: null or wordless text has fingerprint 0, which links like any other; fewer words than the
shingle are one shingle; equal rows share a component; a null doc_id is never a component's id unless
all of its ids are null; other columns are carried through untouched; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import broadcast_if_small, chunks, materialize, spread_join, table
from vellum.llm.components import components
from vellum.llm.groups import keep_least, text_key

SEED = 42
SHINGLE = 4
LIMIT = 4
#: Distinct fingerprints from which bit correlation and candidate counts are estimated.
SAMPLE = 4096
#: Distinct fingerprints under one partition value beyond which no pairs are made.
HOT_BUCKET = 2048


def fingerprint_of(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a text's UTF-8 bytes; 0 if it has no words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)],
        dtype=np.uint64,
    )
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprints(shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            texts = part.column("text").cast(pa.binary())
            out = pa.array([fingerprint_of(x.as_py(), shingle) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), out], ["doc_id", "text_key", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp) of every row of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("text_key"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, text_key long, fp long")


@dataclass(frozen=True)
class Probe:
    """Partitions as bit masks, each with its threshold (-1: not probed)."""

    masks: tuple[int, ...]
    thresholds: tuple[int, ...]


def _group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """Deals the 64 bits to m partitions of near-equal width, each grown around its most correlated bits."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    bits -= bits.mean(axis=0)
    norm = np.sqrt((bits**2).sum(axis=0))
    near = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-9)
    np.fill_diagonal(near, 0)
    free, groups = set(range(64)), []
    for g in range(m):
        width = len(free) // (m - g)
        left = sorted(free)
        group = [max(left, key=lambda b: (near[b, left].max(), -b))]
        while len(group) < width:
            rest = sorted(free - set(group))
            group.append(max(rest, key=lambda b: (near[b, group].mean(), -b)))
        free -= set(group)
        groups.append(sorted(group))
    return groups


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def plan_probe(sample: np.ndarray, distinct: int, limit: int = LIMIT) -> Probe:
    """Chooses the partitions and thresholds of least estimated cost over `distinct` fingerprints.

    The cost of a partition at threshold t: one row per probe, and as many candidates as the share of
    sampled pairs within t there (or of random pairs, if that is more) makes of all pairs.
    """
    sample = np.asarray(sample, dtype=np.int64).view(np.uint64)
    n, best = len(sample), (math.inf, None)
    for m in range(1, limit + 2):
        groups, total = _group_bits(sample, m), limit - m + 1
        costs = []
        for group in groups:
            mask, width = np.uint64(sum(1 << b for b in group)), len(group)
            within = np.zeros(limit + 1)
            for at in range(0, n, 256):
                distance = np.bitwise_count((sample[at : at + 256, None] ^ sample[None, :]) & mask)
                within += np.bincount(np.minimum(distance, limit + 1).ravel(), minlength=limit + 2)[: limit + 1]
            within[0] -= n
            share = np.cumsum(within) / max(n * (n - 1), 1)
            probes = np.cumsum([math.comb(width, k) for k in range(limit + 1)])
            pairs = np.maximum(share, probes / 2.0**width) * distinct
            costs.append([0.0, *(distinct * (1 + probes[t] + pairs[t]) for t in range(max(total + m - 1, 0) + 1) if t <= limit)])
        # least[s]: cost and thresholds of the partitions so far whose thresholds + 1 sum to s
        least: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for cost in costs:
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for (s, (c, chosen)), (t, extra) in itertools.product(least.items(), enumerate(cost)):
                if s + t <= limit + 1 and c + extra < step.get(s + t, (math.inf,))[0]:
                    step[s + t] = (c + extra, (*chosen, t - 1))
            least = step
        cost, thresholds = least[total + m]
        if cost < best[0]:
            masks = tuple(_signed(sum(1 << b for b in group)) for group in groups)
            best = (cost, Probe(masks, thresholds))
    return best[1]


def _flips(mask: int, threshold: int) -> list[int]:
    bits = [b for b in range(64) if (mask >> b) & 1]
    return [_signed(sum(1 << b for b in c)) for k in range(threshold + 1) for c in itertools.combinations(bits, k)]


def links(distinct: DataFrame, limit: int = LIMIT, sample: int = SAMPLE, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(u, v) links between the distinct longs of column `fp` that connect all within the limit."""
    if limit % 2:
        raise ValueError("the limit must be even")
    count = distinct.count()
    some = distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()
    empty = distinct.select(F.col("fp").alias("u"), F.col("fp").alias("v")).where("false")
    if count < 2:
        return empty
    probe = plan_probe(np.array([r.fp for r in some], dtype=np.int64), count, limit)
    used = [(i, m, t) for i, (m, t) in enumerate(zip(probe.masks, probe.thresholds, strict=True)) if t >= 0]
    index = distinct.select(
        "fp", F.inline(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, m, _ in used]))
    )
    buckets = materialize(index.groupBy("part", "value").count().where(F.col("count") > hot_bucket), "hot")
    hot = buckets.count()
    offsets = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(m).alias("mask"), F.lit(x).alias("flip")) for i, m, t in used for x in _flips(m, t)])
    flips = F.transform(offsets, lambda x: F.struct(x.part.alias("part"), F.col("fp").bitwiseAND(x.mask).bitwiseXOR(x.flip).alias("value")))
    probes = distinct.select(F.col("fp").alias("probe"), F.inline(flips))
    found = empty
    if hot:
        side = broadcast_if_small(buckets.select("part", "value"), hot)
        members = index.join(side, ["part", "value"], "left_semi").select("fp")
        probers = probes.join(side, ["part", "value"], "left_semi").select(F.col("probe").alias("fp"))
        found = _meeting(members.union(probers).distinct(), limit)
        index, probes = index.join(side, ["part", "value"], "left_anti"), probes.join(side, ["part", "value"], "left_anti")
    # Spark takes exploded rows to be as large as the table before and would broadcast them from the driver
    pairs = index.hint("merge").join(probes.hint("merge"), ["part", "value"]).where((F.col("fp") < F.col("probe")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("probe"))) <= limit))
    return found.union(pairs.select(F.col("probe").alias("u"), F.col("fp").alias("v")))


def _meeting(fps: DataFrame, limit: int) -> DataFrame:
    """Links each fingerprint to the least that shares a point within limit // 2 bits of both."""
    ball = F.array(*[F.lit(x) for x in _flips(-1, limit // 2)])
    points = fps.select("fp", F.explode(F.transform(ball, lambda x: F.col("fp").bitwiseXOR(x))).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
    # exploded rows are many times what Spark takes them for, so neither side may be broadcast
    return spread_join(points.hint("merge"), least.hint("merge"), "point", "fp").where("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct()


def near_duplicates(docs: DataFrame, limit: int = LIMIT, shingle: int = SHINGLE, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id) of every row: its component's least fingerprint as a signed number,
    and the least doc_id that its fingerprint reaches."""
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(materialize(links(distinct.select("fp"), limit, hot_bucket=hot_bucket), "pairs"))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = spread_join(rooted.select("fp", "root"), least, "root", "fp").select("fp", "root", "component_id")
    return spread_join(prints, named, "fp", "doc_id").select("doc_id", "text_key", "fp", "root", "component_id")


def deduplicate(docs: DataFrame, limit: int = LIMIT, shingle: int = SHINGLE) -> DataFrame:
    """One row of docs for each component of fingerprints, that of the least doc_id and text."""
    # not by component_id: rows of one doc_id with different texts may lie in several components
    return keep_least(docs, near_duplicates(docs, limit, shingle).select("doc_id", "text_key", "root"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
