"""Bottom-k sketches of word shingle hashes.

A document's sketch is the `k` least distinct hashes of its shingles (Broder). Sketches merge: the k
least of two sketches' union sketch the union of the texts' shingles. From two sketches follow the
resemblance (the share of the k least of the union that both hold), the containment and, from the
k-th least hash, the number of distinct shingles. Words are split at ASCII white space with A-Z
lower-cased; shingles are five words, and a text of fewer words is one shingle.

Words are hashed for a whole chunk of texts at once: with B odd, the prefix sums P of b_i * B^i modulo
2^64 give the hash of bytes s..e as (P[e] - P[s]) * B^-s.

Edge cases: null or wordless text has an empty sketch; two empty sketches are alike (1), an empty and
another are not (0); repeated rows have equal sketches; extra columns are ignored; an empty table
gives no rows; a null doc_id comes first in the order of documents.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import chunks, default_parallelism, materialize, table

K = 128
SHINGLE = 5
#: Sketches merged in one group at most.
FAN_IN = 256

_B = 0x9E3779B97F4A7C15
_U = np.uint64
#: One odd multiplier per place in a shingle, and one value per byte, both from a fixed seed.
_PLACES = np.random.default_rng(5).integers(0, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_BYTES = np.random.default_rng(6).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTES[np.arange(65, 91)] = _BYTES[np.arange(97, 123)]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^0 .. B^n and their inverses modulo 2^64."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(n, 1 << 16) * 5 // 4
        for name, base in (("up", _B), ("down", pow(_B, -1, 1 << 64))):
            _POWERS[name] = np.concatenate((np.ones(1, _U), np.multiply.accumulate(np.full(size, base, dtype=_U))))
    return _POWERS["up"][: n + 1], _POWERS["down"][: n + 1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all texts' words, and where each text's words start, with the end."""
    data = b" ".join(texts)
    if not data:
        return np.zeros(0, _U), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)
    up, down = _powers(len(raw))
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(_BYTES[raw] * up[: len(raw)])))
    letter = np.concatenate(([False], ~_SPACE[raw], [False]))
    turns = np.flatnonzero(letter[1:] != letter[:-1])
    starts, ends = turns[::2], turns[1::2]
    words = _mixed((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(_U))
    text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    return words, np.concatenate(([0], np.searchsorted(starts, text_ends)))


def shingle_hashes(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The 64-bit hashes of every text's shingles, in order, repeats included."""
    words, bounds = word_hashes(texts)
    width = max(len(words) - shingle + 1, 0)
    total = np.zeros(width, dtype=_U)
    for j in range(shingle):
        total += words[j : j + width] * _PLACES[j]
    total = _mixed(total)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(total[a : b - shingle + 1])
        elif b > a:
            out.append(_mixed(np.array([(words[a:b] * _PLACES[: b - a]).sum(dtype=_U)])))
        else:
            out.append(total[:0])
    return out


def sketch_of(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k least distinct hashes, ascending, without their lowest 16 bits."""
    return np.unique(hashes >> _U(16))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated share of shared shingles among all of both."""
    both = np.concatenate((a, b))
    if not len(both):
        return 1.0
    both.sort()
    first = np.concatenate(([True], both[1:] != both[:-1]))
    least = min(k, int(first.sum()))
    limit = both[np.flatnonzero(first)[least - 1]]
    return int(np.count_nonzero(~first & (both <= limit))) / least


def distinct_shingles(sketch: np.ndarray, k: int = K) -> float:
    """The estimated number of distinct shingles: exact below k."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) * float(1 << 48) / float(sketch[k - 1])


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated share of a's shingles that b holds too."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k)
    shared = both / (1 + both) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return min(1.0, shared / distinct_shingles(a, k))


def merge(*sketches: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of all the texts' shingles together."""
    return np.unique(np.concatenate(sketches))[:k]


def encoded(sketch: np.ndarray) -> str:
    """A sketch as text: six bytes a hash, in base64."""
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decoded(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.concatenate((np.zeros((len(raw), 2), np.uint8), raw), axis=1).reshape(-1).view(">u8").astype(_U)


def _sketches(k: int, shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            found = shingle_hashes([x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()], shingle)
            sketches = [sketch_of(h, k) for h in found]
            counts = [distinct_shingles(s, k) for s in sketches]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(map(encoded, sketches), pa.string()), pa.array(counts, pa.float64())], ["key", "fingerprint", "n_shingles"])

    return run


def sketch_documents(docs: DataFrame, key: str = "doc_id", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """(key, fingerprint, n_shingles) of every row of docs."""
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_sketches(k, shingle), "key string, fingerprint string, n_shingles double")


def merge_sketches(sketches: DataFrame, group: str, k: int = K) -> DataFrame:
    """(group, fingerprint) of the union of each group's texts, merged `FAN_IN` at a time, so that a
    group of any size never meets in one task."""

    @F.pandas_udf("string")
    def merged(lists):
        return lists.map(lambda texts: encoded(merge(*[decoded(t) for t in texts], k=k)))

    rows = sketches.select(F.col(group).alias("_g"), F.col("fingerprint").alias("_f"), F.xxhash64("fingerprint").alias("_h"))
    most = rows.groupBy("_g").count().agg(F.max("count")).first()[0] or 1
    levels = max(1, math.ceil(math.log(max(most, 2), FAN_IN / 2)))
    for level in range(levels - 1, -1, -1):
        salt = F.pmod(F.col("_h"), F.lit(int((FAN_IN / 2) ** level)))
        rows = rows.groupBy("_g", salt.alias("_h")).agg(F.collect_list("_f").alias("_f")).select("_g", "_h", merged("_f").alias("_f"))
    return rows.select(F.col("_g").alias(group), F.col("_f").alias("fingerprint"))


def _bucket(bounds: list[int]):
    """The number of bounds below doc_id (nulls: 0), searched in two steps of about sqrt(n) each."""
    step = max(1, math.isqrt(len(bounds)))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda a: F.size(F.filter(a, lambda b: b < F.col("doc_id")))
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]).cast("array<bigint>")
    coarse = below(longs([p[-1] for p in parts]))
    fine = F.element_at(F.array(*[longs(p) for p in parts], longs([])), coarse + 1)
    return F.coalesce(coarse * step + below(fine), F.lit(0)).cast("int")


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(bucket, tail, doc_id, text) sorted within partitions: every bucket's documents in ascending
    doc_id order (equal ids by text hash), then as its tail the first document of the next bucket;
    the last bucket's tail is the first document of all.

    Buckets are ranges of doc_id between approximate quantiles; what is gathered is one id per bucket.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = buckets or 2 * default_parallelism(docs.sparkSession)
    bounds = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    rows = rows.select(_bucket(sorted(set(bounds or []))).alias("bucket"), F.lit(0).alias("tail"), "doc_id", "text")
    heads = rows.groupBy("bucket").agg(F.min(F.struct("doc_id", F.xxhash64("text").alias("hash"))).alias("head"))
    heads = heads.withColumn("to", F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(Window.partitionBy())))
    heads = materialize(heads.select(F.col("head.doc_id").alias("_id"), F.col("head.hash").alias("_hash"), F.col("bucket").alias("_of"), "to"), "heads")
    # as many rows as there are buckets
    tails = rows.join(F.broadcast(heads), (F.col("bucket") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")))
    both = rows.union(tails.select(F.col("to").alias("bucket"), F.lit(1).alias("tail"), "doc_id", "text"))
    return both.repartition(n, "bucket").sortWithinPartitions("bucket", "tail", "doc_id", F.xxhash64("text"))


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edits(k: int, shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [x.split()[0] for x in OUT.split(", ")]

    def work(rows: list[tuple]) -> pa.RecordBatch:
        """All but the last row, each against the row after it."""
        pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1]]
        edited = [a[3][: len(a[3]) - len(a[3]) // 4] + b[3][: len(a[3]) // 4] for a, b in pairs]
        raw = [x.encode() for x in edited]
        prints = [sketch_of(h, k) for h in shingle_hashes([r[3].encode() for r in rows], shingle)]
        near = [resemblance(p, q, k) for p, q, a in zip(prints, prints[1:], rows, strict=False) if not a[1]]
        own = [p for p, a in zip(prints[:-1], rows, strict=False) if not a[1]]
        changed = [sketch_of(h, k) for h in shingle_hashes(raw, shingle)]
        columns = (
            [a[2] for a, _ in pairs], [len(a[3]) for a, _ in pairs], [hashlib.sha256(x).hexdigest() for x in raw], list(map(encoded, own)), list(map(encoded, changed)),
            [resemblance(p, q, k) for p, q in zip(own, changed, strict=True)], near,
        )
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for part in chunks(batches, "text"):
            rows = [(b, t, d, x or "") for b, t, d, x in zip(*[part.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "text")], strict=True)]
            yield work([last, *rows] if last else rows)
            last = rows[-1]

    return run


def edited_neighbours(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Each document's fingerprint beside that of its text with the last quarter replaced by the
    start of the next document's, and the likeness of both and of the next document's."""
    return with_next(docs).mapInArrow(_edits(k, shingle), OUT)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_neighbours(table(spark, sf_dir, "documents"))


QUERIES = {"op8_fingerprints": op8_fingerprints}
