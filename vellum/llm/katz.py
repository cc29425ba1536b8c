"""Katz backoff language model: Good-Turing discounted bigrams over add-one unigrams.

Every distinct word and the text's end is a symbol of its own; a text's first word follows a start symbol, which is
a context only. For a context h:

    P(w | h) = d(c) * c(h, w) / c(h)   if c = c(h, w) > 0
             = a(h) * P1(w)            otherwise, and P1(w) if h was never seen

d(c) are Good-Turing discounts for counts to `CUTOFF` (absolute ones where the counts of counts give
none), a(h) makes the probabilities of h sum to 1 exactly, P1(w) = (c(w) + 1) / (N + V + 1), one share being all
unseen words'.

Tables: `unigrams` (word hash, count); the pairs, stored in two forms that give the same probabilities. Pairs of two
of the `VOCABULARY` most frequent words are packed, partitioned by context: one row per part holds the sorted pairs with
their training counts and the documents in which they occur. Pairs with a rarer word are plain rows, met by that word's
64-bit hash. Either way the texts' pairs are shuffled packed or once per rare word, and documents get back sums.

Skew: the `HEAVY` most frequent contexts are spread over parts by the word that follows, and pairs of two heavy
symbols by document chunk as well; their counts (HEAVY^2 at most) are added up and sent to all, as are the sums of the
`VOCABULARY` contexts. A rarer training word holds about one in `VOCABULARY` of the tokens at most, by its rank. A word that only
held-out documents have is not ranked: its rows meet in one task however frequent it is there (sorted and spilled, not held).

Edge cases: null or empty text is the end alone; repeated rows get equal scores; a null doc_id is not held out and
not learned from; without training documents every token has the base probability of an empty corpus, 1; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import chunks, default_parallelism, materialize, table
from vellum.llm.fingerprints import word_hashes
from vellum.llm.language import fold

#: Words whose pairs are packed; of no effect on any score.
VOCABULARY = 400_000
HEAVY = 512
CUTOFF = 5
#: Tokens per part of the pair table.
PART_TOKENS = 1_500_000
CHUNK = 3 << 20
_U = np.uint64
_DOC_BITS, _ID_BITS = _U(16), _U(24)
_ID_MASK = (_U(1) << _ID_BITS) - _U(1)
#: Documents in a chunk: 2^15, which with the mark of a training document is 16 bits.
_PLACE_BITS = 15
#: Sums travel as whole numbers of 1 / UNIT.
UNIT = float(1 << 24)


@dataclass(frozen=True)
class Unigrams:
    """The frequent words' hashes in order with their ids by rank and counts by id, and the totals."""

    hashes: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int
    documents: int

    @property
    def rare(self) -> int:
        return len(self.counts)

    @property
    def end(self) -> int:
        return len(self.counts) + 1

    @property
    def start(self) -> int:
        return len(self.counts) + 2

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """Words' ids; `rare` for all others."""
        if not len(self.hashes):
            return np.full(len(words), self.rare, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.ids[at], self.rare)

    @property
    def share(self) -> int:
        """What a unigram's count + 1 is divided by."""
        return self.tokens + self.distinct + 1

    def all_counts(self) -> np.ndarray:
        """Counts by symbol: frequent words, 0 in the rare ones' place, end."""
        return np.concatenate((self.counts, [0, self.documents]))

    def probabilities(self) -> np.ndarray:
        """P1 by symbol."""
        return (self.all_counts() + 1.0) / self.share

    def is_heavy(self, ids: np.ndarray) -> np.ndarray:
        return (ids < HEAVY) | (ids >= self.rare)


def _rows(docs: DataFrame, held_out) -> DataFrame:
    """(key, doc_id, text, held_out, train); equal rows have equal keys."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = F.coalesce(held_out, F.lit(False))
    return rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text", held.alias("held_out"), (F.col("doc_id").isNotNull() & ~held).alias("train"))


def _texts(part: pa.RecordBatch) -> list[bytes]:
    return part.column("text").cast(pa.binary()).to_pylist()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, counts = np.zeros(0, _U), np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])

    for part in chunks(batches, "text", CHUNK):
        found, n = np.unique(word_hashes(_texts(part))[0], return_counts=True)
        both, at = np.unique(np.concatenate((words, found)), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate((counts, n)), minlength=len(both)).astype(np.int64)
        words = both
        if len(words) > 1_000_000:
            yield out()
            words, counts = np.zeros(0, _U), np.zeros(0, np.int64)
    yield out()


def count_unigrams(rows: DataFrame, vocabulary: int = VOCABULARY) -> tuple[Unigrams, DataFrame]:
    """The unigram table (word, n) of the training rows, and its most frequent words."""
    if vocabulary > int(_ID_MASK) - 3:
        raise ValueError("symbols beyond the vocabulary's bits")
    train = rows.where("train").select("text")
    unigrams = materialize(train.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "unigrams")
    total = unigrams.agg(F.sum("n"), F.count("*")).first()
    documents = train.count()
    # the least count class above which at most `vocabulary` words lie; a few hundred classes at most
    level = F.floor(F.log2("n") * 8)
    classes = sorted((r for r in unigrams.groupBy(level.alias("level")).count().collect()), reverse=True)
    size, least = 0, math.inf
    for r in classes:
        if size + r["count"] > vocabulary:
            break
        size, least = size + r["count"], r.level
    top = unigrams.where(level >= least).toArrow() if size else None
    hashes = top.column("word").to_numpy().view(_U) if size else np.zeros(0, _U)
    n = top.column("n").to_numpy() if size else np.zeros(0, np.int64)
    rank = np.lexsort((hashes, -n))
    ids = np.empty(len(n), dtype=np.int64)
    ids[rank] = np.arange(len(n))
    order = np.argsort(hashes)
    found = Unigrams(hashes[order], ids[order], n[rank], int(total[0] or 0) + documents, int(total[1]) + (documents > 0), documents)
    return found, unigrams


META = "key long, doc_id long, held_out boolean, n_tokens long, n_frequent long, base double, rare array<struct<h:long,w:long,hid:int,wn:long>>"


def _meta(u: Unigrams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per document: its tokens, the frequent ones' part of the base score, the pairs with a rare word.

    Of such a pair, h is the context's hash if that is rare (else 0, and hid its id, -1 for a rare one); w is the
    word's hash if that is rare (else its id, and wn its count, -1 for a rare one)."""
    logs = np.log10(u.all_counts() + 1.0) - math.log10(u.share)
    logs[u.rare] = 0
    counts = u.all_counts()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", CHUNK):
            words, bounds = word_hashes(_texts(part))
            ids = u.lookup(words)
            n = np.diff(bounds)
            n_rare = np.diff(np.concatenate(([0], np.cumsum(ids == u.rare)))[bounds])
            # each text's sum on its own, so that equal texts have equal scores
            base = np.array([logs[ids[a:b]].sum() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]) if len(words) else np.zeros(len(n))
            ends = np.repeat(bounds, 2)[1:-1]
            line, named = np.insert(ids, ends, np.tile([u.start, u.end], len(n))), np.insert(words.view(np.int64), ends, 0)
            docs = np.repeat(np.arange(len(n)), n + 2)
            at = np.flatnonzero((docs[:-1] == docs[1:]) & ((line[:-1] == u.rare) | (line[1:] == u.rare)))
            h, w = line[at], line[at + 1]
            first, second = h == u.rare, w == u.rare
            fields = {
                "h": pa.array(np.where(first, named[at], 0)),
                "w": pa.array(np.where(second, named[at + 1], w)),
                "hid": pa.array(np.where(first, -1, h).astype(np.int32)),
                "wn": pa.array(np.where(second, -1, counts[np.minimum(w, u.end)])),
            }
            offsets = np.searchsorted(docs[at], np.arange(len(n) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
            columns = [part.column(c) for c in ("key", "doc_id", "held_out")]
            columns += [pa.array(n + 1), pa.array(n - n_rare + (u.documents > 0)), pa.array(base + logs[u.end]), lists]
            yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "held_out", "n_tokens", "n_frequent", "base", "rare"])

    return run


def rare_pairs(meta: DataFrame, unigrams: DataFrame, u: Unigrams) -> DataFrame:
    """Every occurrence of a pair with a rare word: (key, hid, wn, rare_w, c, first, total, seen, p, r1 ...): the word's
    and the pair's training counts, whether it is the pair's first row, and a rare context's sums (0 for others).

    Rows of a frequent context meet by the rare word, those of a rare context by that context: no key is frequent."""
    pairs = meta.select("key", F.expr("int(doc_id is not null and not held_out)").alias("t"), F.inline("rare"))
    counts = unigrams.select(F.col("word").alias("w"), "n")

    def counted(rows: DataFrame) -> DataFrame:
        return rows.drop("wn").join(counts, "w", "left").select("key", "t", "h", "w", "hid", F.coalesce("n", F.lit(0)).alias("wn"), F.lit(True).alias("rare_w"))

    def with_counts(rows: DataFrame, *by: str) -> DataFrame:
        pair = Window.partitionBy(*by)
        # the ordered window first: its sort serves the other one too
        return rows.withColumn("first", F.row_number().over(pair.orderBy("key")) == 1).withColumn("c", F.sum("t").over(pair))

    after = with_counts(counted(pairs.where("wn < 0 and hid >= 0")), "w", "hid")
    plain = pairs.where("wn >= 0").select("key", "t", "h", "w", "hid", "wn", F.lit(False).alias("rare_w"))
    # one shuffle by context serves the windows over pairs and those over contexts
    before = with_counts(counted(pairs.where("wn < 0 and hid < 0")).unionByName(plain).repartition("h"), "h", "rare_w", "w")
    context, met = Window.partitionBy("h"), F.col("first") & (F.col("c") > 0)
    number = lambda condition: F.sum(condition.cast("long")).over(context)
    sums = {"total": F.sum("t").over(context), "seen": number(met), "p": F.sum(F.when(met, (F.col("wn") + 1) / F.lit(float(u.share))).otherwise(0.0)).over(context)}
    sums |= {f"r{r}": number(met & (F.col("c") == r)) for r in range(1, CUTOFF + 1)}
    before, after = before.withColumns(sums), after.withColumns({name: F.lit(0.0 if name == "p" else 0) for name in sums})
    columns = ["key", "hid", "wn", "rare_w", "c", "first", *sums]
    return after.select(columns).union(before.select(columns))


def _packed(x: np.ndarray) -> bytes:
    """An array's bytes by place, then compressed: high bytes of small or sorted numbers vanish."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _unpacked(data: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def _pairs(u: Unigrams, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per chunk of documents and part: the packed (context, word, document, trains) quadruples; per
    chunk, in part -1, its documents' keys. A chunk is named by a hash of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in chunks(batches, "text", CHUNK):
            for at in range(0, whole.num_rows, 1 << _PLACE_BITS):
                part = whole.slice(at, 1 << _PLACE_BITS)
                words, bounds = word_hashes(_texts(part))
                n = np.diff(bounds)
                # ids of start, words, end for each text, one after another
                ids = np.insert(u.lookup(words), np.repeat(bounds, 2)[1:-1], np.tile([u.start, u.end], len(n)))
                docs = np.repeat(np.arange(len(n)), n + 2)
                keys = part.column("key").to_numpy(zero_copy_only=False)
                name = xxhash.xxh64_intdigest(keys.tobytes()) >> 1
                place = (docs << 1) | part.column("train").to_numpy(zero_copy_only=False)[docs]
                inside = docs[:-1] == docs[1:]
                inside &= (ids[:-1] != u.rare) & (ids[1:] != u.rare)
                h, w, d = ids[:-1][inside], ids[1:][inside], place[1:][inside]
                key = (h.astype(_U) << (_ID_BITS + _DOC_BITS)) | (w.astype(_U) << _DOC_BITS) | d.astype(_U)
                del ids, docs, place, inside, h, w, d
                key.sort()
                h, w = key >> (_ID_BITS + _DOC_BITS), (key >> _DOC_BITS) & _ID_MASK
                heavy = u.is_heavy(h.astype(np.int64))
                both = heavy & u.is_heavy(w.astype(np.int64))
                route = h * _U(0x9E3779B1) + np.where(heavy, w * _U(0x85EBCA77), _U(0)) + np.where(both, _U(name & 0xFFFFFFFF), _U(0))
                route = ((route ^ (route >> _U(15))) * _U(0x2C1B3C6D) % _U(parts)).astype(np.int32)
                order = np.argsort(route, kind="stable")
                key, route = key[order], route[order]
                firsts = np.flatnonzero(np.diff(route, prepend=-1)).tolist()
                triples = [_packed(np.diff(key[a:b], prepend=_U(0))) for a, b in zip(firsts, [*firsts[1:], len(route)], strict=True)]
                columns = [pa.array([*route[firsts].tolist(), -1], pa.int32()), pa.array([name] * (len(firsts) + 1), pa.int64()), pa.array([*triples, _packed(keys)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "chunk", "packed"])

    return run


TABLE = "part int, chunk long, pairs binary, counts binary, runs binary, places binary, chunks binary"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part: distinct pairs with training counts, and the documents of each as places (chunk by
    its number in `chunks`, document in it). Rows of part -1 pass as they are, one per chunk."""
    names = [x.split()[0] for x in TABLE.split(", ")]

    def row(part: int, chunk: int | None, *columns: bytes | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([chunk], pa.int64()), *[pa.array([c], pa.binary()) for c in columns]], names)

    def merged(part: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        keys, places, train = [], [], []
        for i, (_, packed) in enumerate(rows):
            some = np.cumsum(_unpacked(packed, _U), dtype=_U)
            keys.append(some >> _DOC_BITS)
            places.append((((some & _U(0xFFFF)) >> _U(1)) | _U(i << _PLACE_BITS)).astype(np.uint32))
            train.append((some & _U(1)).astype(np.uint8))
        key = np.concatenate(keys)
        del keys
        order = np.argsort(key, kind="stable")
        key = key[order]
        firsts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        counts = np.add.reduceat(np.concatenate(train)[order], firsts, dtype=np.int64)
        runs = np.diff(np.append(firsts, len(key))).astype(np.uint32)
        pairs = _packed(np.diff(key[firsts], prepend=_U(0)))
        return row(part, None, pairs, _packed(counts.astype(np.uint32)), _packed(runs), _packed(np.concatenate(places)[order]), np.array([c for c, _ in rows], np.int64).tobytes())

    rows: list[tuple[int, bytes]] = []
    last = None
    for batch in batches:
        for part, chunk, packed in zip(*[batch.column(c).to_pylist() for c in ("part", "chunk", "packed")], strict=True):
            if part < 0:
                yield row(-1, chunk, packed, None, None, None, None)
                continue
            if part != last and rows:
                yield merged(last, rows)
                rows = []
            last = part
            rows.append((chunk, packed))
    if rows:
        yield merged(last, rows)


def _split_pairs(u: Unigrams, pairs: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, words, counts, whether the context is heavy, whether both are."""
    key = np.cumsum(_unpacked(pairs, _U), dtype=_U)
    h, w = (key >> _ID_BITS).astype(np.int64), (key & _ID_MASK).astype(np.int64)
    heavy = u.is_heavy(h)
    return h, w, _unpacked(counts, np.uint32).astype(np.int64), heavy, heavy & u.is_heavy(w)


#: kind 0: a count of counts (a = count); 1: a pair of heavy symbols (a, b); 2: a context a's sums over other words.
STATS = "kind int, a long, b long, n long, total long, seen long, p double, r1 long, r2 long, r3 long, r4 long, r5 long"


def _context_sums(h: np.ndarray, w: np.ndarray, c: np.ndarray, p1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct contexts (h sorted) and per context: total count, seen words, their P1, counts of counts to CUTOFF."""
    firsts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    if not len(firsts):
        return h[:0], np.zeros((0, 3 + CUTOFF))
    columns = [c, c > 0, np.where(c > 0, p1[w], 0.0), *[c == r for r in range(1, CUTOFF + 1)]]
    return h[firsts], np.stack([np.add.reduceat(x.astype(float), firsts) for x in columns], axis=1)


def _statistics(u: Unigrams) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    p1 = u.probabilities()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, counts in zip(batch.column("pairs").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                h, w, c, heavy, both = _split_pairs(u, pairs, counts)
                hist = np.bincount(np.minimum(c[~both], CUTOFF + 2), minlength=CUTOFF + 3)
                rows = [(0, r, 0, int(hist[r]), 0, 0, 0.0, 0, 0, 0, 0, 0) for r in range(1, CUTOFF + 2)]
                rows += [(1, int(a), int(b), int(n), 0, 0, 0.0, 0, 0, 0, 0, 0) for a, b, n in zip(h[both], w[both], c[both], strict=True) if n]
                contexts, sums = _context_sums(h[~both], w[~both], c[~both], p1)
                rows += [(2, int(a), 0, 0, int(s[0]), int(s[1]), float(s[2]), *map(int, s[3:])) for a, s in zip(contexts, sums, strict=True)]
                fields = [x.split() for x in STATS.split(", ")]
                kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])

    return run


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """d(r) for r from 0 to CUTOFF by Good-Turing; (r - 1/2) / r where that gives none between 0 and 1."""
    n = np.array(counts_of_counts, dtype=float)
    plain = np.array([1.0, *[(r - 0.5) / r for r in range(1, CUTOFF + 1)]])
    if n[1] <= 0 or (n[1:] <= 0).any():
        return plain
    beyond = (CUTOFF + 1) * n[CUTOFF + 1] / n[1]
    r = np.arange(1, CUTOFF + 1)
    good = ((r + 1) * n[2:] / n[1:-1] / r - beyond) / (1 - beyond) if beyond < 1 else plain[1:]
    return np.concatenate(([1.0], np.where((good > 0) & (good < 1), good, plain[1:])))


def context_weights(sums: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per context: what each count is lowered by beyond d (0, or 1/2 where no count is discounted),
    and the backoff weight."""
    total, seen, p = sums[:, 0], sums[:, 1], sums[:, 2]
    low = sums[:, 3:] @ ((1 - d[1:]) * np.arange(1, CUTOFF + 1))
    extra = np.where(low <= 0, 0.5, 0.0)
    left = np.where(low <= 0, 0.5 * seen, low) / np.maximum(total, 1)
    return extra, np.where(total > 0, left / np.maximum(1 - p, 1e-12), 1.0)


@dataclass(frozen=True)
class Model:
    """Unigrams, discounts, frequent contexts' totals, lowering and backoff weights by id, heavy pairs' counts by key."""

    unigrams: Unigrams
    discounts: np.ndarray
    totals: np.ndarray
    extra: np.ndarray
    weights: np.ndarray
    pair_keys: np.ndarray
    pair_counts: np.ndarray


def fit(pairs: DataFrame, rare: DataFrame, u: Unigrams) -> Model:
    """Adds up both forms' statistics: a few counts, HEAVY^2 pairs and `VOCABULARY` contexts at most."""
    stats = pairs.select("pairs", "counts").mapInArrow(_statistics(u), STATS)
    names = [x.split()[0] for x in STATS.split(", ")][3:]
    found = stats.groupBy("kind", "a", "b").agg(*[F.sum(c).alias(c) for c in names]).toArrow().to_pandas()
    met = F.col("c") > 0
    sums = [F.sum("c"), F.count_if(met), F.sum(F.when(met, (F.col("wn") + 1) / F.lit(float(u.share))).otherwise(0.0))]
    sums = [x.alias(n) for x, n in zip(sums, names[1:4], strict=True)] + [F.count_if(F.col("c") == r).alias(f"r{r}") for r in range(1, CUTOFF + 1)]
    distinct = rare.where("first")
    more = distinct.where("hid >= 0").groupBy(F.col("hid").alias("a")).agg(*sums).toArrow().to_pandas()
    apart = distinct.agg(*[F.count_if(F.col("c") == r) for r in range(1, CUTOFF + 2)]).first()
    counts = {int(r.a): int(r.n) for r in found[found.kind == 0].itertuples()}
    heavy = found[found.kind == 1].sort_values(["a", "b"])
    h, w, c = heavy.a.to_numpy(np.int64), heavy.b.to_numpy(np.int64), heavy.n.to_numpy(np.int64)
    n = [0, *[counts.get(r, 0) + int((c == r).sum()) + apart[r - 1] for r in range(1, CUTOFF + 2)]]
    contexts = np.zeros((u.start + 1, 3 + CUTOFF))
    at, some = _context_sums(h, w, c, u.probabilities())
    contexts[at] += some
    for table in (found[found.kind == 2], more):
        contexts[table.a.to_numpy(np.int64)] += table[names[1:]].to_numpy(float)
    d = discounts(n)
    extra, weights = context_weights(contexts, d)
    return Model(u, d, contexts[:, 0], extra, weights, (h.astype(_U) << _ID_BITS) | w.astype(_U), c)


def _logs(d: np.ndarray, c: np.ndarray, p1: np.ndarray, total: np.ndarray, extra: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """log10 P(w | h) from the pair's count, P1(w) and the context's total, lowering and backoff weight."""
    rate = np.where(c <= CUTOFF, d[np.minimum(c, CUTOFF)], 1.0)
    seen = np.where(extra > 0, c - extra, rate * c) / np.maximum(total, 1)
    return np.log10(np.where(c > 0, seen, weight * p1))


def _evaluate(m: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per part: the sum of its pairs' log10 probabilities for every document."""
    u, d, p1 = m.unigrams, m.discounts, m.unigrams.probabilities()

    def logs(pairs: bytes, counts: bytes) -> np.ndarray:
        h, w, c, _, both = _split_pairs(u, pairs, counts)
        key = (h.astype(_U) << _ID_BITS) | w.astype(_U)
        if both.any():
            at = np.minimum(np.searchsorted(m.pair_keys, key[both]), max(len(m.pair_keys) - 1, 0))
            c[both] = np.where(m.pair_keys[at] == key[both], m.pair_counts[at], 0) if len(m.pair_keys) else 0
        return _logs(d, c, p1[w], m.totals[h], m.extra[h], m.weights[h])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                log = np.repeat(logs(row["pairs"], row["counts"]), _unpacked(row["runs"], np.uint32))
                places, at = np.unique(_unpacked(row["places"], np.uint32), return_inverse=True)
                sums = np.round(np.bincount(at, weights=log) * UNIT).astype(np.int64)
                del log, at
                numbers = places >> np.uint32(_PLACE_BITS)
                firsts = np.flatnonzero(np.diff(numbers, prepend=np.uint32(0xFFFFFFFF)))
                names = np.frombuffer(row["chunks"], np.int64)[numbers[firsts]]
                ends = [*firsts[1:].tolist(), len(places)]
                local = (places & np.uint32((1 << _PLACE_BITS) - 1)).astype(np.uint16)
                packed = [(_packed(local[a:b]), _packed(sums[a:b])) for a, b in zip(firsts.tolist(), ends, strict=True)]
                columns = [pa.array(names), pa.array([x for x, _ in packed], pa.binary()), pa.array([x for _, x in packed], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "places", "sums"])

    return run


def _evaluate_rare(m: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per row of rare_pairs: whether its word is rare and known, a rare word's part of the base score, the pair's log10
    probability in whole numbers of 1 / UNIT."""
    share = m.unigrams.share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            hid, wn, c, rare_w = column("hid"), column("wn"), column("c"), column("rare_w").astype(bool)
            sums = np.stack([column(x).astype(float) for x in ("total", "seen", "p", *[f"r{r}" for r in range(1, CUTOFF + 1)])], axis=1)
            extra, weight = context_weights(sums, m.discounts)
            frequent = hid >= 0
            pick = lambda known, own: np.where(frequent, known[np.maximum(hid, 0)], own)  # noqa: B023, E731
            log = _logs(m.discounts, c, (wn + 1) / share, pick(m.totals, sums[:, 0]), pick(m.extra, extra), pick(m.weights, weight))
            base = np.where(rare_w, np.log10(wn + 1.0) - math.log10(share), 0.0)
            columns = [batch.column("key"), pa.array((rare_w & (wn > 0)).astype(np.int64)), pa.array(base), pa.array(np.round(log * UNIT).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "known", "base", "log"])

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up every chunk's sums, which follow its row of keys (the one without places)."""
    name, keys, total = None, None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total / UNIT)], ["key", "log"])

    for batch in batches:
        for chunk, places, sums in zip(*[batch.column(c).to_pylist() for c in ("chunk", "places", "sums")], strict=True):
            if chunk != name:
                if keys is not None:
                    yield out()
                name, keys = chunk, _unpacked(sums, np.int64)
                total = np.zeros(len(keys), np.int64)
            elif places is not None:
                total[_unpacked(places, np.uint16)] += _unpacked(sums, np.int64)
    if keys is not None:
        yield out()


def score(docs: DataFrame, held_out, vocabulary: int = VOCABULARY) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; rows that
    are not held out train the model."""
    spark = docs.sparkSession
    rows = _rows(docs, held_out)
    u, unigrams = count_unigrams(rows, vocabulary)
    meta = materialize(rows.select("key", "doc_id", "held_out", "text").mapInArrow(_meta(u), META), "meta")
    rare = materialize(rare_pairs(meta, unigrams, u), "rare")
    parts = max(math.ceil(u.tokens / PART_TOKENS), min(default_parallelism(spark), math.ceil(u.tokens / (PART_TOKENS // 8))), 1)
    packed = rows.select("key", "text", "train").mapInArrow(_pairs(u, parts), "part int, chunk long, packed binary")
    # the chunks' rows of keys are spread by chunk, the others meet by part
    by = F.when(F.col("part") < 0, F.col("chunk")).otherwise(F.col("part").cast("long"))
    stored = materialize(packed.repartition(parts, by).sortWithinPartitions("part").mapInArrow(_merge, TABLE), "pairs")
    pairs = stored.where("part >= 0")
    model = fit(pairs, rare, u)
    keys = stored.where("part < 0").select("chunk", F.lit(None).cast("binary").alias("places"), F.col("pairs").alias("sums"))
    sums = pairs.mapInArrow(_evaluate(model), "chunk long, places binary, sums binary").union(keys)
    together = sums.repartition(max(default_parallelism(spark), parts), "chunk").sortWithinPartitions("chunk", F.col("places").isNotNull())
    logs = together.mapInArrow(_documents, "key long, log double").groupBy("key").agg(F.sum("log").alias("log"))
    # rows of one key are equal, and each of them added its words to the key's sums
    same = meta.groupBy("key").agg(F.count("*").alias("m"))
    others = rare.mapInArrow(_evaluate_rare(model), "key long, known long, base double, log long").groupBy("key")
    others = others.agg(F.sum("known").alias("r_known"), F.sum("base").alias("r_base"), (F.sum("log") / UNIT).alias("r_log"))
    sums = same.join(others, "key", "left").join(logs, "key", "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0.0)) / F.col("m")
    return meta.drop("rare").join(sums, "key").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_frequent") + zero("r_known")).cast("long").alias("n_known"), F.lit(u.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("r_base")).alias("base_score"), (zero("log") + zero("r_log")).alias("score"),
    )


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)


QUERIES = {"op3_katz": op3_katz}
