"""Phrase collocation mining over vertical positional inverted lists, level by level.

Texts, A-Z lower-cased, are cut into pieces at `[.,;:!?\\x0A-\\x0D]` and pieces into words `[^\\x20\\x09]+`. Everything is per
language. A postings row covers some megabytes of one language's texts: its distinct words and, per word, the sorted
positions at which it stands; between pieces a position is left out, so that neighbours in a piece are neighbours in
number. A phrase's list of positions is merge-joined with the postings of the word behind it, which gives the lists of the
phrases one word longer; a list's length is the phrase's exact frequency in that row, and Spark adds the rows up. A list is extended
only where the phrase, the word behind it and the phrase without its first word are frequent (all are, in a frequent result).

Most phrases are rare, so they are counted without their words: by the 64-bit hash of language and words, summed within a task
before the shuffle, with the least of the postings rows that have it. Only for hashes of enough occurrences does that one row then
name the words; all else about a rare phrase stays where it is.

What is frequent reaches the tasks as bitmaps of `FILTER_BITS` bits, whatever the size of the input: a phrase sets the bit of its
hash. A bit set by another phrase lets a rare phrase into the next count, where it is dropped by its own exact frequency; so
bitmaps only prune, and all results are exact. Positions never leave their row; what is shuffled are counts of
(language, word hashes), added up within each row of some megabytes before the shuffle, so that the most frequent phrase comes once a row. Words and phrases are told apart by 64-bit hashes.

A candidate's cuts look up the frequencies of both parts by joins; the list of a language is first cut down to its first
`top` rows within each of `SALTS` parts, then ranked, so one language's candidates don't meet in one task. Products are
decimals of 38 digits, so nothing overflows.

Edge cases: null text is empty, null lang is `und` (together with documents of that name); repeated rows count as often as
they occur; languages without a candidate have no row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import bound_batches, chunks, give_back, materialize, new_path, table
from vellum.llm.fingerprints import _BYTES, _POWERS, _mixed, _powers

LEAST = 30
LONGEST = 4
TOP = 2000
#: A candidate goes if a longer one around it has at least this share of its frequency, in hundredths.
COVER = 80
SCALE = 2_000_000
#: Bits of a filter: 8 MB.
FILTER_BITS = 26
SALTS = 64
#: Keys that a task holds to sum them.
HELD_KEYS = 2_000_000
#: Keys that a task sorts at a time, about.
SORTED_KEYS = 1 << 18
#: Rows of a batch of counts that a task gives back.
OUT_ROWS = 1 << 16
#: Bytes of text in a postings row; a task holds back `HELD` times as much of all languages at most.
ROW_BYTES, HELD = 2 << 20, 4
#: Bytes of a row group of the stored lists: a scan holds one at a time.
GROUP_BYTES = 8 << 20

_U = np.uint64
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _BREAK.copy()
_GAP[list(b" \t")] = True
_MULTIPLIER = _U(0xD6E8FEB86659FD93)

POSTINGS = "row long, lang string, n long, words array<long>, names array<string>, counts array<int>, at array<int>"


def inverted(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Distinct word hashes, the words, the lengths of their lists, and the lists one after another."""
    data = b"\n".join(texts)
    raw = np.frombuffer(data, np.uint8)
    word = np.concatenate(([False], ~_GAP[raw], [False]))
    turns = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = turns[::2], turns[1::2]
    if not len(starts):
        return np.zeros(0, _U), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    up, down = _powers(len(raw))
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(_BYTES[raw] * up[: len(raw)])))
    hashes = _mixed((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(_U))
    breaks = np.concatenate(([0], np.cumsum(_BREAK[raw])))
    apart = np.concatenate(([0], np.cumsum(breaks[starts[1:]] > breaks[ends[:-1]])))
    order = np.argsort(hashes, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], hashes[order][1:] != hashes[order][:-1])))
    places = order[first]
    names = [data[a:b].lower() for a, b in zip(starts[places].tolist(), ends[places].tolist(), strict=True)]
    return hashes[places], names, np.diff(np.concatenate((first, [len(order)]))), (np.arange(len(starts)) + apart)[order]


def _row(number: int, lang: str, texts: list[bytes]) -> pa.RecordBatch:
    words, names, counts, at = inverted(texts)
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    pa.default_memory_pool().release_unused()
    columns = [pa.array([number]), pa.array([lang]), pa.array([len(at)]), one(words.view(np.int64), pa.int64()), one([n.decode() for n in names], pa.string()), one(counts.astype(np.int32), pa.int32()), one(at.astype(np.int32), pa.int32())]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in POSTINGS.split(", ")])


def _invert(row_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        for part in chunks(batches, "text"):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text) + 1
            full = [lang for lang, size in sizes.items() if size >= row_bytes]
            if not full and sum(sizes.values()) >= HELD * row_bytes:
                full = [max(sizes, key=sizes.__getitem__)]
            for lang in full:
                del sizes[lang]
                yield _row(next(numbers), lang, held.pop(lang))
        for lang, texts in held.items():
            yield _row(next(numbers), lang, texts)
        # some 40 MB that no later stage of the worker reads
        _POWERS.clear()
        give_back()

    return run


def postings(docs: DataFrame, row_bytes: int = ROW_BYTES) -> DataFrame:
    """docs(text, lang) -> stored rows of `POSTINGS`."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    path = new_path(docs.sparkSession, "postings")
    # else a row group's size is looked at only after 100 rows, which are hundreds of MB
    rows.mapInArrow(_invert(row_bytes), POSTINGS).write.option("parquet.block.size", GROUP_BYTES).option("parquet.page.size.row.check.min", 1).parquet(path)
    return docs.sparkSession.read.schema(POSTINGS).parquet(path)


def _bits(lang: str, words: list[np.ndarray], bits: int) -> np.ndarray:
    """The first bits of the hash of every phrase whose i-th words words[i] are."""
    seed = np.frombuffer(lang.encode() + b"\0" * (-len(lang.encode()) % 8) + len(lang).to_bytes(8, "little"), _U)
    h = _U(len(words))
    for part in seed:
        h = _mixed(np.array([h ^ part]) * _MULTIPLIER)[0]
    out = np.full(len(words[0]), h, dtype=_U)
    for w in words:
        out = _mixed((out ^ w) * _MULTIPLIER)
    return out >> _U(64 - bits)


def _marks(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, words = batch.column("lang").to_pylist(), np.array(batch.column("words").to_pylist(), dtype=np.int64)
            for lang in sorted(set(langs)):
                rows = words[[x == lang for x in langs]].view(_U)
                found = _bits(lang, [np.ascontiguousarray(rows[:, i]) for i in range(rows.shape[1])], bits)
                yield pa.RecordBatch.from_arrays([pa.array((found >> _U(6)).view(np.int64)), pa.array((_U(1) << (found & _U(63))).view(np.int64))], ["place", "mask"])

    return run


def _passes(bitmap: np.ndarray, lang: str, words: list[np.ndarray]) -> np.ndarray:
    bits = _bits(lang, words, len(bitmap).bit_length() + 5)
    return (bitmap[bits >> _U(6)] >> (bits & _U(63))) & _U(1) == 1


def extended(lang: str, words: np.ndarray, counts: np.ndarray, at: np.ndarray, filters: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The phrases of len(filters) + 1 words that one row's lists lead to: the i-th words of all, and their lists' lengths."""
    line = np.full((int(at.max()) if len(at) else 0) + LONGEST + 2, -1, dtype=np.int64)
    line[at] = np.repeat(np.where(_passes(filters[0], lang, [words]), np.arange(len(words)), -1), counts)
    # of the level before: where its phrases start, each place's phrase, every phrase's words
    places, ids, members = np.flatnonzero(line >= 0), line, [words]
    for level in range(1, len(filters) + 1):
        places = places[line[places + level] >= 0]
        if level > 1:
            places = places[ids[places + 1] >= 0]
        pairs, which, lengths = np.unique(ids[places] * len(words) + line[places + level], return_inverse=True, return_counts=True)
        front, back = pairs // max(len(words), 1), pairs % max(len(words), 1)
        members = [m[front] for m in members] + [words[back]]
        if level == len(filters):
            return members, lengths
        good = _passes(filters[level], lang, members)
        places, which = places[good[which]], which[good[which]]
        ids = np.full(len(line), -1, dtype=np.int64)
        ids[places] = which
    raise AssertionError


def _lists(batch: pa.RecordBatch, i: int, known: list[np.ndarray]) -> tuple[int, str, list[np.ndarray], np.ndarray]:
    """One row's number and language, its phrases of len(known) + 1 words, the lengths of their lists."""
    number, lang = batch.column("row")[i].as_py(), batch.column("lang")[i].as_py()
    words, counts, at = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("words", "counts", "at"))
    return number, lang, *(extended(lang, words.view(_U), counts, at, known) if known else ([words.view(_U)], counts))


def _keys(filters: list):
    """(key, row, n) of the phrases, summed within the task as far as it holds them; row is the first that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = [f.value for f in filters], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            # by ranges of keys: one after another is sorted, so only the held ones are there whole
            ranges = 1 + size // SORTED_KEYS
            width = _U(((1 << 64) - 1) // ranges)
            for i in range(ranges):
                inside = [np.minimum(keys // width, _U(ranges - 1)) == i for keys, _, _ in held]
                keys, n = (np.concatenate([h[c][good] for h, good in zip(held, inside, strict=True)]) for c in (0, 2))
                rows = np.repeat([number for _, number, _ in held], [np.count_nonzero(good) for good in inside])
                if not len(keys):
                    continue
                order = np.argsort(keys, kind="stable")
                keys = keys[order]
                first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                keys, n, rows = keys[first], np.add.reduceat(n[order], first), rows[order[first]]
                # the JVM holds a batch whole
                for at in range(0, len(keys), OUT_ROWS):
                    part = slice(at, at + OUT_ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(rows[part]), pa.array(n[part])], ["key", "row", "n"])
            held.clear()
            give_back()

        for batch in batches:
            for i in range(batch.num_rows):
                number, lang, members, lengths = _lists(batch, i, known)
                if len(lengths):
                    held.append((_bits(lang, members, 64), number, lengths))
                    size += len(lengths)
                if size > HELD_KEYS:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    return run


def _place(keys: np.ndarray, row: np.ndarray | int, bits: int) -> np.ndarray:
    """The bit of a key in a row."""
    return _mixed((keys ^ np.asarray(row, dtype=np.int64).astype(_U)) * _MULTIPLIER) >> _U(64 - bits)


def _owners(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = _place(batch.column("key").to_numpy().view(_U), batch.column("row").to_numpy(), bits)
            yield pa.RecordBatch.from_arrays([pa.array((bit >> _U(6)).view(np.int64)), pa.array((_U(1) << (bit & _U(63))).view(np.int64))], ["place", "mask"])

    return run


def _bitmap(marks: DataFrame, bits: int) -> np.ndarray:
    """Marks (place, mask) as one bitmap; 2^bits / 64 rows at most come to the driver."""
    marks = marks.groupBy("place").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    found = np.zeros(1 << (bits - 6), _U)
    found[marks.column("place").to_numpy()] = marks.column("mask").to_numpy().view(_U)
    return found


def _named(filters: list, owners):
    """(key, row, lang, words, name) of the phrases whose bit is set for the row; the name is a single word's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bitmap = [f.value for f in filters], owners.value
        bits = len(bitmap).bit_length() + 5
        for batch in batches:
            for i in range(batch.num_rows):
                number, lang, members, _ = _lists(batch, i, known)
                keys = _bits(lang, members, 64)
                bit = _place(keys, number, bits)
                good = np.flatnonzero((bitmap[bit >> _U(6)] >> (bit & _U(63))) & _U(1) == 1)
                words = np.stack([m[good] for m in members], 1).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(good) + 1) * len(members), pa.int32()), pa.array(words.ravel()))
                names = pa.nulls(len(good), pa.string()) if known else batch.column("names")[i].values.take(pa.array(good))
                yield pa.RecordBatch.from_arrays([pa.array(keys[good].view(np.int64)), pa.array(np.full(len(good), number)), pa.repeat(lang, len(good)), lists, names], ["key", "row", "lang", "words", "name"])
        give_back()

    return run


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = FILTER_BITS, row_bytes: int = ROW_BYTES) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The languages' totals (lang, n), the frequent words' names (lang, word, name), and by length, from 1, all phrases of `least` or more occurrences (lang, words, a)."""
    spark = docs.sparkSession
    lists = postings(docs, row_bytes)
    totals = lists.groupBy("lang").agg(F.sum("n").alias("n"))
    found: list[DataFrame] = []
    filters: list = []
    rows = lists.select("row", "lang", "words", "counts", "at")
    for length in range(1, longest + 1):
        # a row's counts are sums already; a hash table per task before the shuffle would hold most of them once more
        keyed = rows.mapInArrow(_keys(filters), "key long, row long, n long").repartition("key").groupBy("key").agg(F.sum("n").alias("a"), F.min("row").alias("row"))
        keyed = materialize(keyed.where(F.col("a") >= least), f"keys-{length}")
        owners = spark.sparkContext.broadcast(_bitmap(keyed.mapInArrow(_owners(bits), "place long, mask long"), bits))
        named = (rows if filters else lists.select(*rows.columns, "names")).mapInArrow(_named(filters, owners), "key long, row long, lang string, words array<long>, name string")
        found.append(materialize(named.join(keyed, ["key", "row"]).select("lang", "words", "name", "a"), f"phrases-{length}"))
        if length < longest:
            filters.append(spark.sparkContext.broadcast(_bitmap(found[-1].select("lang", "words").mapInArrow(_marks(bits), "place long, mask long"), bits)))
    names = found[0].select("lang", F.get("words", F.lit(0)).alias("word"), "name")
    return totals, names, [f.select("lang", "words", "a") for f in found]


def _exact(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def scored(found: list[DataFrame], cover: int = COVER) -> DataFrame:
    """Candidates that no longer one covers, with their lowest-scoring cut: (lang, words, a, score, k, l, r)."""
    keys = ["lang", "words"]
    candidates = _union(found[1:])
    # a longer phrase around a candidate holds one that is a word longer, at least as frequent
    inner = F.explode(F.array(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1))).alias("words")
    around = _union(found[2:]).select("lang", inner, "a").groupBy(*keys).agg(F.max("a").alias("most")) if found[2:] else None
    if around is not None:
        kept = candidates.join(around, keys, "left")
        candidates = kept.where(F.col("most").isNull() | (_exact(F.col("most")) * 100 < _exact(F.col("a")) * cover)).drop("most")
    cuts = candidates.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"front": F.slice("words", F.lit(1), F.col("k")), "back": F.slice("words", F.col("k") + 1, F.size("words"))})
    parts = _union(found[:-1])
    cuts = cuts.join(parts.select("lang", F.col("words").alias("front"), F.col("a").alias("l")), ["lang", "front"]).join(parts.select("lang", F.col("words").alias("back"), F.col("a").alias("r")), ["lang", "back"])
    score = F.expr(f"cast({SCALE}L as decimal(17,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    return cuts.select("lang", "words", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "words", "a").agg(F.min("cut").alias("cut")).select("lang", "words", "a", "cut.*")


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, cover: int = COVER, top: int = TOP, bits: int = FILTER_BITS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """docs(text, lang) -> each language's first `top` phrases by score, frequency and phrase: (lang, rank, phrase, a, l, r, n, score)."""
    totals, names, found = frequent(docs, least, longest, bits, row_bytes)
    rows = scored(found, cover)
    for i in range(longest):
        rows = rows.withColumn("word", F.get("words", F.lit(i))).join(names.withColumnRenamed("name", f"name{i}"), ["lang", "word"], "left").drop("word")
    rows = rows.withColumn("phrase", F.concat_ws(" ", *[f"name{i}" for i in range(longest)])).select("lang", "phrase", "a", "l", "r", "score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    first = rows.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents").select("lang", "text"))


_GRAMS = " UNION ALL ".join(f"SELECT lang, {k} AS size, unnest(list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i : i + {k - 1}], ' '))) AS phrase FROM pieces" for k in range(1, LONGEST + 1))
SQL = rf"""
WITH pieces AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
counted AS (SELECT lang, size, phrase, count(*) AS a FROM ({_GRAMS}) GROUP BY ALL),
totals AS (SELECT lang, sum(a) AS n FROM counted WHERE size = 1 GROUP BY lang),
often AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS ws FROM counted WHERE a >= {LEAST}),
inner_ones AS (
    SELECT lang, array_to_string(ws[i : i + k - 1], ' ') AS phrase, max(a) AS most
    FROM (SELECT lang, ws, a, k, unnest(range(1, len(ws) - k + 2)) AS i FROM (SELECT lang, ws, a, unnest(range(2, len(ws))) AS k FROM often WHERE size > 2)) GROUP BY ALL),
kept AS (SELECT o.* FROM often o LEFT JOIN inner_ones i USING (lang, phrase) WHERE size > 1 AND (most IS NULL OR 100 * most::HUGEINT < {COVER} * a::HUGEINT)),
cuts AS (
    SELECT c.lang, c.phrase, c.a, c.k, l.a AS l, r.a AS r, ({SCALE} * c.a::HUGEINT) // (l.a::HUGEINT + r.a::HUGEINT) AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM kept) c
    JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1 : c.k], ' ') JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.k + 1 :], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""

QUERIES = {"op12_phrases": op12_phrases}
ORACLE_SQL = {"op12_phrases": SQL}
