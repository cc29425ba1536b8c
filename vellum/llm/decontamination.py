"""Benchmark decontamination by a positional inverted index. DataFrame functions only.

The benchmark's distinct windows are searched, each content once. Term frequencies over all documents
name a window's two rarest places; the index stores (term, document, position) postings of the terms
that stand there, sorted by term. The two lists, each shifted by its place in the window, are
intersected as bitmaps: a posting sets the bits of the window starts that it speaks for in a block of
32 positions, once as a window's rarest place and once as its second; a start that has both is a
candidate. At candidates the document's own words are put together and looked up among the windows, so
what is returned is exact. `find_near` intersects the lists of a phrase's rarest terms by distance.

Sizes: a posting adds two bitmap rows per length of window at most, whatever the windows that hold its term, and a
document has one candidate per start and length at most: a text of one repeated word costs as
much as any other of its length. Terms, anchors, windows and candidates are broadcast while their measured
bytes are within a limit, else both sides are shuffled.

Edge cases: null or wordless texts have no words and are never hit; null or wordless items have no
windows; an item shorter than a window is one window; equal items are searched once and counted each;
repeated rows get equal results; extra columns are ignored; an empty benchmark hits nothing; an empty
document table gives no rows.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import broadcast_within, materialize, table

WINDOW = 10
VOCABULARY_ROWS = 200_000
#: Words of an item that a proximity match looks for, and the words within which they stand.
NEAR_TERMS, SPAN = 3, 10
#: Everything but [0-9A-Za-z] and non-ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def raw_words(text: Column) -> Column:
    """A text's words, A-Z as they are."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS, -1), "")


def lowered(word: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def _documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key): equal rows have equal keys."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("key", F.xxhash64("doc_id", "text"))


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, item_id) of every row, and (item, item_words) of the distinct ones with words."""
    words = F.transform(raw_words(F.col("text")), lowered)
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words.alias("item_words"))
    rows = materialize(rows.where(F.size("item_words") > 0).withColumn("item", F.sha2(F.array_join("item_words", " "), 256)), "items")
    return rows.select("item", "item_id").distinct(), rows.groupBy("item").agg(F.first("item_words").alias("item_words"))


def numbered(terms: DataFrame) -> DataFrame:
    """(term, number) of the distinct terms: small numbers up to VOCABULARY_ROWS terms, hashes beyond."""
    distinct = terms.select("term").distinct()
    if distinct.count() <= VOCABULARY_ROWS:
        return materialize(distinct.withColumn("number", F.row_number().over(Window.orderBy("term")).cast("long")), "terms")
    return materialize(distinct.withColumn("number", F.xxhash64("term")), "terms")


def _tokens(keyed: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(number, key, pos) of the documents' tokens that the vocabulary(term, number) holds."""
    tokens = keyed.select("key", F.posexplode(raw_words(F.col("text"))).alias("pos", "word"))
    tokens = tokens.select(lowered(F.col("word")).alias("term"), "key", "pos")
    return tokens.join(broadcast_within(vocabulary), "term").select("number", "key", "pos")


def build_index(keyed: DataFrame, vocabulary: DataFrame, path: str | None = None) -> DataFrame:
    """Stores (number, key, pos) postings of the vocabulary's terms, sorted by term in every file."""
    return materialize(_tokens(keyed, vocabulary).sortWithinPartitions("number", "key", "pos"), "postings", path)


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(item, gram, n): the windows of every item, words joined by a space."""
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("item_words") - window + 1, F.lit(1))))
    rows = items.select("item", "item_words", starts.alias("first")).withColumn("words", F.slice("item_words", F.col("first"), window))
    return materialize(rows.select("item", F.array_join("words", " ").alias("gram"), F.size("words").alias("n")).distinct(), "windows")


@dataclass(frozen=True)
class Search:
    """What a search over documents shares: keyed documents, the windows, the items, and the terms
    with their frequencies in the documents."""

    keyed: DataFrame
    held: DataFrame
    named: DataFrame
    items: DataFrame
    terms: DataFrame
    window: int


def prepare(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> Search:
    """Reads the benchmark and counts its terms over all documents."""
    if not 1 <= window <= 32:
        raise ValueError("a window has 1 to 32 words")
    keyed = _documents(docs)
    named, items = _items(benchmark)
    vocabulary = numbered(items.select(F.explode("item_words").alias("term")))
    counts = _tokens(keyed, vocabulary).groupBy("number").agg(F.count("*").alias("n_postings"))
    terms = vocabulary.join(counts, "number", "left").select("term", "number", F.coalesce("n_postings", F.lit(0)).alias("n_postings"))
    return Search(keyed, _windows(items, window), named, items, materialize(terms, "frequencies"), window)


def _anchors(search: Search) -> DataFrame:
    """(number, n, first, second): for windows of n words, at which places the term is a window's
    rarest or second rarest, as bits counted from the last place."""
    places = search.held.select("gram", "n").distinct().select("gram", "n", F.posexplode(F.split("gram", " ")).alias("at", "term"))
    places = places.join(broadcast_within(search.terms), "term")
    one = Window.partitionBy("gram")
    ranked = places.withColumn("rank", F.row_number().over(one.orderBy("n_postings", "at"))).withColumn("least", F.min("n_postings").over(one))
    chosen = ranked.where("rank <= 2 and least > 0").withColumn("bit", F.expr(f"shiftleft(1L, {search.window - 1} - at)"))
    mark = lambda which: F.bit_or(F.when(which, F.col("bit")).otherwise(F.lit(0).cast("long")))
    return materialize(chosen.groupBy("number", "n").agg(mark(F.col("rank") == 1).alias("first"), mark((F.col("rank") == 2) | (F.col("n") == 1)).alias("second")), "anchors")


def _candidates(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """(key, blocks): the starts, in blocks of 32, at which both anchors of some window stand."""
    marked = postings.join(broadcast_within(anchors), "number")
    spread = marked.select("key", "n", F.expr("shiftright(pos, 5)").alias("block"), F.expr("shiftleft(first, pos & 31)").alias("first"), F.expr("shiftleft(second, pos & 31)").alias("second"))
    half = lambda up: F.struct((F.col("block") + up).alias("block"), *[F.expr(f"shiftrightunsigned({c}, {32 * up}) & 4294967295L").alias(c) for c in ("first", "second")])
    blocks = spread.select("key", "n", F.inline(F.array(half(0), half(1)))).where("first <> 0 or second <> 0")
    both = blocks.groupBy("key", "n", "block").agg(F.expr("bit_or(first) & bit_or(second)").alias("starts")).where("starts <> 0")
    return both.groupBy("key").agg(F.collect_list(F.struct("n", "block", "starts")).alias("blocks"))


def find_phrases(search: Search) -> DataFrame:
    """(key, gram, start, end): every exact occurrence of a window."""
    anchors = _anchors(search)
    postings = build_index(search.keyed, search.terms.join(anchors.select("number").distinct(), "number", "left_semi").select("term", "number"))
    candidates = materialize(_candidates(postings, anchors), "candidates")
    paired = search.keyed.select("key", "text").join(broadcast_within(candidates), "key")
    # each text is split once: the places are exploded below the words
    texts = paired.withColumn("words", raw_words(F.col("text"))).select("key", "words", F.explode("blocks").alias("b"))
    # 32 rows a block, filtered in the same stage: a lambda would have every row copy its text's words
    starts = texts.select("key", "words", F.col("b.n").alias("n"), F.col("b.block").alias("block"), F.col("b.starts").alias("starts"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit"))
    starts = starts.where("(shiftright(starts, bit) & 1L) = 1")
    starts = starts.withColumn("start", F.col("block") * 32 + F.col("bit") - (search.window - 1)).where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.size("words")))
    grams = starts.select("key", "n", "start", lowered(F.array_join(F.slice("words", F.col("start") + 1, F.col("n")), " ")).alias("gram"))
    windows = materialize(search.held.select("gram").distinct(), "grams")
    found = grams.join(broadcast_within(windows), "gram")
    return materialize(found.select("key", "gram", "start", (F.col("start") + F.col("n")).alias("end")).distinct(), "phrases")


def _near(search: Search, rarest: int, span: int) -> DataFrame:
    """(key, item, end): places where the last of an item's `rarest` rarest words stands within
    `span` words of all the others."""
    words = search.items.select("item", F.explode(F.array_distinct("item_words")).alias("term")).join(search.terms, "term")
    one = Window.partitionBy("item")
    ranked = words.withColumn("rank", F.row_number().over(one.orderBy("n_postings", "term"))).withColumn("least", F.min("n_postings").over(one))
    chosen = materialize(ranked.where((F.col("rank") <= rarest) & (F.col("least") > 0)).select("item", "number", "rank"), "rarest")
    # items of equal rarest words are one search
    sets = materialize(chosen.groupBy("item").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "number"))), lambda x: x.number), ",").alias("set"), F.count("*").alias("need")), "sets")
    members = materialize(chosen.join(sets, "item").select("set", "need", "number", "rank").distinct(), "members")
    postings = build_index(search.keyed, search.terms.join(members.select("number").distinct(), "number", "left_semi").select("term", "number"))
    seeds = postings.join(broadcast_within(members), "number").select("key", "set", "need", "rank", "pos").distinct()
    so_far = Window.partitionBy("key", "set").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.when(F.col("need") < k, F.col("pos")).otherwise(F.coalesce(F.max(F.when(F.col("rank") == k, F.col("pos"))).over(so_far), F.lit(-span - 1))) for k in range(1, rarest + 1)]
    met = seeds.withColumn("first", F.least(*last, F.col("pos"))).where(F.col("pos") - F.col("first") < span)
    return materialize(met.select("key", "set", (F.col("pos") + 1).alias("end")).join(sets.select("item", "set"), "set").select("key", "item", "end"), "near")


def find_near(docs: DataFrame, phrases: DataFrame, span: int = SPAN, rarest: int = NEAR_TERMS) -> DataFrame:
    """(doc_id, item_id, end) where the `rarest` rarest distinct words of a phrase(item_id, text), or all
    if it has fewer, stand within `span` consecutive words that end before `end`, in any order."""
    search = prepare(docs, phrases)
    ids = search.keyed.select("key", "doc_id").distinct()
    return _near(search, rarest, span).join(ids, "key").join(search.named, "item").select("doc_id", "item_id", "end")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near) of every document row; n_near
    counts the items whose rarest words stand near each other."""
    search = prepare(docs, benchmark, window)
    found = find_phrases(search)
    # overlapping runs of a document: each adds the words beyond the furthest end before it
    before = F.max("end").over(Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    runs = found.select("key", "start", "end").distinct().withColumn("_before", F.coalesce(before, F.lit(0)))
    hits = runs.groupBy("key").agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "_before"), F.lit(0))).cast("long").alias("n_hit"))
    ids = found.select("key", "gram").distinct().join(search.held.select("gram", "item"), "gram").select("key", "item").distinct().join(search.named, "item")
    ids = ids.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    near = _near(search, NEAR_TERMS, SPAN).select("key", "item").distinct().join(search.named, "item").groupBy("key").agg(F.count_distinct("item_id").alias("n_near"))
    side = hits.join(ids, "key").select("key", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256")).join(near, "key", "full")
    side = materialize(side, "hits")
    rows = search.keyed.select("doc_id", "key", F.size(raw_words(F.col("text"))).cast("long").alias("n_words"))
    joined = rows.join(broadcast_within(side), "key", "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that hold no whole window of the benchmark."""
    hit = materialize(find_phrases(prepare(docs, benchmark, window)).select(F.col("key").alias("__hit_key")).distinct(), "hit")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.join(broadcast_within(hit), key == F.col("__hit_key"), "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontamination": op10_decontamination}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = {
    "op10_decontamination": rf"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (n, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
item_terms AS (SELECT DISTINCT item_id, unnest(w) AS t FROM items),
postings AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM docs),
ranked AS (
  SELECT item_id, t, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(n, 0), t) AS k
  FROM item_terms LEFT JOIN (SELECT t, count(*) AS n FROM postings GROUP BY t) USING (t)),
rarest AS (SELECT item_id, t, k, max(k) OVER (PARTITION BY item_id) AS need, min(n) OVER (PARTITION BY item_id) AS least FROM ranked WHERE k <= 3),
seeds AS (SELECT doc_id, item_id, k, need, p FROM rarest JOIN postings USING (t) WHERE least > 0),
lasts AS (
  SELECT doc_id, item_id, p,
         max(CASE WHEN k = 1 THEN p END) OVER f AS a,
         CASE WHEN need < 2 THEN p ELSE max(CASE WHEN k = 2 THEN p END) OVER f END AS b,
         CASE WHEN need < 3 THEN p ELSE max(CASE WHEN k = 3 THEN p END) OVER f END AS c
  FROM seeds WINDOW f AS (PARTITION BY doc_id, item_id ORDER BY p)),
near AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near FROM lasts
  WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND p - least(a, b, c) < 10 GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM docs LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN near USING (doc_id)
"""
}
