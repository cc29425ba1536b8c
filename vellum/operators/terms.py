"""Joins of words and phrases with term dictionaries of any size.

A dictionary is a table of terms; words are looked up under several forms (exact, without a German ending), so the join is
an equi-join of forms, made once per distinct word. What it finds goes back to the texts by a second equi-join.
A dictionary is broadcast only if its counted rows are within `BROADCAST_ROWS`; beyond it, and for what was found in texts,
Spark shuffles both sides and may still broadcast one whose size it has measured.

Edge cases: null texts have no words; null or blank terms match nothing; repeated rows are counted as often as they occur;
empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import terms as T

BROADCAST_ROWS = 200_000
#: Characters on either side of a name in which a word for diseases counts.
REACH = 50


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A side broadcast if it has at most `limit` rows; counting stops beyond that."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def dictionary(spark: SparkSession, *more: DataFrame) -> DataFrame:
    """The default terms and drugs with further tables' `term`, as distinct lower-case terms."""
    out = spark.createDataFrame([(t,) for t in T.TERMS + T.DRUGS], "term string")
    for df in more:
        out = out.unionByName(df.select(F.col("term").cast("string").alias("term")))
    return out.select(F.lower(F.trim("term")).alias("term")).where("term <> ''").distinct()


def matched_words(words: DataFrame, terms: DataFrame) -> DataFrame:
    """words(word) -> the distinct ones that a term protects: (word, via), exact or stem."""
    distinct = words.select("word").where("word is not null").distinct()
    looked_up = distinct.select("word", F.explode(T.forms(F.col("word"))).alias("term"))
    hits = looked_up.join(sized(terms), "term", "left_semi")
    return hits.groupBy("word").agg(F.when(F.max(F.col("term") == F.lower("word")), "exact").otherwise("stem").alias("via"))


def all_forms(terms: DataFrame) -> DataFrame:
    """terms(term) -> (form, via) of the lower-case words that they protect, by which few terms meet words without a pass for the distinct ones."""
    ends = F.array(F.lit(""), *[F.lit(s) for s in T.SUFFIXES])
    made = terms.where("term <> ''").select("term", F.explode(F.when(F.length("term") > T.STEM, ends).otherwise(F.array(F.lit("")))).alias("end"))
    return made.groupBy(F.concat("term", "end").alias("form")).agg(F.when(F.min("end") == "", "exact").otherwise("stem").alias("via"))


def _numbered(docs: DataFrame, *columns) -> DataFrame:
    """Columns with a number for every row, given before any row is exploded."""
    return docs.select(*columns).withColumn("row", F.monotonically_increasing_id())


def protected_tokens(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> per document its tokens, those that a term protects, how many of them by their stem, and which, sorted."""
    listed = _numbered(docs, "doc_id", T.tokens(F.col("text")).alias("words")).select("doc_id", "row", F.explode_outer("words").alias("word"))
    most = BROADCAST_ROWS // (1 + len(T.SUFFIXES))
    if terms.limit(most + 1).count() <= most:
        hits = listed.join(F.broadcast(all_forms(terms)), F.lower("word") == F.col("form"), "left").withColumn("n", F.col("word").isNotNull().cast("long"))
    else:
        found = matched_words(docs.select(F.explode(T.tokens(F.col("text"))).alias("word")), terms)
        hits = listed.groupBy("row", "doc_id", "word").agg(F.count("word").alias("n")).join(found, "word", "left")
    # words without a hit are one row of a document before anything is shuffled
    counted = hits.groupBy("row", "doc_id", F.when(F.col("via").isNotNull(), F.col("word")).alias("word"), "via").agg(F.sum("n").alias("n"))
    rows = counted.groupBy("row", "doc_id").agg(
        F.sum("n").alias("n_tokens"),
        F.coalesce(F.sum(F.when(F.col("via").isNotNull(), F.col("n"))), F.lit(0)).alias("n_protected"),
        F.coalesce(F.sum(F.when(F.col("via") == "stem", F.col("n"))), F.lit(0)).alias("n_by_stem"),
        F.array_join(F.array_sort(F.collect_set("word")), " ").alias("protected"),
    )
    return rows.drop("row")


def protected_phrases(phrases: DataFrame, terms: DataFrame) -> DataFrame:
    """phrases(phrase) -> (phrase, via) of the distinct ones: whole phrase exact or by stem, else any word of it, else null."""
    distinct = phrases.select("phrase").where("phrase is not null").distinct()
    parts = F.when(F.contains("phrase", F.lit(" ")), F.split("phrase", r"\s+")).otherwise(F.array().cast("array<string>"))
    looked_up = distinct.select("phrase", F.explode(F.concat(F.transform(F.array("phrase"), lambda p: F.struct(F.lit(0).alias("place"), p.alias("word"))), F.transform(parts, lambda p: F.struct(F.lit(1).alias("place"), p.alias("word"))))).alias("x"))
    hits = matched_words(looked_up.select(F.col("x.word").alias("word")), terms)
    rank = F.when(F.col("via").isNull(), 3).when(F.col("x.place") == 1, 2).when(F.col("via") == "exact", 0).otherwise(1)
    best = looked_up.withColumn("word", F.col("x.word")).join(hits, "word", "left").groupBy("phrase").agg(F.min(rank).alias("best"))
    return best.select("phrase", F.element_at(F.array(F.lit("exact"), F.lit("stem"), F.lit("word"), F.lit(None).cast("string")), F.col("best") + 1).alias("via"))


def eponyms(docs: DataFrame, names: DataFrame, reach: int = REACH) -> DataFrame:
    """docs(doc_id, text) -> every capitalised word with whether it names a disease: (doc_id, pos, name, in_list, near).

    near: a disease word stands within `reach` characters. The text itself is not repeated per word; the windows put the
    context together from neighbouring matches and gaps: a match has two characters at least, so `reach` / 2 rows suffice."""
    word = rf"(?U)\b{T.NAME_WORD}\b"
    text = F.coalesce("text", F.lit(""))
    pieces = F.arrays_zip(F.split(text, word, -1).alias("gap"), F.regexp_extract_all(text, F.lit(word), F.lit(0)).alias("name"))
    rows = _numbered(docs, "doc_id", pieces.alias("pieces")).select("doc_id", "row", F.posexplode("pieces").alias("pos", "x")).select("doc_id", "row", "pos", "x.gap", "x.name")
    rows = rows.select("doc_id", "row", "pos", "name", F.right("gap", F.lit(reach)).alias("tail"), F.left("gap", F.lit(reach)).alias("head"))
    order = Window.partitionBy("row").orderBy("pos")
    span = reach // 2 + 1
    before = F.concat(F.coalesce(F.array_join(F.collect_list(F.concat("tail", F.coalesce("name", F.lit("")))).over(order.rowsBetween(-span, -1)), ""), F.lit("")), "tail")
    after = F.coalesce(F.array_join(F.collect_list(F.concat("head", F.coalesce("name", F.lit("")))).over(order.rowsBetween(1, span)), ""), F.lit(""))
    near = lambda c: F.array(*[F.contains(F.lower(c), F.lit(w)) for w in T.DISEASE_WORDS])
    context = F.concat(F.right("before", F.lit(reach)), "name", F.left("after", F.lit(reach)))
    rows = rows.withColumns({"before": before, "after": after}).where("name is not null")
    listed = sized(names.select(F.lower("name").alias("low")).distinct()).withColumn("in_list", F.lit(True))
    rows = rows.select("doc_id", "pos", "name", F.lower("name").alias("low"), F.array_max(near(context)).alias("near")).join(listed, "low", "left")
    return rows.select("doc_id", "pos", "name", F.coalesce("in_list", F.lit(False)).alias("in_list"), "near")


def rules(spark: SparkSession, abbreviations: DataFrame | None = None) -> DataFrame:
    """The verifier's rules as a table (priority, way, value, reason); `abbreviations`(abbreviation, meaning) come first."""
    out = spark.createDataFrame([(p, w, v, r.replace("{}", v)) for p, w, v, r in T.RULES], "priority int, way string, value string, reason string").dropDuplicates(["priority", "way", "value"])
    if abbreviations is not None:
        meaning = F.concat(F.lit("abbreviation:"), F.coalesce(F.left(F.nullif("meaning", F.lit("")), F.lit(50)), F.lit("known")))
        out = out.unionByName(abbreviations.select(F.lit(1).alias("priority"), F.lit(T.EQUAL).alias("way"), F.lower("abbreviation").alias("value"), meaning.alias("reason")))
    return out


def _substrings(text: Column, size: int) -> Column:
    """All substrings of a size."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(text, i, F.lit(size)))


def _hits(words: DataFrame, table: DataFrame, way: str, keys: Column, holds: Column) -> DataFrame:
    """Words whose keys meet the rules of one way, by an equi-join."""
    some = words.select("term", "low", F.explode(keys).alias("value")).where(holds)
    return some.join(F.broadcast(table.where(F.col("way") == way)) if way != T.EQUAL else sized(table.where(F.col("way") == way)), "value").select("term", "priority", "value", "reason")


def verified(words: DataFrame, table: DataFrame) -> DataFrame:
    """words(term) -> (term, is_medical, reason) of the distinct terms: the rule of the first group that holds.

    Rules are met by equi-joins on the whole term, its ends, its beginnings and its parts of the lengths that occur, and by
    the few expressions; the first is the least by (priority, longest value, value)."""
    distinct = words.select("term").where("term is not null").distinct()
    long = distinct.withColumn("low", F.lower("term")).where(F.length("term") >= 2)
    sizes = lambda values: sorted({len(v) for v in values})
    n = F.length("low")
    ends = F.array_compact(F.array(*[F.when(n > k + 2, F.right("low", F.lit(k))) for k in sizes(T.ENDINGS)]))
    begun = F.array_compact(F.array(*[F.when(n > k + 3, F.left("low", F.lit(k))) for k in sizes(T.BEGINNINGS)]))
    parts = F.flatten(F.array(*[_substrings(F.col("low"), k) for k in sizes(T.ROOTS)]))
    hits = _hits(long, table, T.EQUAL, F.array("low"), F.lit(True))
    hits = hits.unionByName(_hits(long, table, T.END, ends, F.lit(True)))
    hits = hits.unionByName(_hits(long, table, T.BEGINNING, begun, F.array_max(F.array(*[F.endswith("low", F.lit(e)) for e in T.BEGUN_ENDS]))))
    hits = hits.unionByName(_hits(long, table, T.PART, F.array_distinct(parts), F.lit(True)))
    for priority, way, value, reason in T.RULES:
        if way == T.EXPRESSION:
            hits = hits.unionByName(long.where(F.col("term").rlike(value)).select("term", F.lit(priority).alias("priority"), F.lit("").alias("value"), F.lit(reason).alias("reason")))
    # of equal groups the roots count in their order, others by length
    root = F.array_position(F.array(*[F.lit(r) for r in T.ROOTS]), F.col("value"))
    place = F.when(F.col("priority") == 12, root).otherwise(-F.length("value"))
    first = hits.groupBy("term").agg(F.min_by("reason", F.struct("priority", place, "value")).alias("reason"))
    out = distinct.join(first, "term", "left")
    return out.select("term", F.col("reason").isNotNull().alias("is_medical"), F.coalesce("reason", F.when(F.length("term") < 2, "too_short").otherwise("not_medical")).alias("reason"))
