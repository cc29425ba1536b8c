"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. A source takes floor(target / size) whole copies of every document
for certain; the rest, a share f of its words below 1, is an unequal-probability sample in Pareto order (Rosén
1997): document i with inclusion probability p_i has rank (u / (1 - u)) / (p_i / (1 - p_i)) for a uniform u, and
the lowest ranks are taken until the words reach the rest of the target. p_i = min(1, level * weight_i), the level such
that the expected words, the sum of p_i * size_i, are the rest; a document of p_i = 1 is taken for certain. The weight
is the square root of the size unless a column gives it, so that long documents are likelier, but less than in
proportion; it is rounded down to classes of 1 / `CLASSES` octave, from whose sums each source's level
is found. u hashes the row and a seed, so reruns agree.

The words below a rank are a prefix sum without a window over a whole source: ranks fall into
buckets of about `BUCKET_ROWS` documents (more where many documents are far less likely than the mean), buckets are
summed, and only documents of the one bucket per source where the sum passes the rest are ordered exactly.

Edge cases: null text has size 0 and takes 0 words; null sources form one source, last in order;
rows of equal id and text share their rank, so they are taken alike but for a tie at the cut; a source of
size 0 takes nothing; a null or non-positive weight counts as the least class; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import materialize, table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SEED = 17
BUCKET_ROWS = 1000
#: Weight classes to an octave, and the classes' range.
CLASSES, RANGE = 16, 1024
#: Sources up to which their table of totals is broadcast (some 100 bytes each).
BROADCAST_SOURCES = 50_000


def n_words(column: str = "text"):
    """The number of `[^\\x20\\x09-\\x0D]+` words; white space ends are the only bytes looked at."""
    kept = F.trim(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(kept == "", F.lit(0)).otherwise(F.length(kept) - F.length(F.replace(kept, F.lit(" "), F.lit(""))) + 1).cast("long")


def allocate(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources(source, source_size) -> with `target`: shares of share * all words by weight, at most
    most * source_size, the excess dealt again by weight until none is above.

    Water-filling in closed form: sources capped first are those of least most * size / weight; with
    them at their caps the others get a common multiple of their weights. The windows run over one row
    per source, which is as many rows as there are sources, not documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sources.withColumn("_at", F.row_number().over(order) - 1).withColumn(
        "_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    )
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("_cap") / F.col("_weight"), "_at")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        listed.withColumn("_cap", most * F.col("source_size"))
        .withColumn("_total", share * F.sum("source_size").over(everything))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_open"))
        .withColumn("_is_capped", F.col("_level") * F.col("_weight") >= F.col("_cap"))
    )
    # once a source isn't capped, none after it is; the first such level holds for all of them
    level = F.min(F.when(~F.col("_is_capped"), F.struct("_at2", "_level"))).over(everything)
    return (
        filled.withColumn("_at2", F.row_number().over(fill))
        .withColumn("_first", level)
        .withColumn("target", F.when(F.col("_first").isNull() | (F.col("_at2") < F.col("_first._at2")), F.col("_cap")).otherwise(F.col("_first._level") * F.col("_weight")).cast("double"))
        .select("source", "source_size", "target")
    )


def _uniform(seed: int, *columns: str):
    """A uniform in (0, 1) from a row's hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]), 11).cast("double") + 0.5) / float(1 << 53)


def _levels(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, level, certain): the factor from weights to probabilities, and the words of documents of probability 1.

    Classes are capped from the heaviest down; the first that stays below 1 with all above it capped names the level.
    The windows run over a source's classes, 2 * `RANGE` rows at most.
    """
    classes = rows.groupBy("source", "_class").agg(F.sum("size").alias("_words")).join(plan.select("_s", "_rest"), F.col("source").eqNullSafe(F.col("_s")))
    weight = F.pow(F.lit(2.0), F.col("_class") / CLASSES)
    down = Window.partitionBy("_s").orderBy(F.desc("_class"))
    above = F.coalesce(F.sum("_words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(weight * F.col("_words")).over(down.rowsBetween(0, Window.unboundedFollowing))
    tried = classes.withColumn("_above", above).withColumn("_level", F.when(below > 0, (F.col("_rest") - F.col("_above")) / below))
    is_open = F.col("_level") * weight <= 1
    best = tried.groupBy("_s").agg(F.max(F.when(is_open, F.struct("_class", "_level", "_above"))).alias("_b"))
    return best.select(F.col("_s").alias("_ls"), F.greatest(F.coalesce("_b._level", F.lit(0.0)), F.lit(0.0)).alias("_level"), F.coalesce("_b._above", F.lit(0)).alias("_certain"))


def probabilities(rows: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """rows(source, size, _class, ...) -> with source_size, target, whole copies and the probability `_p` of one more."""
    stats = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n")), "sources")
    n = stats.count()
    side = (lambda df: F.broadcast(df)) if n <= BROADCAST_SOURCES else (lambda df: df)
    plan = (
        allocate(stats.select("source", "source_size"), weights, share, most)
        .withColumnRenamed("source", "_s")
        .join(stats.select(F.col("source").alias("_s2"), "_n"), F.col("_s").eqNullSafe(F.col("_s2")))
        .withColumn("_ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("_whole", F.floor(F.col("_ratio") + 1e-12).cast("long"))
        .withColumn("_rest", F.greatest(F.col("target") - F.col("_whole") * F.col("source_size"), F.lit(0.0)))
        .withColumn("_f", F.greatest(F.col("_ratio") - F.col("_whole"), F.lit(0.0)))
        .withColumn("_buckets", F.greatest(F.ceil(F.col("_n") / BUCKET_ROWS), F.lit(1)))
        .drop("_s2")
    )
    plan = materialize(plan, "targets")
    plan = materialize(plan.join(_levels(rows, plan), F.col("_s").eqNullSafe(F.col("_ls"))).drop("_ls"), "levels")
    p = F.when(F.col("_f") > 0, F.least(F.col("_level") * F.pow(F.lit(2.0), F.col("_class") / CLASSES), F.lit(1.0))).otherwise(0.0)
    return rows.join(side(plan), F.col("source").eqNullSafe(F.col("_s"))).withColumn("_p", p)


def classed(sized: DataFrame, weight: str | None = None) -> DataFrame:
    """Adds the weight's class."""
    w = F.col(weight).cast("double") if weight else F.sqrt(F.greatest(F.col("size"), F.lit(1)).cast("double"))
    octaves = F.floor(F.log2(F.when(w > 0, w)) * CLASSES)
    return sized.withColumn("_class", F.greatest(F.least(F.coalesce(octaves, F.lit(-RANGE)), F.lit(RANGE)), F.lit(-RANGE)).cast("int"))


def mix(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, weight: str | None = None) -> DataFrame:
    """sized(doc_id, source, size, row_hash[, weight][, row]) -> with source_size, target, copies and taken words.

    A struct column `row` is carried through; it is read again, not stored.
    """
    rows = classed(sized, weight)
    if "row" not in sized.columns:
        rows = materialize(rows, "sized")
    drawn = probabilities(rows, weights, share, most).withColumn("_u", _uniform(seed, "doc_id", "row_hash"))
    u, p, f = F.col("_u"), F.col("_p"), F.least(F.col("_f"), F.lit(1 - 1e-9))
    rank = F.when(p >= 1, F.lit(0.0)).when(p <= 0, F.lit(1e300)).otherwise(u / (1 - u) * (1 - p) / p)
    # beside the odds of f, ranks of documents as likely as the mean are as even as u
    even = F.col("_rank") * f / (1 - f)
    ranked = (
        drawn.withColumn("_rank", rank)
        .withColumn("_key", F.when(p <= 0, F.lit(1.0)).otherwise(even / (1 + even)))
        .withColumn("_bucket", F.least(F.floor(F.col("_key") * F.col("_buckets")), F.col("_buckets") - 1))
        .withColumn("_sure", p >= 1)
    )
    sums = ranked.where("_f > 0 and not _sure").groupBy("_s", "_bucket").agg(F.sum("size").alias("_words"), F.first(F.col("_rest") - F.col("_certain")).alias("_left"))
    # one row per bucket; the window over a source holds its documents / BUCKET_ROWS rows
    running = Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        sums.withColumn("_before", F.coalesce(F.sum("_words").over(running), F.lit(0)))
        .where("_before < _left and _before + _words >= _left")
        .groupBy(F.col("_s").alias("_cs"))
        .agg(F.min(F.struct(F.col("_bucket").alias("_cut"), "_before")).alias("_c"))
        .select("_cs", "_c.*")
    )
    cut = materialize(cut, "cuts")
    side = (lambda df: F.broadcast(df)) if cut.count() <= BROADCAST_SOURCES else (lambda df: df)
    joined = ranked.join(side(cut), F.col("_s").eqNullSafe(F.col("_cs")), "left")
    exact = Window.partitionBy("_s", "_bucket").orderBy("_rank", "doc_id", "row_hash").rowsBetween(Window.unboundedPreceding, -1)
    at_cut = joined.where("_bucket = _cut and not _sure").withColumn("_words", F.col("_before") + F.coalesce(F.sum("size").over(exact), F.lit(0)))
    # a document goes in if more than half of it lies below the rest: the sum ends within half a document
    at_cut = at_cut.withColumn("_extra", F.col("_words") + F.col("size") / 2 <= F.col("_rest") - F.col("_certain")).drop("_words")
    others = joined.where("_cut is null or _bucket <> _cut or _sure")
    others = others.withColumn("_extra", (F.col("_f") > 0) & (F.col("_sure") | ((F.col("_rest") > F.col("_certain")) & (F.col("_cut").isNull() | (F.col("_bucket") < F.col("_cut"))))))
    return others.unionByName(at_cut).withColumn("copies", F.col("_whole") + F.col("_extra").cast("long")).withColumn("taken", F.col("copies") * F.col("size"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, row_hash) of docs(doc_id, source, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words().alias("size"), F.xxhash64("text").alias("row_hash"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The documents that the mix takes, each repeated as often as it is taken whole."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row")).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").cast("string").alias("source"), n_words("row.text").alias("size"), F.xxhash64("row.text").alias("row_hash"), "row"
    )
    taken = mix(rows, weights, share, most, seed).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op5_mixing": op5_mixing}
