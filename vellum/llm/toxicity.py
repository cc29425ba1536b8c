"""Toxicity by a classifier chain of linear models.

The labelled categories are predicted in order. Each is a logistic regression on the presence of
features; a later category's model also gets the probabilities of the earlier ones. For training these
come from models that did not see the row (out-of-fold, `FOLDS` folds by a hash of the document id),
so that later models learn from probabilities like those that they meet afterwards.

Features of a text: its words in lower case without outer punctuation, their character 4-grams with
ends marked, their beginnings of 5 to 9 characters, and runs of trailing punctuation. Of these `FEATURES` per category are kept, by chi-squared on the training
rows. Training reads at most `TRAIN_ROWS` labelled rows (those of least id hash); counting, scoring
and deciding cover all rows.

Edge cases: null or empty text has no features and is scored by the intercepts; unlabelled rows and
null labels don't train; of several labels for an id the positive one counts; a category with one
value only, or no labels, gets a constant probability (0 without labels); repeated rows get equal
results; extra columns are carried through by `keep_clean`; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import chunks, materialize, table

#: Labelled rows that training reads at most.
TRAIN_ROWS = 20_000
#: Tasks over which those rows are fitted: some thousands in each.
FIT_TASKS = 4
FEATURES = 1_000
FOLDS = 3
THRESHOLD = 0.4
REGULARISATION = 0.0005
LEAST_ROWS = 3
CACHE_WORDS = 150_000
#: Characters that are taken off a word's ends.
OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: The chain over the `labels` table: name, label expression.
CHAIN = (("low_quality", "1 - quality"), ("toxic", "toxic"))


def features_of(word: str) -> list[str]:
    """The features of one white-space separated word in lower case."""
    core = word.strip(OUTER)
    tail = word[len(word.rstrip(OUTER)) :]
    found = ["." + tail] if len(tail) > 1 else []
    if core:
        marked = f"^{core}$"
        found.append("=" + core)
        found += [marked[i : i + 4] for i in range(max(len(marked) - 3, 1))]
        found += [marked[: k + 1] for k in range(5, min(len(core), 10))]
    return found


@dataclass(frozen=True)
class Chain:
    """The chain's models: kept features, then per category its name, weights, intercept and the
    weights of the earlier categories' probabilities."""

    index: dict[str, int]
    names: tuple[str, ...]
    weights: np.ndarray
    intercepts: tuple[float, ...]
    earlier: tuple[tuple[float, ...], ...]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


class Scorer:
    """A task's scorer: remembers which kept features a word has, and goes with the task."""

    def __init__(self, index: dict[str, int]) -> None:
        self.index, self.known = index, {}

    def present(self, text: str | None) -> set[int]:
        """The kept features that a text has."""
        known = self.known
        words = set((text or "").lower().split())
        for word in words.difference(known):
            known[word] = tuple({self.index[f] for f in features_of(word) if f in self.index})
        found = set().union(*map(known.__getitem__, words))
        if len(known) > CACHE_WORDS:
            known.clear()
        return found


def _probabilities(chain: Chain, scorer: Scorer, texts: list[str | None]) -> np.ndarray:
    present = [sorted(scorer.present(text)) for text in texts]
    ends = np.cumsum([len(x) for x in present], dtype=np.int64)
    some = np.flatnonzero(np.diff(ends, prepend=0))
    out = np.zeros((len(texts), len(chain.names)))
    if len(some):
        weights = chain.weights[:, np.fromiter(itertools.chain.from_iterable(present), np.int64, int(ends[-1]))]
        out[some] = np.add.reduceat(weights, np.concatenate(([0], ends[:-1]))[some], axis=1).T
    for c in range(len(chain.names)):
        out[:, c] = _sigmoid(out[:, c] + chain.intercepts[c] + out[:, :c] @ np.array(chain.earlier[c][:c], dtype=float))
    return out


def training_rows(docs: DataFrame, labels: DataFrame, chain: tuple[tuple[str, str], ...] = CHAIN, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, one column per category): the labelled rows that train."""
    values = [F.max(F.expr(e).cast("int")).alias(n) for n, e in chain]
    some = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(*values)
    some = some.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most `rows` rows of a few numbers
    return texts.join(F.broadcast(some), F.col("doc_id") == F.col("_id")).select("doc_id", "text", *[n for n, _ in chain])


def _counts(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", 1 << 20):
            counts: dict[str, list[int]] = {}
            values = list(zip(*[part.column(n).to_pylist() for n in names], strict=True))
            for text, labels in zip(part.column("text").to_pylist(), values, strict=True):
                marks = [x for v in labels for x in ((v == 1) + 0, (v == 0) + 0)]
                for f in {f for w in set((text or "").lower().split()) for f in features_of(w)}:
                    if (c := counts.get(f)) is None:
                        counts[f] = list(marks)
                    else:
                        for i, m in enumerate(marks):
                            c[i] += m
            columns = [pa.array(list(counts), pa.string())] + [pa.array([c[i] for c in counts.values()], pa.int64()) for i in range(2 * len(names))]
            yield pa.RecordBatch.from_arrays(columns, ["feature", *[f"{n}_{k}" for n in names for k in ("yes", "no")]])

    return run


def select_features(rows: DataFrame, names: list[str], keep: int = FEATURES) -> dict[str, int]:
    """The features of highest chi-squared for any category, numbered; at most keep * len(names)."""
    columns = [f"{n}_{k}" for n in names for k in ("yes", "no")]
    counts = rows.mapInArrow(_counts(names), "feature string, " + ", ".join(f"{c} long" for c in columns))
    counts = materialize(counts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in columns]), "features")
    totals = rows.agg(*[F.count_if(F.col(n) == v).alias(f"{n}_{k}") for n in names for k, v in (("yes", 1), ("no", 0))]).first()
    found: set[str] = set()
    for n in names:
        yes, no = totals[f"{n}_yes"], totals[f"{n}_no"]
        if not yes or not no:
            continue
        a, b = F.col(f"{n}_yes").cast("double"), F.col(f"{n}_no").cast("double")
        both = a + b
        chi = (yes + no) * F.pow(a * (no - b) - b * (yes - a), F.lit(2)) / (F.lit(float(yes) * no) * both * (yes + no - both))
        top = counts.where((both >= LEAST_ROWS) & (both < yes + no)).select("feature", chi.alias("chi")).orderBy(F.desc("chi"), "feature").limit(keep)
        found.update(r.feature for r in top.collect())
    return {f: i for i, f in enumerate(sorted(found))}


def _presence(index: dict[str, int], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(index)
        for part in chunks(batches, "text"):
            at = [sorted(scorer.present(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(at, pa.list_(pa.int32())), *[part.column(n) for n in names]], ["doc_id", "at", *names])

    return run


def _fit(rows: DataFrame, name: str, width: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on `x`; a constant if the label is."""
    seen = {r[0]: r[1] for r in rows.groupBy(name).count().collect() if r[0] is not None}
    if len(seen) < 2:
        return np.zeros(width), -20.0 if not seen or 0 in seen else 20.0
    model = LogisticRegression(featuresCol="x", labelCol=name, regParam=REGULARISATION, maxIter=60, standardization=False).fit(rows.where(F.col(name).isNotNull()))
    return np.array(model.coefficients.toArray()), float(model.intercept)


def _with_vectors(rows: DataFrame, width: int, earlier: int) -> DataFrame:
    """Adds `x`: the presence of each kept feature, then the earlier categories' probabilities, as sparse vectors."""
    present = CountVectorizerModel.from_vocabulary([str(i) for i in range(max(width, 1))], "_features", "_presence")
    counted = present.setBinary(True).transform(rows.withColumn("_features", F.transform("at", lambda i: i.cast("string"))))
    # the vocabulary may not be empty: its one feature then occurs nowhere
    for k in range(earlier):
        counted = counted.withColumn(f"_p{k}", F.col("earlier")[k])
    return VectorAssembler(inputCols=["_presence", *[f"_p{k}" for k in range(earlier)]], outputCol="x").transform(counted).drop("_features")


def train(docs: DataFrame, labels: DataFrame, chain: tuple[tuple[str, str], ...] = CHAIN, rows: int = TRAIN_ROWS, keep: int = FEATURES, folds: int = FOLDS) -> Chain:
    """Fits the chain on the labelled rows of docs."""
    names = [n for n, _ in chain]
    some = materialize(training_rows(docs, labels, chain, rows), "labelled")
    index = select_features(some, names, keep)
    width = len(index)
    present = materialize(some.mapInArrow(_presence(index, names), "doc_id long, at array<int>, " + ", ".join(f"{n} int" for n in names)).coalesce(FIT_TASKS), "presence")
    present = present.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds)))
    weights, intercepts, earlier = [], [], []
    passed = present.withColumn("earlier", F.expr("cast(array() as array<double>)"))
    for c, name in enumerate(names):
        width_now = max(width, 1) + c
        rows_now = _with_vectors(passed, width, c).cache()
        w, b = _fit(rows_now, name, width_now)
        weights.append(w[:width])
        earlier.append(tuple(float(x) for x in w[max(width, 1) :]))
        intercepts.append(b)
        if c + 1 < len(names):
            fitted = [_fit(rows_now.where(F.col("fold") != k), name, width_now) for k in range(folds)]
            passed = materialize(passed.mapInArrow(_out_of_fold(fitted, width), passed.schema), "chain")
        rows_now.unpersist()
    return Chain(index, tuple(names), np.array(weights).reshape(len(names), width), tuple(intercepts), tuple(earlier))


def _out_of_fold(fitted: list[tuple[np.ndarray, float]], width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Appends to `earlier` the probability by the model that did not see the row's fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at, before, fold in zip(*[batch.column(c).to_pylist() for c in ("at", "earlier", "fold")], strict=True):
                w, b = fitted[fold]
                out.append([*before, float(_sigmoid(w[at].sum() + b + float(np.dot(w[max(width, 1) :], before) if before else 0.0)))])
            k = batch.schema.get_field_index("earlier")
            yield batch.set_column(k, batch.schema.field(k), pa.array(out, batch.schema.field(k).type))

    return run


def _scores(chain: Chain) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(chain.index)
        for part in chunks(batches, "text"):
            p = np.round(_probabilities(chain, scorer, part.column("text").to_pylist()), 6)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(p[:, c]) for c in range(len(chain.names))]], ["doc_id", *[f"p_{n}" for n in chain.names]])

    return run


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, p_<category> ...) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scores(chain), "doc_id long, " + ", ".join(f"p_{n} double" for n in chain.names))


def keep_clean(docs: DataFrame, chain: Chain, category: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose probability of the category is below the threshold, all columns kept."""
    which, at = chain.names.index(category), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(chain.index)
        for part in chunks(batches, "text"):
            p = _probabilities(chain, scorer, part.column(at).to_pylist())[:, which]
            yield part.filter(pa.array(np.round(p, 6) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.withColumn("toxic", F.col("p_toxic") >= THRESHOLD)


QUERIES = {"op6_toxicity": op6_toxicity}
