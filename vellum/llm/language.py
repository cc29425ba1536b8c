"""Language identification by segmentation-marginalised unigrams.

Every language has a probability per piece of a fixed public vocabulary. A word's probability is the
sum over all of its segmentations into pieces, by the forward algorithm; a text's is the product over
its words. Probabilities are fitted by expectation maximisation (forward-backward on distinct words
with their counts), starting from how often each piece occurs as a substring. A character outside the
vocabulary is a piece of its own, equally likely in all languages.

Words are runs of letters, lower-cased, with the vocabulary's word start in front. The model is fitted
on at most `TRAIN_ROWS` labelled documents, those of least id hash; prediction reads whole texts. A
worker remembers words' log probabilities between tasks, so a word is segmented once.

Edge cases: text that is null or holds no letter is `und` with score 0, as is every text where nothing
could be learned; documents of null lang or null doc_id don't train, and a null doc_id is not held
out; repeated rows get equal results; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import chunks, materialize, table

VOCABULARY = "piece_bpe_32k.model"
#: Labelled documents that fitting reads at most.
TRAIN_ROWS = 12_000
ROUNDS = 3
SMOOTHING = 0.01
UNKNOWN = 1e-7
CACHE_WORDS = 700_000
WORD = re.compile(r"[^\W\d_]+")
START = "▁"



def words_of(text: str) -> list[str]:
    """The runs of letters. The pattern also takes numbers that are no digits, such as superscripts."""
    found = WORD.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


_U = np.uint64
_B = _U(0x9E3779B97F4A7C15)
_BITS = 20


def pieces_of(path: str) -> list[str]:
    """The vocabulary's pieces of lower-case letters."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in found if (p == START or p.removeprefix(START).isalpha()) and p == p.lower()})


class Lattice:
    """All pieces of a vocabulary in batches of words of one length."""

    def __init__(self, pieces: list[str]) -> None:
        hashes = np.array([int([*self._hashes(np.array([[ord(c) for c in p]], np.uint32))][-1][0, 0]) for p in pieces], dtype=_U)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        self.maybe = np.zeros(1 << _BITS, dtype=bool)
        self.maybe[hashes >> _U(64 - _BITS)] = True
        self.n, self.longest = len(pieces), max(map(len, pieces), default=1)

    @staticmethod
    def _hashes(codes: np.ndarray) -> Iterator[np.ndarray]:
        """For each width from 1 the hashes of all substrings of that width, by row and start; each width goes on from the one before."""
        h = np.zeros(codes.shape, dtype=_U)
        for width in range(1, codes.shape[1] + 1):
            n = codes.shape[1] - width + 1
            h = (h[:, :n] ^ codes[:, width - 1 : width - 1 + n].astype(_U)) * _B
            h ^= h >> _U(29)
            yield (h ^ _U(width)) * _B

    def arcs(self, words: list[str]) -> list[np.ndarray]:
        """For each width from 1 the piece numbers by word and start; -1 where there is none, and the
        number after the last for a single character outside the vocabulary."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
        out = []
        for width, h in zip(range(1, min(self.longest, codes.shape[1]) + 1), self._hashes(codes), strict=False):
            found = np.full(h.shape, self.n if width == 1 else -1, dtype=np.int64)
            hit = np.nonzero(self.maybe[h >> _U(64 - _BITS)])
            at = np.minimum(np.searchsorted(self.hashes, h[hit]), self.n - 1)
            right = self.hashes[at] == h[hit]
            found[hit[0][right], hit[1][right]] = self.numbers[at[right]]
            out.append(found)
        return out


def by_length(words: list[str], most: int = 4096) -> Iterator[np.ndarray]:
    """The places of words of equal length, `most` at a time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts):
        for at in range(0, len(group), most):
            if len(group):
                yield group[at : at + most]


def forward(arcs: list[np.ndarray], p: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Forward probabilities by place, scaled at every step, and the log of the words' probabilities.

    p is pieces x languages with a row for unknown characters and, last, one of zeros for no piece.
    """
    n, length = arcs[0].shape
    alphas, log = [np.ones((n, p.shape[1]))], np.zeros((n, p.shape[1]))
    scales = []
    for j in range(1, length + 1):
        a = np.zeros_like(alphas[0])
        for width in range(1, min(len(arcs), j) + 1):
            arc = arcs[width - 1][:, j - width]
            # few words have a piece of this width here
            used = np.flatnonzero(arc >= 0)
            if not len(used):
                continue
            part = alphas[j - width][used] * p[arc[used]]
            # alphas before j are relative to the scale at their own place
            for k in range(j - width, j - 1):
                part /= scales[k][used]
            a[used] += part
        scales.append(np.maximum(a, 1e-300))
        log += np.log(scales[-1])
        alphas.append(a / scales[-1])
    return alphas, log


def expected(arcs: list[np.ndarray], p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected piece counts of words with the given counts per language (forward-backward)."""
    n, length = arcs[0].shape
    # the words that have a piece of a width at a place, and its probabilities
    at = [[np.flatnonzero(arc[:, i] >= 0) for i in range(arc.shape[1])] for arc in arcs]
    plain = [np.ones((n, p.shape[1]))]
    for j in range(1, length + 1):
        now = np.zeros_like(plain[0])
        for w in range(1, min(len(arcs), j) + 1):
            used = at[w - 1][j - w]
            if len(used):
                now[used] += plain[j - w][used] * p[arcs[w - 1][used, j - w]]
        plain.append(now)
    back = [np.ones((n, p.shape[1]))]
    for i in range(length - 1, -1, -1):
        now = np.zeros_like(back[0])
        for w in range(1, min(len(arcs), length - i) + 1):
            used = at[w - 1][i]
            if len(used):
                now[used] += back[length - i - w][used] * p[arcs[w - 1][used, i]]
        back.append(now)
    total = np.zeros_like(p)
    weight = counts / np.maximum(plain[length], 1e-300)
    for w in range(1, len(arcs) + 1):
        for i in range(length - w + 1):
            arc, used = arcs[w - 1][:, i], at[w - 1][i]
            if not len(used):
                continue
            share = plain[i][used] * p[arc[used]] * back[length - i - w][used] * weight[used]
            for c in range(p.shape[1]):
                total[:, c] += np.bincount(arc[used], weights=share[:, c], minlength=len(p))
    return total


@dataclass(frozen=True)
class Model:
    """Languages, pieces, and piece probabilities with the two further rows of `forward`."""

    languages: tuple[str, ...]
    pieces: tuple[str, ...]
    p: np.ndarray


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text", 8 << 20):
        counts: dict[str, Counter] = {}
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(words_of((text or "").lower()))
        for lang, found in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(list(found)), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])


def _expectations(languages: tuple[str, ...], pieces: list[str], p: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces)
        total = np.zeros((len(pieces) + 2, len(languages)))
        for part in chunks(batches, "word"):
            words = [START + w for w in part.column("word").to_pylist()]
            counts = np.array([part.column(f"n{c}").to_numpy(zero_copy_only=False) for c in range(len(languages))], dtype=float).T
            # plain probabilities hold to 1e-300: longer words are fitted in parts of 40 characters
            parts = [(w[i : i + 40], k) for k, w in enumerate(words) for i in range(0, len(w), 40)]
            words, counts = [w for w, _ in parts], counts[[k for _, k in parts]]
            for at in by_length(words, 2048):
                arcs = lattice.arcs([words[i] for i in at])
                if p is None:
                    for arc in arcs:
                        for c in range(len(languages)):
                            total[:-1, c] += np.bincount(np.where(arc < 0, len(pieces), arc).ravel(), weights=np.repeat(counts[at, c], arc.shape[1]), minlength=len(pieces) + 1)
                else:
                    total += expected(arcs, p, counts[at])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pieces))), *[pa.array(total[: len(pieces), c]) for c in range(len(languages))]], ["piece", *[f"n{c}" for c in range(len(languages))]])

    return run


def _normalised(sums: np.ndarray) -> np.ndarray:
    p = sums + SMOOTHING
    p = p / p.sum(axis=0) * (1 - UNKNOWN)
    return np.vstack([p, np.full((1, p.shape[1]), UNKNOWN), np.zeros((1, p.shape[1]))])


def train(docs: DataFrame, rows: int = TRAIN_ROWS, rounds: int = ROUNDS, vocabulary: str | None = None) -> Model | None:
    """Fits the model on labelled rows of docs(doc_id, text, lang); None if there are none."""
    pieces = pieces_of(vocabulary or public_tokenizers.path(VOCABULARY))
    labelled = docs.where("lang is not null and text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    some = labelled.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most `rows` ids
    chosen = labelled.join(F.broadcast(some.distinct()), "doc_id", "left_semi").select("lang", "text")
    counts = chosen.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "language-words")
    languages = tuple(r.lang for r in counts.select("lang").distinct().orderBy("lang").collect())
    if not languages:
        return None
    columns = [F.sum(F.when(F.col("lang") == name, F.col("n")).otherwise(0)).alias(f"n{c}") for c, name in enumerate(languages)]
    words = materialize(counts.groupBy("word").agg(*columns), "words")
    schema = "piece long, " + ", ".join(f"n{c} double" for c in range(len(languages)))
    p = None
    for _ in range(rounds + 1):
        sums = words.mapInArrow(_expectations(languages, pieces, p), schema).groupBy("piece").agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in range(len(languages))])
        # one row per piece of the fixed vocabulary
        found = np.zeros((len(pieces), len(languages)))
        for r in sums.collect():
            found[r[0]] = r[1:]
        p = _normalised(found)
    return Model(languages, tuple(pieces), p)


class Scorer:
    """A worker's scorer: numbers white-space separated tokens and keeps their log probabilities."""

    def __init__(self, model: Model) -> None:
        self.model, self.lattice = model, Lattice(list(model.pieces))
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.log = np.zeros((1 << 16, len(self.model.languages)))
        self.letters = np.zeros(1 << 16, dtype=bool)

    def _learn(self, tokens: list[str]) -> None:
        first = len(self.known)
        self.known.update(zip(tokens, range(first, first + len(tokens)), strict=True))
        if len(self.known) > len(self.log):
            size = max(len(self.known), 2 * len(self.log))
            self.log, self.letters = np.resize(self.log, (size, self.log.shape[1])), np.resize(self.letters, size)
        words, owners = [], []
        for i, token in enumerate(tokens, first):
            for word in words_of(token):
                words.append(START + word)
                owners.append(i)
        self.log[first : first + len(tokens)] = 0
        self.letters[first : first + len(tokens)] = False
        own = np.array(owners, dtype=np.int64)
        self.letters[own] = True
        for at in by_length(words):
            _, log = forward(self.lattice.arcs([words[i] for i in at]), self.model.p)
            np.add.at(self.log, own[at], log)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's log probability per language, and whether it has a letter."""
        if len(self.known) > CACHE_WORDS:
            self._clear()
        split = [(t or "").lower().split() for t in texts]
        missing = list({w for s in split for w in s}.difference(self.known))
        if missing:
            self._learn(missing)
        flat: list[int] = []
        ends = []
        for tokens in split:
            flat += map(self.known.__getitem__, tokens)
            ends.append(len(flat))
        at = np.array(flat, dtype=np.int64)
        # each text is summed on its own: equal texts have equal sums
        stops = np.array(ends, dtype=np.int64)
        starts = np.concatenate(([0], stops[:-1])).astype(np.int64)
        some = np.flatnonzero(stops > starts)
        sums, letters = np.zeros((len(texts), self.log.shape[1])), np.zeros(len(texts), dtype=bool)
        if len(some):
            sums[some] = np.add.reduceat(self.log[at], starts[some], axis=0)
            letters[some] = np.logical_or.reduceat(self.letters[at], starts[some])
        return sums, letters


_SCORERS: dict[int, Scorer] = {}


def _predictions(model: Model | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    key = hash((model.languages, model.p.tobytes())) if model else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model and key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(model)
        for part in chunks(batches, "text"):
            n = part.num_rows
            names, scores = np.full(n, "und", dtype=object), np.zeros(n)
            if model:
                log, some = _SCORERS[key].score(part.column("text").to_pylist())
                best = log.argmax(axis=1)
                share = 1 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1)
                names = np.where(some, np.array(model.languages, dtype=object)[best], names)
                scores = np.where(some, share, 0.0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None, held_out=None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predictions(model), "doc_id long, held_out boolean, lang_pred string, score double")


def fold(column: str, modulus: int):
    """crc32 of an id as text, modulo a number."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold("doc_id", 4) != 2))
    return predict(docs.select("doc_id", "text"), model, fold("doc_id", 4) == 2)


QUERIES = {"op2_language": op2_language}
