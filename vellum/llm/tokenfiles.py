"""Token ids in ORC files: integer run-length stripes, row indexes, Bloom filters on document ids.

A row holds one document: doc_id, n_tokens and its ids with the end id. Files are written in ascending
doc_id order: rows are range-partitioned and sorted by doc_id, so file k holds ids below those of file
k + 1 and the stripes of a file prune by their minimum and maximum and by the Bloom filter. Readers
take stripes in parallel. The place of a document among all ids isn't stored: it is a prefix sum of
n_tokens over the files' order, taken when reading, from one sum per file.

Encoding goes by pieces between single spaces and line feeds, which the byte-level pattern never joins:
a piece is encoded once per worker by the tokenizer and then looked up. Texts in which white space
touches other white space, or ends the text, are encoded whole.

Edge cases: null or empty text holds the end id alone; a null doc_id sorts first; rows of equal doc_id
are ordered by a hash of their text; an empty table gives no files' rows; extra columns are not stored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellum.llm.common import broadcast_within, chunks, default_parallelism, materialize, new_path, table

END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
#: Pieces that a worker keeps, and their characters; beyond either it forgets those that it met once, down to half at least.
CACHE_PIECES, CACHE_CHARS = 700_000, 16 << 20
STRIPE_BYTES = 16 << 20
BLOOM_FPP = 0.01


class _Numbers(dict):
    """Numbers keys in the order in which they are first looked up, and lists the new ones."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class PieceEncoder:
    """Encodes texts to ids with a byte-level tokenizer, by pieces that it has met before.

    A piece is what stands between single spaces or line feeds, with the one before it; it is numbered,
    and all pieces' ids lie in one array, from which a batch's ids are gathered at once. Keys of
    `known`: a piece after a space is its own text, one after a line feed starts with it, a text's first piece starts
    with a space (which no other piece holds).
    """

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        #: Whether an id's text starts with a space or line feed, as the first id of a piece does and no other.
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.opens[k] = token[0] in "\u0120\u010a"
        self._clear()

    def _clear(self) -> None:
        self.known = _Numbers()
        self.ids = np.zeros(1 << 20, dtype=self.dtype)
        self.chars = 0
        self.used = 0
        #: Where a piece's ids lie; -1: the piece may join what follows it.
        self.starts = np.zeros(CACHE_PIECES, dtype=np.int64)
        self.ends = np.zeros(CACHE_PIECES, dtype=np.int64)
        #: How often a piece was met, halved whenever pieces are forgotten.
        self.uses = np.zeros(CACHE_PIECES, dtype=np.int64)

    def _forget(self) -> None:
        """Keeps the pieces that were met more than once, the most frequent half of the bound at most."""
        names, n = list(self.known), len(self.known)
        keep = np.argsort(-self.uses[:n], kind="stable")[: CACHE_PIECES // 2]
        sizes = np.fromiter(map(len, names), np.int64, n)
        keep = keep[np.cumsum(sizes[keep]) <= CACHE_CHARS // 2]
        keep = np.sort(keep[self.uses[keep] > 1])
        ids, starts, lengths, uses = self.ids, self.starts[keep], self.ends[keep] - self.starts[keep], self.uses[keep]
        self._clear()
        self.chars = int(sizes[keep].sum())
        self.known.update(zip(map(names.__getitem__, keep.tolist()), range(len(keep)), strict=True))
        upto = np.cumsum(lengths)
        if len(keep):
            self._append(ids[np.arange(upto[-1]) + np.repeat(starts - (upto - lengths), lengths)])
        self.starts[: len(keep)] = np.where(starts < 0, -1, upto - lengths)
        self.ends[: len(keep)] = np.where(starts < 0, -1, upto)
        self.uses[: len(keep)] = uses // 2

    def whole(self, text: str) -> list[int]:
        """The ids that the tokenizer gives for a whole text."""
        return self.each([text])[0]

    def each(self, texts: list[str]) -> list[list[int]]:
        """The ids that the tokenizer gives for each text, in one call."""
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _append(self, ids: list[int] | np.ndarray) -> int:
        """Where in self.ids the new ids start."""
        start, self.used = self.used, self.used + len(ids)
        if self.used > len(self.ids):
            self.ids = np.resize(self.ids, max(self.used, 2 * len(self.ids)))
        self.ids[start : self.used] = ids
        return start

    def _learn(self) -> None:
        """Encodes the pieces that were numbered since the last call."""
        new, first = self.known.new, len(self.known) - len(self.known.new)
        self.known.new = []
        self.chars += sum(map(len, new))
        if len(self.known) > len(self.starts):
            size = max(len(self.known), 2 * len(self.starts))
            self.starts, self.ends = np.resize(self.starts, size), np.resize(self.ends, size)
            self.uses = np.concatenate((self.uses, np.zeros(size - len(self.uses), np.int64)))
        joined, alone = [], []
        for n, x in enumerate(new, first):
            if not x or x[-1].isspace():
                self.starts[n] = self.ends[n] = -1
            elif x[0] == " ":
                alone.append(n)
            else:
                joined.append(n)
        for n, ids in zip(alone, self.each([new[n - first][1:] for n in alone]), strict=True):
            self.starts[n] = self._append(ids)
            self.ends[n] = self.used
        for at in range(0, len(joined), 400):
            some = joined[at : at + 400]
            text = " " + " ".join([new[n - first] for n in some])
            # before a line feed there is no space
            found = np.array(self.whole(text.replace(" \n", "\n")))
            firsts = np.flatnonzero(self.opens[found])
            if len(firsts) != len(some):
                raise ValueError("the vocabulary joins pieces over a space")
            firsts += self._append(found)
            self.starts[some] = firsts
            self.ends[some] = np.append(firsts[1:], self.used)

    def encode(self, texts: list[str] | pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, an end id after each, and where each text's ids end."""
        if len(self.known) > CACHE_PIECES or self.chars > CACHE_CHARS:
            self._forget()
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        # Arrow cuts the texts and tells equal pieces, so that each is looked up once a call
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        ends = np.cumsum(pieces.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        firsts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        found = pieces.flatten().dictionary_encode()
        number = self.known.__getitem__
        at = np.fromiter(map(number, found.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64, len(found.dictionary))[found.indices.to_numpy(zero_copy_only=False)]
        at[firsts] = [number(" " + x if x else "\n") for x in pieces.flatten().take(pa.array(firsts)).to_pylist()]
        self._learn()
        met = np.bincount(at, minlength=len(self.known))
        self.uses[: len(met)] += met
        starts, stops = self.starts[at], self.ends[at]
        # white space that touches other white space sends its text the whole way
        whole = set(np.searchsorted(ends, np.flatnonzero(starts < 0), side="right").tolist())
        whole.update(np.flatnonzero(pc.match_substring(texts, " \n").to_numpy(zero_copy_only=False)).tolist())
        lengths = stops - starts
        used = self.used
        several = sorted(whole)
        for i, ids in zip(several, self.each(texts.take(pa.array(several, pa.int64())).to_pylist()), strict=True):
            lengths[firsts[i] : ends[i]] = 0
            k = firsts[i]
            starts[k] = self._append(ids)
            lengths[k] = self.used - starts[k]
        # the end id follows each text: one more entry of length 1
        end = self._append([end_id])
        starts, lengths = np.insert(starts, ends, end), np.insert(lengths, ends, 1)
        upto = np.cumsum(lengths)
        gather = np.arange(upto[-1]) + np.repeat(starts - (upto - lengths), lengths)
        out = self.ids[gather]
        self.used = used
        return out, upto[ends + np.arange(len(ends))]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(vocabulary: str) -> PieceEncoder:
    """The worker's encoder, kept between its tasks."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = PieceEncoder(vocabulary)
    return _ENCODERS[vocabulary]


def _encode(vocabulary: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for part in chunks(batches, "text"):
            ids, ends = encode(part.column("text"), end_id)
            offsets = np.concatenate(([0], ends)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(ends, prepend=0)), lists], ["doc_id", "n_tokens", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, files: int | None = None) -> None:
    """Writes docs(doc_id, text) as ORC token files in ascending doc_id order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(files or 2 * default_parallelism(docs.sparkSession), "doc_id")
    rows = rows.sortWithinPartitions("doc_id", F.xxhash64("text"))
    tokens = rows.mapInArrow(_encode(vocabulary, end_id), "doc_id long, n_tokens long, ids array<int>")
    (
        tokens.write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(BLOOM_FPP))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.row.index.stride", "1000")
        .option("orc.create.index", "true")
        .option("compression", "zstd")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of token files; filters on doc_id prune stripes and row groups."""
    return spark.read.schema("doc_id long, n_tokens long, ids array<int>").orc(path)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, values = batch.column("ids"), None
        values = np.asarray(ids.values).astype("<u4", copy=False)
        offsets = np.asarray(ids.offsets)
        sums = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        columns = [batch.column(c) for c in ("file", "block", "row", "doc_id")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())], ["file", "block", "row", "doc_id", "n_tokens", "ids_crc32"])


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row of token files.

    `start` sums n_tokens over the files before, in the order of their part numbers, and the rows before in the file.
    The windows run over one row per file, and over a file's rows without their ids.
    """
    place = F.col("_metadata")
    rows = read_tokens(spark, path).select(
        place["file_name"].alias("file"), place["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row"), "doc_id", "ids"
    )
    read = rows.mapInArrow(_checksums, "file string, block long, row long, doc_id long, n_tokens long, ids_crc32 long")
    sums = read_tokens(spark, path).select("n_tokens", place["file_name"].alias("_file")).groupBy("_file").agg(F.sum("n_tokens").alias("_sum"))
    # names sort by text, where part-100000 precedes part-99999
    number = F.regexp_extract("_file", r"part-(\d+)", 1).cast("long")
    files = sums.select("_file", (F.sum("_sum").over(Window.orderBy(number, "_file")) - F.col("_sum")).alias("_before"))
    files = materialize(files, "files")
    before = Window.partitionBy("file").orderBy("block", "row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        read.join(broadcast_within(files), F.col("file") == F.col("_file"))
        .withColumn("start", F.col("_before") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
        .select("doc_id", "start", "n_tokens", "ids_crc32")
    )


def encode_and_read(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes docs as token files and returns what read_back() finds in them."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, path, vocabulary or public_tokenizers.path(VOCABULARY), end_id)
    return read_back(spark, path)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(table(spark, sf_dir, "documents"))


QUERIES = {"op9_token_files": op9_token_files}
