"""Secrets in texts and in what texts wrap: a worklist of decoded layers, rescanned until nothing new comes out.

Three expressions propose secrets (assignments, access keys, long hex runs), length confirms them. A layer is a text
with, for every character, the place in the document that it stands for. The document is the first layer; each layer off
the worklist is scanned and unwrapped:

    url       `%41` runs that are UTF-8, decoded in place, so that a keyword and its value stay together
    unicode   `\\u0041`, `\\U00000041`, `\\u{41}`, `\\x41`, `&#65;`, `&#x41;`, decoded in place
    base64    runs of 16 characters or more (lines of 60 to 76 are joined), a layer of their own if text comes out
    gzip, zlib, bzip2, xz, zstd   base64 runs that hold such a stream, a layer of the unpacked text

A layer whose text and place were seen before is not opened again, so self-containing streams and decodings that
commute end. A found span is mapped back to the document: from the place of its first character to the end of its
last one's (a packed text stands for its whole run). Spans that the document itself shows stay as they are; equal spans
count once.

Bound: a packed layer beyond `MAX_LAYER` characters' worth of bytes is not opened but counted in `unopened`, as a few
bytes may unpack to any size; the document itself is scanned whole at any size.

Edge cases: null text is empty; empty text has no spans and the hash of nothing; repeated rows get equal results; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import bound_batches, chunks, table

KINDS = ("assign", "access", "hex")
# Each kind's expression; the group whose length counts, and that length.
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]{32,}"), 0, 32),
}
#: Bytes that a packed layer may have.
MAX_LAYER = 32 << 20

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_BASE64 = re.compile(r"(?:[A-Za-z0-9+/]{60,76}\r?\n)+[A-Za-z0-9+/]{1,76}={0,2}|[A-Za-z0-9+/_-]{16,}={0,2}")
_UNPRINTABLE = re.compile(r"[\x00-\x08\x0e-\x1f\x7f�]")
_STREAMS = {
    "gzip": (b"\x1f\x8b", lambda: zlib.decompressobj(31)),
    "bzip2": (b"BZh", bz2.BZ2Decompressor),
    "xz": (b"\xfd7zXZ", lzma.LZMADecompressor),
    "zlib": (b"\x78", zlib.decompressobj),
}


@dataclass(frozen=True)
class Layer:
    """A text; for every character, where in the document that which it stands for starts and ends."""

    text: str
    starts: np.ndarray
    ends: np.ndarray
    path: tuple[str, ...] = ()

    @property
    def key(self) -> tuple:
        place = (int(self.starts[0]), int(self.ends[-1])) if self.text else ()
        return hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest(), *place

    def replaced(self, pieces: list[tuple[int, int, list[tuple[str, int, int]]]], name: str) -> Layer:
        """With each piece (start, end, characters with their own places in this text) in place of that range."""
        text, starts, ends, at = [], [], [], 0
        for a, b, characters in pieces:
            text.append(self.text[at:a])
            starts.append(self.starts[at:a])
            ends.append(self.ends[at:a])
            text.append("".join(c for c, _, _ in characters))
            starts.append(self.starts[[i for _, i, _ in characters]])
            ends.append(self.ends[[j - 1 for _, _, j in characters]])
            at = b
        return Layer("".join([*text, self.text[at:]]), np.concatenate([*starts, self.starts[at:]]), np.concatenate([*ends, self.ends[at:]]), (*self.path, name))


def _url(layer: Layer) -> Iterator[Layer]:
    pieces = []
    for m in _PERCENT.finditer(layer.text):
        try:
            decoded = bytes.fromhex(m.group().replace("%", "")).decode()
        except UnicodeDecodeError:
            continue
        at, characters = m.start(), []
        for c in decoded:
            to = at + 3 * len(c.encode())
            characters.append((c, at, to))
            at = to
        pieces.append((m.start(), m.end(), characters))
    if pieces:
        yield layer.replaced(pieces, "url")


def _unicode(layer: Layer) -> Iterator[Layer]:
    pieces = []
    for m in _ESCAPE.finditer(layer.text):
        found = m.group()
        if found.startswith("\\u") and found[2] != "{":
            # a run of code units, pairs of surrogates joined; a lone surrogate leaves the run as it is
            try:
                decoded = bytes.fromhex(found.replace("\\u", "")).decode("utf-16-be")
            except UnicodeDecodeError:
                continue
            at, characters = m.start(), []
            for c in decoded:
                to = at + (12 if ord(c) > 0xFFFF else 6)
                characters.append((c, at, to))
                at = to
        else:
            digits = found.strip("\\&#;{}uUxX")
            code = int(digits, 10 if found[0] == "&" and found[2] not in "xX" else 16)
            if code > 0x10FFFF or 0xD800 <= code < 0xE000:
                continue
            characters = [(chr(code), m.start(), m.end())]
        pieces.append((m.start(), m.end(), characters))
    if pieces:
        yield layer.replaced(pieces, "unicode")


def _readable(raw: bytes) -> str | None:
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return None if not text or _UNPRINTABLE.search(text) else text


class TooLarge(Exception):
    """A packed layer beyond the bound."""


def _unpacked(raw: bytes, most: int) -> tuple[str, bytes] | None:
    """The name and content of the stream that raw is, if it is one."""
    if raw.startswith(b"\x28\xb5\x2f\xfd"):
        try:
            with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(raw) as reader:
                out = reader.read(most + 1)
        except zstandard.ZstdError:
            return None
        if len(out) > most:
            raise TooLarge
        return "zstd", out
    for name, (magic, opener) in _STREAMS.items():
        if raw.startswith(magic):
            try:
                out = opener().decompress(raw, most + 1)
            except (zlib.error, OSError, lzma.LZMAError, EOFError):
                continue
            if len(out) > most:
                raise TooLarge
            return name, out
    return None


def _base64(layer: Layer, most: int, lost: list[Layer]) -> Iterator[Layer]:
    for m in _BASE64.finditer(layer.text):
        run = m.group()
        places = np.fromiter((i for i, c in enumerate(run) if c not in "\r\n="), np.int64)
        code = re.sub(r"[\r\n=]", "", run).translate({45: "+", 95: "/"})
        if len(code) % 4 == 1:
            continue
        try:
            raw = base64.b64decode(code + "=" * (-len(code) % 4), validate=True)
        except binascii.Error:
            continue
        yield from _opened(layer, raw, m.start() + places, most, lost)


def _opened(layer: Layer, raw: bytes, places: np.ndarray, most: int, lost: list[Layer]) -> Iterator[Layer]:
    """The layer that decoded bytes make; places are those of the run's characters in this layer."""
    low, high = int(layer.starts[places[0]]), int(layer.ends[places[-1]])
    text = _readable(raw)
    if text is not None:
        at = np.concatenate(([0], np.cumsum([len(c.encode()) for c in text])))
        yield Layer(text, layer.starts[places[at[:-1] * 8 // 6]], layer.ends[places[(at[1:] * 8 - 1) // 6]], (*layer.path, "base64"))
        return
    names = ["base64"]
    try:
        # a stream may hold a stream
        while (found := _unpacked(raw, most)) is not None and found[1] != raw:
            names.append(found[0])
            raw = found[1]
            if (text := _readable(raw)) is not None:
                yield Layer(text, np.full(len(text), low), np.full(len(text), high), (*layer.path, *names))
                return
            if len(names) > 64:
                # streams in streams without an end to be seen
                raise TooLarge
    except TooLarge:
        lost.append(Layer("", np.array([low]), np.array([high]), (*layer.path, *names)))


def scan(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed (kind, start, end) in one text: leftmost non-overlapping matches per kind, failing ones dropped."""
    for kind, (pattern, group, least) in PATTERNS.items():
        if kind == "access" and "AKIA" not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                yield kind, m.start(), m.end()


def secrets_of(text: str, most: int = MAX_LAYER) -> tuple[list[tuple[int, int, int, str]], int]:
    """All spans of a text as (start, kind's place in KINDS, end, path of layers; empty in the text itself), sorted, and the number of unopened layers."""
    found: dict[tuple[int, int, int], str] = {(s, KINDS.index(kind), e): "" for kind, s, e in scan(text)}
    if not ("%" in text or "\\" in text or "&#" in text or _BASE64.search(text)):
        return [(*span, path) for span, path in sorted(found.items())], 0
    root = Layer(text, np.arange(len(text)), np.arange(1, len(text) + 1))
    work, seen, lost = [root], {root.key}, []
    while work:
        layer = work.pop()
        if layer.path:
            for kind, s, e in scan(layer.text):
                found.setdefault((int(layer.starts[s]), KINDS.index(kind), int(layer.ends[e - 1])), "/".join(layer.path))
        for unwrapped in (_url(layer), _unicode(layer), _base64(layer, most, lost)):
            for inner in unwrapped:
                if inner.text and inner.key not in seen:
                    seen.add(inner.key)
                    work.append(inner)
    unopened = {(int(x.starts[0]), int(x.ends[0])) for x in lost}
    return [(*span, path) for span, path in sorted(found.items())], len(unopened)


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("path", pa.string())])
SCHEMA = "doc_id long, found array<struct<start:long,kind:string,end:long,path:string>>, unopened long"


def _find(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            spans, lost = [], []
            for text in part.column("text").to_pylist():
                found, unopened = secrets_of(text, most)
                spans.append([{"start": s, "kind": KINDS[k], "end": e, "path": path} for s, k, e, path in found])
                lost.append(unopened)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, pa.list_(_SPAN)), pa.array(lost, pa.int64())], ["doc_id", "found", "unopened"])

    return run


def find(docs: DataFrame, most: int = MAX_LAYER) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, found, unopened): spans (start, kind, end, path) by start, then kind; path is empty for those
    that the text itself shows, else the layers that lead to it."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_find(most), SCHEMA)


def redact(docs: DataFrame, most: int = MAX_LAYER) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, redacted): every found span, those of wrapped secrets too, replaced by its kind in brackets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            out = []
            for text in part.column("text").to_pylist():
                pieces, at = [], 0
                for start, kind, end, _ in secrets_of(text, most)[0]:
                    if end > at:
                        pieces.append(text[at:start] + f"[{KINDS[kind].upper()}]" if start >= at else "")
                        at = end
                out.append("".join(pieces) + text[at:])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "redacted"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, redacted string")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("found", lambda x: x.path == "")
    rows = find(table(spark, sf_dir, "documents")).withColumn("base", base)
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    paths = F.array_join(F.transform("found", lambda x: F.when(x.path == "", "-").otherwise(x.path)), ",")
    return rows.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"), paths.alias("paths"), "unopened")


def _is(kind: str):
    return lambda x: x.kind == kind


QUERIES = {"op13_secrets": op13_secrets}
