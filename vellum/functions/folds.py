"""Folds over the arrays of many rows at once: an array's elements are taken in turn, but the same step of all arrays of an Arrow
batch is one numpy operation. Null elements are NaN, which is near nothing; they come first in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, run: Callable[[Column], Column]) -> Column:
    """run of a value that it uses several times and that is worked out once."""
    return F.get(F.transform(F.array(value), run), F.lit(0))


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The elements of all arrays as doubles, and every array's length; a null array is empty."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), lengths


def nested(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(values, pa.int32()))


def owners(lengths: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(lengths)), lengths)


def ordered(lengths: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """Places of the elements, every array's by the given values in turn."""
    return np.lexsort([*[np.where(np.isnan(x), -np.inf, x) for x in reversed(by)], owners(lengths)])


def steps(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For the first, second, ... elements: the arrays that have one, and the elements' places. Which arrays are left is a
    beginning of the ones before, by length."""
    firsts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    left = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
    for k, n in enumerate(left.tolist()):
        yield order[:n], firsts[order[:n]] + k


def row_numbers(place: np.ndarray, lengths: np.ndarray, limit: np.ndarray, running: bool) -> np.ndarray:
    """Numbers from 1: an element stays in its row if it is within the limit of the row's first, or of its running mean."""
    n_arrays = len(lengths)
    total, members, row = np.zeros(n_arrays), np.ones(n_arrays), np.zeros(n_arrays, np.int32)
    out = np.zeros(len(place), np.int32)
    for k, (which, at) in enumerate(steps(lengths)):
        x = place[at]
        same = np.abs(x - total[which] / members[which]) <= limit[which] if k else np.zeros(len(x), bool)
        row[which] += ~same
        if running:
            total[which] = np.where(same, total[which] + x, x)
            members[which] = np.where(same, members[which] + 1, 1)
        else:
            total[which] = np.where(same, total[which], x)
        out[at] = row[which]
    return out


def opened(place: np.ndarray, lengths: np.ndarray, gap: float) -> np.ndarray:
    """Which elements lie more than the gap behind the last that did; every array's first does."""
    last, out = np.full(len(lengths), -np.inf), np.zeros(len(place), bool)
    for which, at in steps(lengths):
        opens = place[at] - last[which] > gap
        last[which] = np.where(opens, place[at], last[which])
        out[at] = opens
    return out


def column_starts(xs: Column, gap: int = 30) -> Column:
    """Starts of columns: a word opens one where it lies more than `gap` right of the last start."""

    @F.arrow_udf("array<int>")
    def run(lists: pa.Array) -> pa.Array:
        place, lengths = flat(lists)
        place = place[ordered(lengths, place)]
        opens = opened(place, lengths, gap)
        return nested(place[opens], np.bincount(owners(lengths)[opens], minlength=len(lengths)))

    return run(xs)


def clusters(xs: Column, tolerance: int, members: int) -> Column:
    """How many clusters have so many members: an element joins the first cluster whose first member is nearer than the tolerance."""

    @F.arrow_udf("int")
    def run(lists: pa.Array) -> pa.Array:
        place, lengths = flat(lists)
        found = np.zeros(len(lengths), np.int32)
        # few arrays at a time, as each may have a cluster for each element
        for part in np.array_split(np.arange(len(lengths)), max(1, -(-len(lengths) // 1024))):
            mine, at_first = lengths[part], int(lengths[: part[0]].sum()) if len(part) else 0
            first, n, used = np.full((len(part), 8), np.nan), np.zeros((len(part), 8), np.int32), np.zeros(len(part), np.int64)
            for which, at in steps(mine):
                x = place[at_first + at]
                width = int(used.max()) + 1
                if width > first.shape[1]:
                    first, n = np.pad(first, ((0, 0), (0, width)), constant_values=np.nan), np.pad(n, ((0, 0), (0, width)))
                near = np.abs(first[which, :width] - x[:, None]) < tolerance
                joins = near.any(axis=1)
                to = np.where(joins, near.argmax(axis=1), used[which])
                first[which[~joins], to[~joins]] = x[~joins]
                used[which] += ~joins
                n[which, to] += 1
            found[part] = (n >= members).sum(axis=1)
        return pa.array(found)

    return run(xs)
