"""Work along the lines of a sparse grid: whole rows or columns of pixels, one after the other, in a task.

Pixels of a line are dealt to one task and sorted, lines follow one another, and only the line that a
batch of rows breaks off is held back. A line is one row or column of a raster; its pixels, and the places
that they reach, are all that is ever in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Places worked on at a time.
CELLS = 1 << 21


def _breaks(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Whether each row begins another line."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for c in batch.columns[:keys]:
        code = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return new


def _whole_lines(batches, keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that end with a line, and where lines begin in them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        # Only the last row of what is held decides whether the line goes on.
        if held:
            probe = pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), b])
            goes_on = not _breaks(probe, keys)[1]
        else:
            goes_on = False
        starts = np.flatnonzero(_breaks(b, keys))
        if held and not (goes_on and len(starts) == 1):
            cut = int(starts[1]) if goes_on else 0
            whole = pa.concat_batches([*held, b.slice(0, cut)])
            yield whole, _breaks(whole, keys)
            held, b = [], b.slice(cut)
            starts = np.flatnonzero(_breaks(b, keys))
        if not held and len(starts) > 1:
            whole = b.slice(0, int(starts[-1]))
            yield whole, _breaks(whole, keys)
            b = b.slice(int(starts[-1]))
        held.append(b)
    if held:
        whole = pa.concat_batches(held)
        yield whole, _breaks(whole, keys)


def along(df: DataFrame, keys: Sequence[str], position: str, value: str | None, out: str, kind: T.DataType, work: Callable) -> DataFrame:
    """``keys, position, out`` of what ``work`` makes of the pixels of each line.

    ``work`` gets where lines begin, positions and values of whole lines in order, and yields (index of a
    pixel of the line, position, result) arrays.
    """
    columns = [*keys, position] + ([value] if value else [])
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(position, T.LongType()), T.StructField(out, kind)])
    arrow = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64()}[kind]

    def run(batches):
        for b, new in _whole_lines(batches, len(keys)):
            at = b.column(len(keys)).cast(pa.int64()).to_numpy(zero_copy_only=False)
            values = b.column(len(keys) + 1).cast(arrow).to_numpy(zero_copy_only=False) if value else None
            for which, place, result in work(new, at, values):
                take = pa.array(which)
                yield pa.record_batch([c.take(take) for c in b.columns[: len(keys)]] + [pa.array(place), pa.array(result, arrow)], names=[*keys, position, out])

    return df.select(columns).repartition(*keys).sortWithinPartitions(*keys, position).mapInArrow(run, schema)


def _islands(new: np.ndarray, at: np.ndarray, radius: int):
    """Runs of pixels whose reaches meet: yields (slice of pixels, index of each run's first pixel, its first place, places, pixels' places in the run of all)."""
    cut = np.flatnonzero(new | np.r_[True, np.diff(at) > 2 * radius])
    last = np.r_[cut[1:], len(at)]
    size = at[last - 1] - at[cut] + 1 + 2 * radius
    lo = 0
    ends = np.cumsum(size)
    while lo < len(cut):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + CELLS, "right")))
        pixels = slice(int(cut[lo]), int(last[hi - 1]))
        base = np.cumsum(size[lo:hi]) - size[lo:hi]
        run = np.repeat(np.arange(hi - lo), last[lo:hi] - cut[lo:hi])
        first = at[cut[lo:hi]]
        yield pixels, cut[lo:hi], first - radius, size[lo:hi], base[run] + radius + at[pixels] - first[run]
        lo = hi


def _places(first: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pixel index and position of every place of some runs."""
    offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(first, size), np.repeat(start, size) + offset


def running_max(radius: int) -> Callable:
    """Largest value within ``radius`` along a line, at every place that a pixel reaches.

    Prefix and suffix maxima over blocks of the window's length: a window is the end of one block and the
    beginning of the next, so that work does not depend on the radius.
    """
    length = 2 * radius + 1

    def work(new, at, values):
        lowest = np.iinfo(np.int64).min if values.dtype == np.int64 else -np.inf
        for pixels, first, start, size, index in _islands(new, at, radius):
            total = int(size.sum())
            blocks = -(-(total + 2 * radius) // length)
            dense = np.full(blocks * length, lowest, values.dtype)
            np.maximum.at(dense, index + radius, values[pixels])
            dense = dense.reshape(blocks, length)
            prefix = np.maximum.accumulate(dense, axis=1).ravel()
            suffix = np.maximum.accumulate(dense[:, ::-1], axis=1)[:, ::-1].ravel()
            yield *_places(first, start, size), np.maximum(suffix[:total], prefix[length - 1 : length - 1 + total])

    return work


def nearest(radius: int) -> Callable:
    """Distance to the nearest pixel of a line, at every place within ``radius`` of one."""

    def work(new, at, values):
        for _, first, start, size, index in _islands(new, at, radius):
            total = int(size.sum())
            places = np.arange(total)
            before, after = np.full(total, -(1 << 60)), np.full(total, 1 << 60)
            before[index], after[index] = index, index
            distance = np.minimum(places - np.maximum.accumulate(before), np.minimum.accumulate(after[::-1])[::-1] - places)
            near = distance <= radius
            which, place = _places(first, start, size)
            yield which[near], place[near], distance[near]

    return work


def _envelope(at: list[int], height: list[int]) -> tuple[list[int], list[int]]:
    """Which parabolas ``(x - at)^2 + height^2`` are lowest somewhere, and the first whole x from which each is."""
    kept, since = [], []
    for i, (p, h) in enumerate(zip(at, height)):
        begin = -(1 << 60)
        while kept:
            q, g = at[kept[-1]], height[kept[-1]]
            if p == q:
                begin = None if h >= g else since[-1]
            else:
                # The first x at which the new one is lower.
                begin = (p * p - q * q + h * h - g * g) // (2 * (p - q)) + 1
            if begin is None or begin > since[-1]:
                break
            kept.pop()
            since.pop()
            begin = -(1 << 60)
        if begin is not None:
            kept.append(i)
            since.append(begin)
    return kept, since


def squared_distance(radius: int) -> Callable:
    """Least ``(x - position)^2 + value^2`` over a line's pixels, where it is at most ``radius`` squared: the lower envelope of their parabolas."""

    def work(new, at, values):
        starts = np.flatnonzero(new)
        for lo, hi in zip(starts.tolist(), np.r_[starts[1:], len(at)].tolist()):
            own, high = at[lo:hi], values[lo:hi]
            kept, since = (np.array(x, np.int64) for x in _envelope(own.tolist(), high.tolist()))
            p, h = own[kept], high[kept]
            begin = np.maximum(since, p - radius)
            end = np.minimum(np.r_[since[1:], 1 << 60] - 1, p + radius)
            size = np.maximum(end - begin + 1, 0)
            edge = np.r_[0, np.cumsum(size)]
            a = 0
            while a < len(size):
                z = max(a + 1, int(np.searchsorted(edge, edge[a] + CELLS, "right")) - 1)
                which, place = _places(np.arange(a, z), begin[a:z], size[a:z])
                square = (place - p[which]) ** 2 + h[which] ** 2
                near = square <= radius * radius
                yield np.full(int(near.sum()), lo), place[near], square[near]
                a = z

    return work
