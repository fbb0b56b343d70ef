"""Chips held as row-major flat arrays of height x width x channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _index(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def _pick(data: Column, n: int, at) -> Column:
    return F.transform(_index(n), lambda i: F.get(data, at(i).cast("int")))


def gather_channels(data: Column, h: int, w: int, c: int, channels: list[int]) -> Column:
    """A subset of the channels, in the given order."""
    order = F.array(*[F.lit(k) for k in channels])
    k = len(channels)
    return _pick(data, h * w * k, lambda i: F.floor(i / k) * c + F.get(order, (i % k).cast("int")))


def normalize_channels(data: Column, h: int, w: int, c: int) -> Column:
    """P25: each channel stretched to 0..1 within the chip; a constant channel is 0."""
    channel = lambda k: F.filter(data, lambda _, i: i % c == k)
    low = F.array(*[F.array_min(channel(k)) for k in range(c)])
    high = F.array(*[F.array_max(channel(k)) for k in range(c)])

    def stretch(x: Column, i: Column) -> Column:
        a, b = F.get(low, (i % c).cast("int")), F.get(high, (i % c).cast("int"))
        return F.when(b == a, F.lit(0.0)).otherwise((x - a) / (b - a))

    return F.transform(data, stretch)


def flip_up_down(data: Column, h: int, w: int, c: int) -> Column:
    """A1."""
    return _pick(data, h * w * c, lambda i: (h - 1 - F.floor(i / (w * c))) * w * c + i % (w * c))


def flip_left_right(data: Column, h: int, w: int, c: int) -> Column:
    """A2."""
    return _pick(data, h * w * c, lambda i: F.floor(i / (w * c)) * w * c + (w - 1 - F.floor(i / c) % w) * c + i % c)


def rotate_90(data: Column, h: int, w: int, c: int) -> Column:
    """A3: counter-clockwise; the result is w x h."""
    return _pick(data, h * w * c, lambda i: (F.floor(i / c) % h) * w * c + (w - 1 - F.floor(i / (h * c))) * c + i % c)


def to_channel_first(data: Column, h: int, w: int, c: int) -> Column:
    """Height x width x channels to channels x height x width."""
    return _pick(data, h * w * c, lambda i: (i % (h * w)) * c + F.floor(i / (h * w)))


def to_channel_last(data: Column, h: int, w: int, c: int) -> Column:
    """A6, the other way."""
    return _pick(data, h * w * c, lambda i: (i % c) * h * w + F.floor(i / c))


def split_label(data: Column, h: int, w: int, c: int) -> tuple[Column, Column]:
    """A7, SC6: features and the last channel as the label."""
    n = h * w * (c - 1)
    return _pick(data, n, lambda i: F.floor(i / (c - 1)) * c + i % (c - 1)), _pick(data, h * w, lambda i: i * c + c - 1)


def rows_of(data: Column, w: int, c: int) -> Column:
    """Array of (row, col, channel, value) for a flat chip."""
    return F.transform(data, lambda x, i: F.struct(F.floor(i / (w * c)).cast("int").alias("row"), (F.floor(i / c) % w).cast("int").alias("col"), (i % c).cast("int").alias("channel"), x.alias("value")))
