"""SimHash near-duplicates: majority fingerprints, pivot distance tables, connected classes.

A fingerprint's coordinates are its Hamming distances to reference fingerprints (pivots). The pivots
are drawn per block of bits, eight references to each of six blocks, and a coordinate counts the
differing bits inside its block. By the triangle inequality two fingerprints within ``k`` bits differ
by at most ``k`` in any coordinate; and as each differing bit lies in one block, at least four blocks
have equal coordinates for ``k = 2``. So rows of the pivot table are joined on the coordinates of four
blocks (fifteen keys a row), pairs are discarded by their largest coordinate difference over all
pivots, and survivors are verified by exclusive or.

Equal fingerprints are one row before any of that, and within a key only links of a spanning forest
leave the task, so a group of n copies costs n rows, not n * n. A key's rows are compared in the
sorted stream by growing offset, never as a materialised cross product; a key with over ``LONG`` rows
looks each row's neighbours up instead (flipping up to ``k`` of the bits that vary within the key), so
that its work grows with its rows and not with their square.

Cases: a null, empty or blank text has fingerprint zero and links like any other; fewer words than
a shingle make one shingle; repeated rows and ids are kept; empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.operators.components import connected_components
from landweave.storage import discard, materialize, partitions

BLOCKS, KEPT, LONG = 6, 4, 1024
_edges = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
MASKS = np.array([((1 << (b - a)) - 1) << a for a, b in zip(_edges, _edges[1:])], np.uint64)
#: Eight pseudo-random references to a block.
PIVOTS = np.random.default_rng(64).integers(0, 2**63, (BLOCKS, 8), dtype=np.uint64) * np.uint64(2) + np.random.default_rng(65).integers(0, 2, (BLOCKS, 8), dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)])) if len(words) >= shingle else [b" ".join(words)]
    h = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id`` and 64-bit ``fp`` (as a signed long) of every row."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, fp long")


def coordinates(fp: np.ndarray) -> np.ndarray:
    """Pivot table rows: (n, blocks, pivots) distances."""
    return np.bitwise_count((fp[:, None, None] ^ PIVOTS[None]) & MASKS[None, :, None])


def _keys(batches):
    """A row for each fingerprint and choice of four blocks, keyed by their coordinates."""
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        xy = np.ascontiguousarray(coordinates(fp))
        for number, some in enumerate(combinations(range(BLOCKS), KEPT)):
            part = np.ascontiguousarray(xy[:, some, :]).reshape(len(fp), -1)
            key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(part.shape[1]), len(fp), [None, pa.py_buffer(part)])
            yield pa.record_batch([pa.array(np.full(len(fp), number, np.int32)), key.cast(pa.binary()), pa.array(fp.view(np.int64))], names=["choice", "xy", "fp"])


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mask of links that join two parts not joined by earlier ones."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    out = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        if (rx := find(x)) != (ry := find(y)):
            parent[max(rx, ry)] = min(rx, ry)
            out[i] = True
    return out


def _probed(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of links that span the parts of one long key: every neighbour within ``most`` bits is looked up."""
    order = np.argsort(fp)
    fp = fp[order]
    varying = int(np.bitwise_or.reduce(fp ^ fp[0]))
    bits = [np.uint64(1 << i) for i in range(64) if varying >> i & 1]
    parent, left, right = np.arange(len(fp)), [], []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for flips in range(1, most + 1):
        for some in combinations(bits, flips):
            # The highest flipped bit is 0 in the row and 1 in its neighbour, so each pair is met once.
            low = np.flatnonzero((fp & some[-1]) == 0)
            want = fp[low] ^ np.bitwise_or.reduce(np.array(some))
            at = np.minimum(np.searchsorted(fp, want), len(fp) - 1)
            hit = fp[at] == want
            a, b = low[hit], at[hit]
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent[:] = up
            apart = parent[a] != parent[b]
            for x, y in zip(a[apart].tolist(), b[apart].tolist()):
                if (rx := find(x)) != (ry := find(y)):
                    parent[max(rx, ry)] = min(rx, ry)
                    left.append(x)
                    right.append(y)
    return order[np.array(left, int)], order[np.array(right, int)]


def _linker(most: int):
    def link(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links inside runs of equal keys; long runs apart."""
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(edge, len(key)))
        short = np.repeat(size <= LONG, size)
        found = [offsets(key[short], fp[short])]
        for at, n in zip(edge[size > LONG], size[size > LONG]):
            part = fp[at : at + n]
            a, b = _probed(part, most)
            found.append((part[a].view(np.int64), part[b].view(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def offsets(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links inside runs of equal keys, found offset by offset."""
        xy = coordinates(fp).reshape(len(fp), PIVOTS.size).astype(np.int8)
        left, right = [], []
        alive, step = np.arange(len(fp) - 1), 1
        while len(alive):
            alive = alive[alive + step < len(fp)]
            alive = alive[key[alive] == key[alive + step]]
            for part in np.array_split(alive, max(1, len(alive) // 65536)):
                near = part[np.abs(xy[part] - xy[part + step]).max(axis=1, initial=0) <= most]
                near = near[np.bitwise_count(fp[near] ^ fp[near + step]) <= most]
                left.append(near)
                right.append(near + step)
            step += 1
        a, b = np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])
        keep = _forest(a, b)
        return fp[a[keep]].view(np.int64), fp[b[keep]].view(np.int64)

    def run(batches):
        rest = None
        for b in batches:
            new = pa.Table.from_batches([b])
            t = new if rest is None else pa.concat_tables([rest, new])
            k = t.column("k").combine_chunks().to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(k, k[-1])) if len(k) else 0
            rest = t.slice(last)
            if last:
                a, c = link(k[:last], t.column("fp").combine_chunks().to_numpy(zero_copy_only=False)[:last].view(np.uint64))
                yield pa.record_batch([pa.array(a), pa.array(c)], names=["a", "b"])
        if rest is not None and len(rest):
            a, c = link(rest.column("k").combine_chunks().to_numpy(zero_copy_only=False), rest.column("fp").combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.record_batch([pa.array(a), pa.array(c)], names=["a", "b"])

    return run


def links(distinct: DataFrame, most: int = 2) -> DataFrame:
    """Links ``a``, ``b`` whose components are those of all pairs within ``most`` bits; ``distinct`` has one row per ``fp``."""
    if not 0 <= most <= BLOCKS - KEPT:
        raise ValueError(f"the blocks find pairs of up to {BLOCKS - KEPT} bits")
    keyed = distinct.select("fp").mapInArrow(_keys, "choice int, xy binary, fp long").select(F.xxhash64("choice", "xy").alias("k"), "fp")
    dealt = keyed.repartition(partitions(distinct.sparkSession), "k").sortWithinPartitions("k", "fp")
    return dealt.mapInArrow(_linker(most), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 2) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` (smallest id reachable) for every row of ``docs``."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = materialize(links(distinct, most))
    labels = connected_components(found, "a", "b")
    least = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("class", F.coalesce("component", "fp"))
    smallest = least.groupBy("class").agg(F.min("first").alias("component_id"))
    classes = least.select("fp", "class").join(smallest, "class").select("fp", "component_id")
    out = materialize(classes)
    for used in (found, distinct):
        discard(used)
    return prints.join(out, "fp")


def digest(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
