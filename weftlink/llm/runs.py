"""Counts of 64-bit keys over a whole corpus as sorted runs, merged by key range.

A task counts what it reads in runs of bounded size and cuts each run into key
ranges; the ranges are dealt to tasks, and each merges its own. Keys travel as
differences in byte planes, so a key costs a few bytes of shuffle and no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 1 << 20  # keys sorted at once
SCHEMA = "bucket int, keys binary, counts binary"


def pack(keys: np.ndarray) -> bytes:
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def pack_counts(c: np.ndarray) -> bytes:
    return np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_counts(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1).astype(np.int64)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    if not len(k):
        return k, c
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    begin = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[begin], np.add.reduceat(c, begin)


def rows(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([pack(f[1]) for f in found], pa.binary()), pa.array([pack_counts(f[2]) for f in found], pa.binary())], names=["bucket", "keys", "counts"])


class Counter:
    """Holds keys and their counts and gives them back as runs, cut into ``buckets`` ranges of ``bits``-bit keys."""

    def __init__(self, bits: int, buckets: int):
        self.width = (1 << bits) // buckets
        self.buckets, self.held, self.size = buckets, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> pa.RecordBatch | None:
        self.held.append((keys, counts))
        self.size += len(keys)
        return self.flush() if self.size >= RUN else None

    def flush(self) -> pa.RecordBatch | None:
        if not self.size:
            return None
        if all(c is None for _, c in self.held):
            keys, counts = np.unique(np.concatenate([k for k, _ in self.held]), return_counts=True)
        else:
            keys, counts = summed([k for k, _ in self.held], [np.ones(len(k), np.int64) if c is None else c for k, c in self.held])
        self.held, self.size = [], 0
        cuts = np.searchsorted(keys, np.array([b * self.width for b in range(self.buckets)], np.uint64)).tolist() + [len(keys)]
        return rows([(b, keys[lo:hi], counts[lo:hi]) for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo])


def merger(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each range, with the keys counted ``least`` times or more.

    Rows with a negative bucket carry vectors of whole numbers in ``keys``, whose sum is the
    same in any order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        vectors: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, k, c in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if b < 0:
                    v = np.frombuffer(k, np.int64)
                    vectors[b] = vectors[b] + v if b in vectors else v
                else:
                    held.setdefault(b, []).append((k, c))
        for b, v in vectors.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([v.tobytes()], pa.binary()), pa.array([b""], pa.binary())], names=["bucket", "keys", "counts"])
        for b in sorted(held):
            parts = held.pop(b)
            keys, counts = summed([unpack(k) for k, _ in parts], [unpack_counts(c) for _, c in parts])
            if (enough := counts >= least).any():
                yield rows([(b, keys[enough], counts[enough])])

    return run


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in batch.column(2).to_pylist():
            value, n = np.unique(unpack_counts(c), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value, pa.int64()), pa.array(n, pa.int64())], names=["value", "n"])


def _above(cut: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, k, c in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                counts = unpack_counts(c)
                if (own := counts >= cut).any():
                    yield rows([(b, unpack(k)[own], counts[own])])

    return run


def exploded(merged: DataFrame, below: int) -> DataFrame:
    """(key, c) rows of the keys counted less than ``below`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                counts = unpack_counts(c)
                own = counts < below
                yield pa.RecordBatch.from_arrays([pa.array(unpack(k)[own].view(np.int64)), pa.array(counts[own])], names=["key", "c"])

    return merged.where("bucket >= 0").mapInArrow(run, "key long, c long")


HIST_TOP = 100_000


def totals(merged: DataFrame) -> list[tuple[int, int, int]]:
    """(count, keys with it, their sum) from the largest down; counts over ``HIST_TOP`` are one entry."""
    hist = merged.where("bucket >= 0").mapInArrow(_histogram, "value long, n long")
    out = hist.groupBy(F.least("value", F.lit(HIST_TOP)).alias("v")).agg(F.sum("n").alias("n"), F.sum(F.col("value") * F.col("n")).alias("s")).orderBy(F.desc("v"))
    return [tuple(r) for r in out.collect()]  # HIST_TOP rows at most


def top(merged: DataFrame, hist: list[tuple[int, int, int]], size: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The most counted keys, at most ``size``, sorted, their counts, and the count from which on all are there."""
    cut, total = HIST_TOP + 1, 0
    for value, n, _ in hist:
        if total + n > size:
            break
        cut, total = value, total + n
    else:
        cut = least
    found = merged.where("bucket >= 0").mapInArrow(_above(cut), SCHEMA).collect() if total else []
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), cut
    keys, counts = summed([unpack(r["keys"]) for r in found], [unpack_counts(r["counts"]) for r in found])
    return keys, counts, cut


#: Pieces in which a filter of bits travels.
PIECES = 16


def places(h: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two bits for each hash: their bytes and values in a filter of ``size`` bytes, a power of two."""
    bits = [(h >> np.uint64(s)) & np.uint64(8 * size - 1) for s in (0, 32)]
    return [((b >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (b & np.uint64(7)).astype(np.uint8))) for b in bits]


def passes(held: np.ndarray, h: np.ndarray) -> np.ndarray:
    (a, x), (b, y) = places(h, len(held))
    return ((held[a] & x) != 0) & ((held[b] & y) != 0)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, p in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            own = np.frombuffer(p, np.uint8)
            held[k] = held[k] | own if k in held else own
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([p.tobytes() for p in held.values()], pa.binary())], names=["piece", "bits"])


def filter_of(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], size: int) -> np.ndarray:
    """A filter of ``size`` bytes with the bits of all hashes that ``hashes`` takes from a batch; it alone reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.uint8)
        for batch in batches:
            for h in hashes(batch):
                for where, bit in places(h, size):
                    np.bitwise_or.at(held, where, bit)
        found = [(k, p.tobytes()) for k, p in enumerate(held.reshape(PIECES, -1)) if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([p for _, p in found], pa.binary())], names=["piece", "bits"])

    schema = "piece int, bits binary"
    out = np.zeros((PIECES, size // PIECES), np.uint8)
    for r in df.mapInArrow(run, schema).repartition(PIECES, "piece").mapInArrow(_united, schema).collect():
        out[r["piece"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def filter_bytes(n: int, bits: int, least: int, most: int) -> int:
    """A power of two that gives each of ``n`` hashes so many bits, within bounds in bits."""
    return min(most, max(least, 1 << (n * bits).bit_length())) // 8
