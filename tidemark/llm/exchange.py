"""Shuffling packed columns: keyed entries travel as one binary per task and cell.

A mapper gives numpy columns, the first of which is a uniformly distributed 64-bit key.
Entries go to cell ``key % parts`` as contiguous columns, so a row costs its bytes and no
more, and the reducer works on a cell's whole arrays. The number of cells follows the
input's size, which bounds the memory of a reducer; beyond MOST cells a partition has
several, one after the other, which Spark sorts (and spills) by cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import textops

#: Entries that a mapper holds before it sends them: these, or so many a cell, up to a limit.
HOLD, HOLD_EACH, HOLD_MOST = 1 << 19, 32, 1 << 22
#: Partitions of a shuffle.
MOST = 20_000
BLOB = "pid int, data binary"


class Packer:
    """Collects entries and splits them by cell. A key sent as 32 bits is cut to its upper half.

    With ``spread``, for reducers that only ask which keys occur more than once: of a key that
    occurs often among what is held, two entries go to the key's cell and the others, which are
    surely repeated, to cells by their second column. The last column, a byte, says which.
    """

    def __init__(self, parts: int, kinds: Sequence[str], spread: bool = False):
        self.parts, self.kinds, self.held, self.n = parts, [np.dtype(k) for k in kinds], [], 0
        self.spread = spread
        self.limit = max(HOLD, min(HOLD_EACH * parts, HOLD_MOST))

    def add(self, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(cols[0]):
            pid = (cols[0] % np.uint64(self.parts)).astype(np.int32)
            cols = (*cols, np.zeros(len(pid), np.uint8)) if self.spread else cols
            first = cols[0] >> np.uint64(32) if self.kinds[0].itemsize == 4 else cols[0]
            self.held.append([pid, *(c.astype(k, copy=False) for c, k in zip((first, *cols[1:]), self.kinds))])
            self.n += len(cols[0])
        if self.n >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        pid, *cols = (np.concatenate(c) for c in zip(*self.held))
        self.held, self.n = [], 0
        if self.spread:
            order, cut = groups(cols[0])
            sizes = np.diff(np.append(cut, len(order)))
            extra = order[np.arange(len(order)) - np.repeat(cut, sizes) >= 2]
            pid[extra], cols[-1][extra] = (cols[1][extra].view(np.uint64) % np.uint64(self.parts)).astype(np.int32), 1
        order = np.argsort(pid, kind="stable")
        pid, cols = pid[order], [c[order] for c in cols]
        cut = np.flatnonzero(np.concatenate([[True], pid[1:] != pid[:-1]]))
        ends = np.append(cut[1:], len(pid))
        data = [b"".join(c[a:b].tobytes() for c in cols) for a, b in zip(cut, ends)]
        yield pa.RecordBatch.from_arrays([pa.array(pid[cut], pa.int32()), pa.array(data, pa.binary())], ["pid", "data"])


def unpack(batches: Iterator[pa.RecordBatch], kinds: Sequence[str], column: int = 1) -> list[np.ndarray]:
    """All entries of a partition as columns."""
    kinds = [np.dtype(k) for k in kinds]
    width = sum(k.itemsize for k in kinds)
    got: list[list[np.ndarray]] = [[] for _ in kinds]
    for batch in batches:
        for value in batch.column(column):
            raw = np.frombuffer(value.as_buffer(), np.uint8)
            n, at = len(raw) // width, 0
            for k, kind in enumerate(kinds):
                got[k].append(raw[at : at + n * kind.itemsize].view(kind))
                at += n * kind.itemsize
    return [np.concatenate(g) if g else np.zeros(0, k) for g, k in zip(got, kinds)]


def dealt(blobs: DataFrame, parts: int) -> DataFrame:
    """Rows with a cell ``pid`` below ``parts``, the rows of a cell in one partition, one after the other."""
    if parts <= MOST:
        return blobs.repartitionById(parts, blobs.pid)
    return blobs.repartitionById(MOST, blobs.pid % MOST).sortWithinPartitions("pid")


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each cell, from a partition of ``dealt`` with pid in front."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        pid = np.array(batch.column(0))
        cut = [0, *(np.flatnonzero(pid[1:] != pid[:-1]) + 1).tolist(), len(pid)]
        for lo, hi in zip(cut[:-1], cut[1:]):
            if hi > lo:
                if held and held[-1].column(0)[0].as_py() != pid[lo]:
                    yield held
                    held = []
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield held


def exchange(blobs: DataFrame, parts: int, kinds: Sequence[str], reduce: Callable[[list[np.ndarray]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Deal packed entries to their cells and run ``reduce`` on each cell's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells(batches):
            cols = unpack(iter(cell), kinds)
            cell.clear()
            if len(cols[0]):
                yield from reduce(cols)
            del cols
        textops.release()

    return dealt(blobs, parts).mapInArrow(run, schema)


def groups(key: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorting order by the key (then ``more``), and the first index of each group of equals in it."""
    order = np.lexsort((*more[::-1], key)) if more else np.argsort(key, kind="stable")
    new = np.zeros(len(key), bool)
    new[:1] = True
    for k in (key, *more):
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)
