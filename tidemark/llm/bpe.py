"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pre-token that is a vocabulary entry is resolved by one probe of a minimal perfect
hash; any other is merged with a heap of adjacent pairs over a linked list of bytes,
lowest rank first and leftmost among equals.

Null text counts as empty and an empty text has no tokens. Extra columns, repeated rows
and repeated ids pass through untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

_M, _A, _B = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Distinct pre-tokens remembered by a worker before the memory is emptied.
MEMORY = 600_000
#: Characters of the longest word that is remembered, so that the memory is bounded in bytes too.
REMEMBERED = 48
_CUT = re.compile(r" (?=\S)(?<=\S )").split


class PerfectHash:
    """Hash-and-displace table of exactly len(keys) slots.

    Keys fall into buckets; each bucket of several keys searches a displacement that puts
    its keys on free slots, and buckets of one key name their slot outright.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = max(1, len(keys))
        r = self.r = max(1, n // 2)
        hashed = [xxhash.xxh3_64_intdigest(k) for k in keys]
        buckets: dict[int, list[int]] = {}
        for i, h in enumerate(hashed):
            buckets.setdefault(h % r, []).append(i)
        self.shift, self.slot_key = [0] * r, [-1] * n
        for b, members in sorted(buckets.items(), key=lambda kv: (-len(kv[1]), kv[0])):
            if len(members) == 1:
                break
            d = 1
            while True:
                slots = [self._slot(hashed[i], d) for i in members]
                if len(set(slots)) == len(slots) and all(self.slot_key[s] < 0 for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for s, i in zip(slots, members):
                self.slot_key[s] = i
        free = (s for s in range(n) if self.slot_key[s] < 0)
        for b, members in buckets.items():
            if len(members) == 1:
                s = next(free)
                self.shift[b], self.slot_key[s] = -s - 1, members[0]
        self.keys = [keys[i] if i >= 0 else None for i in self.slot_key]

    def _slot(self, h: int, d: int) -> int:
        return ((((h ^ (d * _A)) * _B) & _M) >> 24) % self.n

    def find(self, key: bytes) -> int:
        """Index of the key in the list that the table was built from, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.r]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return self.slot_key[s] if self.keys[s] == key else -1


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """(token bytes, rank) of a rank file: base64 and number on each line."""
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]


class Codec:
    """Encoder and decoder for one vocabulary. Its tables travel when it is pickled; its memo doesn't."""

    def __init__(self, entries: list[tuple[bytes, int]], pattern: str):
        self.pattern = pattern
        self.ranks = dict(entries)
        self.table = PerfectHash([k for k, _ in entries])
        self.rank_at = [r for _, r in entries]
        self.bytes_of = {r: k for k, r in entries}
        self._start()

    def _start(self) -> None:
        self.split = regex.compile(self.pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "memo")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a piece outside the vocabulary: lowest-rank pair first, leftmost among equals."""
        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, to = pop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != to:
                continue  # one side has been merged since
            end[i], end[mid] = to, 0
            if to < n:
                before[to] = i
                if (r := ranks.get(piece[i : end[to]])) is not None:
                    push(heap, (r, i, end[to]))
            j = before[i]
            if j >= 0 and (r := ranks.get(piece[j:to])) is not None:
                push(heap, (r, j, to))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(ids)

    def piece(self, token: str) -> tuple[int, ...]:
        b = token.encode()
        at = self.table.find(b)
        return (self.rank_at[at],) if at >= 0 else self.merge(b)

    def stretch(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.piece, self.split(text))))

    def spaced(self, word: str) -> tuple[int, ...]:
        """Ids of a word after its space, remembered."""
        ids = self.stretch(" " + word)
        if len(word) > REMEMBERED:
            return ids
        if len(self.memo) >= MEMORY:
            self.memo.clear()
        self.memo[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; each match of the pattern is encoded on its own, without special tokens.

        Every match of the pattern ends before a single space that stands between two
        other characters, and the next takes that space with what follows. So a text
        is cut there, and the stretches are encoded (and remembered) one by one.
        """
        if not text:
            return []
        head, *rest = _CUT(text)
        get, spaced = self.memo.get, self.spaced
        ids = list(self.stretch(head))
        ids.extend(chain.from_iterable([get(t) or spaced(t) for t in rest]))
        return ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def load(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encode(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``ids`` (array of int), ``n_tokens``. Narrow: no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [c.encode(t) for t in part.column(1).to_pylist()]
                sizes = [len(x) for x in ids]
                flat = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, sum(sizes)))
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(sizes, pa.int64())], ["doc_id", "ids", "n_tokens"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long")


def round_trip_digests(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each document, decode the ids again, and return digests of both.

    Same encoder and decoder as `encode`; fused in one narrow pass so that neither ids
    nor decoded bytes leave the worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        digits = {r: str(r) for r in c.bytes_of}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n, a, b = [], [], []
                for text in part.column(1).to_pylist():
                    ids = c.encode(text)
                    n.append(len(ids))
                    a.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                    b.append(hashlib.sha256(c.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
