"""Vectorized text primitives on Arrow string buffers (numpy, no per-word Python).

Words are maximal runs of bytes outside a separator set. Each pair of a place in the word
and a byte has its own random number, and a word's hash is the mixed sum of its pairs' numbers,
read off one prefix sum over the whole buffer; words of over PLACES bytes are hashed one by one.
A window's hash mixes the hashes of its two halves (overlapping, where the length isn't a power
of two), so that no arrangement of the same words cancels out.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another system's library
    _libc = None

U = np.uint64
CHUNK_BYTES = 1 << 19
#: Places within a word that have numbers of their own.
PLACES = 64
_NUMBERS = np.random.default_rng(20240229).integers(0, 2**64, PLACES * 256, dtype=np.uint64)
_LEFT, _OUTER = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)

#: The white space that separates words: x20 and x09 to x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII letters and bytes of other scripts.
NON_LETTERS = np.ones(256, bool)
NON_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix)."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def unmix(h: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    h = h ^ (h >> U(31)) ^ (h >> U(62))
    h *= U(pow(0x94D049BB133111EB, -1, 2**64))
    h ^= (h >> U(27)) ^ (h >> U(54))
    h *= U(pow(0xBF58476D1CE4E5B9, -1, 2**64))
    h ^= (h >> U(30)) ^ (h >> U(60))
    return h


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; a longer text is alone, whole."""
    _, offsets = raw(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield batch.slice(at, end - at)
        at = end
    release()


def release() -> None:
    """Give freed memory back to the system, as a worker that waits for its next task keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and each row's offsets (null: empty)."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a chunk in order: byte spans, hashes, each document's word range, and the prefix sums."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray
    sums: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def prefixes(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the first ``n`` bytes (PLACES at most) of the words ``at``."""
        return mix((self.sums[self.start[at] + n] - self.sums[self.start[at]]) ^ U(n))


def words(texts: pa.Array, lower: bool = False, separators: np.ndarray = SPACES) -> Words:
    buf, offsets = raw(texts)
    if lower:
        buf = LOWER[buf]
    n = len(buf)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(buf, empty, empty, np.zeros(0, U), np.zeros(len(offsets), np.int64), np.zeros(1, U))
    inside = np.empty(n + 1, bool)
    inside[:n] = ~separators[buf]
    inside[n] = False
    first = inside[:n].copy()
    first[1:] &= ~inside[: n - 1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    first[cut] = inside[cut]
    last = inside[:n] & ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    place = np.arange(n, dtype=np.int32)
    place -= np.maximum.accumulate(np.where(first, place, 0))
    np.minimum(place, PLACES - 1, out=place)
    sums = np.zeros(n + 1, U)
    np.cumsum(_NUMBERS[(place << 8) | buf], out=sums[1:])
    h = mix(sums[end] - sums[start])
    for i in np.flatnonzero(end - start > PLACES).tolist():
        h[i] = xxhash.xxh3_64_intdigest(buf[start[i] : end[i]].tobytes())
    return Words(buf, start, end, h, np.searchsorted(start, offsets), sums)


def endings(w: Words, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the last ``n`` bytes of the words ``at`` (of the whole word, if it is shorter)."""
    start, end, total = w.start[at], w.end[at], np.zeros(len(at), U)
    for k in range(n):
        some = np.flatnonzero(end - start > k)
        total[some] += _NUMBERS[k * 256 + w.buf[end[some] - 1 - k].astype(np.int64)]
    return mix(total)


def windows(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows of ``length`` words, of hashes ``h``, that start at ``at``."""
    span = 1
    while span * 2 <= length:
        h = mix(h[:-span] * _LEFT + h[span:])
        span *= 2
    return mix(h[at] * _OUTER + h[at + (length - span)] + U(length)) if len(at) else np.zeros(0, U)


def window_starts(bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``length`` words inside one document, and their documents."""
    n = np.maximum(np.diff(bounds) - length + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    return np.arange(n.sum()) - np.repeat(first, n) + bounds[doc], doc


def distinct_by_doc(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document's stretch of ``h``, sorted within it, and the new sizes."""
    h = h.copy()
    edge = np.concatenate([[0], np.cumsum(sizes)])
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if e - s > 1:
            h[s:e].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    keep[edge[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return h[keep], kept[edge[1:]] - kept[edge[:-1]]


def shingle_sets(texts: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of distinct ``length``-word shingles as sorted hashes, and set sizes.

    Words are lower-cased in A-Z. A text of fewer words has its whole sequence as the one
    shingle; a text without words (or null) has the empty set.
    """
    w = words(texts, lower=True)
    counts = w.counts
    full = np.maximum(counts - length + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(full)), full)
    first = np.cumsum(full) - full
    at = np.arange(full.sum()) - np.repeat(first, full) + w.bounds[doc]
    size, h = np.minimum(counts, length)[doc], np.empty(len(at), U)
    for n in np.unique(size).tolist():
        some = np.flatnonzero(size == n)
        h[some] = windows(w.hash, at[some], n)
    return distinct_by_doc(h, full)
