"""Benchmark decontamination by spaced-seed hashing.

A mask picks some positions of a stretch of words and ignores the others, so a hash of the
picked words survives substitutions at ignored places. Hashes of all stretches of all
benchmark items are joined with those of all stretches of the documents; around each hit
item and document are aligned word by word, and the overlap is the stretch of the alignment
with the most equal words among those whose share of equal words is ``least_share`` or more.

The masks together hit every overlap of ten equal words or more at a share of 0.75 or more.
An overlap of 20 equal words or more splits into two of ten or more, one of which has the
share, so it is enough that they hit all patterns of 10 to 19 equal words, which a test
enumerates. The guarantee holds for these thresholds and stricter ones.

Words are runs of letters and digits (A-Z lower-cased, bytes of other scripts kept). Items
of fewer than ``least_words`` words are matched as a whole, from TOLERANT words on with one
substitution, which leaves one half of the item intact (the masks of these are the halves);
items of fewer than ``least_item`` words are not searched, as such texts are everyday
phrases, and null or empty texts match nothing. Repeated documents are reported each,
repeated items each under their own id (ties in item text give one row per item); an item
whose id is null, or no whole number, is searched and reported with a null id. Extra columns
are ignored and empty tables give empty results.

The benchmark's index is broadcast in blocks of bounded size, one pass over the documents
per block; any realistic benchmark is one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textops
from tidemark.llm.scratch import written

U = textops.U
SEPARATORS = textops.NON_LETTERS.copy()
SEPARATORS[48:58] = False
#: Fixed masks: x positions are hashed, others ignored.
MASKS = ("xxxx-xx", "xxx----------xxx", "xx-x---xxx", "xxx--x-xx", "xx---x---xxx", "xxxxxx", "xxxxx--x")
_PICK = textops.mix(np.arange(1, 257, dtype=np.uint64)) | U(1)
BLOCK_BYTES = 4 << 20
#: Words from which a short item may have one substitution.
TOLERANT = 8


def seeds(hashes: np.ndarray, bounds: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, document) of every stretch under a mask."""
    at, doc = textops.window_starts(bounds, len(mask))
    total = np.full(len(at), U(salt))
    for k in [i for i, c in enumerate(mask) if c == "x"]:
        total += hashes[at + k] * _PICK[k]
    return textops.mix(total), at, doc


@dataclass
class Index:
    """Benchmark items: ids, words end to end, and sorted seed hashes with their places."""

    ids: pa.Array
    hashes: np.ndarray
    bounds: np.ndarray
    masks: list[str]
    seed: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    filter: np.ndarray


def needed(n: int, least_words: int) -> int:
    """Equal words that an overlap with an item of ``n`` words must have."""
    return least_words if n >= least_words else n - (n >= TOLERANT)


def index(ids: list[int | None], texts: list[str | None], masks=MASKS, least_words: int = 10, least_item: int = 5) -> Index:
    w = textops.words(pa.array(texts, pa.string()), lower=True, separators=SEPARATORS)
    whole = max(least_words, min(map(len, masks)))  # items of fewer words must be equal in all
    short = sorted({int(n) for n in w.counts if least_item <= n < whole})
    general = len(masks)
    halves = lambda n: ("x" * (n // 2) + "-" * (n - n // 2), "-" * (n // 2) + "x" * (n - n // 2))
    masks = [*masks, *(mask for n in short for mask in (halves(n) if n >= TOLERANT else ("x" * n,)))]
    found = []
    for k, mask in enumerate(masks):
        h, at, doc = seeds(w.hash, w.bounds, mask, k)
        offset = at - w.bounds[doc]
        n = w.counts[doc]
        keep = n >= whole if k < general else n == len(mask)
        found.append((h[keep], doc[keep].astype(np.int32), offset[keep].astype(np.int32)))
    seed, item, offset = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(seed, kind="stable")
    seed = seed[order]
    flags = np.zeros(1 << 20, bool)
    flags[(seed >> U(44)).astype(np.int64)] = True
    return Index(pa.array(ids, pa.int64()), w.hash, w.bounds, masks, seed, item[order], offset[order], flags)


def best_stretch(equal: np.ndarray, least_share: float) -> tuple[int, int, int]:
    """Start, end and number of equal words of the stretch with the most of them at the share or more, the shortest and first of such."""
    share = Fraction(least_share).limit_denominator(10**6)
    weight = np.where(equal, share.denominator - share.numerator, -share.numerator)
    total = np.concatenate([[0], np.cumsum(weight)])  # a stretch has the share if its weights sum up to 0 or more
    same = np.concatenate([[0], np.cumsum(equal)])
    start = np.searchsorted(-np.minimum.accumulate(total), -total)  # the longest such stretch up to each end
    end = int(np.argmax(same - same[start]))
    inside = start[end] + np.flatnonzero(equal[start[end] : end])
    return (int(inside[0]), int(inside[-1]) + 1, len(inside)) if len(inside) else (0, 0, 0)


def search(texts: pa.Array, ix: Index, least_words: int, least_share: float) -> list[tuple[int, int, int, int, int]]:
    """(row, item, first word, words, equal words) of every verified overlap, the best per row and item."""
    w = textops.words(texts, lower=True, separators=SEPARATORS)
    codes, width = [], int(max(w.counts.max(initial=0), np.diff(ix.bounds).max(initial=0)) + 1) * 2
    for k, mask in enumerate(ix.masks):
        h, at, doc = seeds(w.hash, w.bounds, mask, k)
        near = np.flatnonzero(ix.filter[(h >> U(44)).astype(np.int64)])
        lo, hi = np.searchsorted(ix.seed, h[near]), np.searchsorted(ix.seed, h[near], side="right")
        n = hi - lo
        pos = np.repeat(near, n)
        entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shift = at[pos] - w.bounds[doc[pos]] - ix.offset[entry]
        codes.append((doc[pos] * len(ix.ids) + ix.item[entry]) * width + shift + width // 2)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for code in np.unique(np.concatenate(codes)).tolist():
        pair, shift = divmod(code, width)
        row, item = divmod(pair, len(ix.ids))
        shift -= width // 2
        a, b = ix.bounds[item], ix.bounds[item + 1]
        p, q = w.bounds[row], w.bounds[row + 1]
        lo, hi = max(0, shift), min(q - p, shift + b - a)
        s, e, same = best_stretch(w.hash[p + lo : p + hi] == ix.hashes[a + lo - shift : a + hi - shift], least_share)
        if same >= needed(b - a, least_words):
            found = (same, -(lo + s), e - s)
            if found > best.get((row, item), (0,)):
                best[row, item] = found
    return [(r, i, -at, n, same) for (r, i), (same, at, n) in best.items()]


def overlaps(docs: DataFrame, benchmark: DataFrame, least_words: int = 10, least_share: float = 0.75, masks=MASKS) -> DataFrame:
    """One row per document and item with a verified overlap.

    doc_id, item_id, first_word and n_words of the overlap in the document, n_equal of them.
    """
    out = None
    for ix in _blocks(benchmark, masks, least_words):
        found = _overlaps(docs, ix, least_words, least_share)
        out = found if out is None else out.unionByName(found)
    return out


def _blocks(benchmark: DataFrame, masks, least_words: int) -> Iterator[Index]:
    """The benchmark's index, in blocks of bounded size."""
    items = benchmark.select(F.expr("try_cast(item_id as bigint)").alias("item_id"), "text").filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = part.collect()  # one block of bounded size
        yield index([r.item_id for r in rows], [r.text for r in rows], masks, least_words)


def _overlaps(docs: DataFrame, ix: Index, least_words: int, least_share: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            for part in textops.chunks(batch, "text"):
                found = search(part.column(1), ix, least_words, least_share) if len(ix.seed) else []
                rows, items, first, n, same = (np.array(x, np.int64) for x in (zip(*found) if found else [()] * 5))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), ix.ids.take(pa.array(items)), pa.array(first), pa.array(n), pa.array(same)], ["doc_id", "item_id", "first_word", "n_words", "n_equal"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, first_word long, n_words long, n_equal long")


def clean(docs: DataFrame, benchmark: DataFrame, least_words: int = 10, least_share: float = 0.75, masks=MASKS) -> DataFrame:
    """The documents without any overlap, row by row, columns as they are. Texts aren't shuffled.

    What a block of the benchmark leaves is written before the next, so that a worker holds one block.
    """
    out = None
    for ix in _blocks(benchmark, masks, least_words):
        out = _clean(docs if out is None else written(out, "decontam-clean"), ix, least_words, least_share)
    return out


def _clean(docs: DataFrame, ix: Index, least_words: int, least_share: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ix)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.chunks(batch, names[at]):
                keep = np.ones(part.num_rows, bool)
                if len(shared.value.seed):
                    keep[[r for r, *_ in search(part.column(at), shared.value, least_words, least_share)]] = False
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
