"""Repeated-passage removal by level-wise doubling.

A passage is a window of ``length`` words that starts at two places or more, of one
document or of several. The search goes up in levels, each of twice the length before (the
last cut to ``length``), from one of some 16 words or less; all windows inside a repeated
one are repeated, so what occurs once at one level needs no look at the next:

* Of every window's shortest stretches the one with the least hash is an anchor (a repeated
  window has equal anchors at equal offsets, so nothing is lost and few positions travel).
  Anchors that occur once are dropped.
* Surviving anchors are extended to twice their length, forwards or backwards as fits
  into a window; those that occur once are dropped. Documents without survivors never leave
  their task.
* Around what survives, the windows of the next length are compared, until that is the full
  length or no candidate survives.

Equal texts are one text with a multiplicity, merged within each task before any shuffle.
Of entries that a task has seen repeated already only two are compared, so a passage of very
many documents doesn't meet in one task. Entries are compared by 64-bit hashes, windows by 96.

Words are cut at white space and compared unchanged. Null and empty texts have no words;
texts shorter than the length lose nothing; an equal text elsewhere (also a repeated row)
is a repetition. Empty tables give empty results. `digests` ignores extra columns,
`remove` passes them through.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import exchange, idfilter, textops
from tidemark.llm.scratch import parts_for, written

U = textops.U
#: Characters of text in a row of the candidate table.
BLOCK_BYTES = 2 << 20
_CHECK_SALT = U(0xA24BAED4963EE407)


def _running(x: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    """pick over x[i : i + width] for every i where it fits, by doubling."""
    span, out = 1, x
    while span * 2 <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def levels(length: int) -> list[int]:
    """Lengths of the levels, three at least: halves of the full length, rounded up."""
    found = [length]
    while len(found) < 3 or found[0] > 16:
        found.insert(0, (found[0] + 1) // 2)
    return [found[0], min(2 * found[0], length), *found[2:]]


def anchors(w: textops.Words, length: int, short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, document, hash) of stretches of ``short`` words that are least in some window."""
    starts, doc = textops.window_starts(w.bounds, length)
    total = len(w.hash)
    if not len(starts):
        return starts, doc, np.zeros(0, U)
    h = np.full(total, ~U(0), U)
    at = np.arange(total - short + 1)
    h[at] = textops.windows(w.hash, at, short) | U(1)
    width = length - short + 1
    least = np.zeros(total + width - 1, U)  # index i + width - 1: so that a backward look has room
    low = _running(h, width, np.minimum)
    least[starts + width - 1] = low[starts]
    high = _running(least, width, np.maximum)  # high[j]: over windows j - width + 1 .. j
    pos = np.flatnonzero(high == h)
    return pos, np.searchsorted(w.bounds, pos, side="right") - 1, h[pos]


def _survivors(cols: list[np.ndarray]) -> np.ndarray:
    """Indexes of entries whose key occurs more than once, or was seen to where they come from."""
    order = np.argsort(cols[0], kind="stable")
    k = cols[0][order]
    same = cols[-1][order] > 0
    same[1:] |= k[1:] == k[:-1]
    same[:-1] |= k[1:] == k[:-1]
    return order[same]


def _fresh(ids: list[int], seen: Counter) -> list[int]:
    """Rows of a task to take: two of each text at most, which is as good as more."""
    take = []
    for i, t in enumerate(ids):
        if t is not None and seen[t] < 2:
            seen[t] += 1
            take.append(i)
    return take


def _candidates(texts: DataFrame, length: int, parts: int, blocks: int) -> DataFrame:
    """The first two levels: (tid, positions of surviving anchors as int32), one row per text."""
    short, twice, *_ = levels(length)
    first, second, last = ["u8", "i8", "i4", "u8", "u8", "u1"], ["u8", "i8", "i4", "u1"], ["u8", "i4"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = exchange.Packer(parts, first, spread=True), Counter()
        for batch in batches:
            batch = batch.take(pa.array(_fresh(batch.column(0).to_pylist(), seen), pa.int32()))
            for part in textops.chunks(batch, "text"):
                w = textops.words(part.column(1))
                pos, doc, h = anchors(w, length, short)
                n, here = w.counts[doc], pos - w.bounds[doc]
                ahead, back = np.zeros(len(pos), U), np.zeros(len(pos), U)
                ok = here + twice <= n
                ahead[ok] = textops.windows(w.hash, pos[ok], twice) | U(1)
                ok = here >= twice - short
                back[ok] = textops.windows(w.hash, pos[ok] - (twice - short), twice) | U(1)
                tid = np.array(part.column(0), np.int64)[doc]
                yield from out.add(textops.mix(h), tid, here, ahead, back)
        yield from out.flush()

    def double(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        out = exchange.Packer(parts, second, spread=True)
        at = _survivors(cols)
        for k in (3, 4):
            some = at[cols[k][at] != 0]
            yield from out.add(textops.mix(cols[k][some]), cols[1][some], cols[2][some])
        yield from out.flush()

    def regroup(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        out = exchange.Packer(blocks, last)
        at = _survivors(cols)
        yield from out.add(cols[1][at].view(np.uint64), cols[2][at])
        yield from out.flush()

    def collect(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        order, cut = exchange.groups(cols[0], cols[1])
        tid, pos = cols[0][order][cut], cols[1][order][cut]
        edge = np.flatnonzero(np.concatenate([[True], tid[1:] != tid[:-1]]))
        ends = np.append(edge[1:], len(tid))
        yield pa.RecordBatch.from_arrays([pa.array(tid[edge].view(np.int64)), pa.array([pos[a:b].tobytes() for a, b in zip(edge, ends)], pa.binary())], ["tid", "pos"])

    blobs = texts.mapInArrow(scan, exchange.BLOB)
    blobs = exchange.exchange(blobs, parts, first, double, exchange.BLOB)
    blobs = exchange.exchange(blobs, parts, second, regroup, exchange.BLOB)
    return exchange.exchange(blobs, blocks, last, collect, "tid long, pos binary")


def _blocks(texts: DataFrame, cands: DataFrame, blocks: int) -> DataFrame:
    """Candidate texts in rows of about two megabytes: src, and arrays of tid, mult, text, pos."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in batches:
            batch = batch.take(pa.array(_fresh(batch.column(0).to_pylist(), seen), pa.int32()))
            pid = (np.array(batch.column(0), np.int64).view(np.uint64) % U(blocks)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(pid), batch.column(0), batch.column(1), pa.nulls(len(pid), pa.binary())], ["pid", "tid", "text", "pos"])

    def send_pos(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pid = (np.array(batch.column(0), np.int64).view(np.uint64) % U(blocks)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(pid), batch.column(0), pa.nulls(len(pid), pa.string()), batch.column(1)], ["pid", "tid", "text", "pos"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text: dict[int, str] = {}
        mult, pos, pid = Counter(), {}, 0
        for batch in batches:
            for pid, tid, t, p in zip(*(c.to_pylist() for c in batch.columns)):
                if t is None:
                    pos[tid] = p
                else:
                    text[tid] = t
                    mult[tid] += 1
        group, size, n = [], 0, 0
        for tid in sorted(text):
            group.append(tid)
            size += len(text[tid])
            if size >= BLOCK_BYTES:
                yield row(pid, n, group, text, mult, pos)
                group, size, n = [], 0, n + 1
        if group:
            yield row(pid, n, group, text, mult, pos)

    def row(pid, n, group, text, mult, pos) -> pa.RecordBatch:
        cols = [[[*group]], [[min(mult[t], 2) for t in group]], [[text[t] for t in group]], [[pos.get(t, b"") for t in group]]]
        kinds = [pa.list_(k) for k in (pa.int64(), pa.int32(), pa.string(), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([(pid << 20) + n], pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["src", "tids", "mults", "texts", "poss"])

    rows = "pid int, tid long, text string, pos binary"
    both = texts.mapInArrow(send, rows).unionByName(cands.mapInArrow(send_pos, rows))
    return exchange.dealt(both, blocks).mapInArrow(lambda batches: (row for cell in exchange.cells(batches) for row in merge(iter(cell))), "src long, tids array<long>, mults array<int>, texts array<string>, poss array<binary>")


@dataclass
class _Windows:
    """Windows of ``length`` words around surviving stretches of ``have`` words in some texts; in fixed order.

    ``entry`` says which of the different windows (``key``, ``check``) each start has, and
    ``many`` which of those occur more than once here.
    """

    words: textops.Words
    starts: np.ndarray
    entry: np.ndarray
    key: np.ndarray
    check: np.ndarray
    many: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, poss: list[bytes], have: int, length: int) -> _Windows:
        w = textops.words(texts)
        mark = np.zeros(len(w.hash) + 1, np.int64)
        for d, p in enumerate(poss):
            n = w.bounds[d + 1] - w.bounds[d]
            if p and n >= length:
                at = np.frombuffer(p, np.int32).astype(np.int64)
                np.add.at(mark, w.bounds[d] + np.maximum(at - (length - have), 0), 1)
                np.add.at(mark, w.bounds[d] + np.minimum(at, n - length) + 1, -1)
        starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        key = textops.windows(w.hash, starts, length)
        check = (textops.windows(w.hash ^ _CHECK_SALT, starts, length) >> U(32)).astype(np.uint32)
        order, cut = exchange.groups(key, check)
        sizes = np.diff(np.append(cut, len(order)))
        entry = np.empty(len(order), np.int64)
        entry[order] = np.repeat(np.arange(len(cut)), sizes)
        return cls(w, starts, entry, key[order[cut]], check[order[cut]], sizes > 1)

    def dealt(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The different windows in order of their cells, and where each cell begins."""
        pid = (self.key % U(parts)).astype(np.int32)
        order = np.argsort(pid, kind="stable")
        return order, np.flatnonzero(np.concatenate([[True], pid[order][1:] != pid[order][:-1]])) if len(pid) else np.zeros(0, np.int64)

    def hits(self, masks: list[dict] | None, parts: int) -> np.ndarray:
        """The starts of the windows that are repeated, here or by what the cells say."""
        hit = self.many.copy()
        order, cut = self.dealt(parts)
        ends = np.append(cut[1:], len(order))
        place = {int(p): (a, b) for p, a, b in zip(self.key[order[cut]] % U(parts), cut, ends)}
        for m in masks or []:
            a, b = place[m["pid"]]
            hit[order[a:b]] |= np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=b - a).astype(bool)
        return self.starts[hit[self.entry]]


def _find(blocks: DataFrame, have: int, length: int, parts: int) -> DataFrame:
    """One level: (src, pid, mask): a bit for each window that a block sent to a cell; only where one is set."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, src in enumerate(batch.column(0).to_pylist()):
                w = _Windows.of(batch.column(1)[k].values, batch.column(2)[k].as_py(), have, length)
                order, cut = w.dealt(parts)
                cols = [c[order] for c in (w.key, w.check, w.many.astype(np.uint8))]
                data = [b"".join(c[a:b].tobytes() for c in cols) for a, b in zip(cut, np.append(cut[1:], len(order)))]
                pid = (cols[0][cut] % U(parts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(pid, pa.int32()), pa.array(np.full(len(cut), src)), pa.array(data, pa.binary())], ["pid", "src", "data"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in exchange.cells(batches):
            srcs = np.concatenate([np.array(b.column(1)) for b in cell])
            sizes = [len(v.as_buffer()) // 13 for b in cell for v in b.column(2)]
            pid = cell[0].column(0)[0].as_py()
            key, check, many = exchange.unpack(iter(cell), ["u8", "u4", "u1"], 2)
            order, cut = exchange.groups(key, check)
            each = np.diff(np.append(cut, len(order)))
            flag = np.empty(len(key), bool)
            flag[order] = np.repeat((each > 1) | (np.maximum.reduceat(many[order], cut) > 0), each)
            edge = np.cumsum([0, *sizes]).tolist()
            set_ = [k for k, (lo, hi) in enumerate(zip(edge[:-1], edge[1:])) if flag[lo:hi].any()]
            masks = [np.packbits(flag[edge[k] : edge[k + 1]]).tobytes() for k in set_]
            yield pa.RecordBatch.from_arrays([pa.array(srcs[set_], pa.int64()), pa.array([pid] * len(set_), pa.int32()), pa.array(masks, pa.binary())], ["src", "pid", "mask"])

    sent = blocks.select("src", "texts", "poss").mapInArrow(send, "pid int, src long, data binary")
    return exchange.dealt(sent, parts).mapInArrow(compare, "src long, pid int, mask binary")


def _with_masks(blocks: DataFrame, masks: DataFrame) -> DataFrame:
    by_src = masks.groupBy("src").agg(F.collect_list(F.struct("pid", "mask")).alias("masks"))  # one small mask per cell
    return blocks.join(by_src, "src", "left")


def _narrow(blocks: DataFrame, masks: DataFrame, have: int, length: int, parts: int) -> DataFrame:
    """The blocks with the starts of repeated windows of ``length`` as what survives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                w = _Windows.of(batch.column(3)[k].values, batch.column(4)[k].as_py(), have, length)
                hit, bounds = w.hits(batch.column(5)[k].as_py(), parts), w.words.bounds
                left = np.split(hit, np.searchsorted(hit, bounds[1:-1]))
                poss = [(x - lo).astype(np.int32).tobytes() for x, lo in zip(left, bounds[:-1])]
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns[:4]), pa.array([poss], pa.list_(pa.binary()))], ["src", "tids", "mults", "texts", "poss"])

    joined = _with_masks(blocks, masks).select("src", "tids", "mults", "texts", "poss", "masks")
    return joined.mapInArrow(run, blocks.select("src", "tids", "mults", "texts", "poss").schema)


def _cut(blocks: DataFrame, masks: DataFrame, have: int, length: int, parts: int) -> DataFrame:
    """(tid, n_words, n_removed, kept) of every candidate text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tids, mults, poss = (batch.column(c)[k].as_py() for c in (0, 1, 3))
                found = _Windows.of(batch.column(2)[k].values, poss, have, length)
                w, hit = found.words, found.hits(batch.column(4)[k].as_py(), parts)
                mark = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(mark, hit, 1)
                np.add.at(mark, hit + length, -1)
                gone = np.cumsum(mark[:-1]) > 0
                body = w.buf.tobytes()
                n, removed, kept = [], [], []
                for d, (lo, hi) in enumerate(zip(w.bounds[:-1], w.bounds[1:])):
                    if mults[d] > 1 and hi - lo >= length:
                        gone[lo:hi] = True
                    left = lo + np.flatnonzero(~gone[lo:hi])
                    n.append(hi - lo)
                    removed.append(hi - lo - len(left))
                    kept.append(b" ".join([body[a:b] for a, b in zip(w.start[left].tolist(), w.end[left].tolist())]).decode())
                yield pa.RecordBatch.from_arrays([pa.array(tids, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["tid", "n_words", "n_removed", "kept"])

    joined = _with_masks(blocks, masks).select("tids", "mults", "texts", "poss", "masks")
    return joined.mapInArrow(run, "tid long, n_words long, n_removed long, kept string")


def _search(docs: DataFrame, length: int, bytes_each: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents without candidates, documents with (both with __tid), and the candidates' results."""
    parts, blocks = parts_for(docs, bytes_each), parts_for(docs, 4 * bytes_each)
    ided = docs.withColumn("__tid", F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = ided.select(F.col("__tid").alias("tid"), "text").filter("text is not null")
    cands = written(_candidates(texts, length, parts, blocks), "repeat-anchors")
    flagged = idfilter.flagged(ided, cands, "__tid")
    chosen = flagged.filter("__cand and text is not null").drop("__cand")
    table = written(_blocks(chosen.select(F.col("__tid").alias("tid"), "text"), cands, blocks), "repeat-texts")
    have, _, *longer = levels(length)
    for n in longer:
        masks = written(_find(table, have, n, parts), "repeat-windows")
        if n == length or masks.isEmpty():
            break  # with nothing left at one length there is nothing at the full one
        table, have = written(_narrow(table, masks, have, n, parts), "repeat-texts"), n
    return flagged.filter("not __cand or text is null").drop("__cand"), chosen, written(_cut(table, masks, have, length, parts), "repeat-cuts")


def digests(docs: DataFrame, length: int = 35, bytes_each: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) per row."""
    same, chosen, cuts = _search(docs.select("doc_id", "text"), length, bytes_each)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, kept = [], []
            for text in batch.column(1):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                n.append(len(words))
                kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array([0] * len(n), pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    same = same.select("doc_id", "text").mapInArrow(plain, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    found = cuts.select(F.col("tid").alias("__tid"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
    return same.unionByName(chosen.select("doc_id", "__tid").join(found, "__tid").drop("__tid"))


def remove(docs: DataFrame, length: int = 35, bytes_each: int = 4 << 20) -> DataFrame:
    """The documents with repeated passages cut out of their text; others stay as they are."""
    # Inside, a document is one column, so that its own columns may have any names.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), "text")
    same, chosen, cuts = _search(rows, length, bytes_each)
    found = cuts.select(F.col("tid").alias("__tid"), F.col("n_removed").alias("__removed"), F.col("kept").alias("__kept"))
    text = F.when(F.col("__removed") > 0, F.col("__kept")).otherwise(F.col("__row")["text"])
    changed = chosen.select("__tid", "__row").join(found, "__tid").select(F.col("__row").withField("text", text).alias("__row"))
    return same.select("__row").unionByName(changed).select("__row.*")
