"""Exact Jaccard self-join of word-shingle sets by universe partition and pigeonhole.

Sets are grouped into bands by size. In a band two sets with Jaccard similarity of at
least ``share`` differ in at most H tokens. The token universe is hashed into m segments;
a set's tokens in a segment are one subset. A segment of value 0 is indexed by its subset
alone and must be equal in both sets, a segment of value 1 also by its subsets with one
token deleted and may differ by one. If the sum of (value + 1) over segments exceeds H, two
similar sets agree on some segment. If it exceeds H by more, by e + 1, they agree on a
segment of value 1 or on e + 1 of value 0, so each set may leave out the e segments of value
0 that come first in an order of all subsets: the smallest ones, which say least (the last
of the common ones in that order is left out by neither set). How many segments there are
and which get which value is decided per band by estimated cost: entries sent, and pairs
that meet by chance.

Sets that share an index entry are a bucket. Buckets are merged in rounds, so that a large
group of near copies is never expanded into all its pairs: first every member is compared
with the nearest of the least members of its buckets; then, in buckets that still hold
several components, with its nearest member of another component; and at last all pairs
across the components that are left. Nearness is that of parity sketches, whose difference
bounds the sets' difference from below; they grow with the set. Pairs that a sketch allows
are verified on the texts, dealt by the end with more pairs, in blocks.

Equal sets are one class and travel once per task. Words are lower-cased in A-Z; a text
with fewer words than a shingle has its whole sequence as one shingle; null texts and texts
without words have no set and link with nothing. Repeated rows are separate documents of
one class. Empty tables give empty results; extra columns pass through `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import exchange, graph, idfilter, textops
from tidemark.llm.scratch import parts_for, written

U = textops.U
#: Bits of the smallest sketch; others have the next power of two from twice the set's size on.
SKETCH_BITS = 256
_SUB, _SECOND = U(0x8CB92BA72F3D8DD7), U(0xE7037ED1A0B428DB)
#: Relative costs: an index entry sent, and a chance pair looked at.
ENTRY_COST, PAIR_COST = 1.0, 0.25
#: Assumed chance that subsets of one token of two unlike sets are equal (common phrases).
COMMON = 1e-4
#: Second members of pairs that are verified together.
BLOCK = 1000
#: One in so many buckets takes part in the first round.
FIRST_ROUND = 4
#: Members of a bucket that travel as one value.
PIECE = 1 << 16
#: Words of sketches that are compared at once.
STRIP = 1 << 21


@dataclass(frozen=True)
class Share:
    """A similarity threshold as the fraction num / den."""

    num: int
    den: int

    def most_difference(self, total: int | np.ndarray):
        """Largest symmetric difference of two sets whose sizes add up to ``total``."""
        return total * (self.den - self.num) // (self.den + self.num)

    def least_partner(self, n: np.ndarray) -> np.ndarray:
        return -(-n * self.num // self.den)


@dataclass
class Bands:
    """Size bands from ``start[b]`` to below ``end[b]``; segments and how many of them have value 1."""

    start: np.ndarray
    end: np.ndarray
    segments: np.ndarray
    ones: np.ndarray

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, n, side="right") - 1


def _above(mean: np.ndarray, spread: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """By how much a normal variable exceeds a limit on average."""
    spread = np.maximum(spread, 1e-9)
    k = (limit - mean) / spread
    density = np.exp(-k * k / 2) / np.sqrt(2 * np.pi)
    beyond = 0.5 * np.exp(-np.maximum(k, 0) * 0.8 - np.maximum(k, 0) ** 2 / 2)  # about 1 - Phi(k)
    return np.maximum(spread * (density - k * np.where(k < 0, 1 - 0.5 * np.exp(k * 0.8 - k * k / 2), beyond)), 0)


def plan(share: Share, histogram: dict[int, int], largest: int) -> Bands:
    """Cost-based allocation per band; ``histogram`` has the number of sets by size (rounded)."""
    start, ratio = [1], (share.den / share.num) ** 2
    while start[-1] <= largest:
        start.append(max(start[-1] + 1, int(start[-1] * ratio) + 1))
    sizes = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[int(n)] for n in sizes], np.float64)
    segments, ones = [], []
    for lo, hi in zip(start[:-1], start[1:]):
        most = (hi - 1) * (share.den - share.num) // share.num  # difference, by the smaller set
        inside = (sizes >= lo) & (sizes <= -(-hi * share.den // share.num))
        n, c = sizes[inside], counts[inside]
        own = np.minimum(n * (share.den - share.num) // share.num, most)
        best = None
        for spare in sorted({-(-(most + 1) * f // 100) for f in (0, 5, 10, 15, 20, 30, 40, 60, 100)}):
            for d in sorted({(most + 1 + spare) * f // 100 for f in (0, 5, 10, 20, 30, 40, 50)}):  # d segments of value 1 save d segments
                m = most + 1 + spare - d
                plain, each = m - d, n / m
                skip = np.minimum(m + d - 1 - own, plain)
                none, single = np.exp(-each), each * np.exp(-each)
                empty = _above(plain * none, np.sqrt(plain * none * (1 - none)), skip)
                small = _above(plain * (none + single), np.sqrt(plain * (none + single) * (1 - none - single).clip(0)), skip)
                chance = ((c * empty).sum() ** 2 + COMMON * (c * small).sum() ** 2) / max(plain, 1) + d * (c * (none + single)).sum() ** 2
                cost = ENTRY_COST * (c * (plain - skip + d * (1 + each))).sum() + PAIR_COST * chance
                if best is None or cost < best[0]:
                    best = (cost, m, d)
        segments.append(best[1])
        ones.append(best[2])
    if not segments:
        start, segments, ones = [1, 2], [1], [0]
    return Bands(np.array(start[:-1], np.int64), np.array(start[1:], np.int64), np.array(segments, np.int64), np.array(ones, np.int64))


def entries(sets: np.ndarray, sizes: np.ndarray, bands: Bands, share: Share) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of all index entries of some sets: of the set's own band and of smaller partners' bands."""
    part = textops.mix(sets ^ _SUB)
    edge = np.concatenate([[0], np.cumsum(sizes)])
    own, least = bands.of(np.maximum(sizes, 1)), bands.of(np.maximum(share.least_partner(sizes), 1))
    keys, rows = [], []
    back = 0
    while True:
        at = np.flatnonzero((sizes > 0) & (own - back >= least))
        if not len(at):
            break
        band = own[at] - back
        m, ones, last = bands.segments[band], bands.ones[band], bands.end[band] - 1
        most = share.most_difference(sizes[at] + last) if back else sizes[at] * (share.den - share.num) // share.num
        skip = np.minimum(m + ones - 1 - np.minimum(most, last * (share.den - share.num) // share.num), m - ones)
        token = np.repeat(edge[at] - np.concatenate([[0], np.cumsum(sizes[at])[:-1]]), sizes[at]) + np.arange(sizes[at].sum())
        which = np.repeat(np.arange(len(at)), sizes[at])
        segment = ((sets[token] >> U(32)) * m[which].astype(U) >> U(32)).astype(np.int64)
        first = np.cumsum(m) - m
        code = first[which] + segment  # rises, as tokens are sorted
        cut = np.searchsorted(code, np.arange(m.sum() + 1))
        mine = np.concatenate([np.zeros(1, U), np.cumsum(part[token])])
        subset = mine[cut[1:]] - mine[cut[:-1]]
        owner = np.repeat(np.arange(len(at)), m)
        index = np.arange(m.sum()) - first[owner]
        place = textops.mix(band[owner].astype(U) * U(1 << 32) + index.astype(U) + U(1))
        key = textops.mix(subset + place)
        plain = np.flatnonzero(index >= ones[owner])
        # The order of subsets: by size, by key, by segment.
        rank = (owner[plain].astype(U) << U(44)) | (np.minimum(np.diff(cut)[plain], 255).astype(U) << U(36)) | (key[plain] >> U(28))
        order = plain[np.argsort(rank, kind="stable")]
        each = m - ones
        taken = order[np.arange(len(order)) - (np.cumsum(each) - each)[owner[order]] >= skip[owner[order]]]
        valued = np.flatnonzero(index < ones[owner])
        for some in (taken, valued):
            keys.append(key[some])
            rows.append(at[owner[some]])
        fuzzy = segment < ones[which]
        if fuzzy.any():
            slot = code[fuzzy]
            keys.append(textops.mix(subset[slot] - part[token[fuzzy]] + place[slot]))
            rows.append(at[which[fuzzy]])
        back += 1
    return (np.concatenate(keys), np.concatenate(rows)) if keys else (np.zeros(0, U), np.zeros(0, np.int64))


def sums(sets: np.ndarray, sizes: np.ndarray, salt: np.uint64) -> np.ndarray:
    """An order-free hash of each set."""
    total = np.concatenate([np.zeros(1, U), np.cumsum(textops.mix(sets ^ salt))])
    edge = np.concatenate([[0], np.cumsum(sizes)])
    return textops.mix(total[edge[1:]] - total[edge[:-1]] + sizes.astype(U))


def sketches(sets: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Parity of the number of tokens at each position, of as many bits as suit each set."""
    out, edge = [], np.concatenate([[0], np.cumsum(sizes)]).tolist()
    for lo, hi in zip(edge[:-1], edge[1:]):
        bits = max(SKETCH_BITS, 1 << (2 * (hi - lo) - 1).bit_length()) if hi > lo else SKETCH_BITS
        at = (sets[lo:hi] & U(bits - 1)).astype(np.int64)
        out.append(np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes())
    return out


def folded(sketch: bytes, size: int) -> bytes:
    """The sketch of ``size`` bytes of the same set."""
    x = np.frombuffer(sketch, np.uint8)
    return np.bitwise_xor.reduce(x.reshape(-1, size), axis=0).tobytes() if len(x) > size else sketch


def apart(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Positions at which sketches differ, pair by pair, each pair at the smaller one's size."""
    size = np.array([min(len(a), len(b)) for a, b in zip(x, y)], np.int64)
    out = np.zeros(len(size), np.int64)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        a, b = (np.frombuffer(b"".join([folded(s[i], n) for i in at.tolist()]), np.uint64).reshape(len(at), -1) for s in (x, y))
        out[at] = np.bitwise_count(a ^ b).sum(1)
    return out


def profiles(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, tid, n, h1, h2) of every row; tid identifies the text, h1 and h2 the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.chunks(batch, "text"):
                sets, sizes = textops.shingle_sets(part.column(2), shingle)
                h = [pa.array(sums(sets, sizes, s).view(np.int64)) for s in (_SUB, _SECOND)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), *h], ["doc_id", "tid", "n", "h1", "h2"])

    return docs.select("doc_id", "tid", "text").mapInArrow(run, "doc_id long, tid long, n long, h1 long, h2 long")


def _sketched(texts: DataFrame, shingle: int) -> DataFrame:
    """(h1, tid, n, sketch) of the texts that stand for classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.chunks(batch, "text"):
                sets, sizes = textops.shingle_sets(part.column(1), shingle)
                yield pa.RecordBatch.from_arrays([pa.array(sums(sets, sizes, _SUB).view(np.int64)), part.column(0), pa.array(sizes, pa.int64()), pa.array(sketches(sets, sizes), pa.binary())], ["h1", "tid", "n", "sketch"])

    return texts.select("tid", "text").mapInArrow(run, "h1 long, tid long, n long, sketch binary")


def _buckets(docs: DataFrame, shingle: int, share: Share, bands: Bands, parts: int) -> DataFrame:
    """(bucket, piece, hub, members): the classes (h1, sorted, as 64-bit values) that share an index entry, PIECE a row."""
    kinds = ["u4", "u8"]  # 32 bits of a key, within a partition: equal ones are looked at anyway

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = exchange.Packer(parts, kinds), set()
        for batch in batches:
            for part in textops.chunks(batch, "text"):
                sets, sizes = textops.shingle_sets(part.column(0), shingle)
                h1 = sums(sets, sizes, _SUB)
                new = np.zeros(len(h1), bool)
                for i, h in enumerate(h1.tolist()):
                    if sizes[i] and h not in seen:
                        seen.add(h)
                        new[i] = True
                sets, sizes, h1 = sets[np.repeat(new, sizes)], sizes[new], h1[new]
                key, row = entries(sets, sizes, bands, share)
                yield from out.add(key, h1[row])
        yield from out.flush()

    def meet(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        order, cut = exchange.groups(*cols)
        key, who = cols[0][order][cut], cols[1][order][cut]  # each (key, class) once
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(edge[1:], len(key))
        total = np.concatenate([np.zeros(1, U), np.cumsum(textops.mix(who))])
        several = ends - edge > 1
        edge, ends = edge[several], ends[several]
        name = textops.mix(total[ends] - total[edge] + (ends - edge).astype(U))
        _, one = np.unique(name, return_index=True)
        rows: list[tuple[int, int, int, bytes]] = []
        for k in one.tolist():
            lo, hi = int(edge[k]), int(ends[k])
            for piece, at in enumerate(range(lo, hi, PIECE)):
                rows.append((int(name[k].view(np.int64)), piece, int(who[lo].view(np.int64)), who[at : min(at + PIECE, hi)].tobytes()))
            if len(rows) >= 4096 or hi - lo > PIECE:
                yield _bucket_rows(rows)
                rows = []
        if rows:
            yield _bucket_rows(rows)

    blobs = docs.select("text").mapInArrow(scan, exchange.BLOB)
    met = exchange.exchange(blobs, parts, kinds, meet, "bucket long, piece int, hub long, members binary")
    return met.groupBy("bucket", "piece").agg(F.first("hub").alias("hub"), F.first("members").alias("members"))


def _bucket_rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bucket", "piece", "hub", "members"])


def _members(buckets: DataFrame) -> DataFrame:
    """(bucket, hub, h1): one row per member; hub is the bucket's least member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(2)]
            n = np.array(list(map(len, lists)), np.int64)
            for lo in range(0, len(lists), 512):
                some = slice(lo, lo + 512)
                cols = [np.repeat(np.array(batch.column(k)[some]), n[some]) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.concatenate(lists[some]))], ["bucket", "hub", "h1"])

    return buckets.select("bucket", "hub", "members").mapInArrow(run, "bucket long, hub long, h1 long")


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b, apart) one for each b: that of the least difference."""
    return pairs.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")


def _likely(pairs: DataFrame, nodes: DataFrame, share: Share) -> DataFrame:
    """Pairs (a, b, apart) of classes whose sizes and sketches allow the similarity."""
    side = nodes.select("h1", "n", "sketch")
    a, b = (side.select(*[F.col(c).alias(f"{c}_{x}") for c in side.columns]) for x in "ab")
    joined = pairs.join(a, pairs.a == F.col("h1_a")).join(b, pairs.b == F.col("h1_b"))
    sized = joined.filter((F.least("n_a", "n_b") * share.den >= F.greatest("n_a", "n_b") * share.num)).select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = apart(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            near = far <= share.most_difference(np.array(batch.column(2)) + np.array(batch.column(3)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).filter(pa.array(near)) for k in range(2)), pa.array(far[near])], ["a", "b", "apart"])

    return sized.mapInArrow(run, "a long, b long, apart long")


def _verify(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, share: Share) -> DataFrame:
    """The pairs (a, b), each given once, whose texts' sets reach the similarity, by exact counting.

    Pairs are dealt out by their end with more pairs, and those of one such end by the other
    end in blocks of about BLOCK: a block has the text of the one end once, and goes through
    those of the others one by one.
    """
    many = pairs.select(F.explode(F.array("a", "b")).alias("h1")).groupBy("h1").agg(F.count(F.lit(1)).alias("many"))
    many = many.join(nodes.select("h1", "tid"), "h1")
    named = pairs
    for x in "ab":
        named = named.join(many.select(F.col("h1").alias(x), F.struct("many", F.col("h1").alias("h"), "tid").alias(f"x{x}")), x)
    ends = named.select(F.greatest("xa", "xb").alias("p"), F.least("xa", "xb").alias("q"))
    dealt = ends.select(F.col("p.h").alias("a"), F.pmod(F.xxhash64("q.h"), F.ceil(F.col("p.many") / BLOCK)).alias("part"), F.col("p.tid").alias("tid_a"), F.col("q.h").alias("b"), F.col("q.tid").alias("tid_b"))
    dealt = written(dealt, "setjoin-dealt")
    heads = dealt.select("a", "part", F.lit(None).cast("long").alias("b"), F.col("tid_a").alias("tid")).distinct()
    wanted = heads.unionByName(dealt.select("a", "part", "b", F.col("tid_b").alias("tid")))
    found = idfilter.flagged(texts, wanted.select("tid"), "tid").filter("__cand").select("tid", "text").join(wanted, "tid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The text of the common end comes first in each block."""
        now, head = None, None
        for batch in batches:
            good = []
            for part in textops.chunks(batch, "text"):
                tokens, n = textops.shingle_sets(part.column(3), shingle)
                edge = np.concatenate([[0], np.cumsum(n)]).tolist()
                for k, (a, p, b) in enumerate(zip(*(part.column(c).to_pylist() for c in range(3)))):
                    mine = tokens[edge[k] : edge[k + 1]]
                    if b is None:
                        now, head = (a, p), mine.copy()
                        continue
                    if now != (a, p):
                        raise RuntimeError("a block without its common end")
                    both = len(np.intersect1d(head, mine, assume_unique=True))
                    if both and both * share.den >= (len(head) + len(mine) - both) * share.num:
                        good.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], pa.int64()) for k in range(2)], ["a", "b"])

    blocks = found.select("a", "part", "b", "text").repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return blocks.mapInArrow(run, "a long, b long")


def _open(members: DataFrame, comp: DataFrame, nodes: DataFrame) -> DataFrame:
    """The members (bucket, h1, component, n, sketch) of the buckets that still hold several components."""
    known = nodes.join(comp.select(F.col("node").alias("h1"), "component"), "h1", "left").withColumn("component", F.coalesce("component", "h1"))
    placed = members.select("bucket", "h1").join(known.select("h1", "component"), "h1")
    several = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    return placed.join(written(several.select("bucket"), "setjoin-open"), "bucket", "left_semi").join(nodes.select("h1", "n", "sketch"), "h1")


def _across(members: DataFrame, parts: int, share: Share, nearest: bool) -> DataFrame:
    """Pairs (a, b, apart) across components within each bucket whose sketches allow the similarity.

    All of them, a before b, or for each member b the ``nearest`` a. ``members`` has bucket, h1,
    component, n, sketch; a bucket is compared in strips, so memory follows its members and
    not their pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            bucket = np.array(batch.column(0))
            cut = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            for lo, hi in zip(cut[:-1], cut[1:]):
                if hi > lo:
                    if bucket[lo] != now:
                        yield from compare(held)
                        now, held = bucket[lo], []
                    held.append(batch.slice(lo, hi - lo))
        yield from compare(held)

    def compare(held) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        who, comp, n = (np.concatenate([np.array(b.column(k)) for b in held]) for k in (1, 2, 3))
        sketch = [x for b in held for x in b.column(4).to_pylist()]
        size = min(map(len, sketch))
        bits = np.frombuffer(b"".join([folded(x, size) for x in sketch]), np.uint64).reshape(len(who), -1)
        step = max(1, STRIP // bits.size)
        for lo in range(0, len(who), step):
            rows, cols = slice(lo, lo + step), slice(0 if nearest else lo, None)
            far = np.bitwise_count(bits[rows, None, :] ^ bits[None, cols, :]).sum(2, dtype=np.int32)
            x, y = n[rows, None], n[None, cols]
            ok = (comp[rows, None] != comp[None, cols]) & (far <= share.most_difference(x + y)) & (np.minimum(x, y) * share.den >= np.maximum(x, y) * share.num)
            if nearest:
                j = np.where(ok, far, np.iinfo(np.int32).max).argmin(1)
                i = np.flatnonzero(ok[np.arange(len(ok)), j])
                a, b, d = who[j[i]], who[lo + i], far[i, j[i]]
            else:
                i, j = np.nonzero(ok)
                a, b, d = np.minimum(who[lo + i], who[lo + j]), np.maximum(who[lo + i], who[lo + j]), far[i, j]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d.astype(np.int64))], ["a", "b", "apart"])

    dealt = members.repartition(parts, "bucket").sortWithinPartitions("bucket", "h1")
    return dealt.select("bucket", "h1", "component", "n", "sketch").mapInArrow(run, "a long, b long, apart long")


def link(docs: DataFrame, shingle: int = 5, share: Share = Share(4, 5), bytes_each: int = 2 << 20) -> DataFrame:
    """doc_id, tid, n_shingles, component_id of every row of ``docs`` (doc_id, text), and its component's own key (null without a set)."""
    parts = parts_for(docs, bytes_each)
    docs = docs.select("doc_id", "text").withColumn("tid", F.xxhash64(F.coalesce("text", F.lit(""))))
    prof = written(profiles(docs, shingle), "setjoin-profiles")
    some = prof.filter("n > 0")
    classes = written(some.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.min("tid").alias("tid")), "setjoin-classes")
    binned = classes.groupBy(F.floor(F.log("n") * 50).alias("bin")).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("c")).collect()
    bands = plan(share, {r.n: r.c for r in binned}, max((r.n for r in binned), default=0))
    buckets = written(_buckets(docs, shingle, share, bands, parts), "setjoin-buckets")
    members = _members(buckets)
    needed = members.select("h1").distinct().join(classes, "h1").select("tid").distinct()
    needed = written(needed, "setjoin-needed")
    flagged = idfilter.flagged(docs, needed, "tid").filter("__cand and text is not null")
    one = flagged.groupBy("tid").agg(F.first("text").alias("text"))  # copies are merged before the shuffle
    texts = written(one.join(needed, "tid", "left_semi"), "setjoin-texts")
    nodes = written(_sketched(texts, shingle), "setjoin-nodes")
    # The first round is there to merge most of a group cheaply, for which some of its buckets will do.
    hubs = _members(buckets.filter(F.pmod("bucket", F.lit(FIRST_ROUND)) == 0)).filter("hub <> h1").select(F.col("hub").alias("a"), F.col("h1").alias("b")).distinct()
    check = lambda pairs: written(_verify(pairs, nodes, texts, shingle, share), "setjoin-edges")
    tried = written(_nearest(_likely(hubs, nodes, share)), "setjoin-pairs")
    comp = written(graph.components(check(tried)), "setjoin-components")
    for nearest in (True, False):
        pairs = _across(_open(members, comp, nodes), parts, share, nearest)
        # A pair that was tried and failed isn't tried again.
        pairs = (_nearest(pairs) if nearest else pairs).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = written(pairs.join(done, ["a", "b"], "left_anti"), "setjoin-pairs")
        if pairs.isEmpty():
            continue
        more = comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(check(pairs))
        comp, tried = written(graph.components(more), "setjoin-components"), tried.unionByName(pairs)
    final = comp
    mapped = classes.select("h1", "h2", "rep").join(final.select(F.col("node").alias("h1"), "component"), "h1", "left").withColumn("component", F.coalesce("component", "h1"))
    lowest = mapped.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = mapped.join(lowest, "component").select("h1", "h2", "component", "component_id")
    linked = some.select("doc_id", "tid", "n", "h1", "h2").join(by_class, ["h1", "h2"]).select("doc_id", "tid", F.col("n").alias("n_shingles"), "component_id", "component")
    alone = prof.filter("n = 0").select("doc_id", "tid", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    return linked.unionByName(alone)


def deduplicate(docs: DataFrame, **how) -> DataFrame:
    """The documents with one left of each component: the one of the least id.

    Of the component's rows with that id, the one with the least text hash stays, once. Rows
    without an id come behind those with one; rows without a set stay. Components of
    different texts under one id are judged apart.
    Rows that surely stay are neither shuffled nor joined.
    """
    found = written(link(docs, **how), "setjoin-links")
    sure = F.col("n_shingles") == 0
    least = F.col("doc_id").eqNullSafe(F.col("component_id"))
    best = found.filter(least & ~sure).groupBy("component").agg(F.min("tid").alias("best"))
    judged = found.filter(~sure).join(best, "component")
    stays = least & (F.col("tid") == F.col("best"))
    marks = judged.groupBy("doc_id", "tid").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("copies")).filter("not stays or copies > 1")
    marks = written(marks.select(F.col("doc_id").alias("__id"), F.col("tid").alias("__mark"), F.col("stays").alias("__stays")), "setjoin-marks")
    # Inside, a document is one column, so that its own columns may have any names.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("__text"))
    keyed = idfilter.flagged(rows, marks.select(F.col("__mark").alias("tid")), "__text")
    away = keyed.filter("__cand").join(marks, F.col("__text").eqNullSafe(F.col("__mark")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    away = written(away.filter("__stays is null or __stays").select("__row", "doc_id", "__stays", "__mark"), "setjoin-maybe")
    once = away.filter("__stays").dropDuplicates(["doc_id", "__mark"]).select("__row")
    return keyed.filter("not __cand").select("__row").unionByName(away.filter("__stays is null").select("__row")).unionByName(once).select("__row.*")
