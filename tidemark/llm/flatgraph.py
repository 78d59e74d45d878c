"""Near-duplicate embeddings by a flat, robustly pruned neighbour graph.

Vectors are compared within one label and one dimension. Equal vectors are one class with
a number of copies. Large labels are split into overlapping cluster shards: centroids are
fitted on a bounded sample, and every class joins its ``overlap`` nearest. In each shard
every class gets neighbours by robust pruning (a candidate goes if a chosen neighbour is
clearly nearer to it); the lists of a class from all its shards are united. Each class is
then searched for in each of its shards: a greedy beam search from the shard's medoid,
expanded through all neighbours within range until none is new. Pairs are verified by
cosine in double precision. Each shard audits its recall on a sample of its queries
against brute force, widens the beam where it falls short and then compares outright;
shards too dense for the graph (over MOST classes, which clustering could not split)
are compared outright in strips. Links between classes that share no shard are beyond that,
so the whole result is audited too: some QUERIES classes against all others of their label,
and everything is done again with twice the overlap while recall is under LEAST_AUDIT.

A pair in several shards counts in the first of them. Vectors that are null, empty, zero or
hold null or non-finite components, and rows without label or id, link with nothing. Repeated
rows are vectors of their own (cosine 1 with their copies). Empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import graph, sample
from tidemark.llm.scratch import written

#: Sample for the centroids, classes aimed at in a shard before overlap, and most of a shard's graph.
SAMPLE, TARGET, MOST = 20_000, 400, 6_000
#: Classes that the whole result is audited with, the recall it must have, and how often it is done again.
QUERIES, LEAST_AUDIT, AGAIN = 512, 0.98, 2
DEGREE, CANDIDATES, SLACK, BEAM, LEAST_RECALL = 24, 64, 1.2, 32, 0.9995


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centroids of unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, 1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    return c


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def prune(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, slack: float = SLACK) -> np.ndarray:
    """Neighbours of every row (padded with -1): nearest first, dropping what a chosen one is nearer to."""
    m = len(x)
    k = min(candidates, m - 1)
    out = np.full((m, degree), -1, np.int32)
    if k < 1:
        return out
    for lo in range(0, m, 256):
        rows = np.arange(lo, min(m, lo + 256))
        s = x[rows] @ x.T
        s[np.arange(len(rows)), rows] = -np.inf
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        sim = np.take_along_axis(s, near, 1)
        order = np.argsort(-sim, axis=1)
        near, sim = np.take_along_axis(near, order, 1), np.take_along_axis(sim, order, 1)
        far = np.sqrt(np.maximum(2 - 2 * sim, 0))
        alive = np.ones(near.shape, bool)
        at = np.arange(len(rows))
        for d in range(degree):
            some = alive.any(1)
            if not some.any():
                break
            pick = np.argmax(alive, 1)
            out[rows[some], d] = near[at, pick][some]
            alive[at, pick] = False
            to = x[near] @ x[near[at, pick]][:, :, None]
            between = np.sqrt(np.maximum(2 - 2 * to[:, :, 0], 0))
            alive &= ~(slack * between <= far) | ~some[:, None]
    return out


def greedy(x: np.ndarray, nbr: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search on the graph for rows ``queries`` of x: ids and similarities (padded with -1)."""
    all_ids, all_sims = [], []
    for lo in range(0, len(queries), 256):
        q = queries[lo : lo + 256]
        at = np.arange(len(q))
        ids = np.full((len(q), beam), -1, np.int64)
        sims = np.full((len(q), beam), -np.inf)
        done = np.zeros(ids.shape, bool)
        ids[:, 0], sims[:, 0] = start, x[q] @ x[start]
        while True:
            open_ = np.where(done | (ids < 0), -np.inf, sims)
            best = np.argmax(open_, 1)
            live = np.isfinite(open_[at, best])
            if not live.any():
                break
            done[at, best] = True
            cand = np.where(live[:, None], nbr[np.maximum(ids[at, best], 0)], -1)
            sim = np.einsum("qrd,qd->qr", x[np.maximum(cand, 0)], x[q])
            seen = (cand[:, :, None] == ids[:, None, :]).any(2) | (cand < 0)
            both_i, both_s = np.concatenate([ids, cand], 1), np.concatenate([sims, np.where(seen, -np.inf, sim)], 1)
            both_d = np.concatenate([done, seen], 1)
            top = np.argpartition(-both_s, beam - 1, axis=1)[:, :beam]
            ids, sims, done = (np.take_along_axis(v, top, 1) for v in (both_i, both_s, both_d))
            ids = np.where(np.isfinite(sims), ids, -1)
        all_ids.append(ids)
        all_sims.append(sims)
    return np.concatenate(all_ids), np.concatenate(all_sims)


def expand(x: np.ndarray, nbr: np.ndarray, ids: np.ndarray, sims: np.ndarray, least: float) -> np.ndarray:
    """Pairs within range, growing from the beams through neighbours of what is in range (m x m)."""
    m = len(x)
    found, seen = np.zeros((m, m), bool), np.zeros((m, m), bool)
    q, k = np.nonzero(ids >= 0)
    seen[q, ids[q, k]] = True
    q, k = np.nonzero((sims >= least) & (ids >= 0))
    front = (q, ids[q, k])
    found[front] = True
    while len(front[0]):
        grown: list[tuple[np.ndarray, np.ndarray]] = []
        for lo in range(0, len(front[0]), 20_000):
            a, b = (v[lo : lo + 20_000] for v in front)
            nb = nbr[b]
            r, c = np.nonzero(nb >= 0)
            code = np.unique(a[r].astype(np.int64) * m + nb[r, c])
            a, b = code // m, code % m
            new = ~seen[a, b]
            a, b = a[new], b[new]
            seen[a, b] = True
            for at in range(0, len(a), 50_000):
                s = slice(at, at + 50_000)
                ok = np.einsum("nd,nd->n", x[a[s]], x[b[s]]) >= least
                grown.append((a[s][ok], b[s][ok]))
        front = tuple(np.concatenate(v) for v in zip(*grown)) if grown else (np.zeros(0, np.int64),) * 2
        found[front] = True
    return found


def pairs_in_shard(x: np.ndarray, nbr: np.ndarray, least: float, audit: int = 256) -> tuple[np.ndarray, float]:
    """Linked pairs (m x m, symmetric, without the diagonal) and the audited recall."""
    m = len(x)
    start = int(np.argmax(x @ x.mean(0)))
    sample = np.linspace(0, m - 1, min(m, audit)).astype(np.int64)
    truth = x[sample] @ x.T >= least
    recall = 1.0
    for beam in (BEAM, 2 * BEAM, 4 * BEAM):
        found = expand(x, nbr, *greedy(x, nbr, start, np.arange(m), min(beam, m)), least)
        found |= found.T
        np.fill_diagonal(found, True)
        recall = (found[sample] & truth).sum() / truth.sum()
        if recall >= LEAST_RECALL:
            break
    else:
        for lo in range(0, m, 512):
            found[lo : lo + 512] = x[lo : lo + 512] @ x.T >= least
    for lo in range(0, m, 512):  # verification
        a, b = np.nonzero(found[lo : lo + 512])
        for at in range(0, len(a), 50_000):
            i, j = a[at : at + 50_000] + lo, b[at : at + 50_000]
            found[i, j] = np.einsum("nd,nd->n", x[i], x[j]) >= least
    found &= found.T
    np.fill_diagonal(found, False)
    return found, recall


def _first_common(cells: np.ndarray, here: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether ``here`` is the least cell that rows i and j share."""
    a, b = cells[i], cells[j]
    common = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)
    return ~(common & (a[:, :, None] < here)).any((1, 2))


def _grouped(run: Callable[[pa.Table], pa.RecordBatch]) -> Callable:
    """Runs over consecutive rows of equal gid (column 0), one shard at a time."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            gid = np.array(batch.column(0))
            cut = [0, *(np.flatnonzero(gid[1:] != gid[:-1]) + 1).tolist(), len(gid)]
            for lo, hi in zip(cut[:-1], cut[1:]):
                if hi > lo:
                    if gid[lo] != now:
                        if held:
                            yield run(pa.Table.from_batches(held).combine_chunks())
                        now, held = gid[lo], []
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield run(pa.Table.from_batches(held).combine_chunks())

    return each


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks)


def _build(t: pa.Table) -> pa.RecordBatch:
    """Pruned neighbour lists of one shard: cid, list (class ids packed)."""
    cid = t.column("cid").to_numpy()
    if len(cid) > MOST:
        nbr = np.full((len(cid), 1), -1)
    else:
        nbr = prune(_vectors(_column(t, "embedding"), t.column("dim")[0].as_py()))
    lists = [cid[row[row >= 0]].tobytes() for row in nbr]
    return pa.RecordBatch.from_arrays([pa.array(cid), pa.array(lists, pa.binary())], ["cid", "list"])


def _search(least: float) -> Callable[[pa.Table], pa.RecordBatch]:
    def run(t: pa.Table) -> pa.RecordBatch:
        """Per class of a shard: linked copies counted here, and the least class of its component."""
        cid, copies, here = t.column("cid").to_numpy(), t.column("copies").to_numpy(), t.column("cell")[0].as_py()
        x = _vectors(_column(t, "embedding"), t.column("dim")[0].as_py())
        width = max(len(c) for c in t.column("cells").to_pylist())
        cells = np.array([list(c) + [-1] * (width - len(c)) for c in t.column("cells").to_pylist()], np.int64)
        m = len(cid)
        links, root, recall = np.zeros(m, np.int64), np.arange(m), 1.0
        if m > MOST:
            strips = [(lo, min(lo + 512, m)) for lo in range(0, m, 512)]
            block = lambda lo, hi: x[lo:hi] @ x.T >= least
        else:
            place = {c: i for i, c in enumerate(cid.tolist())}
            lists = [[place[c] for part in ls for c in np.frombuffer(part, np.int64).tolist() if c in place] for ls in t.column("lists").to_pylist()]
            lists = [list(dict.fromkeys(ls)) for ls in lists]
            nbr = np.full((m, max(1, max(map(len, lists)))), -1, np.int64)
            for i, ls in enumerate(lists):
                nbr[i, : len(ls)] = ls
            found, recall = pairs_in_shard(x, nbr, least)
            strips = [(lo, min(lo + 512, m)) for lo in range(0, m, 512)]
            block = lambda lo, hi: found[lo:hi]
        first = True
        while True:
            before = root.copy()
            for lo, hi in strips:
                hit = block(lo, hi)
                i, j = np.nonzero(hit)
                i = i + lo
                i, j = i[i != j], j[i != j]
                if first:
                    mine = _first_common(cells, here, i, j)
                    links += np.bincount(i[mine], weights=copies[j[mine]], minlength=m).astype(np.int64)
                np.minimum.at(root, i, root[j])
            root = root[root]
            first = False
            if (root == before).all():
                break
        return pa.RecordBatch.from_arrays([pa.array(cid), pa.array(links), pa.array(cid[root]), pa.array(np.full(m, recall))], ["cid", "links", "root", "recall"])

    return run


def _centroids(classes: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Unit centroids of each large (label, dimension), from a bounded sample."""
    large = classes.groupBy("label", "dim").count().filter(F.col("count") > TARGET).collect()
    if not large:
        return {}
    total = sum(r["count"] for r in large)
    grains = 1 << 20
    some = classes.filter(F.pmod(F.xxhash64(F.lit("centroid"), "cid"), F.lit(grains)) < int(grains * min(1.0, SAMPLE / total)))
    keys = classes.sparkSession.createDataFrame([(r.label, r.dim) for r in large], "label int, dim int")
    rows = some.join(F.broadcast(keys), ["label", "dim"]).select("label", "dim", "cid", "embedding").collect()  # about SAMPLE rows
    out = {}
    for r in large:
        x = np.array([v.embedding for v in sorted((v for v in rows if (v.label, v.dim) == (r.label, r.dim)), key=lambda v: v.cid)], np.float64).reshape(-1, r.dim)
        k = min(-(-r["count"] // TARGET), len(x) // 4)  # beyond the sample's reach shards grow instead
        if k > 1:
            out[r.label, r.dim] = kmeans(x / np.linalg.norm(x, axis=1, keepdims=True), k)
    return out


def _assign(classes: DataFrame, centroids: dict, overlap: int) -> DataFrame:
    """One row per class and shard: cell, cells (all of the class), and the class."""
    shared = classes.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, dim = np.array(batch.column(1)), np.array(batch.column(2))
            cells: list = [[0]] * batch.num_rows
            for a, b in set(zip(label.tolist(), dim.tolist())):
                c = shared.value.get((a, b))
                if c is not None:
                    at = np.flatnonzero((label == a) & (dim == b))
                    x = _vectors(batch.column(4).take(pa.array(at)), b)
                    near = np.sort(np.argsort(-(x @ c.T), axis=1)[:, :overlap], axis=1)
                    for i, row in zip(at.tolist(), near.tolist()):
                        cells[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    rows = classes.select("cid", "label", "dim", "copies", "embedding").mapInArrow(run, "cid long, label int, dim int, copies long, embedding array<float>, cells array<int>")
    return rows.withColumn("cell", F.explode("cells")).withColumn("gid", F.xxhash64("label", "dim", "cell"))


def _found(classes: DataFrame, centroids: dict, overlap: int, least: float) -> DataFrame:
    """cid, links, root, recall of each class in each of its shards."""
    members = written(_assign(classes, centroids, overlap), "flat-members")
    dealt = lambda df: df.repartition("gid").sortWithinPartitions("gid", "cid")
    lists = dealt(members.select("gid", "cid", "dim", "embedding")).mapInArrow(_grouped(_build), "cid long, list binary")
    united = lists.groupBy("cid").agg(F.collect_list("list").alias("lists"))  # at most ``overlap`` short lists
    ready = members.select("gid", "cid", "dim", "copies", "cell", "cells", "embedding").join(united, "cid").select("gid", "cid", "dim", "copies", "cell", "cells", "lists", "embedding")
    return dealt(ready).mapInArrow(_grouped(_search(least)), "cid long, links long, root long, recall double")


def recall(classes: DataFrame, found: DataFrame, least: float) -> float:
    """The share of the links of at most about QUERIES classes that was found, by brute force against all classes."""
    asked = sample.bounded(classes.select("cid", "label", "dim", "embedding"), QUERIES, "cid").collect()
    by_kind: dict[tuple[int, int], list] = {}
    for q in asked:
        by_kind.setdefault((q.label, q.dim), []).append(q)
    unit = {k: (np.array([q.cid for q in v]), np.array([q.embedding for q in v], np.float64)) for k, v in by_kind.items()}
    shared = classes.sparkSession.sparkContext.broadcast({k: (c, x / np.linalg.norm(x, axis=1, keepdims=True)) for k, (c, x) in unit.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, dim, copies = (np.array(batch.column(k)) for k in (1, 2, 3))
            for (a, b), (cid, q) in shared.value.items():
                at = np.flatnonzero((label == a) & (dim == b))
                if len(at):
                    near = _vectors(batch.column(4).take(pa.array(at)), b) @ q.T >= least
                    near &= np.array(batch.column(0))[at][:, None] != cid[None]
                    n = copies[at] @ near
                    yield pa.RecordBatch.from_arrays([pa.array(cid[n > 0]), pa.array(n[n > 0])], ["cid", "n"])

    near = classes.select("cid", "label", "dim", "copies", "embedding").mapInArrow(run, "cid long, n long").groupBy("cid").agg(F.sum("n").alias("n"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    both = near.join(links, "cid").agg(F.sum(F.least("n", "links")).alias("got"), F.sum("n").alias("all")).first()
    return both["got"] / both["all"] if both["all"] else 1.0


def link(vectors: DataFrame, least: float = 0.98, overlap: int = 3) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", "embedding", "label")
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("ok", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & sound, F.lit(False)))
    good = rows.filter("ok").withColumns({"dim": F.size("embedding"), "cid": F.xxhash64("label", "embedding")})
    classes = good.groupBy("label", "dim", "embedding", "cid").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes, "flat-classes")
    centroids, found = _centroids(classes), None
    for again in range(AGAIN + 1):
        found = written(_found(classes, centroids, overlap << again, least), "flat-links")
        got = recall(classes, found, least) if centroids else 1.0  # without several shards a label there is nothing between them
        logging.getLogger(__name__).info("recall %.4f at overlap %d", got, overlap << again)
        if got >= LEAST_AUDIT:
            break
    comp = graph.components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    placed = classes.select("cid", "rep", "copies").join(comp.select(F.col("node").alias("cid"), "component"), "cid").join(links, "cid")
    lowest = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = placed.join(lowest, "component").select("cid", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = good.select("vec_id", "cid").join(by_class, "cid").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

