import numpy as np
import pytest

from tidemark.llm import flatgraph, ring

from brute import DATA


@pytest.mark.parametrize("n,shards", [(0, 5), (3, 5), (200, 40), (431, 7)])
def test_counts_differ_by_one_at_most(spark, n, shards):
    rows = [(i if i % 9 else 0, None if i % 11 == 0 else "é" * (i % 13)) for i in range(n)]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "'x' as key")
    got = ring.shard(table, shards, 16).collect()
    assert len(got) == n and sorted((r.doc_id, r.size) for r in got) == sorted((i, 16 + len((t or "").encode())) for i, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_most_rows_stay_when_a_shard_is_added(spark):
    table = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    a = {r.doc_id: r.shard for r in ring.shard(table, 20).collect()}
    b = {r.doc_id: r.shard for r in ring.shard(table, 21).collect()}
    assert sum(a[i] != b[i] for i in a) < 0.25 * len(a)


def test_no_python_in_the_ring(spark):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        ring.shard(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")).explain()
    assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue()


def _vectors(spark, n=700, dim=16):
    rng = np.random.default_rng(8)
    base = rng.normal(0, 1, (n // 4, dim))
    x = base[rng.integers(0, len(base), n)] + rng.normal(0, 0.08, (n, dim)) * (rng.random((n, 1)) < 0.8)
    rows = [(i, [float(np.float32(v)) for v in x[i]], int(i % 3)) for i in range(n)]
    rows += [(9000, None, 1), (9001, [], 1), (9002, [0.0] * dim, 1), (9003, [float("nan")] * dim, 1), (9004, rows[5][1], None), (None, rows[5][1], 2), (9005, [1.0, None, 2.0], 1), (9006, [float("inf")] * dim, 0)]
    rows.append(rows[5])
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as cid", "2 as component"), rows


@pytest.mark.parametrize("target,most", [(10_000, 6000), (60, 6000), (10_000, 50)])
def test_links_equal_brute_force(spark, monkeypatch, target, most):
    monkeypatch.setattr(flatgraph, "TARGET", target)
    monkeypatch.setattr(flatgraph, "MOST", most)
    table, rows = _vectors(spark)
    got = flatgraph.link(table).collect()
    assert len(got) == len(rows)
    ok = [r for r in rows if r[0] is not None and r[0] < 9000]
    x = np.array([r[1] for r in ok], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in ok])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    want = {}
    for (i, _, _), n in zip(ok, near.sum(1).tolist()):
        want[i] = n
    found = {r.vec_id: r.n_links for r in got if r.vec_id is not None and r.vec_id < 9000}
    assert sum(min(found[i], want[i]) for i in want) >= 0.97 * sum(want.values()) and all(found[i] <= want[i] for i in want)
    if target > 1000:
        assert found == want
    assert all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in got if r.vec_id is not None and r.vec_id >= 9000)
    assert flatgraph.link(table.limit(0)).count() == 0


@pytest.mark.parametrize("overlap", [1, 3])
def test_recall_on_planted_pairs_over_many_shards(spark, caplog, overlap):
    caplog.set_level("INFO")
    rng = np.random.default_rng(31)
    n, dim, least = 1500, 24, 0.98
    x = rng.normal(0, 1, (n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.normal(0, 1, (n, dim))
    off -= (off * x).sum(1, keepdims=True) * x
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cos = rng.uniform(least + 0.0005, 0.9999, (n, 1))
    both = np.concatenate([x, cos * x + np.sqrt(1 - cos**2) * off]).astype(np.float32).astype(np.float64)
    rows = [(i, v.tolist(), i % n % 2) for i, v in enumerate(both)]  # 1,500 a label, of which a shard holds some 400
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    links = {r.vec_id: r.n_links for r in flatgraph.link(table, least, overlap).collect()}
    near = (both @ both.T >= least) & (np.arange(2 * n)[:, None] % n % 2 == np.arange(2 * n)[None] % n % 2)
    np.fill_diagonal(near, False)
    true = near.sum(1)
    assert n // 2 > flatgraph.TARGET and true.sum() >= 2 * n  # there are links to find, in labels of several shards
    assert sum(min(links[i], int(true[i])) for i in range(2 * n)) >= 0.97 * true.sum() and all(links[i] <= true[i] for i in range(2 * n))
    assert sum("at overlap" in m for m in caplog.messages) >= (overlap == 1) + 1  # too small an overlap is noticed


@pytest.mark.parametrize("n,shards,replicas,ranked", [(0, 3, 4, 10), (500, 7, 5, 10), (500, 7, 5, 100_000), (60, 40, 8, 5)])
def test_equals_a_walk(spark, monkeypatch, n, shards, replicas, ranked):
    """Node by node clockwise, what is over a node's quota waits in a line for the next room."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(ring, "RANKED", ranked)
    rows = [(None if i % 3 == 0 else i % 50, "t" * (i % 7)) for i in range(n)]  # a third without an id, many alike
    table = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = sorted((r.node, r.shard, r.cell) for r in ring.nodes(spark, shards, replicas).collect())
    keyed = table.select("doc_id", F.octet_length("text").alias("b"), F.pmod(F.xxhash64(F.lit("key"), F.coalesce(F.col("doc_id").cast("string"), F.lit("\0null"))), F.lit(ring.CELLS)).alias("cell")).collect()
    at = [[] for _ in nodes]
    for r in keyed:
        ahead = [(c, k) for k, _, c in nodes if c >= r.cell]
        cell = min(ahead)[0] if ahead else min(c for _, _, c in nodes)
        at[max(k for k, _, c in nodes if c == cell)].append((r.doc_id, r.b))
    quota = [0] * len(nodes)
    for s in range(shards):
        mine = [k for k, x, _ in nodes if x == s]
        cap, total = n // shards + (s < n % shards), sum(len(at[k]) for k in mine)
        shares = [0] + [cap * (i + 1) // len(mine) if not total else sum(len(at[k]) for k in mine[: i + 1]) * cap // total for i in range(len(mine))]
        for i, k in enumerate(mine):
            quota[k] = shares[i + 1] - shares[i]
    stay = [min(len(a), q) for a, q in zip(at, quota)]
    got, line = [0] * len(nodes), 0
    for _ in range(2):  # twice round: what waits at the end goes on at the start
        for k in range(len(nodes)):
            line += max(0, len(at[k]) - quota[k]) if _ == 0 else 0
            room = quota[k] - stay[k] - got[k]
            got[k], line = got[k] + min(room, line), line - min(room, line)
    by_shard = [sum(stay[k] + got[k] for k, x, _ in nodes if x == s) for s in range(shards)]
    found = ring.shard(table, shards, replicas).collect()
    assert sorted(map(repr, ((r.doc_id, r.size) for r in found))) == sorted(map(repr, ((i, len(t) + 16) for i, t in rows)))
    assert [sum(r.shard == s for r in found) for s in range(shards)] == by_shard
    assert all(sorted(r.slot for r in found if r.shard == s) == list(range(by_shard[s])) for s in range(shards))
    # Rows that stay: of every id at least as many as its node has room for are on that node's shard.
    for k, shard, _ in nodes:
        here = {repr(x) for x in at[k]}
        own = sum(repr((r.doc_id, r.size - 16)) in here and r.shard == shard for r in found)
        assert own >= stay[k]
