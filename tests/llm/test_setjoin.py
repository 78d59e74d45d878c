import random
from dataclasses import replace

import numpy as np
import pytest

from brute import jaccard_groups
from tidemark.llm import graph, setjoin


def _rows():
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(1, 70))) for _ in range(12)]
    rows = []
    for i in range(160):
        w = rng.choice(base).split()
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
            w[rng.randrange(len(w))] = rng.choice("ABCXYZ")
        rows.append((i, " ".join(w)))
    return rows + [(501, None), (502, ""), (503, " \n"), (504, rows[3][1].upper()), (7, rows[7][1])]


@pytest.mark.parametrize("shingle,num,den", [(1, 8, 10), (3, 90, 100)])
def test_equals_brute_force(docs, shingle, num, den):
    rows = _rows()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in setjoin.link(docs(rows, tid="x", n=1, cand=2), shingle, setjoin.Share(num, den)).collect())
    assert got == jaccard_groups(rows, shingle, num, den)


def test_value_one_segments_lose_nothing(docs, monkeypatch):
    """Whatever the allocation, as long as values add up."""
    real = setjoin.plan

    def forced(share, histogram, largest):
        b = real(share, histogram, largest)
        need = b.segments + b.ones
        ones = need // 2
        return replace(b, segments=need - ones, ones=ones)

    monkeypatch.setattr(setjoin, "plan", forced)
    rows = _rows()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in setjoin.link(docs(rows), 2, setjoin.Share(8, 10)).collect())
    assert got == jaccard_groups(rows, 2, 8, 10)


def test_plan_covers_the_difference():
    share = setjoin.Share(4, 5)
    b = setjoin.plan(share, {n: 100 for n in range(1, 400)}, 400)
    assert all(m + d >= (e - 1) * 1 // 4 + 1 and d <= m for m, d, e in zip(b.segments, b.ones, b.end))


@pytest.mark.parametrize("spare,ones", [(0, 0), (3, 0), (20, 0), (5, 4)])
def test_similar_sets_share_an_entry(spare, ones):
    """Whatever is left out: sets at the very threshold, of equal and of unequal sizes."""
    share, rng = setjoin.Share(4, 5), np.random.default_rng(spare)
    sizes = np.array([*range(1, 60), 200])
    b = setjoin.plan(share, {int(n): 50 for n in sizes}, 300)
    need = (b.end - 1) // 4 + 1 + spare
    b = replace(b, segments=need - np.minimum(ones, need // 2), ones=np.minimum(ones, need // 2))
    for n in sizes.tolist():
        for away in range(n // 5 + 1):  # tokens of the first that the second hasn't; the second may add others
            most = next(k for k in range(n, -1, -1) if (n - away) * 5 >= (n + k) * 4)
            for more in {0, most, most // 2}:
                pool = np.unique(rng.integers(0, 2**64, 2 * n + 50, dtype=np.uint64))
                rng.shuffle(pool)
                x, y = np.sort(pool[:n]), np.sort(np.concatenate([pool[away:n], pool[n : n + more]]))
                key, row = setjoin.entries(np.concatenate([x, y]), np.array([len(x), len(y)]), b, share)
                assert set(key[row == 0].tolist()) & set(key[row == 1].tolist()), (n, away, more)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 100, 129, 700, 5000):
        pool = rng.integers(0, 2**64, n + n // 4 + 1, dtype=np.uint64)
        x, y = pool[:n], pool[n // 8 :]
        a, b = setjoin.sketches(np.concatenate([x, y]), np.array([len(x), len(y)]))
        far = setjoin.apart([a, b], [b, a])
        assert far[0] == far[1] <= len(set(x.tolist()) ^ set(y.tolist()))
        assert setjoin.apart([a], [setjoin.folded(a, 32)])[0] == 0


def test_deduplicate(docs):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(5, long), (3, long + " z"), (9, "other words entirely here now then"), (3, long + " z"), (None, long), (8, None), (8, None), (4, "")]
    got = setjoin.deduplicate(docs(rows, stays=1, tid="q", cand=True, component_id=3))
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted([(3, long + " z"), (9, rows[2][1]), (8, ""), (8, ""), (4, "")])
    assert got.columns == ["doc_id", "text", "stays", "tid", "cand", "component_id"]
    assert setjoin.deduplicate(docs([])).count() == 0


def test_deduplicate_keeps_unlinked_texts_of_one_id(docs):
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(5, text("a")), (5, text("b")), (6, text("b") + " z"), (5, text("a")), (None, text("c")), (None, text("c") + " z"), (None, text("c")), (None, text("d")), (None, text("b"))]
    got = [(r.doc_id, r.text) for r in setjoin.deduplicate(docs(rows)).collect()]
    assert sorted(t for i, t in got if i is not None) == [text("a"), text("b")] and all(i in (5, None) for i, _ in got)
    left = sorted(t for i, t in got if i is None)
    assert len(left) == 2 and left[0] in (text("c"), text("c") + " z") and left[1] == text("d")


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (10, 9), (9, 10), (7, 7), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25), (25, 20)], "a long, b long")
    got = {r.node: r.component for r in graph.components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9, 10: 9, 7: 7, **{i: 20 for i in range(20, 26)}}
    assert graph.components(e.limit(0)).count() == 0


def test_long_words_that_differ(docs):
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    rows = [(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits)), (3, "".join("AB"[b] for b in bits)), (4, "x" * 70_000), (5, "x" * 70_001)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in setjoin.link(docs(rows), 3, setjoin.Share(9, 10)).collect())
    assert got == jaccard_groups(rows, 3, 9, 10)
