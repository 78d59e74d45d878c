import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from brute import words
from tidemark.llm import decontam, gru, importance, toxicity

from brute import DATA


def _held(i, n):
    return i is not None and zlib.crc32(str(i).encode()) % n == 0


def test_base_scores_equal_plain_counting(spark, docs):
    table = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()][:120] + [(5000, None), (5001, ""), (None, "the only one")]
    rows.append(rows[3])
    got = gru.score(docs(rows, tid=1, score="x"), head_words=500, words=200, most_docs=60).collect()
    tokens = [(i, [*words(t), 0]) for i, t in rows]
    c = Counter(w for i, ws in tokens if not _held(i, 10) for w in ws)
    total, distinct = sum(c.values()), len(c)
    want = sorted((i or -1, len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws), 6)) for i, ws in tokens)
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == total and r.held_out == _held(r.doc_id, 10) for r in got)
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert gru.score(docs([])).count() == 0


def test_model_is_a_distribution():
    hashes = np.arange(1, 41, dtype=np.uint64)
    vocab = gru.vocabulary(hashes, np.arange(40, 0, -1), 40, 5)
    model = gru.Model(vocab, 17.0, 8)
    rng = np.random.default_rng(0)
    for v in model.p.values():
        v += rng.normal(0, 0.3, v.shape).astype(np.float32)
    h = rng.normal(0, 1, (3, 8)).astype(np.float32)
    total = sum(np.exp(model.output(h, np.full(3, w))[0]) for w in range(-1, 40))
    assert np.allclose(total, 1, atol=1e-4)


def test_gradients_match_differences():
    vocab = gru.vocabulary(np.arange(1, 13, dtype=np.uint64), np.arange(12, 0, -1), 12, 3)
    model = gru.Model(vocab, 3.0, 4)
    rng = np.random.default_rng(1)
    for k, v in model.p.items():
        model.p[k] = (v + rng.normal(0, 0.3, v.shape)).astype(np.float64)
    h, word = rng.normal(0, 1, (5, 4)), np.array([0, 3, 11, -1, 5])
    g = {k: np.zeros_like(v) for k, v in model.p.items()}
    _, dh = model.output(h, word, g)
    for k in ("cw", "ww"):
        i = (1, 1)
        eps = 1e-5
        model.p[k][i] += eps
        up = model.output(h, word)[0].sum()
        model.p[k][i] -= 2 * eps
        down = model.output(h, word)[0].sum()
        model.p[k][i] += eps
        assert abs(-(up - down) / (2 * eps) - g[k][i]) < 1e-4


def test_recurrent_gradients_match_differences():
    """Through time, gate and candidate, with a document that starts inside the window."""
    vocab = gru.vocabulary(np.arange(1, 13, dtype=np.uint64), np.arange(12, 0, -1), 12, 3)
    model, rng = gru.Model(vocab, 3.0, 4), np.random.default_rng(2)
    for k, v in model.p.items():
        model.p[k] = v + rng.normal(0, 0.3, v.shape).astype(np.float32)
    word = rng.integers(-1, 12, (7, 3))
    inp, going = model.inputs(word, rng.integers(0, gru.ENDINGS, word.shape)), np.ones((7, 3, 1), np.float32)
    going[4, 1] = 0
    real, start = np.ones(21, np.float32), rng.normal(0, 0.5, (3, 4)).astype(np.float32)
    loss = lambda: model._window(inp, word, going, real, start)[1]
    _, _, g, rows = model._window(inp, word, going, real, start)
    x = np.zeros_like(model.p["x"])
    x[rows] = g["x"]
    for key, grad in {**g, "x": x}.items():
        places = list(np.ndindex(grad.shape)) if key != "x" else [(int(r), c) for r in rows[:6] for c in range(8)]
        for i in places[:: max(1, len(places) // 12)]:
            keep, eps = model.p[key][i], 0.02
            model.p[key][i] = keep + eps
            up = loss()
            model.p[key][i] = keep - eps
            down = loss()
            model.p[key][i] = keep
            assert abs((up - down) / (2 * eps) - grad[i]) < 0.02 + 0.03 * abs(grad[i]), (key, i)


def test_score_carries_state_over_windows():
    vocab = gru.vocabulary(np.arange(1, 21, dtype=np.uint64), np.arange(20, 0, -1), 20, 4)
    model = gru.Model(vocab, 3.0, 6)
    rng = np.random.default_rng(2)
    word, bounds = rng.integers(-1, 20, 300), np.array([0, 1, 190, 191, 300])
    ending = rng.integers(0, gru.ENDINGS, 300)
    assert np.allclose(model.score(word, ending, bounds, 7), model.score(word, ending, bounds, 1000), atol=1e-3)


def test_model_learns_from_rows_outside_the_sample(docs):
    rng = np.random.default_rng(21)
    text = lambda: " ".join(f"w{(s + j) % 40:02d}" for s in [int(rng.integers(0, 40))] for j in range(100))
    rows = docs([(i, text()) for i in range(2000)]).repartition(2)
    got = [r for r in gru.score(rows, words=60, classes=8, most_docs=0).collect() if r.held_out]
    gain = sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got)
    assert len(got) > 100 and gain > 0.3  # log10 a token; the words are equally frequent, so counts alone say nothing


def test_vocabulary_comes_from_all_training_tokens(spark, docs):
    table = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()][:120]
    tokens = {i: [*words(t), 0] for i, t in rows}
    c = Counter(w for i, ws in tokens.items() if not _held(i, 10) for w in ws)
    total, distinct, most = sum(c.values()), len(c), 200
    least = sorted(c.values(), reverse=True)[most - 1]
    inside = sum(n for n in c.values() if n > least) + least * (most - sum(n > least for n in c.values()))
    tail = lambda w: math.log10((total - inside) / total * (c[w] + 0.1) / (total - inside + 0.1 * (distinct - most + 1)))
    surely = lambda ws: sum(math.log10(c[w] / total) if c[w] > least else tail(w) for w in ws if c[w] != least)
    for most_docs in (0, 10, 1000):
        got = gru.score(docs(rows), head_words=300, words=most, most_docs=most_docs, rounds=0).collect()
        if most_docs == 0:  # the untrained model says what the counts say; words with the last count may be in or out
            for r in got:
                ties = sum(c[w] == least for w in tokens[r.doc_id])
                either = sorted([math.log10(least / total), tail(next(w for w in c if c[w] == least))])
                rest = r.score - surely(tokens[r.doc_id])
                assert ties * either[0] - 1e-2 <= rest <= ties * either[1] + 1e-2
        assert all(math.isfinite(r.score) for r in got)


def test_hashes_unmix():
    from tidemark.llm import textops

    h = np.random.default_rng(3).integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert (textops.unmix(textops.mix(h)) == h).all()


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(r.toxic, got[r.doc_id].predicted) for r in labels.collect() if _held(r.doc_id, 5)]
    assert len(got) == docs.count() and len(held) > 500
    hit = sum(t == p == 1 for t, p in held)
    assert hit >= 0.88 * sum(t for t, _ in held) and hit >= 0.9 * sum(p for _, p in held)


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [(1, None), (2, ""), (2, ""), (None, "you idiot"), (3, "a fine day")]
    model = toxicity.fit(docs(rows), labels)
    got = toxicity.score(docs(rows, score=1, toxic="t"), model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.keep_clean(docs(rows, score=1), model).columns == ["doc_id", "text", "score"]
    assert toxicity.score(docs([]), model).count() == 0


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.2
    one = (y & (rng.random(4000) < 0.7)) | (rng.random(4000) < 0.01)
    two = (y & (rng.random(4000) < 0.6)) | (rng.random(4000) < 0.01)
    p, share = toxicity.label_model(np.stack([one, one, one, two], 1), np.ones(4))
    assert share[0] < 0.5 and share[3] == 1
    assert ((p > 0.5) == (one | two)).mean() > 0.97


def test_label_model_corrects_marks():
    """Marks are one voter of an accuracy that is estimated; voters against count too."""
    rng = np.random.default_rng(9)
    n = 5000
    y = rng.random(n) < 0.2
    mark = np.where(rng.random(n) < 0.12, ~y, y)
    for_ = [(y & (rng.random(n) < 0.15)) | (rng.random(n) < 0.001) for _ in range(12)]
    against = [(~y & (rng.random(n) < 0.35)) | (y & (rng.random(n) < 0.02)) for _ in range(6)]
    p, _ = toxicity.label_model(np.stack([*for_, *against], 1), np.repeat([1, -1], [12, 6]), mark.astype(float))
    right = lambda guess: (guess == y).mean()
    assert right(mark) < 0.9 < 0.95 < right(p > 0.5)


def test_classifier_knows_words_that_are_no_voters(spark, docs):
    """A word that also occurs in clean texts doesn't vote, but counts."""
    rng = np.random.default_rng(2)
    rows, marks = [], []
    for i in range(900):
        bad = i % 5 == 0
        w = [f"w{x}q" for x in rng.integers(0, 300, 30)]
        w += ["zorkish"] * int(bad and rng.random() < 0.6) + ["blarg"] * int(rng.random() < (0.7 if bad else 0.1)) + ["gentle"] * int(not bad and rng.random() < 0.6)
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(bad)))
    rows += [(5, "zorkish blarg")] * 300  # an id that repeats
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(rows), labels)
    texts = pa.array(["w1q w2q zorkish blarg", "w1q w2q blarg", "w1q w2q", "w1q w2q gentle", "w1q zorkish " + "w2q " * 20_000, None, ""])
    hot, warm, plain, kind, long, null, empty = model.score(texts)
    assert hot > warm > plain > kind and hot > 0.5 > plain and long > 0.5 and null == empty < 0.5


def test_seed_lexicon_alone(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        model = toxicity.fit(docs([(1, "a"), (2, None)]), some)
        assert (model.score(pa.array(["you Idiot!", "a fine day", None])) >= 0.5).tolist() == [True, False, False]


def test_resampling(spark, docs):
    good = [(i, " ".join(["calm", "clear", "prose"][(i + j) % 3] for j in range(12))) for i in range(200)]
    bad = [(1000 + i, " ".join(["!!", "junk", "%%"][(i + j) % 3] for j in range(12))) for i in range(100)]
    target = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    table = docs(good + bad + [(5000, None), (5001, "")], target=3, key="k")
    got = [r.doc_id for r in importance.resample(table, target, 0.5).collect()]
    assert len(got) == 151 and sum(i < 1000 for i in got) >= 148
    assert importance.resample(table, target, 1.0).count() == 302 and importance.resample(table, target, 0.0).count() == 0
    assert importance.resample(docs([]), target, 0.5).count() == 0


def test_resampling_equals_plain_version(spark, docs):
    """Counts, ratios, weights and the sample, from words and pairs one by one."""
    from pyspark.sql import functions as F

    from tidemark.llm import textops

    rng = np.random.default_rng(6)
    buckets, seed, fraction = 64, 7, 0.3
    rows = [(int(i % 70) if i % 11 else None, None if i % 17 == 0 else " ".join(rng.choice(["Red", "green", "blue", "x", "y z"], int(rng.integers(0, 12))))) for i in range(150)]
    target = {i for i in range(0, 70, 3)}
    h = {w: int(textops.words(pa.array([w]), lower=True).hash[0]) for w in ("red", "green", "blue", "x", "y", "z")}
    pair = lambda a, b: int(textops.windows(np.array([h[a], h[b]], np.uint64), np.array([0]), 2)[0]) % buckets

    def grams(text):
        w = [x.decode() for x in words(text)]
        return [h[x] % buckets for x in w] + [pair(a, b) for a, b in zip(w, w[1:])]

    raw, good = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in target:
            good.update(grams(t))
    ratio = [math.log((good[b] + 1) / (sum(good.values()) + buckets)) - math.log((raw[b] + 1) / (sum(raw.values()) + buckets)) for b in range(buckets)]
    weight = [sum((ratio[g] for g in grams(t)), 0.0) for _, t in rows]
    uniform = [r.u for r in docs(rows).select(((F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)) + 0.5) / float(1 << 52)).alias("u")).collect()]
    key = [math.floor((w - math.log(-math.log(u))) * 2**20) for w, u in zip(weight, uniform)]
    border = sorted(key, reverse=True)[round(fraction * len(rows)) - 1]
    want = sorted(repr((i, round(w, 6))) for (i, _), w, k in zip(rows, weight, key) if k >= border)
    labels = spark.createDataFrame([(i,) for i in target], "doc_id long")
    got = importance.resample(docs(rows, target="t", key=1), labels, fraction, buckets=buckets, seed=seed).collect()
    assert sorted(repr((r.doc_id, round(r.log_weight, 6))) for r in got) == want and len(want) >= 45


def test_language_model_on_odd_texts(docs):
    rows = [(i, t) for i, t in enumerate(["a b c", None, "", "w " * 60_000, "u" * 200_000, "\n\t "] * 4)] + [(None, "a b"), (3, "w " * 60_000)]
    got = gru.score(docs(rows, tid=1, kind="k"), words=50, classes=4).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    want = Counter((i, len(words(t)) + 1) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    assert gru.score(docs([])).count() == 0


@pytest.mark.parametrize("k", [1, 7, 30, 99, 500])
def test_top_k_by_radix(spark, k):
    rng = np.random.default_rng(k)
    values = [int(x) for x in rng.integers(-(2**41), 2**41, 99)] + [5] * 3
    got = sorted(r.v for r in importance.top_k(spark.createDataFrame([(v,) for v in values], "v long"), "v", k).collect())
    least = sorted(values, reverse=True)[min(k, len(values)) - 1]
    assert got == sorted(v for v in values if v >= least)


def test_decontamination(spark, docs):
    rng = np.random.default_rng(7)
    text = lambda n: " ".join(f"t{x}" for x in rng.integers(0, 5000, n))
    items = [(i, text(30)) for i in range(20)] + [(20, "six short words stand right here"), (21, None), (22, ""), (23, "tiny one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    broken = items[4][1].split()
    broken[5] = broken[17] = broken[25] = "changed"
    rows = [(1, text(40) + " " + items[3][1].upper().replace("T", "t") + " " + text(5)), (2, " ".join(broken)), (3, text(200)), (4, "so six short words, stand right here!"), (5, None), (6, ""), (7, "tiny one"), (8, text(9))]
    got = {(r.doc_id, r.item_id, r.n_equal) for r in decontam.overlaps(docs(rows, item_id=1), bench).collect()}
    assert got == {(1, 3, 30), (2, 4, 27), (4, 20, 6)}
    assert sorted(r.doc_id for r in decontam.clean(docs(rows, item_id=1), bench).collect()) == [3, 5, 6, 7, 8]
    assert decontam.overlaps(docs(rows), bench.limit(0)).count() == 0 and decontam.clean(docs([]), bench).count() == 0


def test_clean_is_the_same_for_any_number_of_blocks(spark, docs, monkeypatch):
    rng = np.random.default_rng(17)
    text = lambda n: " ".join(f"t{x}" for x in rng.integers(0, 5000, n))
    items = [(i, text(30)) for i in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, items[3][1]), (1, text(50)), (None, items[4][1]), (None, text(50)), (2, items[5][1]), (3, None)]
    table, want = docs(rows, item_id=1), sorted([rows[1], rows[3], rows[5]], key=repr)
    for size in (decontam.BLOCK_BYTES, 1000):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        got = decontam.clean(table, bench)
        assert got.columns == table.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == want


def test_short_items_and_items_without_an_id(spark, docs):
    texts = ["one two three four five six seven eight", "alpha beta gamma delta epsilon zeta eta theta iota", "red orange yellow green blue indigo violet", "a b c d"]
    bench = spark.createDataFrame([(None, texts[0]), ("x", texts[1]), ("7", texts[2]), ("8", texts[3])], "item_id string, text string")
    rows, hit = [], []
    for t in texts:
        w = t.split()
        for gone in ((), *((k,) for k in range(len(w))), (0, len(w) - 1)):
            rows.append((len(rows), "so: " + " ".join("other" if k in gone else x for k, x in enumerate(w)) + "."))
            hit.append(len(w) >= 5 and len(gone) <= (len(w) >= 8))
    found = decontam.overlaps(docs(rows), bench).collect()
    assert {r.doc_id for r in found} == {i for i, h in enumerate(hit) if h} and {r.item_id for r in found} == {None, 7}
    assert {r.doc_id for r in decontam.clean(docs(rows), bench).collect()} == {i for i, h in enumerate(hit) if not h}


def test_masks_hit_every_overlap():
    masks = [(len(m), sum(1 << i for i, c in enumerate(m) if c == "x")) for m in decontam.MASKS]
    for equal in range(10, 20):
        for gaps in range(equal // 3 + 1):
            n = equal + gaps
            gone = np.array([sum(1 << i for i in z) for z in itertools.combinations(range(1, n - 1), gaps)], np.int64)
            kept = (1 << n) - 1 - gone
            hit = np.zeros(len(kept), bool)
            for span, mask in masks:
                for k in range(n - span + 1):
                    hit |= (kept >> k) & mask == mask
            assert hit.all(), (equal, gaps)


def test_substituted_items_are_found():
    rng = np.random.default_rng(12)
    items, texts, want = [], [], []
    for n in (10, 11, 12, 13, 15, 20, 30, 40, 60):
        gone = [np.arange(phase, n, 5) for phase in range(5)] if n >= 15 else []
        gone += [rng.choice(n, int(rng.integers(0, (n - 10) // 2 + 1 if n < 20 else n // 4 + 1)), replace=False) for _ in range(60)]
        for g in gone:
            words = [f"w{x}" for x in rng.integers(0, 10**6, n)]
            items.append(" ".join(words))
            for k in g:
                words[k] = "other"
            texts.append("before it " + " ".join(words) + " and after")
            if n - len(g) >= 10:
                want.append((len(texts) - 1, len(items) - 1))
    found = {(r, i) for r, i, *_ in decontam.search(pa.array(texts), decontam.index(list(range(len(items))), items), 10, 0.75)}
    assert len(want) > 500 and set(want) <= found


def _overlapping(doc, item, least_words, least_share):
    """The most equal words of any stretch of any alignment that is accepted, or 0, by trying all."""
    best = 0
    for shift in range(1 - len(item), len(doc)):
        eq = [doc[i] == item[i - shift] for i in range(max(0, shift), min(len(doc), shift + len(item)))]
        for s in range(len(eq)):
            same = 0
            for e in range(s, len(eq)):
                same += eq[e]
                if same >= (least_words if len(item) >= least_words else len(item) - (len(item) >= 8)) and same >= least_share * (e + 1 - s):
                    best = max(best, same)
    return best


def test_overlaps_equal_brute_force():
    rng = np.random.default_rng(13)
    items, texts = [], []
    patterns = ["1" * 15 + "0" * 12 + "1" * 15, "1" * 20 + "0" * 15 + "1" * 20, "1" * 12 + "0" * 9 + "1" * 12, "1" * 9 + "0" * 9 + "1" * 9, "11110" * 9, "110" * 12, "1" * 5, "1" * 4 + "0", "1" * 9, "1" * 8 + "0"]
    patterns += ["".join(rng.choice(["0", "1"], n, p=[q, 1 - q])) for n in (9, 10, 11, 13, 16, 24, 40, 59) for q in (0.1, 0.2, 0.25, 0.3, 0.4) for _ in range(6)]
    for k, pattern in enumerate(patterns):
        item = [f"w{x}" for x in rng.integers(0, 10**6, len(pattern))]
        items.append(item)
        texts.append(["before", "it", *(w if c == "1" else f"o{k}x{j}" for j, (w, c) in enumerate(zip(item, pattern))), "after"])
    got = {(r, i): same for r, i, _, _, same in decontam.search(pa.array(map(" ".join, texts)), decontam.index(list(range(len(items))), list(map(" ".join, items))), 10, 0.75)}
    want = {(k, k): n for k in range(len(items)) if (n := _overlapping(texts[k], items[k], 10, 0.75))}
    assert got == want and 80 < len(want) < len(items) - 20


def test_hashes_agree_across_chunks():
    from tidemark.llm import textops

    a, b = textops.words(pa.array(["x y", "y x", None, "é  y"])), textops.words(pa.array(["y"]))
    assert a.counts.tolist() == [2, 2, 0, 2]
    assert a.hash[1] == a.hash[2] == a.hash[5] == b.hash[0] and a.hash[0] == a.hash[3] != a.hash[1]
