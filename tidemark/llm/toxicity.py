"""Toxicity by weak supervision.

Words and prefixes of four to six bytes are counted over the training rows, in all and in
those marked toxic. Voters are chosen from them: words and prefixes that occur nearly only in
rows marked toxic, and a seed lexicon, vote for toxic where they fire; those that shun such
rows vote against; all abstain where they don't fire. A row's own mark is one more voter, which
never abstains and may be wrong. A generative label model learns, by expectation maximization,
how often each voter fires on toxic and on clean text, how often the mark is wrong, and, again
and again, which voters fire together given the class; those that do share one vote.

A linear classifier is trained on the posterior labels, with a penalty that leaves it few
features. These are words and prefixes too, but they needn't be voters: it chooses among the
``most_features`` that are most strongly associated with the marks, either way. It scores
every whole text in one narrow pass, a feature counting once in a text.

Only a bounded sample of at most ``most`` training rows is used for fitting. A word here
is a run of letters (A-Z lower-cased, bytes of other scripts kept). Null and empty texts
get the score of a text without any feature. Rows with repeated ids are scored one by
one; for fitting they are reduced to one per id (the least text, the largest mark). Without
training rows, or without toxic ones, any word of the seed lexicon makes a text toxic. Empty
tables give empty results; extra columns are ignored; labels, lang, source and doc_id are
never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import sample, textops
from tidemark.llm.scratch import written

#: A small general lexicon of insults.
SEED_WORDS = ("clown", "disgusting", "dumb", "idiot", "idiotic", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
PREFIXES = (4, 5, 6)
#: Share of toxic rows from which a feature votes for toxic; standard errors from which one counts as associated.
PURE, ASSOCIATED = 0.9, 2.6
#: Weight of a seed word where there is nothing to learn from, the bias to begin with, and the largest one:
#: a text without any feature is never taken for toxic, however few rows there are to learn from.
SEED_WEIGHT, BIAS, MOST_BIAS = 4.0, -2.0, -1.0


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, document) of every word, then of every prefix of each length."""
    w = textops.words(texts, lower=True, separators=textops.NON_LETTERS)
    doc = w.doc
    yield w.hash, doc
    for n in PREFIXES:
        at = np.flatnonzero(w.end - w.start > n)
        yield w.prefixes(at, n), doc[at]


@dataclass
class Table:
    """Sorted feature hashes with a small filter before the search."""

    hashes: np.ndarray

    def __post_init__(self):
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.hashes >> textops.U(48)).astype(np.int64)] = True

    def fired(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(document, feature) pairs that occur, each once."""
        pairs, m = [], max(1, len(self.hashes))
        for h, doc in features(texts):
            at = np.flatnonzero(self.filter[(h >> textops.U(48)).astype(np.int64)])
            k = np.searchsorted(self.hashes, h[at])
            ok = (k < len(self.hashes)) & (self.hashes[np.minimum(k, m - 1)] == h[at]) if len(self.hashes) else np.zeros(len(at), bool)
            pairs.append(doc[at[ok]] * m + k[ok])
        code = np.unique(np.concatenate(pairs))
        return code // m, code % m


def _seeds() -> np.ndarray:
    return np.unique(textops.words(pa.array(SEED_WORDS), lower=True, separators=textops.NON_LETTERS).hash)


@dataclass
class Mined:
    """Features (sorted hashes) and which way each votes: 1 for toxic, -1 against, 0 not at all."""

    hashes: np.ndarray
    vote: np.ndarray


def mine(train: DataFrame, rows: int, toxic_rows: int, most_features: int, most_voters: int) -> Mined:
    """The features most strongly associated with the marks, and the voters among them."""
    support = int(np.clip(toxic_rows // 40, 3, 12))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.chunks(batch, "text"):
                toxic = np.array(part.column(1), np.int64) == 1
                for h, doc in features(part.column(0)):
                    order = np.lexsort((doc, h))
                    h, doc = h[order], doc[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                    h, t = h[new], toxic[doc[new]]
                    u, first = np.unique(h, return_index=True)
                    bad = np.add.reduceat(t.astype(np.int64), first) if len(u) else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(bad), pa.array(np.diff(np.append(first, len(h))))], ["h", "bad", "n"])

    found = train.select("text", "toxic").mapInArrow(run, "h long, bad long, n long").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    share = toxic_rows / rows
    expected = F.col("n") * share
    errors = (F.col("bad") - expected) / F.sqrt(expected * (1 - share) * (1 - F.col("n") / rows) + 1e-9)
    strong = found.filter("n >= 3").withColumn("z", errors).filter(F.abs("z") >= ASSOCIATED).orderBy(F.desc(F.abs("z")), "h").limit(most_features).collect()
    h = np.array([r.h for r in strong], np.int64).view(np.uint64)
    bad, n, z = (np.array([r[c] for r in strong], np.float64) for c in ("bad", "n", "z"))
    vote = np.zeros(len(h), np.int64)
    vote[np.flatnonzero((bad >= support) & (bad >= PURE * n))[:most_voters]] = 1
    vote[np.flatnonzero((z < 0) & (bad <= n * share / 2))[: most_voters // 4]] = -1
    seeds = _seeds()
    vote[np.isin(h, seeds)] = 1
    more = seeds[~np.isin(seeds, h)]
    h, vote = np.concatenate([h, more]), np.concatenate([vote, np.ones(len(more), np.int64)])
    order = np.argsort(h)
    return Mined(h[order], vote[order])


def _shares(fired: np.ndarray, rates: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One over the number of voters that each fires together with (correlation over 0.5) within a class."""
    some = weight > 0.01
    if not fired.shape[1] or not some.any():
        return np.ones(fired.shape[1])
    x, w = fired[some].astype(np.float32) - rates[None, :].astype(np.float32), weight[some].astype(np.float32)
    cov = (x * w[:, None]).T @ x / w.sum()
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
    return 1 / (np.abs(cov / np.outer(sd, sd)) > 0.5).sum(1).clip(1)


def label_model(fired: np.ndarray, vote: np.ndarray, mark: np.ndarray | None = None, rounds: int = 30, every: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each row, and each voter's share of a vote.

    ``fired`` is rows x voters (boolean), ``vote`` each voter's sign, ``mark`` the rows' own
    marks. The rates at which voters fire by class are estimated in each round, their
    dependence within the class that they speak for every few rounds, so that several forms
    of one word don't count as independent witnesses. A voter that stays silent abstains.
    """
    n, m = fired.shape
    x, up = fired.astype(np.float32), vote > 0
    for_, against = fired[:, up].any(1), fired[:, ~up].any(1)
    p = np.where(for_, 0.9, np.where(against, 0.01, 0.05))
    p = p if mark is None else np.where(mark > 0, 0.95, p * 0.5)
    share = np.ones(m)
    for step in range(rounds):
        a, b = (p @ x + 0.5) / (p.sum() + 1), ((1 - p) @ x + 0.5) / (n - p.sum() + 1)
        a, b = np.where(up, np.maximum(a, b), np.minimum(a, b)), np.where(up, np.minimum(a, b), np.maximum(a, b))
        if step % every == 2:
            share[up] = _shares(fired[:, up], a[up], p)
            share[~up] = _shares(fired[:, ~up], b[~up], 1 - p)
        prior = np.clip(p.mean(), 1e-3, 0.5)
        z = np.log(prior / (1 - prior)) + x @ (share * np.log(a / b)).astype(np.float32)
        if mark is None:
            # Rows without a vote for toxic lean on how often toxic rows have one.
            z = z + np.where(for_, 0, np.log(max(p[~for_].sum() / max(p.sum(), 1e-9), 1e-3)))
        else:
            right, wrong = np.clip((p @ mark + 1) / (p.sum() + 2), 0.5, 0.999), np.clip(((1 - p) @ mark + 0.1) / (n - p.sum() + 1), 1e-3, 0.5)
            z = z + np.where(mark > 0, np.log(right / wrong), np.log((1 - right) / (1 - wrong)))
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        done = np.abs(q - p).max() < 1e-6
        p = q
        if done and step > 2 * every:
            break
    return p, share


def classifier(row: np.ndarray, feature: np.ndarray, posterior: np.ndarray, n_features: int, rounds: int = 200, penalty: float = 3e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on posterior labels, most weights 0; (row, feature) pairs occur."""
    n = len(posterior)
    toxic = posterior > 0.5
    importance = np.where(toxic, n / max(2 * toxic.sum(), 1), 1.0)
    importance /= importance.sum()
    w, bias, squares, square = np.zeros(n_features), BIAS, np.full(n_features, 1e-12), 1e-12
    for _ in range(rounds):
        z = np.bincount(row, weights=w[feature], minlength=n) + bias
        wrong = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - posterior) * importance
        slope = np.bincount(feature, weights=wrong[row], minlength=n_features)
        squares += slope * slope
        square += wrong.sum() ** 2
        pace = 0.5 / np.sqrt(squares)
        w -= pace * slope
        w = np.sign(w) * np.maximum(np.abs(w) - pace * penalty, 0)
        bias = min(bias - 0.5 / np.sqrt(square) * wrong.sum(), MOST_BIAS)
    return w, bias


@dataclass
class Model:
    table: Table
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        doc, feature = self.table.fired(texts)
        z = np.bincount(doc, weights=self.weights[feature], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, most_features: int = 4096, most_voters: int = 512, folds: int = 5) -> Model:
    """Learn from label rows outside the held-out fold (crc32 of the id modulo ``folds`` is 0)."""
    usable = labels.filter("doc_id is not null and toxic is not null").filter(sample.bucket(F.col("doc_id"), folds) != 0)
    chosen = sample.bounded(usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), most)
    marked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    train = written(marked.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "toxicity-train")
    rows, toxic_rows = train.agg(F.count(F.lit(1)), F.count_if(F.col("toxic") == 1)).first()
    if not toxic_rows:
        seeds = _seeds()
        return Model(Table(seeds), np.full(len(seeds), SEED_WEIGHT), BIAS)
    mined = mine(train, rows, toxic_rows, most_features, most_voters)
    shared = docs.sparkSession.sparkContext.broadcast(Table(mined.hashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.chunks(batch, "text"):
                doc, feature = shared.value.fired(part.column(0))
                each = np.split(feature.astype(np.int16), np.searchsorted(doc, np.arange(1, part.num_rows)))
                yield pa.RecordBatch.from_arrays([pa.array([f.tobytes() for f in each], pa.binary()), part.column(1)], ["features", "toxic"])

    found = train.select("text", "toxic").mapInArrow(run, "features binary, toxic int").collect()  # at most about ``most`` rows, packed
    lists = [np.frombuffer(r.features, np.int16) for r in found]
    row, feature = np.repeat(np.arange(len(lists)), list(map(len, lists))), np.concatenate(lists).astype(np.int64)
    voters = np.flatnonzero(mined.vote)
    place = np.full(len(mined.hashes), -1)
    place[voters] = np.arange(len(voters))
    fired = np.zeros((len(lists), len(voters)), bool)
    cast = place[feature] >= 0
    fired[row[cast], place[feature[cast]]] = True
    posterior, _ = label_model(fired, mined.vote[voters], np.array([float(r.toxic == 1) for r in found]))
    weights, bias = classifier(row, feature, posterior, len(mined.hashes))
    used = np.flatnonzero(weights)
    return Model(Table(mined.hashes[used]), weights[used], bias)


def score(docs: DataFrame, model: Model, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; narrow."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(part.column(1)))], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double").withColumn("held_out", sample.bucket(F.col("doc_id"), folds) == 0)
    return out.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, below: float = 0.5) -> DataFrame:
    """The documents with a lower score, columns as they are; narrow."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.chunks(batch, "text"):
                yield part.filter(pa.array(shared.value.score(part.column(at)) < below))

    return docs.mapInArrow(run, docs.schema)
