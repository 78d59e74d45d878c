"""Document log-likelihood under a gated recurrent language model trained in numpy.

Tokens are words (A-Z lower-cased) and one end per document. Two sets of statistics come
from every training document: exact counts of all tokens, and from them the model's
vocabulary (the commonest words of all training tokens), classes and output biases; and
the recurrent, class and word weights, by truncated backpropagation. They start from a fit
on the driver to a sample of at most ``most_docs`` documents. Then every training row is
learned from once: in each of ``rounds`` rounds a replica per partition goes on from the
common weights over its rows of that round, and the replicas are averaged by their tokens.
The weights so depend on how the input is split. The state is carried across windows, in
training and in scoring.

The output is factored: a class given the state, then a word given class and state. The
last class is the tail: all other words, known or not, share it by their counts, so the
model is a distribution over every token, and a document's score is a full log10
probability. Whole texts are scored.

Counts of the sample's commonest words travel as one number per task; other words travel
with their text's id to the partition that counts them, which returns the text's sum, so no
vocabulary is ever broadcast whole. Equal texts of a batch travel once.

Null and empty texts have one token, the end. Rows without an id count as training rows.
Repeated rows are scored each; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import exchange, sample, textops
from tidemark.llm.scratch import parts_for, written

U = textops.U
END = U(0x5851F42D4C957F2D)
#: Buckets of word endings, through which words outside the model's vocabulary enter it.
ENDINGS = 256
#: States whose output is worked out at once, so that it stays in a processor's cache.
ROWS = 8192
#: Tokens that a replica lays out at once and its parallel streams at most; parameters travel in blocks of so many.
LEARN, STREAMS, BLOCK = 1 << 20, 512, 1600


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, textops.Words]:
    """Token hashes of each document with its end, document bounds, and the words."""
    w = textops.words(texts, lower=True)
    bounds = np.concatenate([[0], np.cumsum(w.counts + 1)])
    h = np.full(bounds[-1], END)
    h[np.arange(len(w.hash)) + w.doc] = w.hash
    return h, bounds, w


def endings(w: textops.Words, word: np.ndarray | None = None) -> np.ndarray:
    """Ending buckets of tokens: of all words, or of those that ``word`` (by token) doesn't know; else 0."""
    place = np.arange(len(w.hash)) + w.doc
    at = np.arange(len(place)) if word is None else np.flatnonzero(word[place] < 0)
    out = np.zeros(len(place) + len(w.bounds) - 1, np.uint8)
    out[place[at]] = textops.endings(w, at, 2) % U(ENDINGS)
    return out


class Lookup:
    """Places of hashes in a sorted table, found by their leading bits."""

    def __init__(self, table: np.ndarray):
        self.table, bits = table, max(4, (8 * len(table)).bit_length())
        self.shift = U(64 - bits)
        self.first = np.searchsorted(table >> self.shift, np.arange((1 << bits) + 1, dtype=U)).astype(np.int32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash in the table, or -1."""
        out = np.full(len(h), -1)
        cell = (h >> self.shift).astype(np.int64)
        at, end = self.first[cell], self.first[cell + 1]
        live = np.flatnonzero(at < end)
        at, end = at[live], end[live]
        while len(live):
            hit = self.table[at] == h[live]
            out[live[hit]] = at[hit]
            at += 1
            more = ~hit & (at < end)
            live, at, end = live[more], at[more], end[more]
        return out


@dataclass
class Vocabulary:
    """The model's words by descending count, cut into classes; the tail is the class behind them."""

    hashes: np.ndarray
    counts: np.ndarray
    edge: np.ndarray
    order: np.ndarray = field(init=False)
    places: Lookup = field(init=False)
    word_class: np.ndarray = field(init=False)

    def __post_init__(self):
        self.order = np.argsort(self.hashes)
        self.places = Lookup(self.hashes[self.order])
        self.word_class = np.repeat(np.arange(len(self.edge) - 1), np.diff(self.edge))

    @property
    def classes(self) -> int:
        return len(self.edge)  # with the tail

    def find(self, h: np.ndarray) -> np.ndarray:
        k = self.places(h)
        return np.where(k >= 0, self.order[np.maximum(k, 0)], -1) if len(self.order) else k


def vocabulary(hashes: np.ndarray, counts: np.ndarray, words: int, classes: int, widest: int = 256) -> Vocabulary:
    top = np.lexsort((hashes, -counts))[:words]
    top = top[counts[top] > 0]
    h, c = hashes[top], counts[top]
    share = np.sqrt(c)
    edge, mass = [0], 0.0
    for i in range(len(h)):
        mass += share[i]
        if mass >= share.sum() / classes or i + 1 - edge[-1] >= widest:
            edge.append(i + 1)
            mass = 0.0
    if edge[-1] != len(h):
        edge.append(len(h))
    return Vocabulary(h, c, np.array(edge))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Model:
    """A minimal gated unit: one gate forgets, and resets what the candidate sees of the state.

    Parameters: x (input rows, 2H), u (H, 2H), class weights and biases, word weights and biases.
    """

    def __init__(self, vocab: Vocabulary, tail_count: float, hidden: int = 24, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.vocab, self.h = vocab, hidden
        m = len(vocab.hashes)
        per_class = np.append(np.add.reduceat(vocab.counts, vocab.edge[:-1]) if m else np.zeros(0), max(tail_count, 1.0)) if m else np.array([1.0])
        f = np.float32
        self.p = {
            "x": (rng.normal(0, 0.3, (m + ENDINGS, 2 * hidden))).astype(f),
            "u": (rng.normal(0, hidden**-0.5, (hidden, 2 * hidden))).astype(f),
            "cw": np.zeros((hidden, len(per_class)), f), "cb": np.log(per_class / per_class.sum()).astype(f),
            "ww": np.zeros((m, hidden), f), "wb": np.log(np.maximum(vocab.counts, 1)).astype(f),
        }

    def inputs(self, word: np.ndarray, ending: np.ndarray) -> np.ndarray:
        return np.where(word >= 0, word, len(self.vocab.hashes) + ending)

    def step(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        return self._step(x, h)[0]

    def _step(self, x: np.ndarray, h: np.ndarray):
        """The next state, and the gate, the candidate and what the gate let in of the state."""
        n = self.h
        a = h @ self.p["u"]
        gate = _sigmoid(x[:, :n] + a[:, :n])
        c = gate * a[:, n:]
        c += x[:, n:]
        np.tanh(c, out=c)
        after = c - h
        after *= gate
        after += h
        return after, gate, c, a[:, n:]

    def output(self, h: np.ndarray, word: np.ndarray, grads: dict | None = None, real: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each word (of the tail, for words outside) given states.

        Words that aren't ``real`` are of the tail and have no gradient.
        """
        p, v = self.p, self.vocab
        cls = np.where(word >= 0, v.word_class[np.maximum(word, 0)] if len(v.hashes) else 0, v.classes - 1)
        order = np.argsort(cls.astype(np.int16), kind="stable")
        cut = np.searchsorted(cls[order], np.arange(v.classes)).tolist()
        h, cls, word = h[order], cls[order], word[order]  # by class, so that a class is a slice
        at, sums = np.arange(len(h)), np.ones((2, len(h)), h.dtype)
        # States are within -1 and 1, so no score is above its bound.
        bound = (p["cb"] + np.abs(p["cw"]).sum(0)).max()
        e, picked = self._softmax(h, p["cw"], p["cb"] - bound, at, cls, sums[0])
        dh = None
        if grads is not None:
            weight = np.ones(len(h), h.dtype) if real is None else real[order]
            e *= (weight / sums[0])[:, None]
            e[at, cls] -= weight
            grads["cw"] += h.T @ e
            grads["cb"] += np.ones(len(e), e.dtype) @ e
            dh = e @ p["cw"].T
        if v.classes > 1:
            bounds = np.maximum.reduceat(p["wb"] + np.abs(p["ww"]).sum(1), v.edge[:-1])
        for c in range(v.classes - 1):
            lo, hi = v.edge[c], v.edge[c + 1]
            rows = slice(cut[c], cut[c + 1])
            if rows.start == rows.stop or hi - lo == 1:
                continue
            hr, k, mine = h[rows], at[: rows.stop - rows.start], word[rows] - lo
            e, chosen = self._softmax(hr, p["ww"][lo:hi].T, p["wb"][lo:hi] - bounds[c], k, mine, sums[1, rows])
            picked[rows] += chosen
            if grads is not None:
                e *= (1 / sums[1, rows])[:, None]
                e[k, mine] -= 1
                grads["ww"][lo:hi] += e.T @ hr
                grads["wb"][lo:hi] += np.ones(len(e), e.dtype) @ e
                dh[rows] += e @ p["ww"][lo:hi]
        back = np.empty(len(order), np.int64)
        back[order] = at
        logp = picked - np.log(sums[0]) - np.log(sums[1])
        return logp[back].astype(np.float64), None if dh is None else dh[back]

    @staticmethod
    def _softmax(h: np.ndarray, weights: np.ndarray, biases: np.ndarray, at: np.ndarray, which: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials of scores, which are below 0, and the chosen score; the sum of each row into ``total``."""
        s = h @ weights
        s += biases
        picked = s[at, which]
        np.exp(s, out=s)
        np.matmul(s, np.ones(s.shape[1], s.dtype), out=total)
        if total.min(initial=1) < 1e-25:  # far below the bound
            s = h @ weights + biases
            s -= s.max(1, keepdims=True)
            picked = s[at, which]
            np.exp(s, out=s)
            total[:] = s.sum(1)
        return s, picked

    def _adam(self, key: str, grad: np.ndarray, state: dict, pace: float, rows: np.ndarray | None = None) -> None:
        """One step of Adam; of a table of which few ``rows`` have a gradient, on these alone."""
        t = state["t"]
        some = slice(None) if rows is None else rows
        np.clip(grad, -0.1, 0.1, out=grad)
        first, second = (m[some] for m in state["moments"][key])
        first += np.float32(0.1) * (grad - first)
        np.multiply(grad, grad, out=grad)
        grad -= second
        grad *= np.float32(0.01)
        second += grad
        change = np.sqrt(second)
        change /= np.float32((1 - 0.99**t) ** 0.5)
        change += np.float32(1e-6)
        np.divide(first, change, out=change)
        change *= np.float32(pace / (1 - 0.9**t))
        self.p[key][some] -= change
        if rows is not None:
            for m, new in zip(state["moments"][key], (first, second)):
                m[rows] = new

    def train(self, word: np.ndarray, ending: np.ndarray, bounds: np.ndarray, streams: int = 64, window: int = 24, rate: float = 0.01, epochs: int = 2, state: dict | None = None) -> list[float]:
        """Truncated backpropagation with Adam over documents laid end to end in parallel streams.

        With a ``state``, Adam's moments and steps go on from it, at one rate; else the rate falls.
        """
        if not len(word):
            return []
        streams = max(1, min(streams, len(word) // 2))
        length = -(-len(word) // streams)
        lay = lambda x, fill: np.append(x, np.full(length * streams - len(x), fill, x.dtype)).reshape(streams, length).T.copy()
        w, inp, real = lay(word, -1), lay(self.inputs(word, ending), 0), lay(np.ones(len(word), np.float32), 0)
        going = np.ones(len(word), np.float32)
        going[bounds[:-1]] = 0
        going = lay(going, 1)[:, :, None]  # 0 where a document starts
        decays, state = state is None, {} if state is None else state
        state.setdefault("moments", {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()})
        losses, n = [], self.h
        steps = epochs * -(-length // window)
        state.setdefault("t", 0)
        for _ in range(epochs):
            h = np.zeros((streams, n), np.float32)
            for lo in range(0, length, window):
                state["t"] += 1
                hi = min(lo + window, length)
                here = real[lo:hi].ravel()
                size = float(here.sum())
                h, loss, g, rows = self._window(inp[lo:hi], w[lo:hi], going[lo:hi], here, h)
                losses.append(loss / size)
                pace = rate * (1 - (state["t"] - 1) / steps) ** 0.5 if decays else rate
                for k, grad in g.items():
                    grad /= np.float32(size)
                    self._adam(k, grad, state, pace, rows if k == "x" else None)
        return losses

    def _window(self, inp: np.ndarray, word: np.ndarray, going: np.ndarray, real: np.ndarray, h: np.ndarray):
        """The state after a window (steps x streams), its loss, and the gradients; those of x for the rows named last."""
        n, (length, streams) = self.h, inp.shape
        x, shape = self.p["x"][inp], (length, streams, n)
        before, c, a, gate = (np.empty(shape, np.float32) for _ in range(4))
        for k in range(length):
            np.multiply(h, going[k], out=before[k])
            h, gate[k], c[k], a[k] = self._step(x[k], before[k])
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("x", "u")}
        logp, dout = self.output(before.reshape(-1, n), word.ravel(), g, real)
        dout = dout.reshape(shape)
        stay = 1 - gate
        to_c = gate * (1 - c * c)
        to_gate = ((c - before) + to_c * a) * gate * stay  # directly, and through the candidate
        dx, da = (np.empty((length, streams, 2 * n), np.float32) for _ in range(2))
        dh, back = np.zeros((streams, n), np.float32), self.p["u"].T.copy()
        for k in range(length - 1, -1, -1):
            np.multiply(dh, to_gate[k], out=dx[k, :, :n])
            np.multiply(dh, to_c[k], out=dx[k, :, n:])
            da[k, :, :n] = dx[k, :, :n]
            np.multiply(dx[k, :, n:], gate[k], out=da[k, :, n:])
            dh *= stay[k]
            dh += da[k] @ back
            dh += dout[k]
            dh *= going[k]
        g["u"] = before.reshape(-1, n).T @ da.reshape(-1, 2 * n)
        order, cut = exchange.groups(inp.ravel())
        g["x"] = np.add.reduceat(dx.reshape(-1, 2 * n)[order], cut)
        return h, -float(logp @ real), g, inp.ravel()[order[cut]]

    def score(self, word: np.ndarray, ending: np.ndarray, bounds: np.ndarray, window: int = 64) -> np.ndarray:
        """Natural log probability of each document's tokens, the state carried over windows."""
        n = np.diff(bounds)
        by_size = np.argsort(-n, kind="stable")
        first, size = bounds[:-1][by_size], n[by_size]
        inp = self.inputs(word, ending)
        out = np.zeros(len(n))
        h = np.zeros((len(n), self.h), np.float32)
        for lo in range(0, int(size[0]) if len(size) else 0, window):
            states, which, docs = [], [], []
            for i in range(lo, lo + window):
                live = int(np.searchsorted(-size, -i, side="left"))  # documents with more than i tokens
                if not live:
                    break
                at = first[:live] + i
                states.append(h[:live])
                which.append(at)
                docs.append(np.arange(live))
                h = self.step(self.p["x"][inp[at]], h[:live])
            states, asked = np.concatenate(states), word[np.concatenate(which)]
            logp = np.concatenate([self.output(states[a : a + ROWS], asked[a : a + ROWS])[0] for a in range(0, len(states), ROWS)])
            out[by_size] += np.bincount(np.concatenate(docs), weights=logp, minlength=len(n))
        return out


@dataclass
class Statistics:
    """What the corpus says: totals, and counts of the head words (sorted hashes)."""

    total: int
    distinct: int
    head: np.ndarray
    counts: np.ndarray


def _fit_rows(docs: DataFrame, most_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a bounded sample of different training texts, on the driver."""
    chosen = sample.bounded(docs.filter("not held_out").select("tid", "text"), most_docs, "tid").dropDuplicates(["tid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.chunks(batch, "text"):
                h, bounds, w = tokens(part.column(0))
                tail, cut = endings(w), list(zip(bounds[:-1], bounds[1:]))
                yield pa.RecordBatch.from_arrays([pa.array([h[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([tail[a:b].tobytes() for a, b in cut], pa.binary())], ["h", "tail"])

    rows = chosen.select("text").mapInArrow(run, "h binary, tail binary").collect()
    rows.sort(key=lambda r: bytes(r.h))
    order = np.random.default_rng(11).permutation(len(rows))
    h = [np.frombuffer(rows[i].h, np.uint64) for i in order]
    tail = [np.frombuffer(rows[i].tail, np.uint8) for i in order]
    if not h:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(1, np.int64)
    return np.concatenate(h), np.concatenate(tail).astype(np.int64), np.cumsum([0, *map(len, h)])


def count(docs: DataFrame, head: np.ndarray, parts: int, words: int) -> DataFrame:
    """One shuffle that counts every token and sums up each text's words outside the head.

    kind 0: key = tid, a = sum of log10(count + 0.1), b = known, c = number of such words;
    kind 1: key = head hash, b = its count; kind 2: b = training tokens, c = distinct ones;
    kind 3: key = hash of another word, b = its count, the ``words`` commonest of each partition.
    """
    kinds = ["u8", "i8", "i8", "i8"]
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, head = exchange.Packer(parts, kinds), shared.value
        known = Lookup(head)
        common = np.zeros(len(head), np.int64)
        for batch in batches:
            tid, train = np.array(batch.column(0), np.int64), ~np.array(batch.column(1), bool)
            _, where, back = np.unique(tid, return_index=True, return_inverse=True)
            copies = np.bincount(back, weights=train, minlength=len(where)).astype(np.int64)
            order = np.argsort(where)
            where, copies = where[order], copies[order]
            one = batch.take(pa.array(where))
            at = 0
            for part in textops.chunks(one, "text"):
                h, bounds, _ = tokens(part.column(2))
                doc = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                times = copies[at : at + part.num_rows]
                k = known(h)
                common += np.bincount(k[k >= 0], weights=times[doc[k >= 0]], minlength=len(head)).astype(np.int64)
                rest = np.flatnonzero(k < 0)
                order, cut = exchange.groups(h[rest], doc[rest])
                first = rest[order[cut]]
                n = np.diff(np.append(cut, len(rest)))
                yield from out.add(textops.mix(h[first]), np.array(part.column(0), np.int64)[doc[first]], n, n * times[doc[first]])
                at += part.num_rows
        zero = np.zeros(len(head), np.int64)
        yield from out.add(textops.mix(head), zero, zero, common)
        yield from out.flush()

    def sum_up(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, tid, n, train = cols
        order, cut = exchange.groups(key)
        sizes = np.diff(np.append(cut, len(key)))
        c = np.add.reduceat(train[order], cut)
        each = np.empty(len(key), np.int64)
        each[order] = np.repeat(c, sizes)
        ask = np.flatnonzero(n > 0)
        o2, c2 = exchange.groups(tid[ask], key[ask])  # a text may come from several tasks
        ask = ask[o2[c2]]
        texts, back = np.unique(tid[ask], return_inverse=True)
        add = lambda w: np.bincount(back, weights=w, minlength=len(texts))
        yield _rows(0, texts, add(n[ask] * np.log10(each[ask] + 0.1)), add(n[ask] * (each[ask] > 0)).astype(np.int64), add(n[ask]).astype(np.int64))
        mine = np.flatnonzero(n == 0)
        keys, first = np.unique(key[mine], return_index=True)
        yield _rows(1, keys.view(np.int64), np.zeros(len(keys)), each[mine[first]], np.zeros(len(keys), np.int64))
        other = np.flatnonzero((n[order[cut]] > 0) & (c > 0))
        keys = key[order[cut[other]]].view(np.int64)
        top = np.lexsort((keys, -c[other]))[:words]
        yield _rows(3, keys[top], np.zeros(len(top)), c[other[top]], np.zeros(len(top), np.int64))
        yield _rows(2, np.zeros(1, np.int64), np.zeros(1), np.array([c.sum()]), np.array([(c > 0).sum()]))

    blobs = docs.select("tid", "held_out", "text").mapInArrow(scan, exchange.BLOB)
    return exchange.exchange(blobs, parts, kinds, sum_up, "kind int, key long, a double, b long, c long")


def _rows(kind: int, key, a, b, c) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key, pa.int64()), pa.array(a, pa.float64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["kind", "key", "a", "b", "c"])


def score(docs: DataFrame, folds: int = 10, head_words: int = 1 << 16, words: int = 4096, classes: int = 40, hidden: int = 24, most_docs: int = 1500, bytes_each: int = 4 << 20, rounds: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    parts = parts_for(docs, bytes_each)
    held = F.coalesce(sample.bucket(F.col("doc_id"), folds) == 0, F.lit(False))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"held_out": held, "tid": F.xxhash64("text")})
    h, tail, bounds = _fit_rows(docs, most_docs)
    seen, times = np.unique(h, return_counts=True)
    head = np.sort(seen[np.lexsort((seen, -times))[:head_words]])
    counted = written(count(docs, head, parts, words), "lm-counts")
    totals = counted.filter("kind = 2").agg(F.sum("b").alias("n"), F.sum("c").alias("v")).first()
    by_key = {r.key: r.b for r in counted.filter("kind = 1").select("key", "b").collect()}  # head words at most
    counts = np.array([by_key.get(k, 0) for k in textops.mix(head).view(np.int64).tolist()], np.int64)
    stats = Statistics(totals.n or 0, totals.v or 0, head, counts)
    others = counted.filter("kind = 3").orderBy(F.desc("b"), "key").limit(words).select("key", "b").collect()
    late = textops.unmix(np.array([r.key for r in others], np.int64).view(U))
    vocab = vocabulary(np.concatenate([head, late]), np.concatenate([counts, np.array([r.b for r in others], np.int64)]), words, classes)
    in_tail = stats.total - int(vocab.counts.sum())
    model = Model(vocab, in_tail, hidden)
    model.train(vocab.find(h), tail, bounds)
    for r in range(rounds):
        mine = docs.filter(~held).filter(F.pmod(F.xxhash64(F.lit("round"), "doc_id", "tid"), F.lit(rounds)) == r)
        model.p = _averaged(mine, model, 0.004 / (1 + r))
    scored = written(_score_rows(docs, stats, model), "lm-scores")
    rest = counted.filter("kind = 0").groupBy(F.col("key").alias("tid")).agg(F.sum("a").alias("rest_log"), F.sum("b").alias("rest_known"))
    whole = np.log10(stats.total + 0.1 * (stats.distinct + 1))
    tail_whole = np.log10(in_tail + 0.1 * (stats.distinct - len(vocab.hashes) + 1))
    both = scored.join(rest, "tid", "left").withColumns({"rest_log": F.coalesce("rest_log", F.lit(0.0)), "rest_known": F.coalesce("rest_known", F.lit(0))})
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.col("rest_known")).cast("long").alias("n_known"), F.lit(stats.total).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.col("rest_log") - F.col("n_tokens") * float(whole)).alias("base_score"),
        (F.col("model_log") + F.col("outside_log") + F.col("rest_log") - F.col("n_tail") * float(tail_whole)).alias("score"),
    )


def _averaged(docs: DataFrame, model: Model, rate: float) -> dict[str, np.ndarray]:
    """The model's parameters after a replica per partition has learned from its rows, averaged by tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, state, held, total = shared.value, {}, [], 0
        model = copy.copy(common)
        model.p = {k: v.copy() for k, v in common.p.items()}

        def learn() -> int:
            word, tail = (np.concatenate([x[i] for x in held]) for i in range(2))
            bounds = np.concatenate([[0], np.cumsum(np.concatenate([x[2] for x in held]))])
            held.clear()
            model.train(word, tail.astype(np.int64), bounds, streams=max(8, min(STREAMS, len(word) // 1000)), rate=rate, epochs=1, state=state)
            return len(word)

        for batch in batches:
            for part in textops.chunks(batch, "text"):
                h, bounds, w = tokens(part.column(0))
                word = model.vocab.find(h).astype(np.int32)
                held.append((word, endings(w, word), np.diff(bounds)))
                if sum(len(x[0]) for x in held) >= LEARN:
                    total += learn()
        total += learn() if held else 0
        if total:
            flat = np.concatenate([model.p[k].ravel() for k in sorted(model.p)])
            data = [flat[a : a + BLOCK].tobytes() for a in range(0, len(flat), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(data), dtype=np.int32)), pa.array(np.full(len(data), total)), pa.array(data, pa.binary())], ["block", "n", "data"])
        textops.release()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for block, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                had, so_far = sums.get(block, (0, 0.0))
                sums[block] = had + n, so_far + n * np.frombuffer(data.as_buffer(), np.float32).astype(np.float64)
        data = [(x / n).astype(np.float32).tobytes() for n, x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(data, pa.binary())], ["block", "data"])

    blobs = docs.select("text").mapInArrow(run, "block int, n long, data binary")
    rows = sorted(written(blobs.repartitionById(16, blobs.block % 16).mapInArrow(add_up, "block int, data binary"), "lm-weights").collect())
    if not rows:
        return model.p
    flat, out, at = np.frombuffer(b"".join(r.data for r in rows), np.float32), {}, 0
    for k in sorted(model.p):
        out[k] = flat[at : at + model.p[k].size].reshape(model.p[k].shape).copy()
        at += model.p[k].size
    return out


def _score_rows(docs: DataFrame, stats: Statistics, model: Model) -> DataFrame:
    """Per row: what the head and the model say; the words outside the head are added by the caller."""
    shared = docs.sparkSession.sparkContext.broadcast((stats, model))
    names = ["doc_id", "tid", "held_out", "n_tokens", "head_known", "head_log", "outside_log", "n_tail", "model_log"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, model = shared.value
        known = Lookup(stats.head)
        logs = np.log10(stats.counts + 0.1)
        for batch in batches:
            for group in textops.chunks(batch, "text", 12 << 20):
                got, at = [], 0
                for part in textops.chunks(group, "text"):
                    h, bounds, w = tokens(part.column(3))
                    word = model.vocab.find(h).astype(np.int32)
                    got.append((known(h), word, endings(w, word), bounds[1:] + at))
                    at += bounds[-1]
                k, word, tail = (np.concatenate([g[i] for g in got]) for i in range(3))
                bounds = np.concatenate([[0], *(g[3] for g in got)])
                doc = np.repeat(np.arange(group.num_rows), np.diff(bounds))
                add = lambda at, w=None: np.bincount(doc[at], weights=w, minlength=group.num_rows).astype(np.int64 if w is None else np.float64)
                inside, outside = np.flatnonzero(k >= 0), np.flatnonzero((k >= 0) & (word < 0))
                late = np.flatnonzero((k < 0) & (word >= 0))  # the caller counts these among the tail's
                values = [
                    np.diff(bounds), add(np.flatnonzero((k >= 0) & (stats.counts[np.maximum(k, 0)] > 0)) if len(stats.head) else inside), add(inside, logs[k[inside]]),
                    add(outside, logs[k[outside]]) - add(late, np.log10(model.vocab.counts[word[late]] + 0.1)), add(np.flatnonzero(word < 0)), model.score(word, tail.astype(np.int64), bounds) / np.log(10),
                ]
                yield pa.RecordBatch.from_arrays([*(group.column(i) for i in range(3)), *map(pa.array, values)], names)

    return docs.select("doc_id", "tid", "held_out", "text").mapInArrow(run, "doc_id long, tid long, held_out boolean, n_tokens long, head_known long, head_log double, outside_log double, n_tail long, model_log double")
