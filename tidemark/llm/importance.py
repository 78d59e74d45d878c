"""Importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Both models are distributions over ``buckets`` hashed word unigrams and bigrams. A
document's log weight is the sum of log target/raw probability over its n-grams; adding
Gumbel noise (a hash of seed and id) and keeping the k largest draws k documents without
replacement in proportion to their weights.

The raw model counts every document. The target model counts target documents: a bounded
sample of at most ``most`` rows labelled 1. A null or empty text has weight 0 in the log
and takes part. Rows with equal keys at the border are all kept, so repeated rows stand or
fall together and the result may exceed k by ties. An empty table gives an empty result;
without target rows all weights are equal. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import sample, textops
from tidemark.llm.scratch import written

#: Keys are kept as multiples of 2**-20, and log weights within +-CLIP.
SCALE, CLIP = 1 << 20, 1e6


def _grams(part: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams, and their documents."""
    w = textops.words(part, lower=True)
    at, doc = textops.window_starts(w.bounds, 2)
    pairs = textops.windows(w.hash, at, 2)
    n = textops.U(buckets)
    return np.concatenate([w.hash % n, pairs % n]).astype(np.int64), np.concatenate([w.doc, doc])


def counts(docs: DataFrame, buckets: int) -> np.ndarray:
    """Bucket counts, raw (row 0) and of rows with target = 1 (row 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for part in textops.chunks(batch, "text"):
                gram, doc = _grams(part.column(0), buckets)
                total[0] += np.bincount(gram, minlength=buckets)
                chosen = np.array(part.column(1).fill_null(0), np.int64)[doc] == 1
                total[1] += np.bincount(gram[chosen], minlength=buckets)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[0, at]), pa.array(total[1, at])], ["bucket", "raw", "target"])

    found = docs.select("text", "target").mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    out = np.zeros((2, buckets), np.int64)
    for b, r, t in found.collect():  # one row per bucket at most
        out[:, b] = r, t
    return out


def weigh(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, log_weight: the sum of ``ratio`` over each document's n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for part in textops.chunks(batch, "text"):
                gram, doc = _grams(part.column(1), len(table))
                total = np.bincount(doc, weights=table[gram], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(total, -CLIP, CLIP))], ["doc_id", "log_weight"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, log_weight double")


def top_k(keyed: DataFrame, key: str, k: int) -> DataFrame:
    """Rows with the k largest values of a long column (all ties at the border): exact, by radix.

    Each pass counts rows by the next bits of the key under the prefix found so far; the
    driver sees some thousand counts a pass.
    """
    if k <= 0:
        return keyed.limit(0)
    at, shift, left = None, 36, k
    while shift >= 0:
        digit = F.shiftright(F.col(key), shift)
        rows = keyed if at is None else keyed.filter(F.shiftright(F.col(key), shift + 12) == at)
        found = sorted(rows.groupBy(digit.alias("d")).count().collect(), reverse=True)
        at = None
        for d, n in found:
            if n >= left:
                at = d
                break
            left -= n
        if at is None:  # fewer than k rows
            return keyed
        shift -= 12
    return keyed.filter(F.col(key) >= at)


def resample(docs: DataFrame, target_ids: DataFrame, fraction: float, buckets: int = 1 << 14, most: int = 20_000, seed: int = 7) -> DataFrame:
    """Sample fraction * rows of ``docs`` (doc_id, text): doc_id, log_weight, gumbel_key, kept (true)."""
    chosen = sample.bounded(target_ids.select("doc_id").filter("doc_id is not null").distinct(), most).withColumn("target", F.lit(1))
    both = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left").select("text", "target")
    raw, target = counts(both, buckets)
    ratio = np.log((target + 1.0) / (target.sum() + buckets)) - np.log((raw + 1.0) / (raw.sum() + buckets)) if target.any() else np.zeros(buckets)
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = weigh(docs, ratio).withColumn("key", F.floor((F.col("log_weight") - F.log(-F.log(uniform))) * SCALE).cast("long"))
    keyed = written(keyed, "importance-keys")
    n = keyed.count()
    best = top_k(keyed, "key", round(fraction * n))
    return best.select("doc_id", "log_weight", (F.col("key") / SCALE).alias("gumbel_key"), F.lit(True).alias("kept"))
