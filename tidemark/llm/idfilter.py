"""A fixed-size filter over hashed ids, to drop most rows before a shuffle by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter, in groups; fixed, so what is broadcast doesn't grow with the input.
GROUPS, GROUP_BITS = 1 << 12, 1 << 10


def flagged(docs: DataFrame, ids: DataFrame, col: str, flag: str = "__cand") -> DataFrame:
    """``docs`` with a boolean ``flag``: surely false where its ``col`` isn't among the ``tid`` of ``ids``.

    It may be true for some others, so a join must follow; a full filter only costs time.
    """
    cell = lambda c: F.pmod(F.xxhash64(F.lit("cand"), F.col(c)), F.lit(GROUPS * GROUP_BITS))
    group = lambda c: F.floor(cell(c) / GROUP_BITS).cast("int")
    bit = lambda c: F.pmod(cell(c), F.lit(GROUP_BITS)).cast("smallint")
    table = ids.select(group("tid").alias("__group"), bit("tid").alias("__bit")).groupBy("__group").agg(F.collect_set("__bit").alias("__bits"))
    joined = docs.withColumns({"__group": group(col), "__bit": bit(col)}).join(F.broadcast(table), "__group", "left")
    return joined.withColumn(flag, F.coalesce(F.array_contains("__bits", F.col("__bit")), F.lit(False))).drop("__group", "__bit", "__bits")
