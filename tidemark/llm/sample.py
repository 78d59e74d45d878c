"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(n))


def bounded(labels: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """About ``most`` of the rows at most, chosen by a hash of the id (all, if there are fewer)."""
    n = labels.count()
    if n <= most:
        return labels
    grains = 1 << 30
    return labels.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(grains)) < int(grains * most / n))
