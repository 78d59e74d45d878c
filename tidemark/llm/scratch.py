"""Written intermediate tables in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and the
master is local (tests) does this module choose one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; set to a temporary one for a local session without one."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of the scans below ``df`` by the optimizer's statistics, for sizing partitions.

    Where a leaf has no statistics (it reports the largest long), the bytes of the texts are
    summed up instead, by one pass.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if all(n < 1 << 60 for n in sizes):
        return sum(sizes)
    return df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def parts_for(df: DataFrame, bytes_each: int, least: int = 12) -> int:
    """How many parts give about ``bytes_each`` of input to each."""
    return max(least, -(-input_bytes(df) // bytes_each))
