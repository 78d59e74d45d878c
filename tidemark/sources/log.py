"""The change log as a source: a message broker where its connector is installed, or files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.model import LOG_RECORD
from tidemark.session import Settings


def _options(conf: Settings, **more: str) -> dict[str, str]:
    if not conf.topics:
        raise ValueError("no topics are configured")
    where = {"kafka.bootstrap.servers": conf.brokers, "subscribe": ",".join(conf.topics)}
    return where | {"startingOffsets": conf.starting_offsets, "failOnDataLoss": str(conf.fail_on_data_loss).lower()} | more


def broker_stream(spark: SparkSession, conf: Settings) -> DataFrame:
    return spark.readStream.format("kafka").options(**_options(conf)).load()


def broker_batch(spark: SparkSession, conf: Settings) -> DataFrame:
    """All records up to now."""
    return spark.read.format("kafka").options(**_options(conf, endingOffsets="latest")).load()


def file_stream(spark: SparkSession, path: str, files_each: int = 100) -> DataFrame:
    """Records from Parquet files with the broker's columns, as they appear."""
    return spark.readStream.schema(LOG_RECORD).option("maxFilesPerTrigger", files_each).parquet(path)


def file_batch(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_RECORD).parquet(path)


def source_tables(spark: SparkSession, tables: list[str], options: dict[str, str], prefix: str = "src_", schema: str = "public.") -> dict[str, DataFrame]:
    """Tables of the source database over JDBC (``options``: url, user, password, driver), registered as views."""
    found = {}
    for t in tables:
        found[t] = spark.read.format("jdbc").options(dbtable=f"{schema}{t}", **options).load()
        found[t].createOrReplaceTempView(f"{prefix}{t}")
    return found
