"""Change envelopes: JSON text to typed columns. Malformed fields become NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import ENTITIES, RAW_COLUMNS

#: The envelope is parsed once; nested objects stay text, as raw rows keep them.
_ENVELOPE = "op string, before string, after string, source string, transaction string, ts_ms string"
#: What of it stored raw rows need.
_SHORT = "op string, source string, ts_ms string"
#: Only what is read of the source block; a narrow schema is what makes parsing cheap.
_SOURCE = "`table` string, lsn bigint, txId bigint"


#: Raw columns that follow from the others, which is all that stored raw rows have.
_TEXTS = {"before_json": "before", "after_json": "after", "source_json": "source", "transaction_json": "transaction"}
STORED_COLUMNS = [c for c in RAW_COLUMNS if c != "event_id" and c not in _TEXTS]


def place(topic: Column, partition: Column, offset: Column) -> Column:
    """Coordinates of a record as text."""
    return F.concat_ws(":", topic, partition.cast("string"), offset.cast("string"))


def event_id(topic: Column, partition: Column, offset: Column) -> Column:
    """Identity of a record: SHA-256 of its coordinates."""
    return F.sha2(place(topic, partition, offset), 256)


def _opened(rows: DataFrame, text: Column, schema: str, names: dict[str, str]) -> DataFrame:
    """Fields of a JSON column as columns. A generator, as a filter on a field isn't pushed below
    it, where the text would be parsed a second time."""
    return rows.select("*", F.inline(F.array(F.from_json(text, schema)))).withColumnsRenamed(names)


def parse(log: DataFrame, texts: bool = True) -> DataFrame:
    """Log records (key, value, topic, partition, offset, timestamp) with the envelope's fields, or those that are stored."""
    text = log.withColumns({"key_json": F.col("key").cast("string"), "value_json": F.col("value").cast("string")})
    names = {"before": "before_json", "after": "after_json", "source": "source_json", "transaction": "transaction_json"}
    opened = _opened(text, F.col("value_json"), _ENVELOPE if texts else _SHORT, names)
    known = _opened(opened, F.col("source_json"), _SOURCE, {"table": "source_table", "lsn": "source_lsn", "txId": "source_tx_id"})
    return known.withColumn("event_ts", F.timestamp_millis(F.col("ts_ms").try_cast("double").try_cast("bigint"))).drop("ts_ms")


def located(log: DataFrame) -> DataFrame:
    """With the record's coordinates under their own names."""
    return log.withColumns({"kafka_partition": F.col("partition"), "kafka_offset": F.col("offset"), "kafka_timestamp": F.col("timestamp")})


def raw_rows(log: DataFrame, clock: Column | None = None) -> DataFrame:
    """The raw layer's 18 columns: records of known tables; tombstones and strangers go.

    ``clock`` is the ingestion time (the current time if not given).
    """
    return _stamped(log, clock, True).withColumn("event_id", event_id(F.col("topic"), F.col("kafka_partition"), F.col("kafka_offset"))).select(*RAW_COLUMNS)


def stored_rows(log: DataFrame, clock: Column | None = None) -> DataFrame:
    """The same rows as they are stored: without what follows from the other columns."""
    return _stamped(log, clock, False).select(*STORED_COLUMNS)


def _stamped(log: DataFrame, clock: Column | None, texts: bool) -> DataFrame:
    parsed = parse(located(log.filter(F.col("value").isNotNull())), texts).filter(F.col("source_table").isin(list(ENTITIES)))
    return parsed.withColumn("ingestion_ts", F.current_timestamp() if clock is None else clock).withColumn("processing_date", F.to_date("ingestion_ts"))


def completed(stored: DataFrame) -> DataFrame:
    """Stored rows with all 18 raw columns. Each is an expression of its own, so a reader pays for those that it uses."""
    made = {column: F.from_json("value_json", f"{field} string")[field] for column, field in _TEXTS.items()}
    return stored.withColumns(made | {"event_id": event_id(F.col("topic"), F.col("kafka_partition"), F.col("kafka_offset"))}).select(*RAW_COLUMNS)
