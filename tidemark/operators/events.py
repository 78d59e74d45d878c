"""Curated events of one entity: parse, deduplicate, split by freshness, project.

All three steps work on one partitioning by the entity's key: a duplicate has its
original's key, so rows are dealt out by key once and every window reuses that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import envelope
from tidemark.model import CURRENT_TAIL, EVENT_COLUMNS, HISTORY_TAIL, INVALID, QUARANTINE_COLUMNS, STALE, Entity

FRESHNESS = ("source_lsn", "source_tx_id", "event_ts", "kafka_offset")


def freshest_first() -> list[Column]:
    """Newest first; the reference order, then partition and id so that full ties have one result."""
    return [F.col(c).desc_nulls_last() for c in FRESHNESS] + [F.col("kafka_partition").desc_nulls_last(), F.col("event_id").desc_nulls_last()]


def parse(raw: DataFrame, entity: Entity) -> DataFrame:
    """Typed record of each event: the image before a delete, else after. Rows without a key go."""
    image = F.from_json(F.when(F.col("op") == "d", F.col("before_json")).otherwise(F.col("after_json")), entity.record)
    # A generator, as the filter on the key would otherwise go below it and parse the text twice.
    rows = raw.select(*EVENT_COLUMNS, F.inline(F.array(image))).select(*entity.columns, *EVENT_COLUMNS)
    deleted = F.coalesce(F.col("op") == "d", F.lit(False))
    return rows.filter(F.col(entity.key).isNotNull()).withColumns({"is_deleted": deleted, "deleted_at": F.when(deleted, F.col("event_ts"))})


def invalid(raw: DataFrame, entity: Entity, clock: Column | None = None) -> DataFrame:
    """Quarantine rows of the events that `parse` can't use: no image, or one without a key."""
    now = F.current_timestamp() if clock is None else clock
    image = F.from_json(F.when(F.col("op") == "d", F.col("before_json")).otherwise(F.col("after_json")), f"{entity.key} bigint")
    rows = raw.select(*EVENT_COLUMNS, F.inline(F.array(image)).alias("_key")).filter("_key is null")
    extra = {"entity": F.lit(entity.name), "primary_key": F.lit(None).cast("string"), "reason": F.lit(INVALID), "previous_max_source_lsn": F.lit(None).cast("bigint"), "quarantined_at": now, "processing_date": F.to_date(now)}
    return rows.withColumns(extra).select(*QUARANTINE_COLUMNS)


def deduplicate(events: DataFrame, entity: Entity) -> DataFrame:
    """One row per event id, the freshest."""
    return _one_an_id(events.repartition(F.col(entity.key)), entity)


def dealt(raw: DataFrame, entity: Entity) -> DataFrame:
    """Parsed and deduplicated events; their ids, which don't compress, are made of the coordinates after the shuffle."""
    at = envelope.place(F.col("topic"), F.col("kafka_partition"), F.col("kafka_offset"))
    rows = parse(raw.withColumn("event_id", at), entity).repartition(F.col(entity.key))
    return _one_an_id(rows.withColumn("event_id", F.sha2("event_id", 256)), entity)


def _one_an_id(dealt: DataFrame, entity: Entity) -> DataFrame:
    one = Window.partitionBy(entity.key, "event_id").orderBy(*freshest_first())
    return dealt.withColumn("_rank", F.row_number().over(one)).filter("_rank = 1").drop("_rank")


def with_previous_lsn(events: DataFrame, entity: Entity) -> DataFrame:
    """The largest log position among the key's earlier arrivals, and whether the event is behind it."""
    arrival = Window.partitionBy(entity.key).orderBy("kafka_partition", "kafka_offset").rowsBetween(Window.unboundedPreceding, -1)
    before = events.withColumn("previous_max_source_lsn", F.max("source_lsn").over(arrival))
    return before.withColumn("is_stale", F.coalesce(F.col("source_lsn") < F.col("previous_max_source_lsn"), F.lit(False)))


def classify(raw: DataFrame, entity: Entity) -> DataFrame:
    """Deduplicated events with ``previous_max_source_lsn`` and ``is_stale``; one shuffle."""
    return with_previous_lsn(deduplicate(parse(raw, entity), entity), entity)


def latest(valid: DataFrame, entity: Entity) -> DataFrame:
    top = Window.partitionBy(entity.key).orderBy(*freshest_first())
    return valid.withColumn("_rank", F.row_number().over(top)).filter("_rank = 1").drop("_rank")


def labelled(classified: DataFrame, entity: Entity) -> DataFrame:
    """Classified events with ``is_latest``, true for the newest valid one of each key; on the same partitioning."""
    top = Window.partitionBy(entity.key, "is_stale").orderBy(*freshest_first())
    return classified.withColumn("is_latest", (F.row_number().over(top) == 1) & ~F.col("is_stale"))


def current(valid: DataFrame, entity: Entity, clock: Column | None = None) -> DataFrame:
    """The newest state of each key; deleted keys stay, marked."""
    now = F.current_timestamp() if clock is None else clock
    return latest(valid, entity).withColumn("silver_updated_at", now).select(*entity.columns, *CURRENT_TAIL)


def history(valid: DataFrame, entity: Entity) -> DataFrame:
    """Every valid event, from when it holds."""
    extra = {"change_op": F.col("op"), "valid_from": F.col("event_ts"), "processing_date": F.to_date("ingestion_ts")}
    return valid.withColumns(extra).select(*entity.columns, *HISTORY_TAIL)


def quarantine(stale: DataFrame, entity: Entity, clock: Column | None = None) -> DataFrame:
    """Events that arrived behind a newer one of their key."""
    now = F.current_timestamp() if clock is None else clock
    extra = {"entity": F.lit(entity.name), "primary_key": F.col(entity.key).cast("string"), "reason": F.lit(STALE), "quarantined_at": now, "processing_date": F.to_date(now)}
    return stale.withColumns(extra).select(*QUARANTINE_COLUMNS)


#: What `judge` keeps of an event beside its record.
_JUDGED = ["is_deleted", "topic", "kafka_partition", "kafka_offset", "op", "source_table", "source_lsn", "source_tx_id", "event_ts", "ingestion_ts", "previous_max_source_lsn", "is_stale", "is_latest"]
#: Bits of the filter on stale events, in pieces of as many as Spark's bitmaps have.
_BITS, _PIECE = 1 << 26, 1 << 15


def judge(raw: DataFrame, entity: Entity) -> DataFrame:
    """Deduplicated events with `is_stale` and `is_latest`, without their texts and ids: to be written once and read by `from_judged`."""
    return labelled(with_previous_lsn(dealt(raw, entity), entity), entity).select(*entity.columns, *_JUDGED)


def _with_texts(stale: DataFrame, stored: DataFrame, entity: Entity) -> DataFrame:
    """Stale events with the texts of their stored raw rows.

    A bitmap of fixed size keeps most other rows out of the join; where it is full, that costs time and no rows.
    """
    spot = F.pmod(F.xxhash64("topic", "kafka_partition", "kafka_offset"), F.lit(_BITS))
    marks = stale.select(spot.alias("_spot")).groupBy(F.expr(f"_spot div {_PIECE}").alias("_piece")).agg(F.bitmap_construct_agg(F.col("_spot") % _PIECE).alias("_bits"))
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast(_spot % {_PIECE} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    met = stored.withColumn("_spot", spot).withColumn("_piece", F.expr(f"_spot div {_PIECE}")).join(F.broadcast(marks), "_piece")
    met = met.filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(_spot % 8 as int))")) != 0).select(*stored.columns)
    same = [entity.key, "topic", "kafka_partition", "kafka_offset", "source_lsn", "source_tx_id", "event_ts"]
    texts = parse(envelope.completed(met), entity).select(*[F.col(c).alias(f"_{c}") for c in same], "event_id", "key_json", "before_json", "after_json", "source_json")
    found = stale.drop("event_id").join(texts, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same])
    return found.drop(*[f"_{c}" for c in same]).dropDuplicates([entity.key, "event_id"])


def from_judged(judged: DataFrame, stored: DataFrame, entity: Entity, clock: Column | None = None) -> Rebuilt:
    """All three curated tables from what `judge` gave, as it was written, and the entity's stored raw rows."""
    at = envelope.event_id(F.col("topic"), F.col("kafka_partition"), F.col("kafka_offset"))
    now = F.current_timestamp() if clock is None else clock
    rows = judged.withColumns({"event_id": at, "deleted_at": F.when(F.col("is_deleted"), F.col("event_ts"))})
    newest = rows.filter("is_latest").withColumn("silver_updated_at", now).select(*entity.columns, *CURRENT_TAIL)
    return Rebuilt(newest, history(rows.filter("not is_stale"), entity), quarantine(_with_texts(judged.filter("is_stale"), stored, entity), entity, clock))


@dataclass(frozen=True)
class Rebuilt:
    current: DataFrame
    history: DataFrame
    quarantine: DataFrame


def rebuild(raw: DataFrame, entity: Entity, clock: Column | None = None) -> Rebuilt:
    """All three curated tables of an entity. Persist `classify`'s result to write them in one pass."""
    return from_classified(classify(raw, entity), entity, clock)


def from_classified(events: DataFrame, entity: Entity, clock: Column | None = None) -> Rebuilt:
    valid, stale = events.filter("not is_stale"), events.filter("is_stale")
    return Rebuilt(current(valid, entity, clock), history(valid, entity), quarantine(stale, entity, clock))


def with_delete_event(rows: DataFrame) -> DataFrame:
    """Current rows with the id of the event that deleted them."""
    return rows.withColumn("delete_event_id", F.when(F.col("is_deleted"), F.col("event_id")))


def transitions(history_rows: DataFrame, entity: Entity) -> DataFrame:
    """Status changes of each key in order, and whether each is an allowed edge."""
    order = Window.partitionBy(entity.key).orderBy("source_lsn", "source_tx_id", "event_ts", "kafka_offset", "event_id")
    moved = history_rows.filter("not is_deleted").withColumn("from_status", F.lag(entity.status).over(order)).filter(F.col("from_status").isNotNull() & (F.col("from_status") != F.col(entity.status)))
    edges = [f"{a}>{b}" for a, b in sorted(entity.transitions)]
    out = moved.select(F.lit(entity.name).alias("entity"), F.col(entity.key).alias("primary_key"), "from_status", F.col(entity.status).alias("to_status"))
    return out.withColumn("allowed", F.concat_ws(">", "from_status", "to_status").isin(edges))
