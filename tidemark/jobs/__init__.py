"""The jobs as functions of a store and settings; `python -m tidemark.jobs` is their command line."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import CURATED, ENTITIES, LAYERS, MARTS, QUARANTINE_TABLE, TABLES, Entity
from tidemark.operators import events, marts, quality
from tidemark.sources.store import Store
from tidemark.streaming import jobs as streams


def ddl(layer: str, catalog: str = "", using: str = "parquet") -> str:
    """A script that makes a layer's namespace and tables in a catalog of the session."""
    space = f"{catalog}.{layer}" if catalog else layer
    made = [f"CREATE NAMESPACE IF NOT EXISTS {space}"]
    for name, table in TABLES.items():
        if table.layer == layer:
            columns = ",\n  ".join(f"{f.name} {f.dataType.simpleString().upper()}" for f in table.schema)
            parts = f" PARTITIONED BY ({', '.join(table.partitions)})" if table.partitions else ""
            made.append(f"CREATE TABLE IF NOT EXISTS {space}.{name} (\n  {columns}\n) USING {using}{parts}")
    return ";\n".join(made) + ";\n"


def create_tables(store: Store, layers: Iterable[str] = LAYERS) -> None:
    """The snapshot tables of some layers, empty, where they don't exist. (Raw tables begin with their first batch.)"""
    for name, table in TABLES.items():
        if table.layer in layers and table.layer != "bronze":
            store.create(name, table.schema, table.partitions)


def rebuild(store: Store, entities: Iterable[Entity] = tuple(CURATED), clock: Column | None = None, invalid: bool = False) -> dict[str, dict[str, int]]:
    """Write current, history and the entity's share of the quarantine from the raw rows; rows by table."""
    create_tables(store, ["silver"])
    written = {}
    for e in entities:
        raw, passing = streams.raw_table(store, e), f"_judged_{e.name}_{uuid.uuid4().hex}"
        try:
            store.overwrite(passing, events.judge(raw, e))
            made = events.from_judged(store.read(passing), streams.stored_table(store, e), e, clock)
            wrong = made.quarantine.unionByName(events.invalid(raw, e, clock)) if invalid else made.quarantine
            store.overwrite(e.current_table, made.current)
            store.overwrite(e.history_table, made.history, ["processing_date"])
            store.replace_where(QUARANTINE_TABLE, wrong, "entity", e.name)
        finally:
            store.drop(passing)
        of_entity = store.read(QUARANTINE_TABLE).filter(F.col("entity") == e.name)
        written[e.name] = {"current": store.read(e.current_table).count(), "history": store.read(e.history_table).count(), "quarantine": of_entity.count()}
    return written


def build_marts(store: Store, clock: Column | None = None) -> None:
    """Write the four marts from the current tables."""
    o, p, r = (store.read(e.current_table) for e in CURATED)
    made = {
        "gold_daily_order_payment_summary": marts.daily_order_payment(o, p, r, clock), "gold_order_funnel_summary": marts.order_funnel(o, p, clock),
        "gold_payment_failure_summary": marts.payment_failures(p, clock), "gold_refund_summary": marts.refund_summary(o, r, clock),
    }
    for name, rows in made.items():
        store.overwrite(name, rows.select(*[F.col(f.name).cast(f.dataType) for f in MARTS[name]]), ["processing_date"])


def report(store: Store, source: Mapping[str, DataFrame]) -> DataFrame:
    """The checks over the store's tables and the source's."""
    current = {e.name: store.read(e.current_table) for e in CURATED}
    return quality.report(dict(source), streams.raw_rows(store), current, store.read(QUARANTINE_TABLE), {m: store.read(m) for m in MARTS})


def counts(store: Store, layer: str) -> DataFrame:
    """Rows of each table of a layer: table_name, n."""
    if layer == "bronze":
        found = {e.raw_table: streams.raw_table(store, e) for e in ENTITIES.values()}
    else:
        found = {n: store.read(n) for n, t in TABLES.items() if t.layer == layer and store.exists(n)}
    return quality.table_counts(found)


def register_views(store: Store) -> list[str]:
    """Views of all tables that exist, for ad-hoc queries; their names."""
    names = [n for n, t in TABLES.items() if t.layer != "bronze" and store.exists(n)]
    store.register(names)
    for e in ENTITIES.values():
        streams.raw_table(store, e).createOrReplaceTempView(e.raw_table)
    return [*names, *(e.raw_table for e in ENTITIES.values())]


def preview(log: DataFrame, rows: int = 5) -> DataFrame:
    """The first few records of a log, parsed."""
    from tidemark.functions import envelope

    parsed = envelope.parse(envelope.located(log)).withColumn("event_id", envelope.event_id(F.col("topic"), F.col("kafka_partition"), F.col("kafka_offset")))
    return parsed.select("event_id", "topic", "op", "source_table", "source_lsn").limit(rows)
