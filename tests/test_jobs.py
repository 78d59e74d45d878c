"""The jobs through their command line, from a log in files to the checks."""

import pytest
from pyspark.sql import functions as F

from tidemark import jobs
from tidemark.jobs.__main__ import main
from tidemark.model import CURATED, MARTS, ORDERS, QUARANTINE_TABLE, TABLES
from tidemark.session import Settings, logger
from tidemark.sources import fixtures
from tidemark.sources.store import Store, split_statements

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    """Settings, store and command line after all jobs have run once."""
    base = tmp_path_factory.mktemp("lake")
    conf = Settings(warehouse=f"{base}/warehouse", checkpoints=f"{base}/checkpoints")
    run = lambda *args: main(list(args), spark, conf)
    assert run("generate", SF, f"{base}/log") == 0
    assert run("bronze", "--once", "--log", f"{base}/log", "--checkpoint-name", "first") == 0
    assert run("rebuild") == run("marts") == 0
    return conf, Store(spark, conf.tables), run, base


def test_tables(lake):
    conf, store, _, base = lake
    n = {r.table_name: r.n for layer in ("bronze", "silver", "gold") for r in jobs.counts(store, layer).collect()}
    assert n.keys() == TABLES.keys() and all(n.values())
    assert (base / "checkpoints" / "first").exists()
    for name, table in TABLES.items():
        if table.layer != "bronze":
            assert [(f.name, f.dataType) for f in store.read(name).schema] == [(f.name, f.dataType) for f in table.schema], name


def test_rebuild_of_one_entity_keeps_the_others(spark, lake):
    _, store, run, _ = lake
    before = sorted(map(tuple, store.read(QUARANTINE_TABLE).groupBy("entity").count().collect()))
    assert len(before) == 3
    assert run("rebuild", "orders") == 0 and run("rebuild", "tables") == 2
    assert sorted(map(tuple, store.read(QUARANTINE_TABLE).groupBy("entity").count().collect())) == before
    assert run("rebuild", "--invalid", "orders") == 0
    reasons = {r.reason for r in store.read(QUARANTINE_TABLE).select("reason").distinct().collect()}
    assert reasons == {"STALE_SOURCE_LSN", "INVALID_EVENT"} and run("rebuild", "orders") == 0


def test_incremental_equals_rebuild(lake):
    _, store, run, _ = lake
    columns = ["order_id", "order_status", "source_lsn", "is_deleted"]
    want = sorted(map(tuple, store.read(ORDERS.current_table).select(*columns).collect()))
    store.delete_all(ORDERS.current_table)
    assert run("incremental", "--once", "--entity", "orders", "--quarantine") == 0
    assert sorted(map(tuple, store.read(ORDERS.current_table).select(*columns).collect())) == want
    assert store.read_batches(f"{QUARANTINE_TABLE}_stream").count() > 0
    assert run("rebuild", "orders") == 0


def test_checks_end_with_1_on_failure(spark, lake, capfd):
    _, store, run, base = lake
    states = {"orders": fixtures.orders_state(spark, SF), "payments": fixtures.payments_state(spark, SF), "refunds": fixtures.refunds_state(spark, SF)}
    for name, rows in states.items():
        rows.filter("not is_deleted").write.mode("overwrite").parquet(f"{base}/source/{name}.parquet")
    fixtures.items_state(spark, SF).write.mode("overwrite").parquet(f"{base}/source/order_items.parquet")
    assert run("checks", "--source", f"{base}/source") == 1
    assert "source.orders_total_amount_matches_order_items" in capfd.readouterr().err
    empty = Store(spark, f"{base}/empty")
    jobs.create_tables(empty)
    source = {n: t.limit(0) for n, t in states.items()} | {"order_items": fixtures.items_state(spark, SF).limit(0)}
    found = jobs.report(empty, source).collect()
    assert len(found) == 24 and {r.status for r in found} == {"PASS", "INFO"}


def test_script_of_the_tables(spark, lake):
    conf, store, run, _ = lake
    script = "".join(jobs.ddl(layer) for layer in ("bronze", "silver", "gold"))
    assert len(split_statements(script)) == len(TABLES) + 3
    assert run("ddl") == 0
    try:
        for name, table in TABLES.items():
            made = spark.table(f"{table.layer}.{name}")
            assert {f.name: f.dataType for f in made.schema} == {f.name: f.dataType for f in table.schema}
            assert spark.catalog.listColumns(f"{table.layer}.{name}")
    finally:
        for layer in ("bronze", "silver", "gold"):
            spark.sql(f"DROP DATABASE {layer} CASCADE")


def test_views_preview_and_upkeep(spark, lake, caplog, monkeypatch):
    conf, store, run, base = lake
    monkeypatch.setattr(logger("counts").parent, "propagate", True)
    caplog.set_level("INFO")
    assert len(jobs.register_views(store)) == len(TABLES)
    assert spark.sql("select count(*) n from silver_orders_current where is_deleted").first().n > 0
    assert spark.table("bronze_customers_cdc").filter(F.col("source_table") != "customers").count() == 0
    assert run("smoke", "--log", f"{base}/log") == run("counts", "gold") == 0
    assert "system_check" in caplog.text and all(m in caplog.text for m in MARTS)
    rows = store.read(ORDERS.current_table).count()
    assert run("vacuum", "--keep", "1") == 0 and store.read(ORDERS.current_table).count() == rows
    assert {e.name for e in CURATED} == {"orders", "payments", "refunds"}
