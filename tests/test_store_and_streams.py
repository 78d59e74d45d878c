import logging
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.model import LOG_RECORD, ORDERS, PAYMENTS, STALE
from tidemark.operators import events, marts
from tidemark.session import DEFAULTS, FILE_VARIABLE, Settings, logger, settings
from tidemark.sources import log as logs
from tidemark.sources.store import Conflict, Store, split_statements
from tidemark.streaming import jobs

from test_events import CLOCK, record, rows


def test_snapshots(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert not store.exists("t")
    with pytest.raises(LookupError):
        store.read("t")
    store.overwrite("t", spark.createDataFrame([(1, "a"), (2, "b")], "id int, entity string"))
    store.overwrite("t", store.read("t").filter("id > 1"))  # reads what it replaces
    assert rows(store.read("t"), "id") == [(2,)]
    store.replace_where("t", spark.createDataFrame([(3, "a")], "id int, entity string"), "entity", "a")
    assert rows(store.read("t"), "id") == [(2,), (3,)]
    store.replace_where("t", store.read("t").limit(0), "entity", "a")  # an empty replacement clears
    assert rows(store.read("t"), "id") == [(2,)]
    store.delete_all("t")
    assert store.read("t").count() == 0
    store.create("u", ORDERS.record)
    store.register(["u"])
    assert spark.table("u").columns == ORDERS.columns


def test_failed_write_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.overwrite("t", spark.range(3))
    with pytest.raises(Exception):
        store.overwrite("t", spark.range(3).select(F.raise_error(F.lit("no")).alias("id")))
    assert store.read("t").count() == 3


def test_script():
    assert split_statements("select ';' -- a; b\n; select 2;;\n select \"x;y\"") == ["select ';'", "select 2", 'select "x;y"']


def test_stream_twice_gives_the_same(spark, tmp_path):
    place, store = str(tmp_path / "log"), Store(spark, str(tmp_path / "tables"))
    write = lambda *r: spark.createDataFrame(list(r), LOG_RECORD).write.mode("append").parquet(place)
    clock = F.expr(CLOCK)

    def run():
        jobs.ingest(logs.file_stream(spark, place), store, str(tmp_path / "c1"), clock=clock).awaitTermination()
        jobs.maintain_current(jobs.raw_stream(store, ORDERS), ORDERS, store, str(tmp_path / "c2"), clock=clock, quarantine_table="quarantine").awaitTermination()
        return rows(store.read(ORDERS.current_table), "order_id", "order_status", "is_deleted"), store.read_batches(jobs.RAW).count()

    write(record(0, lsn=10), record(4, key=2, lsn=20))
    assert run() == ([(1, "PAID", False), (2, "PAID", False)], 2)
    assert run() == ([(1, "PAID", False), (2, "PAID", False)], 2)
    write(record(1, lsn=5, status="LATE"), record(5, op="d", key=2, lsn=30))
    assert run() == ([(1, "PAID", False), (2, "PAID", True)], 4)
    assert rows(store.read_batches("quarantine"), "primary_key", "reason") == [("1", STALE)]
    whole = events.rebuild(jobs.raw_table(store, ORDERS), ORDERS, clock)
    assert rows(whole.current, "order_id", "is_deleted") == [(1, False), (2, True)]


def test_seed_marts(spark):
    """Three orders on three days, by hand."""
    day = [datetime(2024, 1, d) for d in (1, 2, 3)]
    null = lambda *names: {n: F.lit(None).cast("timestamp") for n in names}
    orders = spark.createDataFrame([(1, "PAID", day[0], False), (2, "PENDING_PAYMENT", day[1], False), (3, "REFUNDED", day[2], False)], "order_id long, order_status string, ordered_at timestamp, is_deleted boolean")
    orders = orders.withColumns(null("created_at", "updated_at", "silver_updated_at"))
    payments = spark.createDataFrame([(1, "CAPTURED", Decimal(21000), Decimal(21000)), (2, "REQUESTED", Decimal(9000), None), (3, "CAPTURED", Decimal(15000), None)], "order_id long, payment_status string, requested_amount decimal(12,2), approved_amount decimal(12,2)").withColumn("is_deleted", F.lit(False))
    refunds = spark.createDataFrame([(3, "COMPLETED", Decimal(15000))], "order_id long, refund_status string, refund_amount decimal(12,2)").withColumn("is_deleted", F.lit(False)).withColumns(null("completed_at", "approved_at", "updated_at", "silver_updated_at")).withColumn("requested_at", F.lit(day[2]))
    m = marts.daily_order_payment(orders, payments, refunds, F.expr(CLOCK))
    got = rows(m.withColumn("day", F.dayofmonth("summary_date")), "day", "paid_order_count", "payment_success_order_count", "payment_success_amount", "refund_count", "refund_amount", "refund_rate")
    assert got == [(1, 1, 1, Decimal("21000.00"), 0, Decimal("0.00"), 0.0), (2, 0, 0, Decimal("0.00"), 0, Decimal("0.00"), 0.0), (3, 1, 1, Decimal("15000.00"), 1, Decimal("15000.00"), 1.0)]
    s = marts.refund_summary(orders, refunds, F.expr(CLOCK)).first()
    assert (s.refund_count, s.affected_order_count, round(s.refund_rate, 4)) == (1, 1, 0.3333)
    assert marts.refund_summary(orders.limit(0), refunds).first().refund_rate == 0.0


def test_settings(tmp_path):
    assert settings(env={}).topics[0] == "cdc.public.customers" and DEFAULTS.exists()
    file = tmp_path / "s.json"
    file.write_text('{"brokers": "a:1", "topics": ["x", "y"], "fail_on_data_loss": "Yes"}')
    got = settings(env={FILE_VARIABLE: str(file), "KAFKA_BOOTSTRAP_SERVERS": "b:2", "S3_SSL_ENABLED": "Yes", "POSTGRES_HOST": "h", "POSTGRES_DB": "d", "ICEBERG_CATALOG_NAME": "c"})
    assert (got.brokers, got.s3_ssl, got.fail_on_data_loss, got.under(got.checkpoints, "j"), got.tables) == ("b:2", True, True, "checkpoints/j", "warehouse/c")
    assert got.jdbc["url"] == "jdbc:postgresql://h:5432/d"
    assert logs._options(got, endingOffsets="latest") == {"kafka.bootstrap.servers": "b:2", "subscribe": "x,y", "startingOffsets": "earliest", "failOnDataLoss": "true", "endingOffsets": "latest"}
    with pytest.raises(ValueError):
        logs._options(Settings())
    file.write_text('{"colour": 1}')
    with pytest.raises(ValueError):
        settings(str(file), {})


def test_logger_writes_each_line_once():
    for _ in range(3):
        logger("one")
    handlers = [h for h in logger("one").parent.handlers if type(h) is logging.StreamHandler]
    assert len(handlers) == 1 and not logger("one").handlers


def test_two_writers(spark, tmp_path):
    """The second of two writes that began with the same version fails and changes nothing."""
    store = Store(spark, str(tmp_path))
    store.overwrite("t", spark.range(1))
    since = store.version("t")
    store.overwrite("t", spark.range(2))
    with pytest.raises(Conflict):
        store.overwrite("t", spark.range(3), since=since)
    assert store.read("t").count() == 2
    new = store.version("none")
    store.create("u", spark.range(0).schema)
    assert new is None and store.read("u").count() == 0


def test_merge_rewrites_only_what_it_touches(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    newest = lambda old, new: old.join(new, "id", "left_anti").unionByName(new)
    rows = lambda *r: spark.createDataFrame(list(r), "id long, v string")
    store.create("t", rows().schema)
    store.merge("t", rows(*[(i, "a") for i in range(100)]), "id", newest, buckets=8)
    before = store.version("t").folders
    store.merge("t", rows((3, "b")), "id", newest, buckets=8, batch=("q", 4))
    after = store.version("t").folders
    assert sorted(before) == sorted(after) and sum(before[k] != after[k] for k in before) == 1
    assert store.read("t").count() == 100 and [r.id for r in store.read("t").filter("v = 'b'").collect()] == [3]
    store.merge("t", rows(), "id", newest, buckets=8)
    assert store.version("t").folders == after and store.holds("t", ("q", 4)) and not store.holds("t", ("q", 5)) and not store.holds("t", ("p", 0))
    assert store.vacuum("t", keep=1) >= 2
    assert store.read("t").count() == 100 and store.vacuum("t", keep=1) == 0


def test_fresh_checkpoint_keeps_what_is_stored(spark, tmp_path):
    store = Store(spark, str(tmp_path / "tables"))
    for k, offset in enumerate((0, 4)):
        place = str(tmp_path / f"log{k}")
        spark.createDataFrame([record(offset, key=k + 1, lsn=10)], LOG_RECORD).write.parquet(place)
        jobs.ingest(logs.file_stream(spark, place), store, str(tmp_path / f"c{k}"), clock=F.expr(CLOCK)).awaitTermination()
    assert rows(jobs.raw_rows(store), "kafka_offset") == [(0,), (4,)]


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    """As after a crash between the snapshot and the checkpoint: the commit of the batch is taken back."""
    place, store, clock = str(tmp_path / "log"), Store(spark, str(tmp_path / "tables")), F.expr(CLOCK)
    write = lambda *r: spark.createDataFrame(list(r), LOG_RECORD).write.mode("append").parquet(place)

    def run():
        jobs.ingest(logs.file_stream(spark, place), store, str(tmp_path / "c1"), clock=clock).awaitTermination()
        jobs.maintain_current(jobs.raw_stream(store, ORDERS), ORDERS, store, str(tmp_path / "c2"), clock=clock, quarantine_table="q").awaitTermination()

    write(record(0, lsn=10))
    run()
    write(record(1, lsn=20, status="PAID"), record(2, lsn=30, status="LATE"))
    run()
    table = rows(store.read(ORDERS.current_table), "order_id", "order_status", "source_lsn")
    wrong = rows(store.read_batches("q"), "primary_key", "kafka_offset")
    number = store.version(ORDERS.current_table).number
    commits = sorted(p for p in (tmp_path / "c2" / "commits").iterdir() if p.name.isdigit())
    for f in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        f.unlink()  # else Spark takes the rest for another writer's
    run()
    assert rows(store.read(ORDERS.current_table), "order_id", "order_status", "source_lsn") == table == [(1, "LATE", 30)]
    assert rows(store.read_batches("q"), "primary_key", "kafka_offset") == wrong and store.version(ORDERS.current_table).number == number


def test_two_entities_share_a_quarantine(spark, tmp_path):
    import json

    store, place, clock = Store(spark, str(tmp_path / "tables")), str(tmp_path / "log"), F.expr(CLOCK)
    pay = []
    for r in (record(0, lsn=50), record(1, lsn=5)):
        value = json.loads(r[1])
        value["source"]["table"], value["after"] = "payments", {"payment_id": 9, "payment_status": "REQUESTED"}
        pay.append((r[0], json.dumps(value), "cdc.public.payments", *r[3:]))
    spark.createDataFrame([record(0, lsn=50), record(1, lsn=5), *pay], LOG_RECORD).write.parquet(place)
    jobs.ingest(logs.file_stream(spark, place), store, str(tmp_path / "c"), clock=clock).awaitTermination()
    for e in (ORDERS, PAYMENTS):
        jobs.maintain_current(jobs.raw_stream(store, e), e, store, str(tmp_path / e.name), clock=clock, quarantine_table="q").awaitTermination()
    assert rows(store.read_batches("q"), "entity", "primary_key") == [("orders", "1"), ("payments", "9")]
