"""What the tables and their jobs keep on disk."""

import time

from pyspark.sql import functions as F

from tidemark.functions import envelope
from tidemark.model import LOG_RECORD, ORDERS, RAW_COLUMNS
from tidemark.operators import events
from tidemark.sources import log as logs
from tidemark.sources.store import Store
from tidemark.streaming import jobs

from test_events import CLOCK, record, rows


def _log(spark):
    """Stale events, deletes, duplicates (one with another text), full ties, keys without a log position, odd records."""
    spaced = '{ "op":"c", "after":{"order_id": 5,  "order_status":"\\u00e9\\n"}, "source":{"table":"orders", "lsn":7, "x":[1, {"y":null}]}, "ts_ms":"3", "transaction":{"id":"a b"}}'
    records = [
        record(0, lsn=10), record(1, lsn=30, status="LATE"), record(2, lsn=20), record(2, lsn=20), record(2, lsn=15, status="OTHER"), record(3, op="d", lsn=40), record(4, lsn=5, key=1, partition=1),
        record(5, key=2, lsn=None), record(6, key=2, lsn=8), record(7, key=2, lsn=1, op="d"), record(8, key=None, lsn=3), record(9, key="absent"), record(10, value=spaced), record(11, value="not json"),
        record(12, key=3, lsn=50), record(12, key=4, lsn=50), record(13, key=4, lsn=49), record(14, key=3, lsn=49, ts="soon"), record(15, table="strangers"),
    ]
    return spark.createDataFrame(records, LOG_RECORD)


def test_raw_rows_are_stored_once_and_read_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    want = envelope.raw_rows(_log(spark), F.expr(CLOCK))
    store.append_batch(jobs.RAW, envelope.stored_rows(_log(spark), F.expr(CLOCK)), "w", 0, jobs.RAW_PARTITIONS)
    assert set(store.read_batches(jobs.RAW).columns) - {"writer", "batch"} == set(envelope.STORED_COLUMNS) and "event_id" not in envelope.STORED_COLUMNS
    got = jobs.raw_rows(store)
    assert got.columns == RAW_COLUMNS and rows(got, *RAW_COLUMNS) == rows(want, *RAW_COLUMNS)
    store.append_batch(jobs.RAW, want, "w", 1, jobs.RAW_PARTITIONS)  # batches with all columns, of before
    assert rows(jobs.raw_rows(store), *RAW_COLUMNS) == sorted(2 * rows(want, *RAW_COLUMNS), key=repr)


def test_streams_store_raw_rows_without_what_follows(spark, tmp_path):
    _log(spark).write.parquet(str(tmp_path / "log"))
    store = Store(spark, str(tmp_path / "tables"))
    jobs.ingest(logs.file_stream(spark, str(tmp_path / "log")), store, str(tmp_path / "c"), clock=F.expr(CLOCK)).awaitTermination()
    assert not {"event_id", "after_json"} & set(store.read_batches(jobs.RAW).columns)
    assert rows(jobs.raw_rows(store), *RAW_COLUMNS) == rows(envelope.raw_rows(_log(spark), F.expr(CLOCK)), *RAW_COLUMNS)


def test_judged_events_give_the_same_tables(spark, tmp_path):
    store, clock = Store(spark, str(tmp_path)), F.expr(CLOCK)
    store.append_batch(jobs.RAW, envelope.stored_rows(_log(spark), clock), "w", 0, jobs.RAW_PARTITIONS)
    store.overwrite("judged", events.judge(jobs.raw_table(store, ORDERS), ORDERS))
    assert not {"key_json", "before_json", "after_json", "source_json", "event_id"} & set(store.read("judged").columns)
    got = events.from_judged(store.read("judged"), jobs.stored_table(store, ORDERS), ORDERS, clock)
    want = events.rebuild(envelope.raw_rows(_log(spark), clock).filter("source_table = 'orders'"), ORDERS, clock)
    for a, b in ((got.current, want.current), (got.history, want.history), (got.quarantine, want.quarantine)):
        assert a.columns == b.columns and rows(a, *a.columns) == rows(b, *b.columns)
    assert want.quarantine.count() == 5


def test_a_write_leaves_no_shuffle_files(spark, tmp_path):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: sum("shuffle_" in disk.getAllFiles().apply(i).getName() for i in range(disk.getAllFiles().size()))
    before = files()
    kept = spark.range(1000).withColumn("k", F.col("id") % 7).repartition("k")
    Store(spark, str(tmp_path)).overwrite("t", kept)
    end = time.time() + 20
    while files() > before and time.time() < end:
        time.sleep(0.2)
    assert files() <= before and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_a_merge_goes_through_some_buckets_at_a_time(spark, tmp_path):
    store, seen = Store(spark, str(tmp_path)), []
    place = lambda name, *r: spark.createDataFrame(list(r), "id long, v string").write.parquet(str(tmp_path / name)) or spark.read.parquet(str(tmp_path / name))

    def newest(old, new):
        seen.append(new.count())
        return old.join(new, "id", "left_anti").unionByName(new)

    first, second = place("a", *[(i, "a") for i in range(100)]), place("b", *[(i, "b") for i in range(50, 150)])
    store.merge("t", first, "id", newest, buckets=8, bytes_each=1)
    store.merge("t", second, "id", newest, buckets=8, bytes_each=1, batch=("q", 1))
    assert len(seen) == 16 and sum(seen) == 200 and store.version("t").number == 1 and store.holds("t", ("q", 1))
    assert rows(store.read("t"), "id", "v") == sorted([(i, "a") for i in range(50)] + [(i, "b") for i in range(50, 150)], key=repr)
    store.overwrite("w", first)  # not in buckets yet
    store.merge("w", second, "id", newest, buckets=4, bytes_each=1)
    assert rows(store.read("w"), "id", "v") == rows(store.read("t"), "id", "v") and len(store.version("w").folders) == 4


def test_log_files_go_when_they_are_taken_in(spark, tmp_path, monkeypatch):
    from tidemark.plans import catalog

    monkeypatch.setattr(catalog, "_place", lambda spark: str(tmp_path))
    store, _ = catalog._ingested(spark, "/root/testdata/sf0.001")
    assert not (tmp_path / "log").exists() and store.read_batches(jobs.RAW).select("source_table").distinct().count() == 6
