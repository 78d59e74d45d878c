"""Edge rows of the change log, written as literals."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import envelope
from tidemark.model import LOG_RECORD, ORDERS, RAW_COLUMNS, TABLES
from tidemark.operators import events, quality, upsert

CLOCK = "timestamp '2024-05-01 12:00:00'"


def record(offset, op="c", lsn=None, key=1, partition=0, table="orders", ts=1000, tx=1, status="PAID", amount="10.00", value=None, **more):
    image = None if key == "absent" else {"order_id": key, "customer_id": 7, "order_status": status, "total_amount": amount, "ordered_at": "2024-01-02T03:04:05Z"} | more
    body = {"before": image if op == "d" else None, "after": None if op == "d" else image, "source": {"table": table, "lsn": lsn, "txId": tx}, "op": op, "ts_ms": ts, "transaction": None}
    return (json.dumps({"order_id": key}), json.dumps(body) if value is None else value, f"cdc.public.{table}", partition, offset, datetime(2024, 1, 1))


@pytest.fixture
def raw(spark):
    def make(*records):
        return envelope.raw_rows(spark.createDataFrame(list(records), LOG_RECORD), F.expr(CLOCK))

    return make


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_envelope(raw):
    got = raw(record(0, lsn=5), record(1, table="strangers"), record(2, ts="soon"), record(3, value="not json"), ("k", None, "t", 0, 4, datetime(2024, 1, 1)))
    assert got.columns == RAW_COLUMNS
    assert rows(got, "kafka_offset", "op", "source_lsn", "event_ts") == [(0, "c", 5, datetime(1970, 1, 1, 0, 0, 1)), (2, "c", None, None)]
    first = got.filter("kafka_offset = 0").first()
    assert first.transaction_json is None and first.before_json is None and json.loads(first.after_json)["customer_id"] == 7
    import hashlib

    assert first.event_id == hashlib.sha256(b"cdc.public.orders:0:0").hexdigest()


def test_null_key_overflow_and_delete_image(raw):
    parsed = events.parse(raw(record(0, key=None), record(1, key="absent"), record(2, key=2, amount="99999999999.99"), record(3, op="d", key=3)), ORDERS)
    assert rows(parsed, "order_id", "total_amount", "is_deleted") == [(2, None, False), (3, parsed.filter("order_id = 3").first().total_amount, True)]
    gone = parsed.filter("is_deleted").first()
    assert gone.customer_id == 7 and gone.deleted_at == gone.event_ts


def test_staleness_is_strict_and_skips_nulls(raw):
    got = events.classify(raw(record(0, lsn=None), record(1, lsn=10), record(2, lsn=10), record(3, lsn=9), record(4, lsn=None), record(5, lsn=11)), ORDERS)
    assert rows(got, "kafka_offset", "is_stale", "previous_max_source_lsn") == [(0, False, None), (1, False, None), (2, False, 10), (3, True, 10), (4, False, 10), (5, False, 10)]
    done = events.from_classified(got, ORDERS, F.expr(CLOCK))
    assert rows(done.current, "order_id", "kafka_offset") == [(1, 5)]
    assert rows(done.quarantine, "entity", "primary_key", "reason", "source_lsn") == [("orders", "1", "STALE_SOURCE_LSN", 9)]
    assert done.history.count() == 5


def test_duplicates_and_reinsert_after_delete(raw):
    got = events.rebuild(raw(record(0, lsn=1), record(0, lsn=1), record(1, op="d", lsn=2), record(2, lsn=3, status="CREATED")), ORDERS)
    assert rows(got.current, "order_id", "order_status", "is_deleted") == [(1, "CREATED", False)]
    assert got.history.count() == 3
    gone = events.with_delete_event(events.rebuild(raw(record(0), record(1, op="d", lsn=9)), ORDERS).current).first()
    assert gone.is_deleted and gone.delete_event_id == gone.event_id


def test_one_shuffle_classifies(raw):
    plan = events.classify(raw(record(0)), ORDERS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def _random_log(seed):
    rng = random.Random(seed)
    out = []
    for offset in range(80):
        key = rng.randint(1, 6)
        out.append(record(offset, op=rng.choice("cuud"), lsn=rng.choice([None, *range(1, 60)]), key=key, partition=key % 3, ts=rng.randint(1, 50), tx=rng.randint(1, 9), status=f"S{offset}"))
    return out + rng.sample(out, 5)


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_equal_rebuild(spark, raw, seed):
    log = _random_log(seed)
    whole = events.rebuild(raw(*log), ORDERS, F.expr(CLOCK))
    log.sort(key=lambda r: r[4])
    have, stale = spark.createDataFrame([], TABLES[ORDERS.current_table].schema), []
    for lo, hi in ((0, 17), (17, 18), (18, 60), (60, 99)):
        batch = raw(*log[lo:hi])
        stale += rows(upsert.batch_quarantine(batch, ORDERS, have, F.expr(CLOCK)), "kafka_offset", "previous_max_source_lsn")
        have = upsert.upsert(have, upsert.batch_updates(batch, ORDERS, F.expr(CLOCK)), "order_id").checkpoint()
    names = [c for c in whole.current.columns if c != "silver_updated_at"]
    assert rows(have, *names) == rows(whole.current, *names)
    assert {o for o, _ in stale} >= {o for (o,) in rows(whole.quarantine, "kafka_offset")}


def test_upsert_keeps_the_target_on_ties(spark, raw):
    one = events.current(events.parse(raw(record(0, lsn=5, status="OLD")), ORDERS), ORDERS)
    same = events.current(events.parse(raw(record(0, lsn=5, status="NEW")), ORDERS), ORDERS)
    newer = events.current(events.parse(raw(record(1, lsn=6, status="NEWER"), record(2, key=9)), ORDERS), ORDERS)
    assert rows(upsert.upsert(one, same, "order_id"), "order_status") == [("OLD",)]
    assert rows(upsert.upsert(one, newer, "order_id"), "order_id", "order_status") == [(1, "NEWER"), (9, "PAID")]


def test_transitions(raw):
    past = events.rebuild(raw(record(0, lsn=1, status="CREATED"), record(1, lsn=2, status="PENDING_PAYMENT"), record(2, lsn=3, status="REFUNDED"), record(3, lsn=4, status="REFUNDED")), ORDERS).history
    assert rows(events.transitions(past, ORDERS), "from_status", "to_status", "allowed") == [("CREATED", "PENDING_PAYMENT", True), ("PENDING_PAYMENT", "REFUNDED", False)]


def test_check_framework(spark):
    facts = quality._beside([quality._n(spark.range(n), f"f{n}") for n in (0, 3, 2)])
    zero = F.lit(0)
    report = facts.select(F.inline(F.array(quality._check("a", "f0", zero, ""), quality._check("b", "f3", zero, ""), quality._check("c", "f3", F.col("f2") + 1, ""), quality._check("d", "f3", None, "", info=True))))
    assert rows(report, "name", "status", "observed") == [("a", "PASS", 0), ("b", "FAIL", 3), ("c", "PASS", 3), ("d", "INFO", 3)]
    assert rows(quality.failed(report), "name") == [("b",)]
