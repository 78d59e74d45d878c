"""A deterministic change log and current-state tables derived from the provided star schema.

Integer rules only, so that any SQL engine can restate them. The log goes through the
same JSON encoding as captured changes; the state tables feed marts and checks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _start() -> Column:
    """When masters and odd records begin."""
    return F.expr("timestamp '2023-01-01 00:00:00'")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(rows: DataFrame) -> DataFrame:
    """Rows that fewer tasks would read than there are cores, dealt out, as a log's many partitions would be.

    Large files stay as they are: Spark splits them, and dealing them out would write them to disk once more.
    """
    spark = rows.sparkSession
    n, leaves = spark.sparkContext.defaultParallelism, rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return rows.repartition(n) if size < n * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() and len(rows.inputFiles()) < n else rows


def _log(events: DataFrame, table: str, record: dict[str, Column]) -> DataFrame:
    """Records from rows with id, e, op, lsn, tx, ts (timestamp): partition id % 3, offset 4 * id + e."""
    _e = F.col("e")
    millis = F.unix_millis("ts")
    source = F.struct(F.lit(table).alias("table"), F.col("lsn"), F.col("tx").alias("txId"), F.lit("postgresql").alias("connector"))
    image = F.struct(*[c.alias(k) for k, c in record.items()])
    value = F.to_json(
        F.struct(
            F.when(F.col("op") == "d", image).alias("before"), F.when(F.col("op") != "d", image).alias("after"), source.alias("source"), F.col("op"), millis.alias("ts_ms"), F.lit(None).cast("string").alias("transaction")
        ),
        {"ignoreNullFields": "false"},
    )
    return events.select(
        F.to_json(F.struct(F.col("id"))).alias("key"), value.alias("value"), F.lit(f"cdc.public.{table}").alias("topic"),
        (F.col("id") % 3).cast("int").alias("partition"), (F.col("id") * 4 + _e).alias("offset"), F.col("ts").alias("timestamp"),
    )


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    _k = F.col("k")
    o = _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("st"), F.col("o_totalprice").cast("decimal(12,2)").alias("amount"),
        F.col("o_orderdate").cast("timestamp").alias("day"), F.col("o_orderpriority").alias("priority"),
    )
    final = F.when(F.col("st") == "F", "PAID").when(F.col("st") == "O", "CANCELLED").when(_k % 2 == 0, "REFUNDED").otherwise("PENDING_PAYMENT")
    return o.withColumn("final", final)


def _expanded(rows: DataFrame, deleted: Column, third: Column, base: int, most: int = 2) -> DataFrame:
    """Up to three events for each id, with operation and log position; e = 0 twice where id % 13 = 0."""
    _e = F.col("e")
    numbers = F.when(third, F.array(*map(F.lit, (0, 1, 2)))).otherwise(F.array(*map(F.lit, range(most))))
    e = _spread(rows).withColumn("e", F.explode(numbers))
    copies = F.when((_e == 0) & (F.col("id") % 13 == 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    e = e.withColumn("_copy", F.explode(copies)).drop("_copy")
    op = F.when(_e == 0, F.when(F.col("id") % 5 == 0, "r").otherwise("c")).when((_e == 2) & deleted, "d").otherwise("u")
    at = base + F.col("id") * 40
    lsn = F.when((_e == 1) & (F.col("id") % 17 == 0), F.lit(None).cast("bigint")).when((_e == 1) & (F.col("id") % 11 == 0), at - 15).otherwise(at + _e * 10)
    return e.withColumns({"op": op, "lsn": lsn, "tx": F.col("id") * 3 + _e, "ts": F.timestamp_seconds(F.unix_seconds("day") + _e * 60)})


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    _k, _e = F.col("k"), F.col("e")
    rows = _orders(spark, sf_dir).withColumn("id", _k)
    e = _expanded(rows, _k % 7 == 0, (_k % 2 == 1) | (_k % 7 == 0), 1000)
    status = F.when(_e == 0, "CREATED").when(_e == 1, "PENDING_PAYMENT").otherwise(F.col("final"))
    record = {"order_id": _k, "customer_id": F.col("cust"), "order_status": status, "currency": F.lit("KRW"), "total_amount": F.col("amount").cast("string"), "ordered_at": F.date_format("day", "yyyy-MM-dd'T'HH:mm:ss'Z'")}
    return _log(e, "orders", record).unionByName(_keyless(spark, sf_dir, record))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few rows for odd records: id is null, r counts."""
    r = _read(spark, sf_dir, "region").select(F.lit(None).cast("bigint").alias("id"), F.col("r_regionkey").cast("bigint").alias("r"))
    return r.withColumns({"e": F.lit(0), "op": F.lit("u"), "lsn": F.col("r"), "tx": F.col("r"), "ts": _start()})


def _placed(rows: DataFrame, base: int, r: str = "r") -> DataFrame:
    return rows.withColumns({"partition": F.lit(0), "offset": F.lit(base).cast("bigint") + F.col(r)}).drop(r)


def _keyless(spark: SparkSession, sf_dir: str, record: dict[str, Column]) -> DataFrame:
    """Events of orders whose record has no key."""
    image = {name: F.lit("CREATED" if name == "order_status" else "KRW" if name == "currency" else None) for name in record}
    rows = _log(_numbered(spark, sf_dir), "orders", image | {"order_id": F.lit(None).cast("bigint")})
    return _placed(rows.withColumn("r", F.get_json_object("value", "$.source.lsn").cast("bigint")), 900_000_000_000)


def odd_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the raw layer doesn't take: tombstones, a table that isn't known, text that isn't JSON."""
    plain = _numbered(spark, sf_dir).select(F.lit("{}").alias("key"), F.lit("cdc.public.orders").alias("topic"), F.col("ts").alias("timestamp"), "r")
    values = (F.lit(None).cast("string"), F.lit('{"op":"c","source":{"table":"regions","lsn":1,"txId":1},"ts_ms":1}'), F.lit('{"op":"c","source":{"table":"orders"'))
    parts = [_placed(plain.withColumn("value", v), 910_000_000_000 + k * 1000).select("key", "value", "topic", "partition", "offset", "timestamp") for k, v in enumerate(values)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def customer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name", _start().alias("day"))
    e = _expanded(rows, F.lit(False), F.lit(False), 1000)
    return _log(e, "customers", {"customer_id": F.col("id"), "customer_name": F.col("c_name"), "customer_status": F.lit("ACTIVE")})


def product_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", F.col("p_retailprice").cast("decimal(12,2)").cast("string").alias("price"), _start().alias("day"))
    e = _expanded(rows, F.lit(False), F.lit(False), 1000, 1)
    return _log(e, "products", {"product_id": F.col("id"), "product_name": F.col("p_name"), "unit_price": F.col("price")})


def item_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").cast("decimal(12,2)").cast("string").alias("amount"), _start().alias("day"))
    e = _expanded(rows, F.lit(False), F.lit(False), 1000, 1)
    return _log(e, "order_items", {"order_item_id": F.col("id"), "order_id": F.col("k"), "product_id": F.col("part"), "item_amount": F.col("amount")})


def payment_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    _k, _e = F.col("k"), F.col("e")
    rows = payments_state(spark, sf_dir).withColumns({"id": F.col("payment_id"), "k": F.col("order_id"), "day": F.col("requested_at")})
    e = _expanded(rows, _k % 7 == 0, _k % 7 == 0, 1000)
    status = F.when(_e == 0, "REQUESTED").otherwise(F.col("payment_status"))
    approved = F.when(_e > 0, F.col("approved_amount").cast("string"))
    record = {
        "payment_id": F.col("payment_id"), "order_id": _k, "payment_status": status, "payment_method": F.col("payment_method"), "requested_amount": F.col("requested_amount").cast("string"),
        "approved_amount": approved, "failure_code": F.when(_e > 0, F.col("failure_code")), "requested_at": F.date_format("day", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    }
    return _log(e, "payments", record)


def refund_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    _k, _e = F.col("k"), F.col("e")
    rows = refunds_state(spark, sf_dir).withColumns({"id": F.col("refund_id"), "k": F.col("order_id"), "day": F.col("requested_at")})
    e = _expanded(rows, _k % 19 == 0, _k % 19 == 0, 1000)
    status = F.when(_e == 0, "REQUESTED").otherwise(F.col("refund_status"))
    record = {"refund_id": F.col("refund_id"), "payment_id": F.col("payment_id"), "order_id": _k, "refund_status": status, "refund_amount": F.col("refund_amount").cast("string"), "requested_at": F.date_format("day", "yyyy-MM-dd'T'HH:mm:ss'Z'")}
    return _log(e, "refunds", record)


#: The log of each entity.
LOGS = {"customers": customer_log, "products": product_log, "orders": order_log, "order_items": item_log, "payments": payment_log, "refunds": refund_log}


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs of all entities, and the odd records."""
    return reduce(DataFrame.unionByName, [*(log(spark, sf_dir) for log in LOGS.values()), odd_log(spark, sf_dir)])


def _times(*names: str) -> dict[str, Column]:
    return {n: F.lit(None).cast("timestamp") for n in names}


def orders_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    _k = F.col("k")
    o = _orders(spark, sf_dir)
    rows = o.select(_k.alias("order_id"), F.col("cust").alias("customer_id"), F.col("final").alias("order_status"), F.lit("KRW").alias("currency"), F.col("amount").alias("total_amount"), F.col("day").alias("ordered_at"), (_k % 7 == 0).alias("is_deleted"))
    return rows.withColumns(_times("created_at", "updated_at", "silver_updated_at"))


def payments_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    _k = F.col("k")
    j = F.col("j")
    o = _orders(spark, sf_dir).withColumn("j", F.explode(F.when(_k % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    first = F.when((F.col("st") == "F") & (_k % 6 == 5), "APPROVED").when(F.col("st") == "F", "CAPTURED").when(F.col("st") == "O", "FAILED").when(_k % 2 == 0, "CAPTURED").otherwise("APPROVED")
    o = o.withColumn("payment_status", F.when(j == 1, F.when(_k % 8 == 0, "CAPTURED").otherwise("FAILED")).otherwise(first))
    method = F.element_at(F.array(*map(F.lit, ("CARD", "BANK_TRANSFER", "POINT", "VIRTUAL_ACCOUNT")), F.lit(None)), F.substring("priority", 1, 1).cast("int"))
    asked = (F.col("amount") + F.when((j == 1) & (_k % 16 == 0), F.lit(100)).otherwise(F.lit(0))).cast("decimal(12,2)")
    rows = o.withColumns({"payment_id": _k * 2 + j, "requested_amount": asked}).select(
        "payment_id", _k.alias("order_id"), "payment_status", method.alias("payment_method"), "requested_amount",
        F.when(F.col("payment_status").isin("APPROVED", "CAPTURED") & (_k % 9 != 0), F.col("requested_amount")).alias("approved_amount"),
        F.when((F.col("payment_status") == "FAILED") & (_k % 3 == 1), "CARD_DECLINED").when((F.col("payment_status") == "FAILED") & (_k % 3 == 2), "LIMIT_EXCEEDED").alias("failure_code"),
        F.col("day").alias("requested_at"), F.col("day").alias("failed_at"), (_k % 7 == 0).alias("is_deleted"),
    )
    return rows.withColumns(_times("updated_at", "silver_updated_at"))


def refunds_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    _k = F.col("k")
    returned = _read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("k"))
    r = returned.agg(F.max("l_extendedprice").cast("decimal(12,2)").alias("refund_amount"), F.max("l_shipdate").cast("timestamp").alias("requested_at"))
    status = F.element_at(F.array(*map(F.lit, ("COMPLETED", "REQUESTED", "APPROVED", "REJECTED"))), (_k % 4 + 1).cast("int"))
    rows = r.select(_k.alias("refund_id"), (_k * 2).alias("payment_id"), _k.alias("order_id"), status.alias("refund_status"), "refund_amount", "requested_at", (_k % 19 == 0).alias("is_deleted"))
    return rows.withColumns(_times("completed_at", "approved_at", "updated_at", "silver_updated_at"))


def items_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_extendedprice").cast("decimal(12,2)").alias("item_amount"))
