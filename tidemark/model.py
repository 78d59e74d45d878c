"""Entities of the change log: record schemas, keys, value sets and allowed transitions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_TYPES = {"id": T.LongType(), "text": T.StringType(), "amount": T.DecimalType(12, 2), "count": T.IntegerType(), "time": T.TimestampType()}


def _record(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


@dataclass(frozen=True)
class Entity:
    """One captured table. Entities with ``curated`` get current, history and quarantine tables."""

    name: str
    key: str
    record: T.StructType
    curated: bool = False
    status: str | None = None
    transitions: frozenset[tuple[str, str]] = field(default_factory=frozenset)

    @property
    def columns(self) -> list[str]:
        return self.record.fieldNames()

    @property
    def raw_table(self) -> str:
        return f"bronze_{self.name}_cdc"

    @property
    def current_table(self) -> str:
        return f"silver_{self.name}_current"

    @property
    def history_table(self) -> str:
        return f"silver_{self.name}_history"


ORDERS = Entity(
    "orders",
    "order_id",
    _record(order_id="id", customer_id="id", order_status="text", currency="text", total_amount="amount", ordered_at="time", created_at="time", updated_at="time"),
    curated=True,
    status="order_status",
    transitions=frozenset({("CREATED", "PENDING_PAYMENT"), ("PENDING_PAYMENT", "PAID"), ("PENDING_PAYMENT", "CANCELLED"), ("PAID", "REFUND_REQUESTED"), ("REFUND_REQUESTED", "REFUNDED")}),
)
PAYMENTS = Entity(
    "payments",
    "payment_id",
    _record(
        payment_id="id", order_id="id", payment_status="text", payment_method="text", requested_amount="amount", approved_amount="amount", failure_code="text",
        failure_message="text", requested_at="time", approved_at="time", captured_at="time", failed_at="time", created_at="time", updated_at="time",
    ),
    curated=True,
    status="payment_status",
    transitions=frozenset({("REQUESTED", "APPROVED"), ("APPROVED", "CAPTURED"), ("REQUESTED", "FAILED"), ("APPROVED", "CANCELLED")}),
)
REFUNDS = Entity(
    "refunds",
    "refund_id",
    _record(
        refund_id="id", payment_id="id", order_id="id", refund_status="text", refund_amount="amount", reason="text",
        requested_at="time", approved_at="time", completed_at="time", rejected_at="time", created_at="time", updated_at="time",
    ),
    curated=True,
    status="refund_status",
    transitions=frozenset({("REQUESTED", "APPROVED"), ("APPROVED", "COMPLETED"), ("REQUESTED", "REJECTED")}),
)
CUSTOMERS = Entity("customers", "customer_id", _record(customer_id="id", customer_name="text", email="text", phone="text", customer_status="text", created_at="time", updated_at="time"))
PRODUCTS = Entity("products", "product_id", _record(product_id="id", sku="text", product_name="text", category="text", unit_price="amount", product_status="text", created_at="time", updated_at="time"))
ORDER_ITEMS = Entity("order_items", "order_item_id", _record(order_item_id="id", order_id="id", product_id="id", quantity="count", unit_price="amount", item_amount="amount", created_at="time"))

ENTITIES = {e.name: e for e in (CUSTOMERS, PRODUCTS, ORDERS, ORDER_ITEMS, PAYMENTS, REFUNDS)}
CURATED = [e for e in ENTITIES.values() if e.curated]

#: Fixed value: why an event is quarantined.
STALE = "STALE_SOURCE_LSN"
#: Why an event without a usable image or key is quarantined, where that is asked for.
INVALID = "INVALID_EVENT"

#: One record of the log as the message source delivers it.
LOG_RECORD = T.StructType(
    [
        T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("timestamp", T.TimestampType()),
    ]
)

#: Fixed names: the 18 columns of a raw row.
RAW_COLUMNS = [
    "event_id", "topic", "kafka_partition", "kafka_offset", "kafka_timestamp", "op", "key_json", "value_json", "before_json", "after_json",
    "source_json", "transaction_json", "source_table", "source_lsn", "source_tx_id", "event_ts", "ingestion_ts", "processing_date",
]

#: Fixed names: what a curated event keeps of its raw row beside the record.
EVENT_COLUMNS = [
    "event_id", "topic", "kafka_partition", "kafka_offset", "op", "key_json", "before_json", "after_json", "source_json",
    "source_table", "source_lsn", "source_tx_id", "event_ts", "ingestion_ts",
]
#: Fixed names: what current and history rows have behind the record, and the quarantine's columns.
CURRENT_TAIL = ["is_deleted", "deleted_at", "event_id", "source_lsn", "source_tx_id", "event_ts", "kafka_offset", "ingestion_ts", "silver_updated_at"]
HISTORY_TAIL = ["change_op", "is_deleted", "event_id", "source_lsn", "source_tx_id", "event_ts", "kafka_offset", "ingestion_ts", "valid_from", "processing_date"]
QUARANTINE_COLUMNS = [
    "entity", "primary_key", "reason", "event_id", "topic", "kafka_partition", "kafka_offset", "op", "source_table", "source_lsn", "previous_max_source_lsn",
    "source_tx_id", "event_ts", "key_json", "before_json", "after_json", "source_json", "quarantined_at", "processing_date",
]

_KINDS = {
    "kafka_partition": T.IntegerType(), "kafka_offset": T.LongType(), "source_lsn": T.LongType(), "source_tx_id": T.LongType(), "previous_max_source_lsn": T.LongType(),
    "is_deleted": T.BooleanType(), "processing_date": T.DateType(),
    **dict.fromkeys(("kafka_timestamp", "event_ts", "ingestion_ts", "deleted_at", "valid_from", "quarantined_at", "silver_updated_at"), T.TimestampType()),
}


def _schema(names: list[str], first: T.StructType | None = None) -> T.StructType:
    return T.StructType([*(first.fields if first else []), *[T.StructField(n, _KINDS.get(n, T.StringType())) for n in names]])


def _mart(text: str) -> T.StructType:
    """A mart's own columns as `name kind`, and the two that all marts end with."""
    kinds = {"day": T.DateType(), "text": T.StringType(), "n": T.LongType(), "money": T.DecimalType(18, 2), "rate": T.DoubleType()}
    own = [T.StructField(n, kinds[k]) for n, k in (part.split() for part in text.split(","))]
    return T.StructType([*own, T.StructField("generated_at", T.TimestampType()), T.StructField("processing_date", T.DateType())])


QUARANTINE_TABLE = "silver_quarantine_events"
#: Fixed names and types: the columns of the marts.
MARTS = {
    "gold_daily_order_payment_summary": _mart(
        "summary_date day, order_count n, paid_order_count n, payment_success_order_count n, payment_success_amount money, payment_failed_count n, payment_success_rate rate, "
        "refund_count n, refund_amount money, refund_rate rate"
    ),
    "gold_order_funnel_summary": _mart(
        "summary_date day, created_order_count n, paid_order_count n, payment_completed_order_count n, cancelled_order_count n, refunded_order_count n, order_to_paid_rate rate, "
        "order_to_payment_completed_rate rate, order_to_refunded_rate rate"
    ),
    "gold_payment_failure_summary": _mart("failure_date day, payment_method text, failure_code text, failed_payment_count n, failed_order_count n, failed_requested_amount money"),
    "gold_refund_summary": _mart("refund_date day, refund_status text, refund_count n, completed_refund_count n, refund_amount money, completed_refund_amount money, affected_order_count n, refund_rate rate"),
}
MART_TABLES = list(MARTS)


@dataclass(frozen=True)
class Table:
    """A table of the lakehouse: its layer, schema and partition columns."""

    layer: str
    schema: T.StructType
    partitions: tuple[str, ...] = ("processing_date",)


TABLES = {
    **{e.raw_table: Table("bronze", _schema(RAW_COLUMNS)) for e in ENTITIES.values()},
    **{e.current_table: Table("silver", _schema(CURRENT_TAIL, e.record), ()) for e in CURATED},
    **{e.history_table: Table("silver", _schema(HISTORY_TAIL, e.record)) for e in CURATED},
    QUARANTINE_TABLE: Table("silver", _schema(QUARANTINE_COLUMNS)),
    **{name: Table("gold", schema) for name, schema in MARTS.items()},
}
LAYERS = ("bronze", "silver", "gold")
