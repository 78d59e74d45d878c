"""The registered queries restated in SQL over the provided tables."""

from __future__ import annotations

_ORDERS = """
base as (select o_orderkey k, o_custkey cust, o_orderstatus st, cast(o_totalprice as decimal(12,2)) amount, cast(o_orderdate as date) as day, o_orderpriority pr,
  case when o_orderstatus = 'F' then 'PAID' when o_orderstatus = 'O' then 'CANCELLED' when o_orderkey % 2 = 0 then 'REFUNDED' else 'PENDING_PAYMENT' end as final from orders),
orders_s as (select k as order_id, cust as customer_id, final as order_status, amount as total_amount, day, k % 7 = 0 as is_deleted from base),
pbase as (select *, unnest(case when k % 4 = 0 then [0, 1] else [0] end) j from base),
pstate as (select *, case when j = 1 then case when k % 8 = 0 then 'CAPTURED' else 'FAILED' end when st = 'F' and k % 6 = 5 then 'APPROVED' when st = 'F' then 'CAPTURED' when st = 'O' then 'FAILED' when k % 2 = 0 then 'CAPTURED' else 'APPROVED' end as payment_status,
  cast(amount + case when j = 1 and k % 16 = 0 then 100 else 0 end as decimal(12,2)) as requested_amount from pbase),
payments_s as (select 2 * k + j as payment_id, k as order_id, payment_status, case substr(pr, 1, 1) when '1' then 'CARD' when '2' then 'BANK_TRANSFER' when '3' then 'POINT' when '4' then 'VIRTUAL_ACCOUNT' end as payment_method, requested_amount,
  case when payment_status in ('APPROVED', 'CAPTURED') and k % 9 <> 0 then requested_amount end as approved_amount,
  case when payment_status = 'FAILED' and k % 3 = 1 then 'CARD_DECLINED' when payment_status = 'FAILED' and k % 3 = 2 then 'LIMIT_EXCEEDED' end as failure_code, day, k % 7 = 0 as is_deleted from pstate),
refunds_s as (select l_orderkey as refund_id, 2 * l_orderkey as payment_id, l_orderkey as order_id, case l_orderkey % 4 when 0 then 'COMPLETED' when 1 then 'REQUESTED' when 2 then 'APPROVED' else 'REJECTED' end as refund_status,
  cast(max(l_extendedprice) as decimal(12,2)) as refund_amount, cast(max(l_shipdate) as date) as day, l_orderkey % 19 = 0 as is_deleted from lineitem where l_returnflag = 'R' group by l_orderkey),
items_s as (select l_orderkey as order_id, cast(l_extendedprice as decimal(12,2)) as item_amount from lineitem)"""


def _events(name: str, source: str, ident: str, third: str, deleted: str, most: str = "[0, 1]") -> str:
    return f"""
{name}0 as (select *, {ident} as id, unnest(case when {third} then [0, 1, 2] else {most} end) e from {source}),
{name}1 as (select *, unnest(case when e = 0 and id % 13 = 0 then [0, 1] else [0] end) as copy from {name}0),
{name}_log as (select *, case when e = 0 then case when id % 5 = 0 then 'r' else 'c' end when e = 2 and {deleted} then 'd' else 'u' end as op,
  case when e = 1 and id % 17 = 0 then null when e = 1 and id % 11 = 0 then 1000 + 40 * id - 15 else 1000 + 40 * id + 10 * e end as lsn, 3 * id + e as tx, id % 3 as part, 4 * id + e as off, epoch_ms(cast(day as timestamp)) + e * 60000 as ms from {name}1),
{name}_one as (select * from {name}_log where copy = 0),
{name}_prev as (select *, max(lsn) over (partition by id order by part, off rows between unbounded preceding and 1 preceding) as prev from {name}_one),
{name}_valid as (select * from {name}_prev where not coalesce(lsn < prev, false)),
{name}_stale as (select * from {name}_prev where lsn < prev),
{name}_cur as (select * from {name}_valid qualify row_number() over (partition by id order by lsn desc nulls last, tx desc nulls last, off desc) = 1)"""


_LOGS = ",".join(
    [
        _ORDERS,
        _events("ord", "base", "k", "k % 2 = 1 or k % 7 = 0", "k % 7 = 0"),
        _events("pay", "payments_s", "payment_id", "order_id % 7 = 0", "order_id % 7 = 0"),
        _events("ref", "refunds_s", "refund_id", "order_id % 19 = 0", "order_id % 19 = 0"),
        _events("cus", "(select c_custkey, timestamp '2023-01-01' as day from customer)", "c_custkey", "false", "false"),
        _events("pro", "(select p_partkey, timestamp '2023-01-01' as day from part)", "p_partkey", "false", "false", "[0]"),
        _events("itm", "(select l_orderkey, l_linenumber, timestamp '2023-01-01' as day from lineitem)", "l_orderkey * 8 + l_linenumber", "false", "false", "[0]"),
        "keyless as (select 'orders' as source_table, 'u' as op, cast(r_regionkey as bigint) as lsn, cast(r_regionkey as bigint) as tx, 0 as part, 900000000000 + r_regionkey as off from region)",
        "all_log as ("
        + " union all ".join(f"select '{t}' as source_table, op, lsn, tx, part, off from {n}_log" for t, n in (("orders", "ord"), ("payments", "pay"), ("refunds", "ref"), ("customers", "cus"), ("products", "pro"), ("order_items", "itm")))
        + " union all select * from keyless)",
    ]
)
_STATE = {"ord": "case e when 0 then 'CREATED' when 1 then 'PENDING_PAYMENT' else final end", "pay": "case e when 0 then 'REQUESTED' else payment_status end", "ref": "case e when 0 then 'REQUESTED' else refund_status end"}


def _log(select: str) -> str:
    return f"with {_LOGS} {select}"


def _state(select: str) -> str:
    return f"with {_ORDERS} {select}"


def _event_columns(table: str) -> str:
    return f"sha256(concat_ws(':', 'cdc.public.{table}', part, off)) as event_id, cast(tx as bigint) as source_tx_id, cast(off as bigint) as kafka_offset, cast(ms as bigint) as event_ts_ms"


def _with_event(select: str, table: str, more: str) -> str:
    """A statement on one entity's events with what the event says of itself."""
    head, tail = select.rsplit(" from ", 1)
    return f"{head}, {_event_columns(table)}, {more} from {tail}"


_CUR_ORDERS = f"select id as order_id, cust as customer_id, {_STATE['ord']} as order_status, cast(amount as double) as total_amount, op = 'd' as is_deleted, cast(lsn as bigint) as source_lsn from ord_cur"
_CUR_PAYMENTS = f"select id as payment_id, order_id, {_STATE['pay']} as payment_status, payment_method, cast(requested_amount as double) as requested_amount, cast(case when e > 0 then approved_amount end as double) as approved_amount, op = 'd' as is_deleted, cast(lsn as bigint) as source_lsn from pay_cur"
_CUR_REFUNDS = f"select id as refund_id, payment_id, order_id, {_STATE['ref']} as refund_status, cast(refund_amount as double) as refund_amount, op = 'd' as is_deleted, cast(lsn as bigint) as source_lsn from ref_cur"
_DELETED = "cast(case when op = 'd' then ms end as bigint) as deleted_at_ms"
#: The current tables as the jobs write them.
_CURRENT = f""",
c_orders as (select id as order_id, {_STATE['ord']} as order_status, amount as total_amount, op = 'd' as is_deleted, day from ord_cur),
c_payments as (select id as payment_id, order_id, {_STATE['pay']} as payment_status, payment_method, requested_amount, case when e > 0 then approved_amount end as approved_amount, case when e > 0 then failure_code end as failure_code, op = 'd' as is_deleted from pay_cur),
c_refunds as (select id as refund_id, payment_id, order_id, {_STATE['ref']} as refund_status, refund_amount, op = 'd' as is_deleted, day from ref_cur)"""
_PER_ORDER = """,
p as (select order_id, count(*) filter (payment_status = 'CAPTURED') as n_cap, sum(case when payment_status = 'CAPTURED' then coalesce(approved_amount, requested_amount, 0) else 0 end) as cap_amount, count(*) filter (payment_status = 'FAILED') as n_fail from payments_s where not is_deleted group by 1),
r as (select order_id, count(*) as n_ref, sum(case when refund_status = 'COMPLETED' then refund_amount else 0 end) as ref_amount from refunds_s where not is_deleted group by 1),
o as (select * from orders_s left join p using (order_id) left join r using (order_id) where not is_deleted)"""
_DAY = "cast({0} as varchar)"

_COUNTED = "refund_status in ('REQUESTED', 'APPROVED', 'COMPLETED')"
#: What each check observes and what it expects (None: it only informs), over the source (s) or the current tables (c).
CHECKS = {
    "source.orders_total_amount_matches_order_items": ("select count(*) from orders_s left join (select order_id, sum(item_amount) as t from items_s group by 1) using (order_id) where total_amount <> coalesce(t, 0)", "0"),
    "source.payments_approved_amount_not_greater_than_order_total": ("select count(*) from payments_s join orders_s using (order_id) where approved_amount > total_amount", "0"),
    "source.refunds_cumulative_amount_not_greater_than_payment_approved_amount": (f"select count(*) from (select payment_id, sum(refund_amount) as t from refunds_s where {_COUNTED} group by 1) join payments_s using (payment_id) where t > coalesce(approved_amount, 0)", "0"),
    "silver.payments_approved_amount_not_greater_than_order_total": ("select count(*) from c_payments p join c_orders o using (order_id) where not p.is_deleted and not o.is_deleted and approved_amount > total_amount", "0"),
    "silver.refunds_cumulative_amount_not_greater_than_payment_approved_amount": (f"select count(*) from (select payment_id, sum(refund_amount) as t from c_refunds where not is_deleted and {_COUNTED} group by 1) join c_payments p using (payment_id) where not p.is_deleted and t > coalesce(approved_amount, 0)", "0"),
    "silver.paid_orders_have_captured_payment": ("select count(*) from c_orders where not is_deleted and order_status = 'PAID' and order_id not in (select order_id from c_payments where not is_deleted and payment_status = 'CAPTURED')", "0"),
    "silver.refunded_orders_have_completed_refund": ("select count(*) from c_orders where not is_deleted and order_status = 'REFUNDED' and order_id not in (select order_id from c_refunds where not is_deleted and refund_status = 'COMPLETED')", "0"),
}
_BY_ENTITY = (("customers", "cus"), ("products", "pro"), ("orders", "ord"), ("order_items", "itm"), ("payments", "pay"), ("refunds", "ref"))
_CURATED = (("orders", "ord"), ("payments", "pay"), ("refunds", "ref"))
for _n, _t in _CURATED:
    CHECKS[f"reconciliation.source_{_n}_active_count_equals_silver_current"] = (f"select count(*) from {_n}_s", f"select count(*) from c_{_n} where not is_deleted")
    CHECKS[f"reconciliation.{_n}_delete_events_match_silver_soft_deletes"] = (f"select count(*) from {_t}_log where op = 'd'", f"select count(*) from c_{_n} where is_deleted")
for _n, _t in _BY_ENTITY:
    CHECKS[f"bronze.bronze_{_n}_cdc.duplicate_event_id"] = (f"select count(*) from (select off from {_t}_log group by part, off having count(*) > 1)", "0")
_STALE = "select (select count(*) from ord_stale) + (select count(*) from pay_stale) + (select count(*) from ref_stale)"
_MART_ROWS = {
    "gold_daily_order_payment_summary": "select count(distinct day) from c_orders where not is_deleted",
    "gold_order_funnel_summary": "select count(distinct day) from c_orders where not is_deleted",
    # The log has no time of failure, so that of the table's last change, one day, stands in.
    "gold_payment_failure_summary": "select count(*) from (select distinct coalesce(payment_method, 'UNKNOWN'), coalesce(failure_code, 'UNKNOWN') from c_payments where not is_deleted and payment_status = 'FAILED')",
    "gold_refund_summary": "select count(*) from (select distinct day, refund_status from c_refunds where not is_deleted)",
}
CHECKS["silver.quarantine_event_count"] = (_STALE, None)
for _n, _sql in _MART_ROWS.items():
    CHECKS[f"gold.{_n}.row_count"] = (_sql, None)


def _check(name: str, observed: str, expected: str | None) -> str:
    limit = "null" if expected is None else f"({expected})"
    status = "'INFO'" if expected is None else "case when observed = expected then 'PASS' else 'FAIL' end"
    return f"select '{name}' as name, {status} as status, observed, expected from (select cast(({observed}) as bigint) as observed, cast({limit} as bigint) as expected)"


_ALLOWED = {
    "orders": "'CREATED>PENDING_PAYMENT', 'PAID>REFUND_REQUESTED', 'PENDING_PAYMENT>CANCELLED', 'PENDING_PAYMENT>PAID', 'REFUND_REQUESTED>REFUNDED'",
    "payments": "'REQUESTED>APPROVED', 'APPROVED>CAPTURED', 'REQUESTED>FAILED', 'APPROVED>CANCELLED'",
    "refunds": "'REQUESTED>APPROVED', 'APPROVED>COMPLETED', 'REQUESTED>REJECTED'",
}


def _moves(table: str, name: str) -> str:
    state = _STATE[name]
    return f"""select '{table}' as entity, id as primary_key, from_status, to_status, concat(from_status, '>', to_status) in ({_ALLOWED[table]}) as allowed
from (select id, {state} as to_status, lag({state}) over (partition by id order by lsn nulls first, tx, off) as from_status from {name}_valid where op <> 'd') where from_status <> to_status"""


_IMAGE = "cast(to_json({'order_id': id, 'customer_id': cust, 'order_status': st, 'currency': 'KRW', 'total_amount': amount, 'ordered_at': ordered}) as varchar)"
_ORDER_ROWS = f"""rows as (select id, cust, {_STATE['ord']} as st, cast(amount as varchar) as amount, strftime(day, '%Y-%m-%dT%H:%M:%SZ') as ordered, op, lsn, tx, part, off, ms, cast(to_json({{'id': id}}) as varchar) as key_json from ord_log
  union all select null, null, 'CREATED', null, null, op, lsn, tx, part, off, 1672531200000, '{{}}' from keyless),
images as (select *, case when op = 'd' then {_IMAGE} end as before_json, case when op <> 'd' then {_IMAGE} end as after_json, cast(to_json({{'table': 'orders', 'lsn': lsn, 'txId': tx, 'connector': 'postgresql'}}) as varchar) as source_json from rows)
select {_event_columns('orders')}, 'cdc.public.orders' as topic, cast(part as int) as kafka_partition, cast(ms as bigint) as kafka_timestamp_ms, op, key_json,
'{{"before":' || coalesce(before_json, 'null') || ',"after":' || coalesce(after_json, 'null') || ',"source":' || source_json || ',"op":"' || op || '","ts_ms":' || ms || ',"transaction":null}}' as value_json,
before_json, after_json, source_json, cast(null as varchar) as transaction_json, 'orders' as source_table, cast(lsn as bigint) as source_lsn, cast(1704067200000 as bigint) as ingestion_ts_ms, '2024-01-01' as processing_date from images"""
_KPI = """,
dated as (select order_id from c_orders where not is_deleted),
sums as (select (select count(*) from dated) as order_count,
  (select coalesce(sum(case when payment_status = 'CAPTURED' then coalesce(approved_amount, requested_amount) end), 0) from c_payments where not is_deleted and order_id in (from dated)) as payment_success_amount,
  (select count(*) from c_payments where not is_deleted and payment_status = 'FAILED' and order_id in (from dated)) as payment_failed_count,
  (select count(*) from c_refunds where not is_deleted and order_id in (from dated)) as refund_count,
  (select coalesce(sum(case when refund_status = 'COMPLETED' then refund_amount end), 0) from c_refunds where not is_deleted and order_id in (from dated)) as refund_amount)
"""
_COUNTS = {f"bronze_{n}_cdc": f"select count(*) from all_log where source_table = '{n}'" for n, _ in _BY_ENTITY}
_COUNTS |= {f"silver_{n}_current": f"select count(*) from {t}_cur" for n, t in _CURATED} | {f"silver_{n}_history": f"select count(*) from {t}_valid" for n, t in _CURATED}
_COUNTS |= {"silver_quarantine_events": _STALE} | _MART_ROWS

ORACLES = {
    "bronze_event_id": _log("select id as order_id, cast(off as bigint) as kafka_offset, sha256(concat_ws(':', 'cdc.public.orders', part, off)) as event_id from (select id, part, off from ord_log union all select null, part, off from keyless)"),
    "bronze_order_rows": _log("")[:-1] + ", " + _ORDER_ROWS,
    "bronze_envelope_fields": _log("select source_table, cast(off as bigint) as kafka_offset, op, cast(lsn as bigint) as source_lsn, cast(tx as bigint) as source_tx_id from all_log"),
    "bronze_route_counts": _log("select source_table, count(*) as n from all_log group by 1"),
    "bronze_duplicate_event_id": _log("select count(*) as duplicate_groups from (select 1 from all_log group by source_table, part, off having count(*) > 1)"),
    "bronze_event_id_audit": _log("select count(*) as n, count(distinct (source_table, part, off)) as distinct_ids, cast(0 as bigint) as null_ids from all_log"),
    "silver_dedup": _log("select id as order_id, cast(off as bigint) as kafka_offset, op from ord_one"),
    "silver_stale_events": _log("select 'orders' as entity, cast(id as varchar) as primary_key, cast(off as bigint) as kafka_offset, cast(lsn as bigint) as source_lsn, cast(prev as bigint) as previous_max_source_lsn, 'STALE_SOURCE_LSN' as reason from ord_stale"),
    "silver_valid_events": _log("select id as order_id, cast(off as bigint) as kafka_offset from ord_valid"),
    "silver_orders_current": _log(_with_event(_CUR_ORDERS, "orders", _DELETED)),
    "silver_payments_current": _log(_with_event(_CUR_PAYMENTS, "payments", _DELETED)),
    "silver_refunds_current": _log(_with_event(_CUR_REFUNDS, "refunds", _DELETED)),
    "silver_orders_history": _log(_with_event("select id as order_id, op as change_op, op = 'd' as is_deleted, cast(lsn as bigint) as source_lsn from ord_valid", "orders", "cast(ms as bigint) as valid_from_ms")),
    "silver_payments_history": _log(_with_event("select id as payment_id, op as change_op, op = 'd' as is_deleted, cast(lsn as bigint) as source_lsn from pay_valid", "payments", "cast(ms as bigint) as valid_from_ms")),
    "silver_refunds_history": _log(_with_event("select id as refund_id, op as change_op, op = 'd' as is_deleted, cast(lsn as bigint) as source_lsn from ref_valid", "refunds", "cast(ms as bigint) as valid_from_ms")),
    "silver_quarantine": _log("select entity, count(*) as n from (select 'orders' as entity from ord_stale union all select 'payments' from pay_stale union all select 'refunds' from ref_stale) group by 1"),
    "silver_soft_deletes": _log("select id as order_id from ord_cur where op = 'd'"),
    "silver_upsert_orders": _log(_CUR_ORDERS),
    "stream_upsert_current": _log(_CUR_ORDERS),
    "stream_bronze_counts": _log("select source_table, count(*) as n from all_log group by 1"),
    "gold_daily_order_payment_summary": _state(
        _PER_ORDER
        + """ select cast(day as varchar) as summary_date, count(*) as order_count, count(*) filter (order_status in ('PAID', 'REFUNDED')) as paid_order_count, count(*) filter (n_cap > 0) as payment_success_order_count,
cast(coalesce(sum(cap_amount), 0) as double) as payment_success_amount, cast(sum(coalesce(n_fail, 0)) as bigint) as payment_failed_count, cast(count(*) filter (n_cap > 0) as double) / count(*) as payment_success_rate,
cast(sum(coalesce(n_ref, 0)) as bigint) as refund_count, cast(coalesce(sum(ref_amount), 0) as double) as refund_amount, case when count(*) filter (n_cap > 0) = 0 then 0.0 else cast(count(*) filter (n_ref > 0) as double) / count(*) filter (n_cap > 0) end as refund_rate from o group by day"""
    ),
    "gold_order_funnel_summary": _state(
        _PER_ORDER
        + """ select cast(day as varchar) as summary_date, count(*) as created_order_count, count(*) filter (order_status in ('PAID', 'REFUNDED')) as paid_order_count, count(*) filter (n_cap > 0) as payment_completed_order_count,
count(*) filter (order_status = 'CANCELLED') as cancelled_order_count, count(*) filter (order_status = 'REFUNDED') as refunded_order_count, cast(count(*) filter (order_status in ('PAID', 'REFUNDED')) as double) / count(*) as order_to_paid_rate,
cast(count(*) filter (n_cap > 0) as double) / count(*) as order_to_payment_completed_rate, cast(count(*) filter (order_status = 'REFUNDED') as double) / count(*) as order_to_refunded_rate from o group by day"""
    ),
    "gold_payment_failure_summary": _state(
        "select cast(day as varchar) as failure_date, coalesce(payment_method, 'UNKNOWN') as payment_method, coalesce(failure_code, 'UNKNOWN') as failure_code, count(*) as failed_payment_count, count(distinct order_id) as failed_order_count, cast(sum(requested_amount) as double) as failed_requested_amount from payments_s where not is_deleted and payment_status = 'FAILED' group by all"
    ),
    "gold_refund_summary": _state(
        "select cast(day as varchar) as refund_date, refund_status, count(*) as refund_count, count(*) filter (refund_status = 'COMPLETED') as completed_refund_count, cast(sum(refund_amount) as double) as refund_amount, cast(coalesce(sum(refund_amount) filter (refund_status = 'COMPLETED'), 0) as double) as completed_refund_amount, count(distinct order_id) as affected_order_count, cast(count(distinct order_id) as double) / (select count(*) from orders_s where not is_deleted) as refund_rate from refunds_s where not is_deleted group by day, refund_status"
    ),
    "dq_all_checks": _log("")[:-1] + _CURRENT + " " + " union all ".join(_check(n, *sql) for n, sql in CHECKS.items()),
    "dq_kpi_reconciliation": _log("")[:-1] + _CURRENT + _KPI + " union all ".join(f"select '{n}' as measure, cast({n} as double) as mart, cast({n} as double) as expected, true as matches from sums" for n in ("order_count", "payment_success_amount", "payment_failed_count", "refund_count", "refund_amount")),
    "lake_table_counts": _log("")[:-1] + _CURRENT + " " + " union all ".join(f"select '{n}' as table_name, cast(({sql}) as bigint) as n" for n, sql in _COUNTS.items()),
    "ext_state_transitions": _log(" union all ".join(_moves(table, name) for table, name in _CURATED)),
    "ext_invalid_events": _log("select 'orders' as entity, 'INVALID_EVENT' as reason, cast(off as bigint) as kafka_offset, sha256(concat_ws(':', 'cdc.public.orders', part, off)) as event_id from keyless"),
    "events_props_json": "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events",
}
for _k, _v in {
    "dq_order_total_vs_items": "source.orders_total_amount_matches_order_items",
    "dq_approved_vs_total": "silver.payments_approved_amount_not_greater_than_order_total",
    "dq_refund_vs_approved": "silver.refunds_cumulative_amount_not_greater_than_payment_approved_amount",
    "dq_paid_without_capture": "silver.paid_orders_have_captured_payment",
    "dq_refunded_without_completed": "silver.refunded_orders_have_completed_refund",
}.items():
    # These go over the final states rather than over what the log rebuilds.
    _sql = CHECKS[_v][0]
    for _n, _ in _CURATED:
        _sql = _sql.replace(f"c_{_n}", f"{_n}_s")
    ORACLES[_k] = _state(f"select cast(({_sql}) as bigint) as violations")
ORACLES["dq_count_reconciliation"] = _state(" union all ".join(f"select '{n}' as entity, (select count(*) from {n}_s) as source_rows, (select count(*) from {n}_s where not is_deleted) as active_rows" for n in ("orders", "payments", "refunds")))
ORACLES["dq_delete_reconciliation"] = _log(" union all ".join(f"select '{n}' as entity, (select count(*) from {t}_log where op = 'd') as delete_events, (select count(*) from {t}_cur where op = 'd') as deleted_rows" for n, t in (("orders", "ord"), ("payments", "pay"), ("refunds", "ref"))))
