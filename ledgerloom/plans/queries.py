"""The library's queries over the driver's tables, named after the operators they apply, and the same in DuckDB's SQL."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.functions import text as T
from ledgerloom.operators import admission
from ledgerloom.operators import analytics as A
from ledgerloom.operators import categorize as CAT
from ledgerloom.operators import classify as C
from ledgerloom.operators import dedup as D
from ledgerloom.operators import extract as X
from ledgerloom.operators import ledger as L
from ledgerloom.operators import match as M
from ledgerloom.operators import resolve as R
from ledgerloom.operators import statement as ST
from ledgerloom.plans import folds, ingest
from ledgerloom.plans import parsing as P
from ledgerloom.plans import tables as B
from ledgerloom.rules import categories as RC
from ledgerloom.rules import messages as RM
from ledgerloom.session import shared_folder, written
from ledgerloom.sources import files, mailbox, messages, parts
from ledgerloom.streaming import outcomes, state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DAY = 86_400_000
#: Parts of the tables that streams write here; these are small.
PARTS = 8
#: 2024-01-10 to 2024-01-20 in UTC, and a year before the end.
SLICE = A.Slice(1_704_844_800_000, 1_705_708_800_000, 1_705_708_800_000 - 366 * DAY)
#: 1998 and 1999 of `orders`.
YEARS = A.Slice(883_612_800_000, 946_684_800_000, 946_684_800_000 - 366 * DAY)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def over(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"


def simple(name: str, f: Callable[[DataFrame], DataFrame], body: str) -> None:
    """A query over the ledger of `events`."""
    query(name, over(B.LEDGER, body))(lambda spark, d: f(B.ledger(spark, d)))


IDS = "id, amount_paise, occurred_at"


def listed(name: str, filters: L.Filters, where: str) -> None:
    simple(name, lambda t: L.filtered(t, filters).select("id", "amount_paise", "occurred_at"), f"SELECT {IDS} FROM ledger WHERE {where}")


ALIVE = "deleted_at IS NULL"
listed("flt1_tenant", L.Filters(user_id=3), f"user_id = 3 AND {ALIVE}")
listed("flt2_only_deleted", L.Filters(only_deleted=True), "deleted_at IS NOT NULL")
listed("flt2_with_deleted", L.Filters(include_deleted=True), "TRUE")
_SEARCH = " OR ".join(f"contains(lower({c}), '{{q}}')" for c in L.SEARCHED)
listed("flt3_search", L.Filters(q="  SHOP 4"), f"{ALIVE} AND ({_SEARCH.format(q='shop 4')})")
listed("flt3_search_wildcards", L.Filters(q="50%_OFF"), f"{ALIVE} AND ({_SEARCH.format(q='50%_off')})")
listed("flt4_category", L.Filters(category="purchase"), f"{ALIVE} AND category_id = 'purchase'")
listed("flt4_uncategorized", L.Filters(category="uncategorized"), f"{ALIVE} AND category_id IS NULL")
listed("flt5_low_confidence", L.Filters(low_confidence=True), f"{ALIVE} AND merchant_confidence < 0.6")
listed("flt6_category_source", L.Filters(category_source="generic"), f"{ALIVE} AND category_source = 'generic'")
listed("flt7_channel_direction", L.Filters(channel="UPI", direction="debit"), f"{ALIVE} AND channel = 'UPI' AND direction = 'debit'")
listed("flt8_time_range", L.Filters(start=SLICE.start, end=SLICE.end), f"{ALIVE} AND occurred_at BETWEEN {SLICE.start} AND {SLICE.end}")
_ALL = L.Filters(user_id=5, q="shop", channel="Card", direction="credit", low_confidence=True, start=SLICE.start)
listed("flt9_all_together", _ALL, f"user_id = 5 AND {ALIVE} AND ({_SEARCH.format(q='shop')}) AND channel = 'Card' AND direction = 'credit' AND merchant_confidence < 0.6 AND occurred_at >= {SLICE.start}")
_CUT = A.Slice(SLICE.start, SLICE.end, SLICE.year_ago, category="__none__", channel="Other")
simple("flt10_slice", lambda t: A.base(t, _CUT).select("id", "amount_paise", "occurred_at"), f"SELECT {IDS} FROM ledger WHERE {ALIVE} AND duplicate_of_id IS NULL AND occurred_at BETWEEN {SLICE.year_ago} AND {SLICE.end} AND coalesce(category_id, '__none__') = '__none__' AND coalesce(channel, 'Other') = 'Other'")
simple("flt11_analytics_base", lambda t: A.base(t, SLICE), f"SELECT id, user_id, occurred_at, amount_paise, direction, category_id, channel, merchant_normalized, merchant FROM ledger WHERE {ALIVE} AND duplicate_of_id IS NULL AND occurred_at BETWEEN {SLICE.year_ago} AND {SLICE.end}")
simple("flt12_baseline", lambda t: L.after_baseline(t.withColumn("occurred_at", F.col("occurred_at") + 725 * DAY)).select("id", "occurred_at"), f"SELECT id, occurred_at + {725 * DAY} AS occurred_at FROM ledger WHERE occurred_at + {725 * DAY} >= {S.BASELINE_MS}")
simple("flt13_in_list", lambda t: L.filtered(t, L.Filters(categories=("click", "signup"), include_deleted=True)).select("id"), "SELECT id FROM ledger WHERE category_id IN ('click', 'signup')")
simple("prj3_derived_flag", lambda t: L.with_message_flag(t).select("id", "has_message"), "SELECT id, gmail_message_id IS NOT NULL AS has_message FROM ledger")
simple("prj4_rate", lambda t: L.rate(t, window_ms=3_600_000).select("id", "recent"), "SELECT id, count(*) OVER (PARTITION BY user_id ORDER BY created_at RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS recent FROM ledger")

query("prj1_jn1_ledger_with_category", over(B.LEDGER, "SELECT l.id, l.user_id, l.amount_paise, l.direction, l.merchant, l.channel, c.name AS category_name, c.color AS category_color FROM ledger l LEFT JOIN categories c ON l.category_id = c.id"))(
    lambda spark, d: L.with_category(B.ledger(spark, d), B.categories(spark)).select("id", "user_id", "amount_paise", "direction", "merchant", "channel", "category_name", "category_color")
)
query("jn2_agg9_category_counts", over(B.LEDGER, "SELECT c.id, c.name, count(l.id) AS count FROM categories c LEFT JOIN ledger l ON l.category_id = c.id GROUP BY 1, 2"))(lambda spark, d: A.category_counts(B.categories(spark), B.ledger(spark, d)))
query("jn3_rules_with_category", over(B.LEDGER, "SELECT p_partkey AS rule_id, p_name AS pattern, c.name FROM part JOIN categories c ON c.id = CASE p_partkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'rent' ELSE 'gone' END"))(
    lambda spark, d: CAT.rules_with_category(
        B.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("pattern"), F.when(F.col("p_partkey") % 5 == 0, "click").when(F.col("p_partkey") % 5 == 1, "error").when(F.col("p_partkey") % 5 == 2, "rent").otherwise("gone").alias("category_id")),
        B.categories(spark),
    ).select(F.col("id").alias("rule_id"), "pattern", F.col("category_name").alias("name"))
)
query("jn4_users_with_connections", "SELECT c_custkey AS user_id, c_name AS name, s_suppkey IS NOT NULL AS connected FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")(
    lambda spark, d: L.with_connection(B.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name")), B.read(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id")))
)
query("jn7_src4_unseen", over(B.LEDGER, "SELECT e.event_id, e.user_id FROM events e ANTI JOIN ledger l ON l.user_id = e.user_id AND l.gmail_message_id = 'm' || e.event_id"))(
    lambda spark, d: L.unseen(B.read(spark, d, "events").select("user_id", "event_id", F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message_id")), B.ledger(spark, d)).select("event_id", "user_id")
)
query("jn15_semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")(lambda spark, d: L.with_rows(B.read(spark, d, "customer"), B.read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey", "c_name"))

# Aggregates

COUNTED = f"{ALIVE} AND duplicate_of_id IS NULL"
RANGE = f"{COUNTED} AND occurred_at BETWEEN {SLICE.start} AND {SLICE.end}"
_SIDE = "CAST(coalesce(sum(amount_paise) FILTER (direction {op} 'debit'), 0) AS BIGINT)"
DEBIT, CREDIT = _SIDE.format(op="="), _SIDE.format(op="<>")
simple("agg1_totals", lambda t: A.totals(t, SLICE), f"SELECT {DEBIT} AS debit, {CREDIT} AS credit, count(*) AS count, {CREDIT} - {DEBIT} AS net FROM ledger WHERE {RANGE}")
_BEFORE = SLICE.start - (SLICE.end - SLICE.start)
simple("agg8_win5_previous", lambda t: A.previous(t, SLICE), f"SELECT {DEBIT} AS debit, {CREDIT} AS credit FROM ledger WHERE {COUNTED} AND occurred_at BETWEEN {_BEFORE} AND {SLICE.start}")
_DELTA = "nullif(CASE WHEN b{s} <> 0 THEN CAST(floor((n{s} - b{s}) / b{s} * 100 + 0.5) AS BIGINT) END, 0)"
_NOW, _OLD = f"occurred_at BETWEEN {SLICE.start} AND {SLICE.end}", f"occurred_at BETWEEN {_BEFORE} AND {SLICE.start}"
simple(
    "agg12_deltas",
    lambda t: A.deltas(t, SLICE),
    f"SELECT {_DELTA.format(s='d')} AS debit_percent, {_DELTA.format(s='c')} AS credit_percent FROM (SELECT " + ", ".join(f"CAST(coalesce(sum(amount_paise) FILTER ({w} AND direction {op} 'debit'), 0) AS BIGINT) AS {n}{s}" for n, w in (("n", _NOW), ("b", _OLD)) for s, op in (("d", "="), ("c", "<>"))) + f" FROM ledger WHERE {COUNTED})",
)
_NAMED = "CASE WHEN id = '__none__' THEN 'Uncategorized' ELSE coalesce(name, 'Unknown') END AS name, CASE WHEN id = '__none__' THEN '#8e8e93' ELSE coalesce(color, '#8e8e93') END AS color"
query("agg_by_category", over(B.LEDGER, f"SELECT s.id, {_NAMED.replace('id =', 's.id =')}, total FROM (SELECT coalesce(category_id, '__none__') AS id, CAST(sum(amount_paise) AS BIGINT) AS total FROM ledger WHERE {RANGE} AND direction = 'debit' GROUP BY 1) s LEFT JOIN categories c ON s.id = c.id"))(lambda spark, d: A.by_category(B.ledger(spark, d), B.categories(spark), SLICE))
_CHANNEL = f"SELECT coalesce(channel, 'Other') AS channel, CAST(sum(amount_paise) AS BIGINT) AS total FROM ledger WHERE {RANGE} AND direction = 'debit' GROUP BY 1"
simple("agg3_by_channel", lambda t: A.by_channel(t, SLICE), _CHANNEL)
simple("agg13_channel_shares", lambda t: A.channel_shares(t, SLICE), f"SELECT channel, total, CAST(floor(total / sum(total) OVER () * 100 + 0.5) AS BIGINT) AS percent FROM ({_CHANNEL})")
_KEY = "coalesce(merchant_normalized, merchant, 'unknown')"
simple("agg4_srt5_top_merchants", lambda t: A.top_merchants(t, SLICE), f"SELECT {_KEY} AS key, first(coalesce(merchant, {_KEY}) ORDER BY occurred_at, id) AS label, CAST(sum(amount_paise) AS BIGINT) AS total, count(*) AS count FROM ledger WHERE {RANGE} AND direction = 'debit' GROUP BY 1 ORDER BY total DESC, key LIMIT 10")
_CR = "CAST(coalesce(sum(amount_paise) FILTER (direction = 'credit'), 0) AS BIGINT)"
simple("agg5_scl1_by_day", lambda t: A.by_day(t, SLICE), f"SELECT strftime(make_timestamp_ms(occurred_at + 19800000), '%Y-%m-%d') AS date, {DEBIT} AS debit, {_CR} AS credit FROM ledger WHERE {RANGE} GROUP BY 1")
query("agg6_by_month", over(B.ORDERS, f"SELECT strftime(make_timestamp_ms(occurred_at + 19800000), '%Y-%m') AS month, {DEBIT} AS debit, {_CR} AS credit FROM ledger WHERE occurred_at BETWEEN least({YEARS.start}, {YEARS.year_ago}) AND {YEARS.end} AND occurred_at >= {YEARS.year_ago} GROUP BY 1"))(lambda spark, d: A.by_month(B.orders(spark, d), YEARS))
simple(
    "agg_dashboard_all_tenants",
    lambda t: A.dashboard(t, SLICE),
    f"SELECT user_id, CASE WHEN c IS NOT NULL THEN 'category' WHEN h IS NOT NULL THEN 'channel' WHEN w IS NOT NULL THEN 'merchant' WHEN y IS NOT NULL THEN 'day' ELSE 'total' END AS kind, coalesce(c, h, w, y, '') AS key, {DEBIT} AS debit, {CREDIT} AS credit, count(*) AS count FROM (SELECT *, coalesce(category_id, '__none__') AS c, coalesce(channel, 'Other') AS h, coalesce(merchant_normalized, merchant, 'unknown') AS w, strftime(make_timestamp_ms(occurred_at + 19800000), '%Y-%m-%d') AS y FROM ledger WHERE {RANGE}) GROUP BY GROUPING SETS ((user_id, c), (user_id, h), (user_id, w), (user_id, y), (user_id))",
)
simple("agg10_filtered_count", lambda t: L.filtered(t, L.Filters(channel="UPI")).agg(F.count(F.lit(1)).alias("n")), f"SELECT count(*) AS n FROM ledger WHERE {ALIVE} AND channel = 'UPI'")
query("agg11_unsealed", "SELECT (SELECT count(*) FROM events WHERE event_id % 3 = 0) + (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0) AS remaining")(
    lambda spark, d: L.unsealed(B.read(spark, d, "events").select(F.when(F.col("event_id") % 3 != 0, "v1.x").alias("enc_payload")), B.read(spark, d, "orders").select(F.when(F.col("o_orderkey") % 2 != 0, "v1.x").alias("enc_payload")))
)
query("agg15_first_letters", "SELECT user_id, letter, count(*) AS n, list(name ORDER BY name) AS names FROM (SELECT p_size AS user_id, p_name AS name, CASE WHEN upper(substr(trim(p_name), 1, 1)) BETWEEN 'A' AND 'Z' THEN upper(substr(trim(p_name), 1, 1)) ELSE '#' END AS letter FROM part) GROUP BY 1, 2")(lambda spark, d: R.by_letter(B.read(spark, d, "part").select(F.col("p_size").alias("user_id"), F.col("p_name").alias("name"))))

# Order and pages


def ordered(name: str, sort: str, descending: bool, clause: str, number: int = 1, size: int = 50) -> None:
    simple(name, lambda t: L.page(L.filtered(t, L.Filters()), sort, descending, number, size).select("id", "amount_paise", "merchant"), f"SELECT id, amount_paise, merchant FROM ledger WHERE {ALIVE} ORDER BY {clause}, created_at DESC, id LIMIT {size} OFFSET {(number - 1) * size}")


ordered("srt1_srt3_by_time", "occurred_at", True, "occurred_at DESC NULLS FIRST", 3)
ordered("srt1_by_amount", "amount_paise", False, "amount_paise ASC NULLS LAST", 2, 200)
ordered("srt1_by_merchant", "merchant", True, "merchant DESC NULLS FIRST")
simple("srt2_nulls_last", lambda t: t.orderBy(*L.order("merchant", True, nulls_last=True)).select("id", "merchant"), "SELECT id, merchant FROM ledger ORDER BY merchant DESC NULLS LAST, created_at DESC, id")
simple("srt4_row_cap", lambda t: L.filtered(t, L.Filters(user_id=8)).orderBy(*L.order()).limit(L.ROW_CAP).select("id"), f"SELECT id FROM ledger WHERE user_id = 8 AND {ALIVE} ORDER BY occurred_at DESC, created_at DESC, id LIMIT {L.ROW_CAP}")
simple("srt6_oldest_first", lambda t: L.stalest_first(t, "deleted_at").select("id", "deleted_at"), "SELECT id, deleted_at FROM ledger ORDER BY deleted_at ASC NULLS FIRST, id")
simple("srt7_nearest", lambda t: t.orderBy(S.distance(F.col("occurred_at"), F.lit(SLICE.start)), "id").select("id", "occurred_at"), f"SELECT id, occurred_at FROM ledger ORDER BY abs(occurred_at - {SLICE.start}), id")
simple("srt8_work_queue", lambda t: CAT.work_queue(t).select("id", "created_at"), "SELECT id, created_at FROM ledger WHERE category_id IS NULL ORDER BY created_at, id")
query("set_ops_domains", "SELECT DISTINCT o_orderpriority AS d FROM orders UNION SELECT DISTINCT event_type FROM events")(lambda spark, d: B.read(spark, d, "orders").select(F.col("o_orderpriority").alias("d")).distinct().union(B.read(spark, d, "events").select("event_type").distinct()).distinct())

# Sinks and changes

query("snk4_export", over(B.LEDGER, f"SELECT l.id, strftime(make_timestamp_ms(occurred_at + 19800000), '%Y-%m-%d') AS date, strftime(make_timestamp_ms(occurred_at + 19800000), '%H:%M:%S') AS time, coalesce(channel, '') AS channel, coalesce(merchant, upi_id, '') AS party, amount_paise / 100 AS amount, CASE WHEN direction = 'debit' THEN 'Debit' ELSE 'Credit' END AS direction, coalesce(c.name, '') AS category, coalesce(notes, '') AS notes FROM ledger l LEFT JOIN categories c ON l.category_id = c.id WHERE {COUNTED}"))(lambda spark, d: L.export(B.ledger(spark, d), B.categories(spark)))
simple("snk1_ded3_str5_insert_new", lambda t: L.insert_new(t.filter("direction = 'credit'"), t).select("id", "gmail_message_id"), "SELECT id, gmail_message_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, gmail_message_id ORDER BY created_at, id) AS rn FROM ledger) n WHERE gmail_message_id IS NULL OR rn = 1 AND NOT EXISTS (SELECT 1 FROM ledger o WHERE o.direction = 'credit' AND o.user_id = n.user_id AND o.gmail_message_id = n.gmail_message_id)")
query("snk2_agg7_add_counters", "SELECT event_type AS provider, 2 * count(*) AS total_count, 2 * count(*) FILTER (event_id % 3 = 0) AS merchant_hits FROM events GROUP BY 1")(
    lambda spark, d: (lambda t: L.add_counters(t.groupBy("provider").agg(F.sum("total_count").alias("total_count"), F.sum("merchant_hits").alias("merchant_hits")), t, "provider"))(B.read(spark, d, "events").select(F.col("event_type").alias("provider"), F.lit(1).cast("long").alias("total_count"), (F.col("event_id") % 3 == 0).cast("long").alias("merchant_hits")))
)
query("snk3_upsert_latest", "SELECT user_id, ts_ms, event_type FROM (SELECT user_id, epoch_us(ts) // 1000 + 5 AS ts_ms, event_type || '!' AS event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1")(
    lambda spark, d: (lambda t: L.upsert_latest(t, t.withColumns({"ts_ms": F.col("ts_ms") + 5, "event_type": F.concat("event_type", F.lit("!"))}), ["user_id"], "ts_ms"))(B.read(spark, d, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "event_type"))
)
simple("snk5_ded4_patch", lambda t: L.patch(t, t.filter("direction = 'credit'").select("id", F.create_map(F.lit("duplicate_of_id"), F.lit(None).cast("string"), F.lit("notes"), F.concat(F.lit("n"), F.col("id").cast("string"))).alias("set"))).select("id", "notes", "duplicate_of_id", "category_id"), "SELECT id, CASE WHEN direction = 'credit' THEN 'n' || id ELSE notes END AS notes, CASE WHEN direction <> 'credit' THEN duplicate_of_id END AS duplicate_of_id, category_id FROM ledger")
simple("snk5_delete_category", lambda t: L.delete_category(t, "error").select("id", "category_id"), "SELECT id, nullif(category_id, 'error') AS category_id FROM ledger")
simple("snk8_without_tenant", lambda t: L.without_tenant(t, 4).select("id", "user_id"), "SELECT id, user_id FROM ledger WHERE user_id <> 4")


@query("snk7_scl5_seal", over(B.LEDGER, folds.SEALED))
def snk7_seal(spark: SparkSession, d: str) -> DataFrame:
    """Sealed rows, with the payload opened again; a table of keys by tenant stands for the key store."""
    t = B.ledger(spark, d).withColumns({c: F.lit(None).cast("string") for c in ("enc_payload", "amount_bidx", "ref_bidx", "bank", "card_last4", "raw")})
    keys = t.select("user_id").distinct().withColumn("key", F.unhex(F.sha2(F.concat(F.lit("key of "), F.col("user_id").cast("string")), 256)))
    return L.unseal(L.seal(t, keys), keys).select("id", "amount_paise", "payload", "amount_bidx", "ref_bidx")


_CHANGED = """SELECT id, user_id, CASE WHEN user_id % 5 = 1 AND direction = 'credit' THEN 'n' || id ELSE notes END AS notes, CASE WHEN user_id % 5 = 1 AND direction = 'credit' THEN NULL ELSE duplicate_of_id END AS duplicate_of_id,
  amount_paise + CASE WHEN user_id % 7 = 2 AND id % 3 = 0 THEN 1 ELSE 0 END AS amount_paise FROM ledger WHERE user_id <> 4"""


@query("snk3_snk5_snk8_in_parts", over(B.LEDGER, _CHANGED))
def snk_in_parts(spark: SparkSession, d: str) -> DataFrame:
    """A stored ledger after a patch, an upsert and the removal of a tenant, each of which rewrites the parts it touches."""
    t = B.ledger(spark, d)
    table = parts.stored(t, shared_folder(spark), tenants=8, rows=2)
    parts.patch(table, t.filter("user_id % 5 = 1 AND direction = 'credit'").select("user_id", "id", F.create_map(F.lit("duplicate_of_id"), F.lit(None).cast("string"), F.lit("notes"), F.concat(F.lit("n"), F.col("id").cast("string"))).alias("set")))
    later = table.read(spark).filter("user_id % 7 = 2 AND id % 3 = 0").withColumns({"amount_paise": F.col("amount_paise") + 1, "created_at": F.col("created_at") + 1})
    parts.upsert_latest(table, written(later), ["user_id", "id"], "created_at")
    parts.remove_tenant(table, spark, 4)
    return table.read(spark).select("id", "user_id", "notes", "duplicate_of_id", "amount_paise")


# Messages


def _spread(spark: SparkSession, m: DataFrame) -> DataFrame:
    """A message is far cheaper to move than to parse, so those of few files are spread over all cores first."""
    return m.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def messages_query(name: str, sql: str | None, whole: str | None = None) -> Callable:
    """A query over messages; sql is put after what makes them, whole stands by itself."""

    def add(f):
        query(name, whole or over(B.MESSAGES, sql))(lambda spark, d: f(_spread(spark, B.messages(spark, d))))
        return f

    return add


def _quoted(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _match(column: str, p: str) -> str:
    return f"regexp_matches({column}, {_quoted(p)}, 'i')"


_CLASS = "CASE " + " ".join(f"WHEN {_match('text', p)} THEN '{r}'" for p, r in RM.HARD_NEGATIVE) + f" WHEN NOT {_match('text', RM.AMOUNT)} THEN 'no-amount' WHEN NOT (" + " OR ".join(_match("text", p) for p in RM.STRONG_POSITIVE) + ") THEN 'no-transaction-phrase' WHEN (" + " OR ".join(_match("text", p) for p in RM.SOFT_NEGATIVE) + f") AND NOT {_match('text', RM.DEFINITIVE)} THEN 'promo' ELSE 'ok' END"
_PROVIDER = lambda i, other: "CASE " + " ".join(f"WHEN {_match('sender', p[3])} THEN " + (_quoted(p[i]) if p[i] else "NULL") for p in RM.PROVIDERS) + f" ELSE {other} END"
messages_query("cls1_classify", f"SELECT message_id, {_CLASS} AS reason, {_CLASS} = 'ok' AS is_txn FROM texts")(lambda m: C.classify(m).select("message_id", "reason", "is_txn"))
messages_query("cls6_provider", f"SELECT message_id, {_PROVIDER(0, _quoted('generic'))} AS provider, {_PROVIDER(1, 'NULL')} AS bank, {_PROVIDER(2, 'NULL')} AS channel_hint FROM texts")(lambda m: m.select("message_id", C.provider(F.col("sender")).alias("provider"), C.bank(F.col("sender")).alias("bank"), C.channel_hint(F.col("sender")).alias("channel_hint")))
messages_query("src5_sender_filter", f"SELECT message_id, sender FROM messages WHERE {_PROVIDER(0, 'NULL')} IS NOT NULL")(lambda m: m.filter(C.looks_relevant(F.col("sender"))).select("message_id", "sender"))
_TEXT = lambda m: m.withColumn("text", C.scanned(F.col("subject"), F.col("body")))
_ONE = lambda p: f"nullif(regexp_extract(text, {_quoted(p)}, 1, 'i'), '')"
_VPA = f"list_filter(list_transform(regexp_extract_all(text, {_quoted(RM.VPA)}, 1, 'i'), lambda v: lower(v)), lambda v: split_part(v, '@', 2) NOT IN ({', '.join(map(_quoted, RM.EMAIL_PROVIDERS))}))[1]"
messages_query("ext4_upi_id", f"SELECT message_id, {_VPA} AS upi_id FROM texts")(lambda m: _TEXT(m).select("message_id", X.upi_id(F.col("text")).alias("upi_id")))
_REF = "coalesce(" + ", ".join(f"CASE WHEN NOT regexp_matches({_ONE(p)}, '^\\d{{1,2}}[-/]\\d{{1,2}}') THEN {_ONE(p)} END" for p in RM.REFERENCE) + ")"
messages_query("ext5_reference", f"SELECT message_id, {_REF} AS reference FROM texts")(lambda m: _TEXT(m).select("message_id", X.reference(F.col("text")).alias("reference")))
_CARD = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, {_quoted(p)}, 1), '')" for p in RM.CARD) + ")"
messages_query("ext6_card", f"SELECT message_id, {_CARD} AS card_last4 FROM texts")(lambda m: _TEXT(m).select("message_id", X.card_last4(F.col("text")).alias("card_last4")))
_CHAN = f"CASE WHEN {_VPA} IS NOT NULL OR {_match('text', chr(92) + 'bvpa' + chr(92) + 'b')} THEN 'UPI' WHEN {_match('text', chr(92) + 'bcard' + chr(92) + 'b')} AND {_CARD} IS NOT NULL THEN 'Card' " + " ".join(f"WHEN {_match('text', p)} THEN '{c}'" for p, c in RM.CHANNEL_WORDS) + f" ELSE {_PROVIDER(2, 'NULL')} END"
messages_query("ext7_channel", f"SELECT message_id, {_CHAN} AS channel FROM texts")(lambda m: _TEXT(m).select("message_id", X.channel(F.col("text"), X.upi_id(F.col("text")), X.card_last4(F.col("text")), C.channel_hint(F.col("sender"))).alias("channel")))
_NARR = RM.NARRATION
messages_query("ext10_narration", f"SELECT message_id, nullif(regexp_extract(text, {_quoted(_NARR)}, 1), '') AS ref, lower(nullif(regexp_extract(text, {_quoted(_NARR)}, 4), '')) AS upi_id FROM texts")(lambda m: _TEXT(m).select("message_id", X.narration(F.col("text")).alias("n")).select("message_id", "n.ref", "n.upi_id"))
messages_query("ext18_collapse", "SELECT message_id, trim(regexp_replace(replace(body, ' ', '   '), '[ \\t]+', ' ', 'g')) AS text FROM messages")(lambda m: m.select("message_id", T.collapse_whitespace(F.replace("body", F.lit(" "), F.lit("   "))).alias("text")))
_OK = f"ok AS (SELECT * FROM texts WHERE {_CLASS} = 'ok')"


def parsed_query(name: str, ctes: str, sql: str) -> Callable:
    """A query over the messages that are payments; its SQL reads their texts."""
    return messages_query(name, None, over(f"{B.MESSAGES}, {_OK}, {ctes}", sql))


_paid = lambda m: C.payments(C.classify(m))
parsed_query("ext1_ext3_amounts", P.MONEY, "SELECT message_id, hits[1].paise AS first_paise, len(hits)::INT AS n, amount_paise FROM money")(
    lambda m: _paid(m).withColumns({"a": X.amounts(F.col("text")), "d": X.direction(F.col("text"))}).select("message_id", F.get("a", F.lit(0))["paise"].alias("first_paise"), F.size("a").alias("n"), X.amount(F.col("a"), F.col("d.place")).alias("amount_paise"))
)
parsed_query("ext2_direction", P.MONEY, "SELECT message_id, direction FROM money")(lambda m: _paid(m).select("message_id", X.direction(F.col("text"))["direction"].alias("direction")))
parsed_query("ext16_occurred_at", P.TIMES, "SELECT message_id, occurred_at AS ms, parsed, precise FROM timed")(lambda m: _paid(m).select("message_id", X.occurred_at(F.col("text"), F.col("arrived_at")).alias("w")).select("message_id", "w.*"))
parsed_query("ext13_ext11_ext12_merchant", P.merchants("ok", _VPA), "SELECT message_id, m.name AS name, m.source AS source FROM named")(
    lambda m: _paid(m).withColumn("n", X.narration(F.col("text"))).withColumn("v", F.coalesce(F.col("n.upi_id"), X.upi_id(F.col("text")))).select("message_id", X.merchant(F.col("text"), F.col("n.merchant"), F.col("v")).alias("m")).select("message_id", "m.name", "m.source")
)
parsed_query("ext9_suffixes", P.merchants("ok", _VPA), f"SELECT message_id, {P.stripped('m.name')} AS name FROM named WHERE m.name IS NOT NULL")(
    lambda m: C.kept(X.named(_paid(m)).select("message_id", "m.name"), F.col("name").isNotNull()).select("message_id", T.strip_suffixes(F.col("name")).alias("name"))
)
parsed_query("ext14_doubtful_remarks", P.merchants("ok", _VPA), f"SELECT message_id, m.name AS name, {P.DOUBTFUL} AS doubtful FROM named WHERE m.source = 'info-freetext'")(
    lambda m: C.kept(X.named(_paid(m)).select("message_id", "vpa", "m"), F.col("m.source") == "info-freetext").select("message_id", "m.name", (F.col("vpa").isNotNull() & ~X.looks_like_a_name(F.col("m.name"))).alias("doubtful"))
)
_TOLD = lambda group: f"nullif(regexp_extract(text, {_quoted(_NARR)}, {group}), '')"
_STEPS = f"{B.MESSAGES}, {_OK}, {P.MONEY}, {P.TIMES.replace('FROM ok', 'FROM money')}, {P.merchants('timed', _VPA)}"
_PARSED = f"""SELECT *, CASE merchant_source WHEN 'narration' THEN 0.9::DOUBLE WHEN 'vpa-name' THEN 0.85::DOUBLE WHEN 'pattern' THEN 0.7::DOUBLE WHEN 'upi-id' THEN 0.6::DOUBLE WHEN 'info-freetext' THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END AS merchant_confidence,
  least(40 + 25 * (provider <> 'generic')::INT + 12 * (merchant IS NOT NULL)::INT + 10 * (reference_number IS NOT NULL)::INT + 5 * (channel IS NOT NULL)::INT + 5 * parsed::INT, 97)::DOUBLE / 100 AS confidence
FROM (SELECT message_id, user_id, {_PROVIDER(0, _quoted('generic'))} AS provider, amount_paise, direction,
  coalesce(CASE WHEN NOT {P.DOUBTFUL} THEN m.name END, vpa) AS merchant, coalesce(CASE WHEN NOT {P.DOUBTFUL} THEN m.source END, CASE WHEN vpa IS NOT NULL THEN 'upi-id' END) AS merchant_source,
  {_CHAN} AS channel, coalesce({_TOLD(1)}, {_REF}) AS reference_number, vpa AS upi_id, {_CARD} AS card_last4, occurred_at, precise AS occurred_at_precise, parsed FROM named WHERE direction IS NOT NULL AND amount_paise IS NOT NULL)"""
messages_query("ext17_parse", None, over(_STEPS, f"SELECT * EXCLUDE (parsed) FROM ({_PARSED})"))(lambda m: X.parse(C.classify(m)).select("message_id", "user_id", "provider", "amount_paise", "direction", "merchant", "merchant_source", "merchant_confidence", "channel", "reference_number", "upi_id", "card_last4", "occurred_at", "occurred_at_precise", "confidence"))
_PERCENT = lambda c: f"CAST(floor(count({c}) / count(*) * 100 + 0.5) AS BIGINT)"
messages_query("agg7_parse_health", None, over(_STEPS, f"SELECT provider, count(*) AS total, {_PERCENT('merchant')} AS merchant_percent, {_PERCENT('upi_id')} AS upi_id_percent, {_PERCENT('reference_number')} AS reference_number_percent, {_PERCENT('card_last4')} AS category_id_percent FROM ({_PARSED}) GROUP BY 1"))(
    lambda m: A.health_percent(A.parse_health(X.parse(C.classify(m)).withColumn("category_id", F.col("card_last4"))))
)
messages_query("src8_sms", "SELECT 'sms:' || sha256(sender || '|' || body || '|' || (arrived_at // 60000)) AS message_id, user_id, arrived_at, sender FROM messages")(lambda m: messages.sms(m.select("user_id", "sender", "body", F.lit(None).cast("string").alias("timestamp"), F.col("arrived_at").alias("received_at"))).select("message_id", "user_id", "arrived_at", "sender"))
query("src9_wallet", "SELECT user_id, 'wallet:' || sha256('Shop ' || k || '|' || p || '|' || (t // 60000)) AS external_id, p AS amount_paise, 'debit' AS direction, 'Card' AS channel, t AS occurred_at FROM (SELECT user_id, (epoch_us(ts) // 1000) AS t, CAST(floor(value * 100 + 0.5) AS BIGINT) AS p, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE p > 0")(
    lambda spark, d: messages.wallet(B.read(spark, d, "events").select("user_id", F.concat(F.lit("Shop "), F.get_json_object("props", "$.k")).alias("merchant"), F.col("value").alias("amount"), F.lit(None).cast("string").alias("card"), F.lit(None).cast("string").alias("timestamp"), F.unix_millis(F.col("ts").cast("timestamp")).alias("received_at"))).select("user_id", "external_id", "amount_paise", "direction", "channel", "occurred_at")
)
_TAGLESS = "html"
for _p, _to in ((r"(?is)<style.*?</style>", " "), (r"(?is)<script.*?</script>", " "), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</(p|div|tr|li|h[1-6])>", "\n"), ("<[^>]+>", " "), *((f"(?i){e}", to) for e, to in RM.ENTITIES.items() if e != "&amp;"), ("(?i)&(?:[b-z#0-9][a-z#0-9]*|a[a-ln-z0-9#][a-z#0-9]*|am[a-oq-z0-9#][a-z#0-9]*|amp[a-z#0-9]+|a|am);", " "), ("(?i)&amp;", "&"), (r"[ \t]+", " "), (r"\n\s*\n+", "\n"), (r"\A\s+|\s+\z", "")):
    _TAGLESS = f"regexp_replace({_TAGLESS}, {_quoted(_p)}, {_quoted(_to)}, 'g')"
query("src7_html_to_text", f"SELECT page_id, {_TAGLESS} AS text FROM pages")(lambda spark, d: B.read(spark, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text")))
#: Keys of one file: their number, and not their size, grows with the table.
FILE_KEYS = 400
query("src10_statement_csv", f"SELECT CAST(o_orderkey // {FILE_KEYS} AS VARCHAR) AS file, CAST(row_number() OVER (PARTITION BY o_orderkey // {FILE_KEYS} ORDER BY o_orderkey) - 1 AS INT) AS row_index, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || '|a \"b\", c|' || o_orderstatus AS cells FROM orders")(lambda spark, d: files.csv_rows(B.read(spark, d, "orders").groupBy(F.floor(F.col("o_orderkey") / FILE_KEYS).cast("string").alias("file")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit(',"a ""b"", c",'), F.col("o_orderstatus")))), "\r\n").alias("value"))).select("file", "row_index", F.array_join("cells", "|").alias("cells")))
query("src13_vcards", f"SELECT CAST(c_custkey // {FILE_KEYS} AS VARCHAR) AS file, CAST(row_number() OVER (PARTITION BY c_custkey // {FILE_KEYS} ORDER BY c_name) - 1 AS INT) AS nth, c_name AS name, '+91 99900 0' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') AS phones FROM customer")(lambda spark, d: files.cards(B.read(spark, d, "customer").groupBy(F.floor(F.col("c_custkey") / FILE_KEYS).cast("string").alias("file")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("BEGIN:VCARD\nFN:"), F.col("c_name"), F.lit("\nTEL;TYPE=CELL:+91 99900 0"), F.lpad(F.col("c_custkey").cast("string"), 4, "0"), F.lit("\nEND:VCARD")))), "\n").alias("value"))).select("file", "nth", "name", F.array_join("phones", ",").alias("phones")))

# Merchants, contacts, categories


def _normalized(l: str) -> str:
    out = f"CASE WHEN regexp_matches({l}, '^[a-z0-9._-]+@[a-z0-9]+$') THEN split_part({l}, '@', 1) ELSE {l} END"
    for pattern, put in ((r"[*_]", " "), (r"[^a-z0-9@ .&-]", " "), (RM.NOISE_WORDS, " "), (r"\s+", " ")):
        out = f"regexp_replace({out}, {_quoted(pattern)}, '{put}', 'g')"
    return f"nullif(trim(regexp_replace(trim({out}), '\\s+\\d{{2,}}$', '')), '')"


query("ent1_normalize_merchant", f"SELECT id, {_normalized('l')} AS norm FROM (SELECT p_partkey AS id, lower(trim(p_name || ' Online*Services ' || p_brand || ' Pvt Ltd ' || p_size)) AS l FROM part UNION ALL SELECT s_suppkey + 1000000, lower(s_name || '@YBL') FROM supplier)")(
    lambda spark, d: B.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" Online*Services "), "p_brand", F.lit(" Pvt Ltd "), F.col("p_size").cast("string")).alias("raw")).union(B.read(spark, d, "supplier").select(F.col("s_suppkey") + 1_000_000, F.concat("s_name", F.lit("@YBL")))).select("id", T.normalize_merchant(F.col("raw")).alias("norm"))
)
query("ent3_phones", "SELECT c_custkey AS id, CASE WHEN length(d) >= 10 THEN right(d, 10) END AS phone FROM (SELECT c_custkey, regexp_replace('+91 9' || (c_custkey * 7919) || '-' || c_custkey, '\\D', '', 'g') AS d FROM customer)")(lambda spark, d: B.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), R.normalize_phone(F.concat(F.lit("+91 9"), (F.col("c_custkey") * 7919).cast("string"), F.lit("-"), F.col("c_custkey").cast("string"))).alias("phone")))
query("ent8_similarity", "SELECT a.p_partkey AS a, b.p_partkey AS b, 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) AS similarity FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size")(
    lambda spark, d: R.similarities(B.read(spark, d, "part"), ["p_brand", "p_size"], "p_partkey", "p_name")
)


@query("ent5_match_contact", over(B.LEDGER, folds.CONTACTS.replace("NORM", _normalized("lower(trim(merchant))"))))
def ent5(spark: SparkSession, d: str) -> DataFrame:
    t = B.ledger(spark, d).select("user_id", "upi_id", "merchant")
    people = t.filter("upi_id IS NOT NULL").groupBy("user_id").agg(F.min("upi_id").alias("low"), F.max("merchant").alias("m"))
    contacts = people.select(F.col("user_id").alias("id"), "user_id", F.col("m").alias("name"), F.coalesce(T.normalize_merchant(F.col("m")), F.lit("someone")).alias("name_normalized"), F.lit("[]").alias("phones"), F.concat(F.lit('["'), F.substring_index("low", "@", 1), F.lit('@mail.example"]')).alias("emails"), F.lit(0).cast("long").alias("created_at"))
    return R.match_contacts(t, contacts).select("user_id", "upi_id", "merchant", "contact_id", "tier")


_CONTACT = "message_id % 23 = 0"
_ALIAS = "CASE norm " + " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in RC.KNOWN_MERCHANTS.items()) + " END"


def _resolved(contact: str) -> str:
    """The final merchant of parsed messages; contact says where one is known by that name."""
    return f"""SELECT message_id, CASE WHEN {contact} THEN 'Asha Rao' ELSE coalesce(alias, plain) END AS merchant, {_normalized('k')} AS merchant_normalized,
        CASE WHEN {contact} THEN 'contact' ELSE merchant_source END AS merchant_source, CASE WHEN {contact} THEN 1.0::DOUBLE WHEN alias IS NOT NULL THEN greatest(merchant_confidence, 0.95::DOUBLE) ELSE merchant_confidence END AS merchant_confidence
        FROM (SELECT *, lower(trim(CASE WHEN {contact} THEN 'Asha Rao' ELSE coalesce(alias, plain, upi_id) END)) AS k
          FROM (SELECT *, {_ALIAS} AS alias FROM (SELECT *, {_normalized('l')} AS norm
            FROM (SELECT *, lower(trim(coalesce(plain, upi_id))) AS l FROM (SELECT *, CASE WHEN merchant_source IN ('pattern', 'narration') THEN {P.stripped('merchant')} ELSE merchant END AS plain FROM ({_PARSED}))))))"""


@query(
    "str9_reprocess",
    over(
        f"{_STEPS}, parsed_rows AS ({_PARSED}), final AS ({_resolved('FALSE')})",
        "SELECT m.message_id AS id, CASE WHEN hit THEN f.merchant ELSE 'old' END AS merchant, CASE WHEN hit THEN f.merchant_normalized ELSE 'old' END AS merchant_normalized, CASE WHEN hit THEN f.merchant_source ELSE 'pattern' END AS merchant_source, CASE WHEN hit THEN p.occurred_at ELSE m.arrived_at END AS occurred_at, CASE WHEN hit THEN coalesce(p.upi_id, 'old@upi') ELSE 'old@upi' END AS upi_id, CASE WHEN hit THEN p.reference_number END AS reference_number FROM (SELECT *, coalesce(user_id % 2 = 0, false) AND message_id IN (SELECT message_id FROM parsed_rows) AS hit FROM messages) m LEFT JOIN parsed_rows p USING (message_id) LEFT JOIN final f USING (message_id)",
    ),
)
def str9(spark: SparkSession, d: str) -> DataFrame:
    """Every second tenant is behind the parser: its rows are derived anew, the others stay; a second run finds none behind."""
    m = _spread(spark, B.messages(spark, d))
    raw = F.to_json(F.struct(F.col("sender").alias("from"), "subject", "body", F.col("arrived_at").alias("internalDate")))
    none = lambda kind: F.lit(None).cast(kind)
    old = {"merchant": F.lit("old"), "merchant_normalized": F.lit("old"), "merchant_source": F.lit("pattern"), "merchant_confidence": F.lit(0.7), "occurred_at": F.col("arrived_at"), "confidence": F.lit(0.5), "upi_id": F.lit("old@upi"), "source": F.lit("gmail"), "deleted_at": none("long"), "raw": raw}
    txns = m.withColumn("id", F.col("message_id")).withColumns(old | {c: none("string") for c in ("channel", "reference_number", "card_last4", "bank", "category_id", "category_source")}).drop("message_id", "sender", "subject", "body", "arrived_at")
    users = B.ledger(spark, d).select(F.col("user_id").alias("id")).distinct().withColumn("parser_version_applied", F.when(F.col("id") % 2 != 0, 1))
    contacts = spark.createDataFrame([], "id long, user_id long, name string, name_normalized string, phones string, emails string, created_at long")
    categories, rules = spark.createDataFrame([], "id string, user_id long, name string"), spark.createDataFrame([], "id long, user_id long, pattern string, category_id string, created_at long")
    txns = written(txns)
    fresh, after = ingest.reprocess_due(txns, users, contacts, categories, rules)
    fresh = written(fresh)
    if not ingest.due_for_reprocess(after).isEmpty():
        raise ValueError("a tenant is still behind")
    rest = txns.join(fresh.select("id"), "id", "left_anti")
    return fresh.unionByName(rest.select(fresh.columns)).select("id", "merchant", "merchant_normalized", "merchant_source", "occurred_at", "upi_id", "reference_number")


query("ent2_resolve_merchant", over(_STEPS, _resolved(_CONTACT)))(lambda spark, d: ent2(spark, d))


def ent2(spark: SparkSession, d: str) -> DataFrame:
    p = X.parse(C.classify(_spread(spark, B.messages(spark, d)))).withColumn("contact_name", F.when(F.col("message_id") % 23 == 0, "Asha Rao"))
    return R.resolve_merchant(p).select("message_id", "merchant", "merchant_normalized", "merchant_source", "merchant_confidence")


def _category_rows(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("swiggy", "amazonpay", "corner cafe", "uberx", "hotel sun", "zepto now", "nothing")])
    t = B.ledger(spark, d)
    return t.select("id", "user_id", F.get(words, (F.col("id") % 7).cast("int")).alias("merchant_normalized"), F.lit(None).cast("string").alias("merchant"), "upi_id", F.when(F.col("id") % 4 == 0, "Your UBER ride").otherwise("Alert").alias("email_subject"))


_RULES_SQL = lambda hay, rules: "coalesce(" + ", ".join(f"CASE WHEN {_match(hay, chr(92) + 'b' + w.replace('.', chr(92) + '.') + chr(92) + 'b')}" + (f" AND NOT contains(replace({hay}, ' ', ''), '{u}')" if u else "") + f" THEN '{c.lower()}' END" for w, c, u in sorted(rules, key=lambda r: -len(r[0]))) + ")"
query(
    "cat1_categorize",
    over(
        B.LEDGER,
        f"""SELECT id, coalesce(u, b, g) AS category_id, CASE WHEN u IS NOT NULL THEN 'user' WHEN b IS NOT NULL THEN 'brand' WHEN g IS NOT NULL THEN 'generic' END AS category_source FROM (
        SELECT id, CASE WHEN contains(hay, 'shop1') THEN 'food' END AS u, {_RULES_SQL('hay', RC.BRANDS)} AS b, {_RULES_SQL('own', RC.GENERIC)} AS g
        FROM (SELECT id, lower(concat_ws(' | ', w, upi_id, s)) AS hay, lower(concat_ws(' | ', w, upi_id)) AS own FROM (
          SELECT id, upi_id, ['swiggy', 'amazonpay', 'corner cafe', 'uberx', 'hotel sun', 'zepto now', 'nothing'][id % 7 + 1] AS w, CASE WHEN id % 4 = 0 THEN 'Your UBER ride' ELSE 'Alert' END AS s FROM ledger)))""",
    ),
)(
    lambda spark, d: CAT.categorize(
        _category_rows(spark, d),
        B.ledger(spark, d).select("user_id").distinct().withColumn("c", F.explode(F.array(*[F.lit(n) for n, _ in RC.DEFAULT_CATEGORIES]))).select(F.lower("c").alias("id"), "user_id", F.col("c").alias("name")),
        B.ledger(spark, d).select("user_id").distinct().select(F.col("user_id").alias("id"), "user_id", F.lit("SHOP1").alias("pattern"), F.lit("food").alias("category_id"), F.lit(1).cast("long").alias("created_at")),
    ).select("id", "category_id", "category_source")
)
_EVERY = [*RC.BRANDS, *RC.GENERIC]
_EVERY_TEXT = "[" + ", ".join(_quoted(w) for w, _, _ in _EVERY) + f"][id % {len(_EVERY)} + 1]"


@query(
    "cat4_cat5_every_rule",
    over(
        B.LEDGER,
        f"""SELECT id, coalesce(b, g) AS category_id, CASE WHEN b IS NOT NULL THEN 'brand' WHEN g IS NOT NULL THEN 'generic' END AS category_source FROM (
        SELECT id, {_RULES_SQL('hay', RC.BRANDS)} AS b, {_RULES_SQL('hay', RC.GENERIC)} AS g FROM (
          SELECT id, lower(CASE id // {len(_EVERY)} % 5 WHEN 0 THEN w WHEN 1 THEN upper(w) || ' store' WHEN 2 THEN 'x' || w WHEN 3 THEN 'the ' || w || 's' ELSE w || ' pay' END) AS hay FROM (SELECT id, {_EVERY_TEXT} AS w FROM ledger)))""",
    ),
)
def cat4_cat5(spark: SparkSession, d: str) -> DataFrame:
    """Every brand and generic word as a merchant: alone, in capitals with a word behind, run into letters before or behind, and before the word that may exclude it."""
    t = B.ledger(spark, d)
    w, form = F.get(F.split(F.lit("\x01".join(r[0] for r in _EVERY)), "\x01"), (F.col("id") % len(_EVERY)).cast("int")), F.floor(F.col("id") / len(_EVERY)) % 5
    said = F.when(form == 0, w).when(form == 1, F.concat(F.upper(w), F.lit(" store"))).when(form == 2, F.concat(F.lit("x"), w)).when(form == 3, F.concat(F.lit("the "), w, F.lit("s"))).otherwise(F.concat(w, F.lit(" pay")))
    none = F.lit(None).cast("string")
    rows = t.select("id", "user_id", said.alias("merchant_normalized"), none.alias("merchant"), none.alias("upi_id"), none.alias("email_subject"))
    named = t.select("user_id").distinct().withColumn("name", F.explode(F.array(*[F.lit(n) for n, _ in RC.DEFAULT_CATEGORIES]))).select(F.lower("name").alias("id"), "user_id", "name")
    rules = spark.createDataFrame([], "id long, user_id long, pattern string, category_id string, created_at long")
    return CAT.categorize(rows, named, rules).select("id", "category_id", "category_source")


@query(
    "jn12_own_rules",
    """WITH rules AS (SELECT c_custkey AS id, c_nationkey AS user_id, lower(right(c_name, 1 + c_custkey % 4)) AS pattern, c_mktsegment AS category_id, c_custkey * 7919 % 1000 AS created_at FROM customer WHERE c_mktsegment <> 'MACHINERY' OR c_nationkey % 2 = 1),
    texts AS (SELECT o_orderkey AS id, c_nationkey AS user_id, lower(c_name || ' | ' || o_orderpriority || ' ' || o_orderkey) AS hay FROM orders JOIN customer ON o_custkey = c_custkey),
    hits AS (SELECT t.id, arg_min(r.category_id, (r.created_at, r.id)) AS category_id FROM texts t JOIN rules r ON r.user_id = t.user_id AND contains(t.hay, r.pattern) GROUP BY t.id)
    SELECT texts.id, category_id, CASE WHEN category_id IS NOT NULL THEN 'user' END AS category_source FROM texts LEFT JOIN hits USING (id)""",
)
def jn12_own_rules(spark: SparkSession, d: str) -> DataFrame:
    """A rule for every customer, a nation's customers being a tenant's rules; of each tenant's orders the first created rule that matches."""
    c, o = B.read(spark, d, "customer"), B.read(spark, d, "orders")
    users = c.select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").cast("long").alias("user_id"))
    none = F.lit(None).cast("string")
    subject = F.concat("o_orderpriority", F.lit(" "), F.col("o_orderkey").cast("string"))
    txns = o.join(users, "o_custkey").select(F.col("o_orderkey").alias("id"), "user_id", none.alias("merchant_normalized"), F.col("c_name").alias("merchant"), none.alias("upi_id"), subject.alias("email_subject"))
    who = F.col("c_nationkey").cast("long").alias("user_id")
    rules = c.select(F.col("c_custkey").alias("id"), who, F.right("c_name", (1 + F.col("c_custkey") % 4).cast("int")).alias("pattern"), F.col("c_mktsegment").alias("category_id"), (F.col("c_custkey") * 7919 % 1000).cast("long").alias("created_at"))
    named = c.filter("c_mktsegment <> 'MACHINERY' OR c_nationkey % 2 = 1").select(who, F.col("c_mktsegment").alias("id"), F.col("c_mktsegment").alias("name")).distinct()
    return CAT.categorize(txns, named, rules).select("id", "category_id", "category_source")


simple("cat7_apply_rule", lambda t: CAT.apply_rule(t, 3, "Shop 4", "food").select("id", "category_id"), f"SELECT id, CASE WHEN user_id = 3 AND category_id IS NULL AND {ALIVE} AND contains(lower(concat_ws(' ', merchant, merchant_normalized, upi_id, email_subject)), 'shop 4') THEN 'food' ELSE category_id END AS category_id FROM ledger")
query("cat8_default_categories", "SELECT c_custkey AS user_id, name, color FROM customer, (VALUES " + ", ".join(f"('{n}', '{c}')" for n, c in RC.DEFAULT_CATEGORIES) + ") v(name, color) WHERE c_nationkey <> 3")(lambda spark, d: (lambda u: CAT.default_categories(u.select("user_id"), u.filter("c_nationkey = 3")))(B.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")))

# Matching and duplicates

_PAIRS = "SELECT e.id AS event_id, l.id AS txn_id, abs(l.occurred_at - {at}) AS distance, l.category_id IS NOT NULL AS categorised FROM logged e JOIN ledger l ON l.user_id = e.user_id AND l.amount_paise = e.amount_paise AND l.direction = e.direction AND l.deleted_at IS NULL AND abs(l.occurred_at - {at}) <= 259200000"
_AT = "coalesce(e.occurred_at, e.created_at)"


def matching(name: str, f: Callable[[DataFrame, DataFrame], DataFrame], body: str) -> None:
    query(name, body if body.startswith("WITH") else over(B.LEDGER + "," + B.SHORTCUTS, body))(lambda spark, d: f(B.shortcut_events(spark, d), B.ledger(spark, d)))


matching("jn8_mat1_candidates", lambda e, t: M.candidates(e, t).select("event_id", "txn_id", "distance", "categorised"), _PAIRS.format(at=_AT))
_TOP = "SELECT event_id, txn_id, distance, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY distance, categorised, txn_id) AS INT) AS rank FROM ({p})) WHERE rank <= 5"
matching("win1_jn14_top5", lambda e, t: M.top_candidates(e, t).select("event_id", "txn_id", "distance", "rank"), _TOP.format(p=_PAIRS.format(at=_AT)))
matching("mat7_pending_list", lambda e, t: M.pending_with_candidates(e, t).select("event_id", "txn_id", "distance", "rank"), _TOP.format(p=_PAIRS.format(at="e.created_at") + " AND e.status = 'pending'"))
_AUTO = f"SELECT event_id, CASE WHEN count(*) = 1 THEN min(txn_id) WHEN count(*) FILTER (distance <= 1800000) = 1 THEN min(txn_id) FILTER (distance <= 1800000) END AS txn_id, least(count(*), 5) AS n FROM ({_PAIRS.format(at=_AT)}) GROUP BY 1"
matching("mat2_win3_auto_match", lambda e, t: M.auto_match(e, t), f"SELECT event_id, txn_id FROM ({_AUTO}) WHERE txn_id IS NOT NULL")
matching("mat5_src14_outcome", M.outcome, f"SELECT e.id AS event_id, CASE WHEN txn_id IS NOT NULL THEN 'matched' WHEN n IS NOT NULL THEN 'pending' ELSE 'queued' END AS status, coalesce(n, 0) AS candidates, txn_id FROM logged e LEFT JOIN ({_AUTO}) a ON a.event_id = e.id")
matching("mat3_resolve_pending", lambda e, t: M.resolve_pending(t, e), folds.RESOLVED)
_APPLIED = ["id", "user_id", "category_id", "notes"]


def _applied(e: DataFrame, t: DataFrame) -> DataFrame:
    """All events and all transactions after the pending events that have a match are applied."""
    txns, events = M.apply_matches(t, e, M.auto_match(e.filter("status = 'pending'"), t))
    closed = events.select(F.lit("event").alias("kind"), *_APPLIED, "status", "matched_transaction_id")
    return closed.unionByName(txns.select(F.lit("transaction").alias("kind"), *_APPLIED), allowMissingColumns=True)


matching(
    "mat4_apply",
    _applied,
    f"""SELECT 'event' AS kind, e.id, user_id, category_id, notes, CASE WHEN m.txn_id IS NOT NULL THEN 'matched' ELSE status END AS status, m.txn_id AS matched_transaction_id
    FROM logged e LEFT JOIN (SELECT * FROM ({_AUTO})) m ON m.event_id = e.id AND e.status = 'pending'
    UNION ALL SELECT 'transaction', l.id, l.user_id, CASE WHEN m.txn_id IS NOT NULL THEN 'rent' ELSE l.category_id END, coalesce(m.notes, l.notes), NULL, NULL
    FROM ledger l LEFT JOIN (SELECT a.txn_id, last(e.notes ORDER BY e.created_at, e.id) AS notes FROM ({_AUTO}) a JOIN logged e ON e.id = a.event_id AND e.status = 'pending' WHERE a.txn_id IS NOT NULL GROUP BY 1) m ON m.txn_id = l.id""",
)
matching("mat6_decide", lambda e, t: M.decide(e, e.select(F.col("id").alias("event_id"), F.when(F.col("direction") == "debit", F.col("id") - 1_000_000_000).alias("txn_id"))).select("id", "status", "matched_transaction_id"), "SELECT id, CASE WHEN status <> 'pending' THEN status WHEN direction = 'debit' THEN 'resolved' ELSE 'dismissed' END AS status, CASE WHEN status = 'pending' AND direction = 'debit' THEN id - 1000000000 END AS matched_transaction_id FROM logged")
simple("ded3_first_by_key", lambda t: D.first_by_key(t).select("id"), "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, gmail_message_id ORDER BY created_at, id) AS rn FROM ledger) WHERE gmail_message_id IS NULL OR rn = 1")
_FLAGS = folds.recursive(B.LEDGER, folds.FLAGGED, "SELECT id, dup AS duplicate_of_id FROM fold WHERE id IS NOT NULL")
query("ded1_flag_duplicates", _FLAGS)(lambda spark, d: D.flag_duplicates(B.ledger(spark, d)))


@query("ded1_flag_batch", _FLAGS)
def ded1_batch(spark: SparkSession, d: str) -> DataFrame:
    """The later half of the ledger as a batch that comes after the earlier one."""
    ledger = B.ledger(spark, d)
    half = ledger.agg(F.percentile_approx("created_at", 0.5)).first()[0]
    old, new = ledger.filter(F.col("created_at") <= half), ledger.filter(F.col("created_at") > half)
    flags = written(D.flag_duplicates(old))
    return flags.unionByName(D.flag_duplicates(new, old.drop("duplicate_of_id").join(flags, "id")))


@query("ded2_statement_duplicates", folds.recursive(B.LEDGER, folds.STATEMENT, folds.STATEMENT_PAIRS))
def ded2(spark: SparkSession, d: str) -> DataFrame:
    t = B.ledger(spark, d)
    rows = t.select("user_id", F.col("id").alias("row_index"), "amount_paise", "direction", "reference_number", (F.col("occurred_at") + 3 * 3_600_000).alias("occurred_at"))
    return D.statement_duplicates(rows, ST.numbered(t))


def _statement_rows(spark: SparkSession, d: str) -> DataFrame:
    o = B.read(spark, d, "orders")
    i, p = F.col("o_orderkey"), F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")
    money = F.concat(F.floor(p / 100).cast("long").cast("string"), F.lit("."), F.lpad((p % 100).cast("string"), 2, "0"))
    day = F.lpad((i % 28 + 1).cast("string"), 2, "0")
    date = F.when(i % 13 == 0, "n/a").when(i % 7 == 0, F.concat(day, F.lit("/06/2019"))).otherwise(F.concat(day, F.lit("-Jul-2026")))
    cells = F.array(date, F.concat(F.lit("UPI-SHOP"), (i % 50).cast("string"), F.lit("-shop"), (i % 50).cast("string"), F.lit("@icici-"), F.lpad(i.cast("string"), 12, "9")), F.when(i % 2 == 0, money).otherwise(""), F.when((i % 2 == 1) & (i % 11 != 0), money).otherwise(""))
    mapping = F.struct(*[F.lit(v).cast("int").alias(k) for k, v in {"date": 0, "narration": 1, "debit": 2, "credit": 3, "amount": None, "crDr": None, "ref": None}.items()])
    return o.select(i.alias("row_index"), cells.alias("cells"), mapping.alias("mapping"))


_NORMALIZED = "SELECT row_index, reason, t AS occurred_at, direction, amount_paise, 'shop' || row_index % 50 || '@icici' AS upi_id FROM (SELECT *, CASE WHEN t IS NULL THEN 'bad-date' WHEN t < 1767205800000 THEN 'before-baseline' WHEN coalesce(amount_paise, 0) = 0 THEN 'bad-amount' END AS reason FROM (SELECT o_orderkey AS row_index, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN epoch_ms(make_timestamp(2019, 6, o_orderkey % 28 + 1, 6, 30, 0)) ELSE epoch_ms(make_timestamp(2026, 7, o_orderkey % 28 + 1, 6, 30, 0)) END AS t, CASE WHEN o_orderkey % 2 = 0 THEN 'debit' WHEN o_orderkey % 11 <> 0 THEN 'credit' END AS direction, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 11 <> 0 THEN CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) END AS amount_paise FROM orders))"
query(
    "stm5_normalize",
    _NORMALIZED,
)(lambda spark, d: ST.normalize(_statement_rows(spark, d)).select("row_index", "reason", "occurred_at", "direction", "amount_paise", "upi_id"))
query(
    "src12_statement_import",
    f"""SELECT row_index % 9 AS user_id, 'stmt:' || sha256(occurred_at || '|' || amount_paise || '|' || direction || '|' || 'upi-shop' || row_index % 50 || '-' || upi_id || '-' || lpad(CAST(row_index AS VARCHAR), 12, '9')) AS external_id,
    amount_paise, direction, upi_id AS merchant, occurred_at FROM ({_NORMALIZED}) WHERE reason IS NULL AND direction IS NOT NULL""",
)(lambda spark, d: messages.statement(ST.normalize(_statement_rows(spark, d)).withColumns({"user_id": F.col("row_index") % 9, "received_at": F.col("occurred_at")})).select("user_id", "external_id", "amount_paise", "direction", "merchant", "occurred_at"))

_STATEMENT = "Bank of Somewhere\r\nAddress, line\r\nDate,Narration,Withdrawal,Deposit,Ref No\r\n"


def _statement_files(spark: SparkSession, d: str) -> DataFrame:
    o = B.read(spark, d, "orders")
    line = F.concat(F.lit("05/07/2026,UPI-SHOP-shop@icici-"), F.lpad(F.col("o_orderkey").cast("string"), 12, "9"), F.lit(",5.00,,R"), F.col("o_orderkey").cast("string"))
    return o.groupBy(F.floor(F.col("o_orderkey") / FILE_KEYS).cast("string").alias("file")).agg(F.concat(F.lit(_STATEMENT), F.array_join(F.array_sort(F.collect_list(line)), "\r\n")).alias("value"))


query("stm1_detect_headers", f"SELECT DISTINCT CAST(o_orderkey // {FILE_KEYS} AS VARCHAR) AS file, 2 AS header_row, 0 AS date, 1 AS narration, 2 AS debit, 3 AS credit, 4 AS ref FROM orders")(lambda spark, d: ST.detect_headers(files.csv_rows(_statement_files(spark, d))).select("file", "header_row", *[F.col(f"mapping.{k}").alias(k) for k in ("date", "narration", "debit", "credit", "ref")]))


_HEADS = ["Date", "Txn Date", "Value Date", "transaction date", "Updated", "Narration", "Description", "PARTICULARS", "Remarks", "Transaction Details", "Debit", "Withdrawal Amt.", "Debit Amount (INR)", "Credit", "Deposit Amt", "Amount", " amount ", "Transaction Amount", "Amount due", "Cr/Dr", "DR/CR", "Type", "Type of account", "Ref No.", "Reference Number", "Cheque No", "UTR", "Balance", "", "Branch: Somewhere", "5,000.00"]
_HEAD_CELLS = ", ".join(f"heads[(o_orderkey * {k} + o_orderkey // {j + 2}) % {len(_HEADS)} + 1]" for j, k in enumerate((7, 11, 13, 17, 19, 23)))
_PLACES = ", ".join(f"list_position(list_transform(cells, lambda c: regexp_matches(trim(c), {_quoted(p)})), true) - 1 AS {k}" for k, p in RM.HEADERS.items())


@query(
    "stm1_header_forms",
    f"""WITH r AS (SELECT o_orderkey // 40 AS file, o_orderkey % 40 AS row_index, [{_HEAD_CELLS}] AS cells FROM (SELECT *, [{", ".join(map(_quoted, _HEADS))}] AS heads FROM orders)),
    p AS (SELECT file, row_index, {_PLACES} FROM r WHERE row_index < 25)
    SELECT file, row_index AS header_row, {", ".join(f"CASE WHEN {k} >= 0 THEN {k}::INT END AS {k}" for k in RM.HEADERS)} FROM p
    WHERE date >= 0 AND narration >= 0 AND (debit >= 0 OR credit >= 0 OR amount >= 0) QUALIFY row_number() OVER (PARTITION BY file ORDER BY row_index) = 1""",
)
def stm1_header_forms(spark: SparkSession, d: str) -> DataFrame:
    """Rows of six cells from forty to a file, each cell one of many wordings of headers or none: the first that is a header, if it is among the first 25, and its columns."""
    heads, i = F.split(F.lit("\x01".join(_HEADS)), "\x01"), F.col("o_orderkey")
    cells = F.array(*[F.get(heads, ((i * k + F.floor(i / (j + 2))) % len(_HEADS)).cast("int")) for j, k in enumerate((7, 11, 13, 17, 19, 23))])
    rows = B.read(spark, d, "orders").select(F.floor(i / 40).alias("file"), (i % 40).alias("row_index"), cells.alias("cells"))
    return ST.detect_headers(rows).select("file", "header_row", *[F.col(f"mapping.{k}").alias(k) for k in RM.HEADERS])


@query("agg14_summary", f"SELECT CAST(o_orderkey // {FILE_KEYS} AS VARCHAR) AS file, count(*) FILTER (o_orderkey % 4 <> 0) AS new, count(*) FILTER (o_orderkey % 4 = 0) AS duplicates, 0 AS bad FROM orders GROUP BY 1")
def agg14(spark: SparkSession, d: str) -> DataFrame:
    rows = files.csv_rows(_statement_files(spark, d))
    good = ST.normalize(ST.below_header(rows, ST.detect_headers(rows)))
    key = F.regexp_extract("reference_number", "R([0-9]+)", 1).cast("long")
    return ST.summary(good.withColumn("existing_id", F.when(key % 4 == 0, key)))


# Streams


def _streamed(spark: SparkSession, stream: DataFrame, keys: list[str]) -> DataFrame:
    folder = shared_folder(spark)
    state.write_once(stream, f"{folder}/out", f"{folder}/checkpoint", keys, PARTS).awaitTermination()
    return state.written_once(spark, f"{folder}/out", stream.schema)


query("str7_stream_duplicates", folds.recursive(B.LEDGER, folds.FLAGGED, "SELECT id, user_id, dup AS duplicate_of_id FROM fold WHERE id IS NOT NULL"))(lambda spark, d: _streamed(spark, state.flag_duplicates(B.ledger(spark, d, B.event_stream(state.stateful(spark), d))), ["id"]))


@query("str8_stream_matches", folds.recursive(B.LEDGER + "," + B.SHORTCUTS, folds.STREAM_MATCHES, "SELECT user_id, CASE WHEN is_txn THEN id ELSE chosen.id END AS txn_id, CASE WHEN is_txn THEN chosen.id ELSE id END AS event_id FROM fold WHERE chosen IS NOT NULL"))
def str8(spark: SparkSession, d: str) -> DataFrame:
    events = B.event_stream(spark, d)
    return _streamed(spark, state.match_events(state.as_arrivals(B.ledger(spark, d, events), B.shortcut_events(spark, d, events))), ["event_id"])


@query("str1_str5_incremental", "SELECT message_id, sender FROM messages WHERE message_id % 4 <> 3")
def str1(spark: SparkSession, d: str) -> DataFrame:
    """Relevant messages of the stream, appended once however often they come: the second run changes nothing."""
    m = B.messages(spark, d, B.event_stream(spark, d)).filter(C.looks_relevant(F.col("sender"))).select("message_id", "sender")
    folder = shared_folder(spark)
    for run in ("a", "b"):
        state.write_once(m, f"{folder}/out", f"{folder}/checkpoint-{run}", ["message_id"], PARTS).awaitTermination()
    return state.written_once(spark, f"{folder}/out", m.schema)


SQL["str1_str5_incremental"] = over(B.MESSAGES, SQL["str1_str5_incremental"])


def _mails(spark: SparkSession, d: str) -> DataFrame:
    """The messages as mails, with a history that rises with their time."""
    m = B.messages(spark, d)
    return m.withColumns({"history_id": F.col("arrived_at") * 1_000_000 + F.col("message_id") % 1_000_000, "status": F.lit(200)})


_RELEVANT = f"SELECT message_id, user_id, sender, body FROM messages WHERE {_PROVIDER(0, 'NULL')} IS NOT NULL"


@query("src1_src2_mailbox", over(B.MESSAGES, f"{_RELEVANT} AND arrived_at BETWEEN {SLICE.start} AND {SLICE.end} AND sender IN ('alerts@hdfcbank.net', 'no-reply@phonepe.com')"))
def src1(spark: SparkSession, d: str) -> DataFrame:
    """A mailbox read with its filters pushed down: pages by time, headers by sender, bodies of what is left."""
    folder = shared_folder(spark)
    mailbox.store(_mails(spark, d), folder)
    mail = mailbox.mail(mailbox.registered(spark), folder)
    return mail.filter(F.col("arrived_at").between(SLICE.start, SLICE.end) & F.col("sender").isin("alerts@hdfcbank.net", "no-reply@phonepe.com")).select("message_id", "user_id", "sender", "body")


@query("str1_str2_str3_replay", over(B.MESSAGES, _RELEVANT))
def str3(spark: SparkSession, d: str) -> DataFrame:
    """A stream from a mailbox that grows between runs and forgets its history: the second run goes back a day, and nothing comes twice."""
    folder, mails = shared_folder(spark), _mails(spark, d)
    session = mailbox.registered(spark)

    def run() -> None:
        m = mailbox.mail_stream(session, f"{folder}/mail").select("message_id", "user_id", "sender", "body")
        state.write_once(m, f"{folder}/out", f"{folder}/checkpoint", ["message_id"], PARTS).awaitTermination()

    mailbox.store(mails.filter(F.col("arrived_at") < SLICE.start), f"{folder}/mail")
    run()
    mailbox.store(mails.filter(F.col("arrived_at") >= SLICE.start), f"{folder}/mail")
    mailbox.expire(f"{folder}/mail", mailbox.newest(f"{folder}/mail")["history"])
    run()
    return state.written_once(spark, f"{folder}/out", "message_id long, user_id long, sender string, body string")


@query("str4_resumed_sync", over(B.MESSAGES, _RELEVANT))
def str4(spark: SparkSession, d: str) -> DataFrame:
    """A sync that runs out of time after some steps and goes on where it stopped."""
    folder, mails = shared_folder(spark), _mails(spark, d)
    mailbox.store(mails, f"{folder}/mail")
    session, ends = mailbox.registered(spark), mails.agg(F.min("history_id").alias("a"), F.max("history_id").alias("z")).first()
    ticks = itertools.count()
    while not mailbox.sync(session, f"{folder}/mail", f"{folder}/out", f"{folder}/cursor", 2.5, (ends.z - ends.a) // 5 + 1, clock=lambda: next(ticks), buckets=PARTS):
        pass
    return state.written_once(spark, f"{folder}/out", mailbox.MAIL).select("message_id", "user_id", "sender", "body")


@query(
    "str10_fetch_outcomes",
    "SELECT event_id AS message_id, CASE WHEN event_id % 23 = 0 THEN 'gone' WHEN event_id % 29 = 0 AND event_id % 7 >= 5 THEN 'dead' WHEN event_id % 29 = 0 AND event_id % 37 <> 0 THEN 'ok' WHEN event_id % 31 = 0 AND event_id % 29 <> 0 OR event_id % 37 = 0 THEN 'bad' ELSE 'ok' END AS outcome, CASE WHEN event_id % 23 <> 0 AND event_id % 29 = 0 THEN least(event_id % 7 + 1, 5) ELSE 1 END AS attempts FROM events",
)
def str10(spark: SparkSession, d: str) -> DataFrame:
    """Mails that are gone, that answer after some tries or never, and that can't be read."""
    i = F.col("message_id")
    status = F.when(i % 23 == 0, 404).when(i % 29 == 0, F.when(F.col("attempts") < i % 7, 429).otherwise(200)).when(i % 31 == 0, 418).otherwise(200)
    fetch = lambda due: due.withColumn("outcome", outcomes.of_status(status, i % 37 != 0))
    return outcomes.settled(B.messages(spark, d).select("message_id"), fetch).select("message_id", "outcome", "attempts")


@query(
    "str11_rejects",
    over(
        B.MESSAGES,
        "SELECT 'push' AS source, message_id::VARCHAR AS key, CASE WHEN message_id % 9 = 0 THEN 'json' WHEN message_id % 10 = 0 THEN 'body' END AS reason FROM messages WHERE message_id % 9 = 0 OR message_id % 10 = 0 UNION ALL SELECT 'statement', o_orderkey::VARCHAR, CASE o_orderkey % 4 WHEN 1 THEN 'bad-date' WHEN 2 THEN 'bad-amount' ELSE 'before-baseline' END FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT 'vcard', c_custkey::VARCHAR, 'no-name' FROM customer WHERE c_custkey % 6 = 0",
    ),
)
def str11(spark: SparkSession, d: str) -> DataFrame:
    """Records of pushes, statements and vCards that are set aside with a reason; none stops the others."""
    i = F.col("message_id")
    told = F.to_json(F.struct(F.lit("sms").alias("type"), "sender", F.when(i % 10 != 0, F.col("body")).alias("body")))
    pushes = B.messages(spark, d).select("user_id", F.col("message_id").alias("received_at"), F.when(i % 9 == 0, F.substring(told, 1, 20)).otherwise(told).alias("json"))
    pushed = outcomes.pushed(pushes, messages.SMS_JSON, {"body": F.length("body") > 0})
    k = F.col("o_orderkey")
    cells = F.array(F.when(k % 4 == 1, "31-31-2026").when(k % 4 == 3, "05/07/2020").otherwise("05/07/2026"), F.lit("UPI"), F.when(k % 4 == 2, "n/a").otherwise("10.00"), F.lit(""))
    rows = B.read(spark, d, "orders").select(k.alias("row_index"), cells.alias("cells"), F.struct(F.lit(0).alias("date"), F.lit(1).alias("narration"), F.lit(2).alias("debit"), F.lit(3).alias("credit"), F.lit(None).cast("int").alias("amount"), F.lit(None).cast("int").alias("crDr"), F.lit(None).cast("int").alias("ref")).alias("mapping"))
    c = F.col("c_custkey")
    card = F.concat(F.lit("BEGIN:VCARD\n"), F.when(c % 6 != 0, F.concat(F.lit("FN:"), "c_name", F.lit("\n"))).otherwise(""), F.lit("TEL:1\nEND:VCARD"))
    cards = files.all_cards(B.read(spark, d, "customer").select(c.cast("string").alias("file"), card.alias("value")))
    out = outcomes.rejects(pushed, "push", F.col("received_at"), F.col("reason"))
    out = out.unionByName(outcomes.rejects(ST.normalize(rows), "statement", F.col("row_index"), F.col("reason")))
    return out.unionByName(outcomes.rejects(cards, "vcard", F.col("file"), F.when(F.col("name").isNull(), "no-name")))


_ADMITTED = folds.admitted(2, 6 * 3_600_000)
query("prj4_win4_admission", _ADMITTED)(lambda spark, d: admission.admitted(B.ledger(spark, d).select("id", "user_id", "created_at"), 2, 6 * 3_600_000).select("id", "user_id", "recent", "admitted"))
query("prj4_admission_stream", _ADMITTED)(lambda spark, d: _streamed(spark, admission.admitted_stream(B.ledger(spark, d, B.event_stream(spark, d)), 2, 6 * 3_600_000), ["id"]))

# Scalars

query("scl4_scl6_hashes", over(B.LEDGER, "SELECT id, 'x:' || sha256(coalesce(merchant, '') || '|' || amount_paise) AS hash, regexp_replace(lower(reference_number), '[^a-z0-9]', '', 'g') AS ref FROM ledger"))(lambda spark, d: B.ledger(spark, d).select("id", S.external_id("x", F.col("merchant"), F.col("amount_paise")).alias("hash"), S.normalized_reference(F.col("reference_number")).alias("ref")))
query("scl10_paise", "SELECT event_id, CAST(floor(value * 100 + 0.5) AS BIGINT) AS paise FROM events")(lambda spark, d: B.read(spark, d, "events").select("event_id", S.paise(F.col("value")).alias("paise")))
query("scl2_format_inr", over(B.ORDERS, folds.RUPEES))(lambda spark, d: B.orders(spark, d).select("id", S.format_inr(F.col("amount_paise")).alias("text")))
query("win4_sliding_rate", over(B.LEDGER, "SELECT id, count(*) OVER (PARTITION BY user_id ORDER BY occurred_at RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW) AS recent FROM ledger"))(lambda spark, d: L.rate(B.ledger(spark, d), at="occurred_at").select("id", "recent"))


@query("stm7_confidence", "SELECT o_orderkey AS row_index, CASE o_orderkey % 3 WHEN 0 THEN 0.7::DOUBLE WHEN 1 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS merchant_confidence, CASE o_orderkey % 3 WHEN 0 THEN 'narration' WHEN 1 THEN 'upi-id' END AS merchant_source, CASE o_orderkey % 3 WHEN 0 THEN 'SHOP' || o_orderkey % 50 WHEN 1 THEN 'shop' || o_orderkey % 50 || '@icici' END AS merchant FROM orders")
def stm7(spark: SparkSession, d: str) -> DataFrame:
    i, shop = F.col("row_index"), (F.col("row_index") % 50).cast("string")
    told = F.when(i % 3 == 0, F.concat(F.lit("UPI/DR/123456789012/SHOP"), shop, F.lit("/YESB/shop@ybl"))).when(i % 3 == 1, F.concat(F.lit("shop"), shop, F.lit("@icici"))).otherwise("CASH")
    rows = _statement_rows(spark, d).withColumn("cells", F.transform("cells", lambda c, k: F.when(k == 1, told).otherwise(c)))
    return ST.normalize(rows).select("row_index", "merchant_confidence", "merchant_source", "merchant")


query("cat9_find_category", "SELECT c_nationkey AS user_id, min(c_custkey) AS id FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1")(
    lambda spark, d: CAT.find_category(B.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("user_id"), F.when(F.col("c_custkey") % 3 == 1, " Food").when(F.col("c_custkey") % 3 == 2, "FOOD ").otherwise("Foods").alias("name")), " fooD ").select("user_id", "id")
)


@query("src6_mime", over(B.MESSAGES, "SELECT message_id, user_id, arrived_at, sender, subject, CASE message_id % 3 WHEN 0 THEN body WHEN 1 THEN 'Dear' || chr(10) || ' ' || sender ELSE '' END AS body FROM messages"))
def src6(spark: SparkSession, d: str) -> DataFrame:
    part = lambda mime, text: F.struct(F.lit(mime).alias("mime"), text.alias("text"))
    html = F.concat(F.lit("<style>p{}</style><p>Dear</p><div>"), F.col("sender"), F.lit("</div>"))
    both, one = F.array(part("text/html", html), part("text/plain", F.col("body"))), F.array(part("text/plain", F.lit("")), part("text/html", html))
    mails = B.messages(spark, d).withColumns({"headers": F.create_map(F.lit("From"), F.col("sender"), F.lit("Subject"), F.col("subject")), "parts": F.when(F.col("message_id") % 3 == 0, both).when(F.col("message_id") % 3 == 1, one).otherwise(F.slice(one, 1, 1))})
    return messages.from_mime(mails)


query("jn5_samples_with_users", over(B.MESSAGES, "SELECT message_id, user_id, c_name || '@mail.example' AS user_email FROM messages LEFT JOIN customer ON c_custkey = user_id"))(
    lambda spark, d: A.samples_with_users(B.messages(spark, d), B.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit("@mail.example")).alias("email"))).select("message_id", "user_id", "user_email")
)


PRESETS = ("7d", "30d", "90d", "month", "year", "all")


@query("scl3_range_presets", over(B.LEDGER, f"SELECT name, begins, ends, (SELECT count(*) FROM ledger WHERE occurred_at BETWEEN begins AND ends) AS n FROM (VALUES ('7d', 1705104000000, 1705708800000), ('30d', 1703116800000, 1705708800000), ('90d', 1697932800000, 1705708800000), ('month', 1704047400000, 1705708800000), ('year', 1704047400000, 1705708800000), ('all', 0, 1705708800000)) AS v(name, begins, ends)"))
def scl3(spark: SparkSession, d: str) -> DataFrame:
    """Transactions in each preset, in one pass."""
    spans = {n: S.range_preset(n, 1_705_708_800_000) for n in PRESETS}
    counts = B.ledger(spark, d).agg(*[F.count(F.when(F.col("occurred_at").between(*span), 1)).alias(n) for n, span in spans.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).cast("long").alias("begins"), F.lit(z).cast("long").alias("ends"), F.col(f"`{n}`").alias("n")) for n, (a, z) in spans.items()])))
