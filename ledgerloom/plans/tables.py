"""The driver's tables in the shape of a ledger; SQL of the same shape for DuckDB stands beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.wordings import WORDINGS, pieces

#: (id, name, color); `signup` is left out so that a category may be unknown.
CATEGORIES = [("click", "Food", "#ff9500"), ("error", "Bills", "#ff3b30"), ("purchase", "Shopping", "#af52de"), ("rent", "Rent", "#ff9f0a")]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "id string, name string, color string")


def ledger(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Transactions from `events`, the table or a stream of it."""
    e = read(spark, sf_dir, "events") if events is None else events
    i, k, at = F.col("event_id"), F.get_json_object("props", "$.k").cast("long"), F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(
        i.alias("id"),
        "user_id",
        at.alias("occurred_at"),
        (i % 4 != 0).alias("occurred_at_precise"),
        F.floor(F.col("value") * 100 + 0.5).cast("long").alias("amount_paise"),
        F.when(F.col("event_type").isin("purchase", "error"), "debit").otherwise("credit").alias("direction"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("category_id"),
        F.when(i % 3 == 1, "UPI").when(i % 3 == 2, "Card").alias("channel"),
        F.when(k % 11 != 0, F.concat(F.lit("SHOP "), k.cast("string"), F.lit(" Pvt Ltd"))).alias("merchant"),
        F.when(k % 7 != 0, F.concat(F.lit("shop "), k.cast("string"))).alias("merchant_normalized"),
        F.when(i % 3 == 1, F.concat(F.lit("shop"), k.cast("string"), F.lit("@icici"))).alias("upi_id"),
        F.when(i % 5 == 0, F.concat(F.lit("REF"), F.lpad((i % 700).cast("string"), 6, "0"))).alias("reference_number"),
        F.when(i % 4 == 1, 0.45).when(i % 4 == 2, 0.7).when(i % 4 == 3, 0.95).alias("merchant_confidence"),
        F.when(i % 6 == 0, "generic").when(i % 6 == 1, "brand").when(i % 6 == 2, "user").alias("category_source"),
        F.when(i % 17 == 0, at + 1).alias("deleted_at"),
        F.when((i % 19 == 0) & (i > 0), i - 1).alias("duplicate_of_id"),
        F.concat(F.lit("Alert "), "event_type").alias("email_subject"),
        F.when(i % 13 == 0, F.concat(F.lit("50%_off "), k.cast("string"))).alias("notes"),
        (at + 1000).alias("created_at"),
        F.when(i % 10 != 3, F.concat(F.lit("m"), (i - i % 2).cast("string"))).alias("gmail_message_id"),
    )


LEDGER = """
ledger AS (
  SELECT event_id AS id, user_id, (epoch_us(ts) // 1000) AS occurred_at, event_id % 4 <> 0 AS occurred_at_precise,
    CAST(floor(value * 100 + 0.5) AS BIGINT) AS amount_paise,
    CASE WHEN event_type IN ('purchase', 'error') THEN 'debit' ELSE 'credit' END AS direction,
    CASE WHEN event_type <> 'view' THEN event_type END AS category_id,
    CASE event_id % 3 WHEN 1 THEN 'UPI' WHEN 2 THEN 'Card' END AS channel,
    CASE WHEN k % 11 <> 0 THEN 'SHOP ' || k || ' Pvt Ltd' END AS merchant,
    CASE WHEN k % 7 <> 0 THEN 'shop ' || k END AS merchant_normalized,
    CASE WHEN event_id % 3 = 1 THEN 'shop' || k || '@icici' END AS upi_id,
    CASE WHEN event_id % 5 = 0 THEN 'REF' || lpad(CAST(event_id % 700 AS VARCHAR), 6, '0') END AS reference_number,
    CASE event_id % 4 WHEN 1 THEN 0.45::DOUBLE WHEN 2 THEN 0.7::DOUBLE WHEN 3 THEN 0.95::DOUBLE END AS merchant_confidence,
    CASE event_id % 6 WHEN 0 THEN 'generic' WHEN 1 THEN 'brand' WHEN 2 THEN 'user' END AS category_source,
    CASE WHEN event_id % 17 = 0 THEN (epoch_us(ts) // 1000) + 1 END AS deleted_at,
    CASE WHEN event_id % 19 = 0 AND event_id > 0 THEN event_id - 1 END AS duplicate_of_id,
    'Alert ' || event_type AS email_subject,
    CASE WHEN event_id % 13 = 0 THEN '50%_off ' || k END AS notes,
    (epoch_us(ts) // 1000) + 1000 AS created_at,
    CASE WHEN event_id % 10 <> 3 THEN 'm' || (event_id - event_id % 2) END AS gmail_message_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
),
categories AS (SELECT * FROM (VALUES ROWS) AS c(id, name, color))
""".replace("ROWS", ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in CATEGORIES))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions from `orders`, which span years."""
    o = read(spark, sf_dir, "orders")
    i, none = F.col("o_orderkey"), F.lit(None)
    return o.join(read(spark, sf_dir, "customer"), o.o_custkey == F.col("c_custkey")).select(
        i.alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("occurred_at"),
        F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long").alias("amount_paise"),
        F.when(F.col("o_orderstatus") == "F", "debit").otherwise("credit").alias("direction"),
        F.col("o_orderpriority").alias("category_id"),
        F.when(i % 3 == 1, "UPI").when(i % 3 == 2, "Card").alias("channel"),
        F.col("c_name").alias("merchant"),
        F.lower("c_name").alias("merchant_normalized"),
        none.cast("long").alias("deleted_at"),
        none.cast("long").alias("duplicate_of_id"),
    )


ORDERS = """
ledger AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, (epoch_us(o_orderdate) // 1000) AS occurred_at, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS amount_paise,
    CASE WHEN o_orderstatus = 'F' THEN 'debit' ELSE 'credit' END AS direction, o_orderpriority AS category_id,
    CASE o_orderkey % 3 WHEN 1 THEN 'UPI' WHEN 2 THEN 'Card' END AS channel, c_name AS merchant, lower(c_name) AS merchant_normalized
  FROM orders JOIN customer ON o_custkey = c_custkey
)
"""


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a stream of files, read as they are there."""
    return spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")


def shortcut_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """A logged expense for every event: near its transaction by up to some hours."""
    t = ledger(spark, sf_dir, events)
    return t.select(
        (F.col("id") + 1_000_000_000).alias("id"),
        "user_id",
        "amount_paise",
        "direction",
        F.lit("rent").alias("category_id"),
        F.concat(F.lit("logged "), F.col("id").cast("string")).alias("notes"),
        F.when(F.col("id") % 9 == 0, "resolved").otherwise("pending").alias("status"),
        F.lit(None).cast("long").alias("matched_transaction_id"),
        F.when(F.col("id") % 2 == 0, F.col("occurred_at") + (F.col("id") % 50) * 60_000).alias("occurred_at"),
        (F.col("occurred_at") + (F.col("id") % 7) * 3_600_000).alias("created_at"),
    )


SHORTCUTS = """
logged AS (
  SELECT id + 1000000000 AS id, user_id, amount_paise, direction, 'rent' AS category_id, 'logged ' || id AS notes,
    CASE WHEN id % 9 = 0 THEN 'resolved' ELSE 'pending' END AS status,
    CASE WHEN id % 2 = 0 THEN occurred_at + (id % 50) * 60000 END AS occurred_at, occurred_at + (id % 7) * 3600000 AS created_at
  FROM ledger
)
"""


def messages(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Alerts written from `events`, in each of the wordings in turn."""
    t = read(spark, sf_dir, "events") if events is None else events
    i, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("long")
    p = F.floor(F.col("value") * 100 + 0.5).cast("long")
    rs = F.concat(F.floor(p / 100).cast("long").cast("string"), F.lit("."), F.lpad((p % 100).cast("string"), 2, "0"))
    values = {"rs": rs, "l": F.lpad((i % 10_000).cast("string"), 4, "0"), "k": k.cast("string"), "ref": F.lpad((i * 7919 % 1_000_000_007).cast("string"), 12, "4")}
    c = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    body = F.lit(None).cast("string")
    for n, wording in enumerate(WORDINGS):
        body = F.when(i % len(WORDINGS) == n, F.concat(*[values[x] if named else F.lit(x) for x, named in pieces(wording)])).otherwise(body)
    sender = F.when(i % 4 == 0, "alerts@hdfcbank.net").when(i % 4 == 1, "no-reply@phonepe.com").when(i % 4 == 2, "InstaAlerts@icicibank.com").otherwise("me@example.org")
    return t.select(i.alias("message_id"), "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("arrived_at"), sender.alias("sender"), c("Alert ", k).alias("subject"), body.alias("body"))


MESSAGES = """
messages AS (
  SELECT event_id AS message_id, user_id, (epoch_us(ts) // 1000) AS arrived_at,
    CASE event_id % 4 WHEN 0 THEN 'alerts@hdfcbank.net' WHEN 1 THEN 'no-reply@phonepe.com' WHEN 2 THEN 'InstaAlerts@icicibank.com' ELSE 'me@example.org' END AS sender,
    'Alert ' || k AS subject,
    CASE event_id % COUNT WORDINGS END AS body
  FROM (SELECT *, CAST(p // 100 AS VARCHAR) || '.' || lpad(CAST(p % 100 AS VARCHAR), 2, '0') AS rs, lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') AS l,
          lpad(CAST(event_id * 7919 % 1000000007 AS VARCHAR), 12, '4') AS ref
        FROM (SELECT *, CAST(floor(value * 100 + 0.5) AS BIGINT) AS p, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))
),
texts AS (SELECT *, substr(subject || chr(10) || body, 1, 6000) AS text FROM messages)
"""
_SAID = lambda x, named: x if named else "'" + x.replace("'", "''") + "'"
MESSAGES = MESSAGES.replace("COUNT", str(len(WORDINGS))).replace("WORDINGS", " ".join(f"WHEN {n} THEN " + " || ".join(_SAID(x, named) for x, named in pieces(w)) for n, w in enumerate(WORDINGS)))
