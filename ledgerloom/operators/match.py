"""Expenses that a user logged, matched with transactions of the same amount near in time.

The equi-join on tenant, amount and direction carries a bucket of time as well, so that one common amount is
spread over many keys; the exact distance is then tested.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_MS, AUTO_MS, LIMIT = 72 * 3_600_000, 30 * 60_000, 5


def logged_at() -> Column:
    return F.coalesce("occurred_at", "created_at")


def candidates(events: DataFrame, txns: DataFrame, at: Column | None = None) -> DataFrame:
    """(event_id, txn_id, distance, categorised, at) within 72 hours; at is an event's time, its own if it has one."""
    at = logged_at() if at is None else at
    bucket = lambda c: F.floor(c / WINDOW_MS)
    left = events.select(F.col("id").alias("event_id"), "user_id", "amount_paise", "direction", at.alias("at")).withColumn("bucket", F.explode(F.array(bucket(F.col("at")) - 1, bucket(F.col("at")), bucket(F.col("at")) + 1)))
    right = txns.filter("deleted_at IS NULL").select(F.col("id").alias("txn_id"), "user_id", "amount_paise", "direction", F.col("occurred_at").alias("txn_at"), F.col("category_id").isNotNull().alias("categorised")).withColumn("bucket", bucket(F.col("txn_at")))
    pairs = left.join(right, ["user_id", "amount_paise", "direction", "bucket"]).withColumn("distance", F.abs(F.col("txn_at") - F.col("at")))
    return pairs.filter(F.col("distance") <= WINDOW_MS).select("event_id", "txn_id", "distance", "categorised", "at")


def _nearest():
    return Window.partitionBy("event_id").orderBy("distance", "categorised", "txn_id")


def top_candidates(events: DataFrame, txns: DataFrame, at: Column | None = None, limit: int = LIMIT) -> DataFrame:
    """The nearest few of each event, those without category first at equal distance."""
    return candidates(events, txns, at).withColumn("rank", F.row_number().over(_nearest())).filter(F.col("rank") <= limit)


def auto_match(events: DataFrame, txns: DataFrame, at: Column | None = None) -> DataFrame:
    """(event_id, txn_id): the only candidate, or the only one within 30 minutes of several; else none."""
    found = candidates(events, txns, at)
    near = F.col("distance") <= AUTO_MS
    out = found.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(near, 1)).alias("close"), F.min("txn_id").alias("only"), F.min(F.when(near, F.col("txn_id"))).alias("only_close"))
    return out.select("event_id", F.when(F.col("n") == 1, F.col("only")).when(F.col("close") == 1, F.col("only_close")).alias("txn_id")).filter("txn_id IS NOT NULL")


def outcome(events: DataFrame, txns: DataFrame) -> DataFrame:
    """Every event's outcome when it is logged: matched, pending (several candidates) or queued (none); the count stops at 5."""
    counts = candidates(events, txns).groupBy("event_id").agg(F.least(F.count(F.lit(1)), F.lit(LIMIT)).alias("candidates"))
    chosen = auto_match(events, txns)
    out = events.select(F.col("id").alias("event_id")).join(counts, "event_id", "left").join(chosen, "event_id", "left")
    status = F.when(F.col("txn_id").isNotNull(), "matched").when(F.col("candidates").isNotNull(), "pending").otherwise("queued")
    return out.select("event_id", status.alias("status"), F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"), "txn_id")


def pending_with_candidates(events: DataFrame, txns: DataFrame) -> DataFrame:
    """The list for deciding by hand; here an event's time is when it was created."""
    return top_candidates(events.filter("status = 'pending'"), txns, F.col("created_at"))


def apply_matches(txns: DataFrame, events: DataFrame, matches: DataFrame, status: str = "matched") -> tuple[DataFrame, DataFrame]:
    """New versions of both tables: the transaction gets category and notes, the event is closed. Events of one
    transaction are applied by creation, then id: the last one's category stays, and the last notes that there are."""
    own = events.select(F.col("id").alias("event_id"), F.col("category_id").alias("_c"), F.col("notes").alias("_n"), F.struct("created_at", "id").alias("_at"))
    last = [F.max_by("_c", "_at").alias("_c"), F.max_by("_n", F.when(F.col("_n").isNotNull(), F.col("_at"))).alias("_n")]
    told = matches.join(own, "event_id").groupBy(F.col("txn_id").alias("id")).agg(*last).withColumn("_hit", F.lit(True))
    new = txns.join(told, "id", "left").withColumns({"category_id": F.when(F.col("_hit"), F.col("_c")).otherwise(F.col("category_id")), "notes": F.coalesce("_n", "notes")}).select(txns.columns)
    closed = matches.select(F.col("event_id").alias("id"), F.col("txn_id").alias("_t"))
    done = events.join(closed, "id", "left").withColumns({"status": F.when(F.col("_t").isNotNull(), status).otherwise(F.col("status")), "matched_transaction_id": F.coalesce("_t", "matched_transaction_id")})
    return new, done.select(events.columns)


def decide(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """Resolving (with txn_id) or dismissing by hand; only pending events change."""
    d = decisions.select(F.col("event_id").alias("id"), F.col("txn_id").alias("_t"), F.lit(True).alias("_hit"))
    hit = (F.col("status") == "pending") & F.coalesce("_hit", F.lit(False))
    out = events.join(d, "id", "left")
    return out.withColumns({"matched_transaction_id": F.when(hit & F.col("_t").isNotNull(), F.col("_t")).otherwise(F.col("matched_transaction_id")), "status": F.when(hit, F.when(F.col("_t").isNotNull(), "resolved").otherwise("dismissed")).otherwise(F.col("status"))}).select(events.columns)


def _resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stretches come one by one, their pending events first, then their transactions in ingest order; each of these
    may close one event, which is then gone. The pool is in order of time, so a look takes a few bisections."""
    key, pool = None, []
    for rows in batches:
        out = []
        for new in zip(rows.user_id, rows.amount_paise, rows.direction, rows.run, rows.is_txn, rows.id, rows["at"], strict=True):
            if new[:4] != key:
                key, pool = new[:4], []
            is_txn, id_, at = new[4:]
            if not is_txn:
                insort(pool, (at, id_))
                continue
            for reach in (WINDOW_MS, AUTO_MS):
                first, last = bisect_left(pool, (at - reach,)), bisect_left(pool, (at + reach + 1,))
                if last - first == 1:
                    out.append((id_, pool.pop(first)[1]))
                    break
        yield pd.DataFrame(out, columns=["txn_id", "event_id"])


def resolve_pending(txns: DataFrame, events: DataFrame) -> DataFrame:
    """(txn_id, event_id): new transactions look for pending events, in ingest order; a match takes the event away.

    Stretches of time without a gap of 72 hours are independent, so a common amount is one group only as long
    as it comes without a pause.
    """
    key = ["user_id", "amount_paise", "direction"]
    left = txns.select(*key, F.lit(True).alias("is_txn"), "id", F.col("occurred_at").alias("at"), "created_at")
    right = events.filter("status = 'pending'").select(*key, F.lit(False).alias("is_txn"), "id", logged_at().alias("at"), "created_at")
    both = left.unionByName(right).withColumn("bucket", F.floor(F.col("at") / WINDOW_MS))
    line = Window.partitionBy(*key).orderBy("bucket")
    gap = F.coalesce(F.col("lo") - F.lag("hi").over(line) > WINDOW_MS, F.lit(True)).cast("int")
    spans = both.groupBy(*key, "bucket").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).select(*key, "bucket", gap.alias("gap"))
    spans = spans.withColumn("run", F.sum("gap").over(line)).drop("gap")
    types = f"txn_id {dict(txns.dtypes)['id']}, event_id {dict(events.dtypes)['id']}"
    order = [*key, "run"]
    return both.join(spans, [*key, "bucket"]).repartition(*order).sortWithinPartitions(*order, "is_txn", "created_at", "id").mapInPandas(_resolve, types)
