"""What became of each record: kept, gone, bad with a reason, or to be tried again with growing pauses. One record never stops the others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import written

#: Answers after which a record is tried again, and that of one that is gone.
TRANSIENT, GONE = (403, 429, 500, 503), 404
#: Tries of a record, and the pause before its second try in ms, which doubles from try to try.
ATTEMPTS, PAUSE_MS = 5, 500


def of_status(status: Column, usable: Column) -> Column:
    """The outcome of fetching a record: ok, gone, retry, or bad (also where what came isn't usable)."""
    known = F.when(status == GONE, "gone").when(status.isin(*TRANSIENT), "retry")
    return known.when((F.coalesce(status, F.lit(200)) == 200) & usable, "ok").otherwise("bad")


def queued(records: DataFrame, now: int) -> DataFrame:
    """records as a quarantine's first rows: due at once."""
    return records.withColumns({"attempts": F.lit(0), "next_at": F.lit(now).cast("long")})


def attempt(queue: DataFrame, fetch: Callable[[DataFrame], DataFrame], now: int, jitter: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Try what is due at `now`: (settled records with outcome and attempts, the queue that is left).

    fetch gets the due records and adds `outcome`. One that is still to be tried again after ATTEMPTS tries settles as `dead`.
    """
    tried = fetch(queue.filter(F.col("next_at") <= now)).withColumn("attempts", F.col("attempts") + 1)
    again = (F.col("outcome") == "retry") & (F.col("attempts") < ATTEMPTS)
    tried = written(tried.withColumn("outcome", F.when((F.col("outcome") == "retry") & ~again, "dead").otherwise(F.col("outcome"))))
    pause = (F.lit(PAUSE_MS) * F.pow(F.lit(2), F.col("attempts") - 1)).cast("long") + (F.lit(0) if jitter is None else jitter)
    left = tried.filter(again).withColumn("next_at", F.lit(now) + pause).drop("outcome").select(queue.columns)
    return tried.filter(~again).drop("next_at"), left.unionByName(queue.filter(F.col("next_at") > now))


def settled(records: DataFrame, fetch: Callable[[DataFrame], DataFrame], now: int = 0) -> DataFrame:
    """All records with their last outcome and how often they were tried; the clock jumps to where the next one is due."""
    queue, done = queued(records, now), []
    while True:
        out, queue = attempt(queue, fetch, now)
        done.append(out)
        queue = written(queue)
        now = queue.agg(F.min("next_at")).first()[0]
        if now is None:
            break
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def pushed(pushes: DataFrame, schema: str, required: dict[str, Column]) -> DataFrame:
    """Pushes (user_id, received_at, json) with fields, outcome and reason: `json` where it can't be read, else the first of
    the required conditions that doesn't hold."""
    read = pushes.withColumn("p", F.from_json("json", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}))
    read = read.select("user_id", "received_at", "json", "p.*")
    reason = F.when(F.col("_corrupt").isNotNull() | F.col("json").isNull(), "json")
    for name, holds in required.items():
        reason = reason.when(~F.coalesce(holds, F.lit(False)), name)
    return read.withColumn("reason", reason).withColumn("outcome", F.when(F.col("reason").isNull(), "ok").otherwise("bad")).drop("_corrupt")


def rejects(rows: DataFrame, source: str, key: Column, reason: Column) -> DataFrame:
    """(source, key, reason) of the records of any source that were set aside."""
    return rows.select(F.lit(source).alias("source"), key.cast("string").alias("key"), reason.alias("reason")).filter("reason IS NOT NULL")
