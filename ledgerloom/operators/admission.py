"""Which pushes are let in: at most so many of a user in any stretch of time, counting only those that were let in."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.session import written

#: Pushes of a user that are let in within WINDOW_MS, and expenses logged.
PUSHES, LOGGED, WINDOW_MS = 30, 20, 60_000


def _judge(held: deque, at: int, limit: int, window_ms: int) -> int:
    """How many that were let in lie in the window that ends at `at`; the push is noted if it is let in too."""
    while held and held[0] < at - window_ms:
        held.popleft()
    recent = len(held)
    if recent < limit:
        held.append(at)
    return recent


def _folded(batches: Iterator[pd.DataFrame], limit: int, window_ms: int) -> Iterator[pd.DataFrame]:
    """Pushes come part by part, in order; what is held is `limit` times at most."""
    part, held = None, deque()
    for batch in batches:
        recent = []
        for p, at in zip(batch.part, batch.created_at, strict=True):
            if p != part:
                part, held = p, deque()
            recent.append(_judge(held, at, limit, window_ms))
        yield batch.assign(recent=recent)


def admitted(pushes: DataFrame, limit: int = PUSHES, window_ms: int = WINDOW_MS) -> DataFrame:
    """pushes (id, user_id, created_at and more) with recent, how many that were let in lie in the window before each, and
    admitted, in order of (created_at, id). A push that is turned away doesn't count.

    Only pushes with `limit` or more before them in their window, let in or not, can be turned away. What lies up to two windows
    before these or one behind them is folded, in parts that end where no such stretch reaches on; all others have all before
    them let in, so a count tells. Counts are taken a user and window at a time (a push also counts in the next one), so
    that a busy user is many tasks.
    """
    step = F.floor(F.col("created_at") / window_ms)
    slot = pushes.select("*", F.explode(F.array(step, step + 1)).alias("_slot")).withColumn("_own", F.col("_slot") == step)
    line = Window.partitionBy("user_id", "_slot").orderBy("created_at")
    upto = F.count(F.lit(1)).over(line.rangeBetween(-window_ms, 0))
    later = F.count(F.lit(1)).over(line.rangeBetween(0, 0)) - F.row_number().over(Window.partitionBy("user_id", "_slot", "created_at").orderBy("id"))
    counted = slot.withColumn("_before", upto - 1 - later).filter("_own").drop("_own")
    at = F.col("created_at")
    busy = counted.filter(F.col("_before") >= limit).groupBy("user_id", "_slot").agg(F.min(at - 2 * window_ms).alias("lo"), F.max(at + window_ms).alias("hi"))
    run = Window.partitionBy("user_id").orderBy("lo")
    gap = F.coalesce(F.col("lo") > F.max("hi").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    spans = busy.withColumn("_gap", gap.cast("int")).withColumn("_run", F.sum("_gap").over(run)).groupBy("user_id", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # spans are three windows long or more and don't overlap, so a slot meets two at most
    slots = spans.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("lo") / window_ms), F.floor(F.col("hi") / window_ms))))
    slots = slots.groupBy("user_id", "_slot").agg(F.collect_list(F.struct("lo", "hi", F.xxhash64("user_id", "_run").alias("part"))).alias("_spans"))
    inside = F.get(F.filter("_spans", lambda x: at.between(x["lo"], x["hi"])), F.lit(0))
    placed = written(counted.join(slots, ["user_id", "_slot"], "left").withColumn("_in", inside).select(*pushes.columns, "_before", F.col("_in.part").alias("part"), F.col("_in.lo").alias("lo")))
    fold = placed.filter("part IS NOT NULL").repartition("part").sortWithinPartitions("part", "created_at", "id")
    folded = fold.mapInPandas(lambda b: _folded(b, limit, window_ms), ", ".join(f"`{c}` {t}" for c, t in fold.dtypes) + ", recent long")
    folded = folded.withColumn("recent", F.when(at < F.col("lo") + window_ms, F.col("_before")).otherwise(F.col("recent")))
    both = folded.unionByName(placed.filter("part IS NULL").withColumn("recent", F.col("_before")))
    return both.select(*pushes.columns, "recent", (F.col("recent") < limit).alias("admitted"))


def admitted_stream(pushes: DataFrame, limit: int = PUSHES, window_ms: int = WINDOW_MS) -> DataFrame:
    """(id, user_id, recent, admitted) of a stream of pushes, as `admitted` has them; of a user `limit` times are held at most."""

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = deque(state.get[0] if state.exists else ())
        rows = pd.concat(list(batches)).sort_values(["created_at", "id"])
        recent = [_judge(held, int(at), limit, window_ms) for at in rows.created_at]
        state.update((list(held),))
        yield pd.DataFrame({"id": rows.id, "user_id": rows.user_id, "recent": recent, "admitted": [n < limit for n in recent]})

    return pushes.select("id", "user_id", "created_at").groupBy("user_id").applyInPandasWithState(judge, "id long, user_id long, recent long, admitted boolean", "held array<long>", "append", GroupStateTimeout.NoTimeout)
