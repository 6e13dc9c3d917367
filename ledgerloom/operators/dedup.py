"""Duplicates: messages that tell of one payment twice, and statement rows that are in the ledger already."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import MIN_REFERENCE, normalized_reference
from ledgerloom.session import written

MINUTE_MS = 60_000
TIGHT_MS, WIDE_MS, STATEMENT_MS = 3 * MINUTE_MS, 20 * 60 * MINUTE_MS, 86_400_000
#: Rows that are few enough to be one part.
TOGETHER = 100_000


#: What is known of a row: it is canonical, a duplicate of a known row or of one that isn't known yet, or open.
CANONICAL, DUPLICATE, TWIN_OPEN, OPEN = range(4)
_DECIDED = ["status", "duplicate_of_id"]


def _decide(batches: Iterator[pd.DataFrame], alone: bool) -> Iterator[pd.DataFrame]:
    """Rows come part by part, each in ingest order, and get what can be known of them from their part and from what was
    told of their reference; with `alone` there are no open rows elsewhere. What is held is one part's rows that aren't duplicates."""
    part, near, refs = None, {}, {}
    for rows in batches:
        statuses, twins = [], []
        for p, held, id_, created, user, amount, direction, ref, at, precise, deleted, told, twin, doubt in zip(rows.part, rows.held, rows.id, rows.created_at, rows.user_id, rows.amount_paise, rows.direction, rows.reference_number, rows.occurred_at, rows.occurred_at_precise, rows.deleted, rows.told, rows.told_id, rows.doubt, strict=True):
            if p != part:
                part, near, refs = p, {}, {}
            nth, name, pool = (not held, created, id_), (user, ref), (user, amount, direction)
            status, twin = (CANONICAL, None) if held else (DUPLICATE, twin) if told else decided(refs.get(name) if isinstance(ref, str) else None, doubt and not alone, near.get(pool, ()), at, precise)
            statuses.append(status)
            twins.append(twin)
            if not deleted and status in (CANONICAL, OPEN):
                sure = status == CANONICAL
                insort(near.setdefault(pool, []), (at, nth, bool(precise), sure))
                if isinstance(ref, str):
                    first, open_ = refs.get(name, (None, False))
                    refs[name] = (nth if first is None and sure else first, open_ or not sure)
        yield rows.assign(status=statuses, duplicate_of_id=pd.array(twins, "Int64" if pd.api.types.is_integer_dtype(rows.id.dtype) else object))


def decided(reference: tuple | None, doubt: bool, pool, at: int, precise: bool) -> tuple:
    """A row's status and twin: by its reference, else the earliest of its amount that is near in time."""
    first, open_ = reference or (None, False)
    if first:
        return DUPLICATE, first[2]
    doubt, best, unsure = doubt or open_, None, None
    i = bisect_left(pool, (at - WIDE_MS,))
    while i < len(pool) and pool[i][0] <= at + WIDE_MS:
        other, nth, other_precise, sure = pool[i]
        if not (precise and other_precise) or abs(other - at) <= TIGHT_MS:
            if sure:
                best = nth if best is None else min(best, nth)
            else:
                unsure = nth if unsure is None else min(unsure, nth)
        i += 1
    if best is None:
        return (OPEN if doubt or unsure else CANONICAL), None
    return (TWIN_OPEN, None) if doubt or unsure and unsure < best else (DUPLICATE, best[2])


def _stretches(rows: DataFrame) -> DataFrame:
    """rows with `part`, by amount, direction and stretches of time: rows of different parts are never near each other.

    A precise row reaches 3 minutes, another one 20 hours both ways; a part ends where no row before reaches on. Rows are
    summed up by 3 minutes first, so that of one amount a task sees as many rows as it has such times.
    """
    key = ["user_id", "amount_paise", "direction"]
    wide = F.when(F.col("occurred_at_precise"), 0).otherwise(WIDE_MS)
    rows = rows.withColumn("_bucket", F.floor(F.col("occurred_at") / TIGHT_MS))
    spans = rows.groupBy(*key, "_bucket").agg(F.min(F.col("occurred_at") - wide).alias("lo"), F.max(F.col("occurred_at") + F.greatest(wide, F.lit(TIGHT_MS))).alias("hi"))
    line = Window.partitionBy(*key).orderBy("lo", "_bucket")
    gap = F.coalesce(F.col("lo") > F.max("hi").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    spans = spans.withColumn("_gap", gap.cast("int")).withColumn("_run", F.sum("_gap").over(line))
    return rows.join(spans.select(*key, "_bucket", F.xxhash64(*key, "_run").alias("part")), [*key, "_bucket"]).drop("_bucket")


#: What a row is told of its reference. Without that told_id is the row's own: beside nulls pandas would make ids floats.
_TOLD = ["told", "told_id", "doubt"]


def _folded(rows: DataFrame, alone: bool = False) -> DataFrame:
    """rows with status and duplicate_of_id, each part in one go."""
    kind = dict(rows.dtypes)["id"]
    order = ["part", F.col("held").desc(), "created_at", "id"]
    plain = rows.drop(*_DECIDED)
    schema = ", ".join(f"`{c}` {t}" for c, t in plain.dtypes) + f", status int, duplicate_of_id {kind}"
    # by a hash of its own: behind a join on `part` Spark would leave the same exchange out and then, where it turns that join
    # into a broadcast at run time, read its shuffle by mapper, which scatters a part over tasks
    return plain.repartition(F.xxhash64("part")).sortWithinPartitions(*order).mapInPandas(lambda b: _decide(b, alone), schema)


def _rounds(rows: DataFrame, together: int) -> Iterator[DataFrame]:
    """Decided rows of the parts whose references are also held elsewhere, round by round.

    A round tells of each reference its first canonical row and its first open one, and folds the parts that still have
    open rows. The earliest open row is always decided, so rounds end; what chains through many references is left to
    one last part as soon as it has at most `together` rows.
    """
    nth, key = F.struct((~F.col("held")).alias("late"), "created_at", "id"), ["user_id", "reference_number"]
    is_open = lambda df: df.filter(F.col("status").isin(TWIN_OPEN, OPEN)).select("part").distinct()
    rows = rows.withColumns({"status": F.when(F.col("held"), CANONICAL).otherwise(OPEN), "duplicate_of_id": F.lit(None).cast(dict(rows.dtypes)["id"])})
    known = []
    while True:
        telling = reduce(DataFrame.unionByName, [x.select(*key, "held", "created_at", "id", "status", "deleted", "tied") for x in [rows, *known]])
        told = telling.filter("tied AND NOT deleted").groupBy(*key).agg(F.min(F.when(F.col("status") == CANONICAL, nth)).alias("_first"), F.min(F.when(F.col("status") == OPEN, nth)).alias("_open"))
        # a row with no reference, or one that its part holds alone, finds nothing
        asked = rows.drop(*_TOLD).withColumn("_ref", F.when(F.col("tied"), F.col("reference_number"))).join(told.withColumnsRenamed({"reference_number": "_ref"}), ["user_id", "_ref"], "left")
        asked = asked.withColumns({"told": F.coalesce(F.col("_first") < nth, F.lit(False)), "told_id": F.coalesce("_first.id", "id"), "doubt": F.coalesce(F.col("_open") < nth, F.lit(False))}).drop("_ref", "_first", "_open")
        last = rows.limit(together + 1).count() <= together
        done = written(_folded(asked.withColumn("part", F.lit(0).cast("long")) if last else asked, last))
        if last or is_open(done).isEmpty():
            yield done
            return
        rows, closed = written(done.join(is_open(done), "part", "left_semi")), written(done.join(is_open(done), "part", "left_anti"))
        yield closed
        known.append(closed)


def possible_twins(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """The rows of the ledger that a fresh row can be a duplicate of: neither duplicates nor deleted, and of the tenant's
    same reference, or of the same amount and direction in a bucket of time next to it.

    Semi joins with the batch's distinct keys, which are few beside the ledger.
    """
    bucket, key = F.floor(F.col("occurred_at") / WIDE_MS), ["user_id", "amount_paise", "direction"]
    kept = existing.filter("duplicate_of_id IS NULL AND deleted_at IS NULL")
    times = fresh.select(*key, F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_bucket")).distinct()
    near = kept.withColumn("_bucket", bucket).join(times, [*key, "_bucket"], "left_semi").select(existing.columns)
    told = kept.join(fresh.select("user_id", "reference_number").distinct(), ["user_id", "reference_number"], "left_semi").select(existing.columns)
    return near.unionByName(told).dropDuplicates(["id"])


def flag_duplicates(txns: DataFrame, existing: DataFrame | None = None, together: int = TOGETHER) -> DataFrame:
    """(id, duplicate_of_id) of all txns, in ingest order (created_at, id).

    A row is a duplicate of a row before it that isn't one itself nor deleted: of the same reference at any
    distance, else of the same amount and direction within 3 minutes, or 20 hours if either time is a guess.
    With existing, txns are a batch that comes after those rows of the ledger; of these only possible twins are
    read again, and they keep the flags that they have.

    Parts by amount and stretch of time are folded each by itself. Those that hold a reference which another part holds
    too are folded in rounds, between which references tell what is decided; the last `together` rows are one part.
    """
    shape = ["id", "user_id", "created_at", "amount_paise", "direction", "reference_number", "occurred_at", "occurred_at_precise", F.col("deleted_at").isNotNull().alias("deleted")]
    rows = txns.select(*shape, F.lit(False).alias("held"))
    if existing is not None:
        rows = rows.unionByName(possible_twins(existing, txns).select(*shape, F.lit(True).alias("held")))
    rows = written(_stretches(rows))
    spread = rows.filter("reference_number IS NOT NULL").groupBy("user_id", "reference_number").agg(F.min("part").alias("a"), F.max("part").alias("z")).filter("a <> z")
    spread = spread.select("user_id", "reference_number", F.lit(True).alias("tied"))
    rows = written(rows.join(spread, ["user_id", "reference_number"], "left").withColumns({"tied": F.coalesce("tied", F.lit(False)), "told": F.lit(False), "told_id": F.col("id"), "doubt": F.lit(False)}))
    parts = rows.filter("tied").select("part").distinct()
    out = [_folded(rows.join(parts, "part", "left_anti")), *_rounds(rows.join(parts, "part", "left_semi"), together)]
    return reduce(DataFrame.unionByName, [x.filter("NOT held").select("id", "duplicate_of_id") for x in out])


def first_by_key(txns: DataFrame, keys: tuple[str, ...] = ("user_id", "gmail_message_id")) -> DataFrame:
    """The first row of each idempotency key; rows without one all stay."""
    first = Window.partitionBy(*keys).orderBy("created_at", "id")
    named = txns.filter(F.col(keys[-1]).isNotNull()).withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
    return named.unionByName(txns.filter(F.col(keys[-1]).isNull()))


# Statements


class _Free:
    """Transactions that aren't taken yet, by time; those of one time are taken in order. Emptied times are skipped for good."""

    def __init__(self, txns: list[tuple]):
        self.times, self.queues = [], []
        for at, nth, id_ in sorted(txns):
            if not self.times or self.times[-1] != at:
                self.times.append(at)
                self.queues.append([])
            self.queues[-1].append((nth, id_))
        n = len(self.times)
        self.taken, self.left, self.right = [0] * n, list(range(n)), list(range(n + 1))

    def _skip(self, to: list[int], i: int, step: int) -> int:
        """The nearest time from i on that has any left; paths are shortened on the way."""
        seen = []
        while 0 <= i < len(self.times) and self.taken[i] == len(self.queues[i]):
            seen.append(i)
            i = to[i] if to[i] != i else i + step
        for k in seen:
            to[k] = i
        return i

    def _head(self, i: int, at: int) -> tuple | None:
        if 0 <= i < len(self.times) and abs(self.times[i] - at) <= STATEMENT_MS:
            return abs(self.times[i] - at), *self.queues[i][self.taken[i]], i
        return None

    def nearest(self, at: int) -> tuple | None:
        """(distance, nth, id, place) of the nearest that is left within a day."""
        i = bisect_left(self.times, at)
        both = [self._head(self._skip(self.left, i - 1, -1), at), self._head(self._skip(self.right, i, 1), at)]
        return min([x for x in both if x], default=None)

    def take(self, at: int):
        found = self.nearest(at)
        if found:
            self.taken[found[3]] += 1
            return found[2]
        return None


def _nearest(txns: list[tuple], rows: list[tuple]) -> Iterator[tuple]:
    """Greedy and one-to-one: rows by their first best distance, each takes the nearest that is left."""
    free = _Free(txns)
    for _, i, at in sorted((best[0], i, at) for i, at in rows if (best := free.nearest(at))):
        if (id_ := free.take(at)) is not None:
            yield i, id_


def _pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Transactions and statement rows come part by part."""
    part, user, txns, rows = None, None, [], []
    for batch in chain(batches, [None]):
        out = []
        for new in [None] if batch is None else zip(batch.part, batch.user_id, batch.is_row, batch.id, batch.occurred_at, batch.nth, strict=True):
            if new is None or new[0] != part:
                out += [(user, i, id_) for i, id_ in _nearest(txns, rows)] if txns and rows else []
                part, txns, rows = new and new[0], [], []
            if new:
                _, user, is_row, id_, at, nth = new
                rows.append((id_, at)) if is_row else txns.append((at, nth, id_))
        yield pd.DataFrame(out, columns=["user_id", "row_index", "existing_id"])


def _days(items: DataFrame) -> DataFrame:
    """items with `part`: those of one amount and direction up to a pause of a day in which no statement row reaches on.

    Only rows reach, a day both ways; transactions that none reaches are left out. Items are summed up by hours first, so that of
    one amount a task sees as many rows as it has hours.
    """
    key = ["user_id", "amount_paise", "direction"]
    items = items.withColumn("_hour", F.floor(F.col("occurred_at") / 3_600_000))
    reach = F.when(F.col("is_row"), STATEMENT_MS).otherwise(0)
    spans = items.groupBy(*key, "_hour").agg(F.min(F.col("occurred_at") - reach).alias("lo"), F.max(F.col("occurred_at") + reach).alias("hi"), F.bool_or("is_row").alias("_told"))
    line = Window.partitionBy(*key).orderBy("lo", "_hour")
    gap = F.coalesce(F.col("lo") > F.max("hi").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    spans = spans.withColumn("_gap", gap.cast("int")).withColumn("_run", F.sum("_gap").over(line))
    spans = spans.withColumn("_told", F.bool_or("_told").over(Window.partitionBy(*key, "_run"))).filter("_told")
    return items.join(spans.select(*key, "_hour", F.xxhash64(*key, "_run").alias("part")), [*key, "_hour"]).drop("_hour")


def statement_duplicates(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """(user_id, row_index, existing_id): statement rows that the ledger has already, each of its rows at most once.

    First by reference, the n-th row of a reference with the n-th transaction that has it; then by amount and
    direction within a day: rows in order of their first best distance take the nearest that is left. existing needs nth,
    its order. Parts end where no row reaches on (see _days); in a part a row finds its transaction in about constant time.
    """
    clean = normalized_reference(F.col("reference_number"))
    ref = lambda df: df.withColumn("_ref", F.when(F.length(clean) >= MIN_REFERENCE, clean))
    nth = lambda by: F.row_number().over(Window.partitionBy("user_id", "_ref").orderBy(by))
    left = ref(rows).filter("_ref IS NOT NULL").withColumn("_n", nth("row_index")).select("user_id", "_ref", "_n", "row_index")
    right = ref(existing).filter("_ref IS NOT NULL").withColumn("_n", nth("nth")).select("user_id", "_ref", "_n", F.col("id").alias("existing_id"))
    first = written(left.join(right, ["user_id", "_ref", "_n"]).select("user_id", "row_index", "existing_id"))
    key = ["user_id", "amount_paise", "direction"]
    rest = rows.join(first, ["user_id", "row_index"], "left_anti").select(*key, F.lit(True).alias("is_row"), F.col("row_index").alias("id"), "occurred_at", F.lit(0).alias("nth"))
    free = existing.join(first.select("user_id", F.col("existing_id").alias("id")), ["user_id", "id"], "left_anti").select(*key, F.lit(False).alias("is_row"), "id", "occurred_at", "nth")
    types = dict(first.dtypes)
    schema = f"user_id {types['user_id']}, row_index {types['row_index']}, existing_id {types['existing_id']}"
    both = _days(rest.unionByName(free)).repartition("part").sortWithinPartitions("part")
    return first.unionByName(both.mapInPandas(_pair, schema))
