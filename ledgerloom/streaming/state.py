"""Payments as they come: duplicates as maps of state for each tenant, matches with logged expenses as state for each of its amounts.

The state is in Spark's store (RocksDB on executors, checkpointed to the shared folder), so a lost executor loses nothing.
Results are those of the batch operators for rows in the same order. Nothing is forgotten unless `keep_ms` says so, as a
payment may be told again at any time.
"""

from __future__ import annotations

import json
from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from ledgerloom.operators import match
from ledgerloom.operators.dedup import CANONICAL, DUPLICATE, WIDE_MS, decided
from ledgerloom.session import exists

_FLAGS = "id long, user_id long, duplicate_of_id long"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> SparkSession:
    """A session of the same cluster whose streams may hold maps of state; the caller's own settings stay."""
    session = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        if (value := spark.conf.get(name, None)) is not None:
            session.conf.set(name, value)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    return session


class _Canonicals(StatefulProcessor):
    """Of a tenant the canonical row of each reference, and those of each amount, direction and 20 hours.

    A batch reads the entries that its rows name and their neighbours in time, each once, and writes back those it changed,
    so what it costs doesn't grow with what is held.
    """

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.references = handle.getMapState("references", "reference string", "created_at long, id long", self.keep_ms)
        self.amounts = handle.getMapState("amounts", "amount long, direction string, bucket long", "canonicals string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["created_at", "id"])
        refs: dict[str, tuple | None] = {}
        pools: dict[tuple, list] = {}
        new_refs, changed, out = set(), set(), []
        # each entry asked for is a call of the store, which a tenant that has none yet need not make
        any_refs, any_amounts = self.references.exists(), self.amounts.exists()

        def pool(amount, direction, bucket) -> list:
            name = (int(amount), direction, int(bucket))
            if name not in pools:
                held = self.amounts.getValue(name) if any_amounts else None
                pools[name] = [(at, tuple(nth), precise, True) for at, nth, precise in json.loads(held[0])] if held else []
            return pools[name]

        for r in batch.itertuples(index=False):
            ref = r.reference_number if isinstance(r.reference_number, str) else None
            if ref is not None and ref not in refs:
                found = self.references.getValue((ref,)) if any_refs else None
                refs[ref] = (False, *found) if found else None
            at, precise, nth = int(r.occurred_at), bool(r.occurred_at_precise), (False, int(r.created_at), int(r.id))
            bucket = at // WIDE_MS
            known = refs.get(ref)
            if known:
                status, twin = DUPLICATE, known[2]
            else:
                near = [x for b in (bucket - 1, bucket, bucket + 1) for x in pool(r.amount_paise, r.direction, b)]
                status, twin = decided(None, False, near, at, precise)
            if status == CANONICAL and not r.deleted:
                insort(pool(r.amount_paise, r.direction, bucket), (at, nth, precise, True))
                changed.add((int(r.amount_paise), r.direction, bucket))
                if ref is not None:
                    refs[ref] = nth
                    new_refs.add(ref)
            out.append((int(r.id), int(r.user_id), twin))
        for ref in new_refs:
            self.references.updateValue((ref,), refs[ref][1:])
        for name in changed:
            self.amounts.updateValue(name, (json.dumps([x[:3] for x in pools[name]]),))
        yield pd.DataFrame({"id": [x[0] for x in out], "user_id": [x[1] for x in out], "duplicate_of_id": pd.array([x[2] for x in out], "Int64")})

    def close(self) -> None:
        pass


def flag_duplicates(stream: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """(id, user_id, duplicate_of_id) of a stream of transactions, as `dedup.flag_duplicates` has them for a table.

    The stream's session must hold maps of state (`stateful`). With keep_ms, what hasn't changed for so long is forgotten, by
    the cluster's clock; a payment told again after that counts as new.
    """
    rows = stream.select("id", "user_id", "created_at", "amount_paise", "direction", "reference_number", "occurred_at", "occurred_at_precise", F.col("deleted_at").isNotNull().alias("deleted"))
    return rows.groupBy("user_id").transformWithStateInPandas(_Canonicals(keep_ms), _FLAGS, "Append", "ProcessingTime" if keep_ms else "None")


_MATCHES = "user_id long, txn_id long, event_id long"
#: Slices of keys (tenant, amount and direction) that matches are dealt to by a hash; a checkpoint holds for the number it began with.
SLICES = 4096


def _matcher(keep_ms: int | None):
    def pair(txns: list, events: list, rows: list) -> Iterator[tuple[int, int]]:
        """Both directions: an expense looks for transactions when it is logged, a transaction for pending expenses when it comes."""
        newest = 0
        for created, kind, id_, at in rows:
            mine, others = (txns, events) if kind == "txn" else (events, txns)
            near = [x for x in others if abs(x[1] - at) <= match.WINDOW_MS]
            close = [x for x in near if abs(x[1] - at) <= match.AUTO_MS]
            chosen = near[0] if len(near) == 1 else close[0] if len(close) == 1 else None
            newest = max(newest, created)
            if kind == "txn":
                mine.append([id_, at, created])
                if chosen:
                    others.remove(chosen)
                    yield id_, chosen[0]
            elif chosen:
                yield chosen[0], id_
            else:
                mine.append([id_, at, created])
        if keep_ms is not None:
            for held in (txns, events):
                held[:] = [x for x in held if x[2] >= newest - keep_ms]

    def slice_(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Many keys are one group: calls of Python, and entries of the store, are one a slice; only keys that rows came for are folded."""
        held = {tuple(key): kept for key, *kept in json.loads(state.get[0])} if state.exists else {}
        came: dict[tuple, list] = {}
        for rows in batches:
            for user, amount, direction, *row in zip(*(rows[c].tolist() for c in ("user_id", "amount_paise", "direction", "created_at", "kind", "id", "at")), strict=True):
                came.setdefault((user, amount, direction), []).append(row)
        out = []
        for key, rows in came.items():
            txns, events = held.setdefault(key, [[], []])
            out += [(key[0], *ids) for ids in pair(txns, events, sorted(rows))]
            if not txns and not events:
                del held[key]
        state.update((json.dumps([[key, *kept] for key, kept in held.items()]),))
        if out:
            yield pd.DataFrame(out, columns=["user_id", "txn_id", "event_id"])

    return slice_


def match_events(both: DataFrame, keep_ms: int | None = None, slices: int = SLICES) -> DataFrame:
    """(user_id, txn_id, event_id) as matches are made; both is the union of the streams (kind txn or event, id, user_id, amount_paise, direction, at, created_at).

    Only rows of one amount and direction match, so these are keys with the tenant, and a large tenant is many keys; keys are dealt to
    slices. A batch reads and writes what is held by the slices that its rows name, so slices are to grow with what is held. With
    keep_ms, rows of a key are forgotten when its clock of creation has gone so far past theirs.
    """
    named = both.withColumn("slice", F.pmod(F.xxhash64("user_id", "amount_paise", "direction"), F.lit(slices)))
    return named.groupBy("slice").applyInPandasWithState(_matcher(keep_ms), _MATCHES, "held string", "append", GroupStateTimeout.NoTimeout)


def as_arrivals(txns: DataFrame, events: DataFrame) -> DataFrame:
    """Transactions that aren't deleted and pending events as one stream for `match_events`."""
    left = txns.filter("deleted_at IS NULL").select(F.lit("txn").alias("kind"), "id", "user_id", "amount_paise", "direction", F.col("occurred_at").alias("at"), "created_at")
    right = events.filter("status = 'pending'").select(F.lit("event").alias("kind"), "id", "user_id", "amount_paise", "direction", match.logged_at().alias("at"), "created_at")
    return left.unionByName(right)


#: Parts of a table that is written once a key, by a hash of the key.
BUCKETS = 256


def append_once(batch: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Append the rows of batch whose keys aren't in the table at path yet; only the parts that these keys belong to are read."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(keys).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    if exists(spark, path):
        touched = [r[0] for r in fresh.select("_bucket").distinct().collect()]  # at most `buckets` numbers
        held = spark.read.schema(fresh.schema).parquet(path).filter(F.col("_bucket").isin(touched)).select("_bucket", *keys)
        fresh = fresh.join(held, ["_bucket", *keys], "left_anti")
    fresh.repartition("_bucket").write.mode("append").partitionBy("_bucket").parquet(path)


def written_once(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of a table that `append_once` or `write_once` filled, or may have left empty."""
    known = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(StructType([*known.fields, StructField("_bucket", IntegerType())])).parquet(path).drop("_bucket")


def write_once(stream: DataFrame, path: str, checkpoint: str, keys: list[str], buckets: int = BUCKETS):
    """Start a query that reads what is there, appends rows whose keys aren't in the table at path yet, and stops.

    A replayed batch, or an overlap after a lost offset, so changes nothing.
    """
    each = lambda batch, _: append_once(batch, path, keys, buckets)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
