"""The ledger: filters, search, order, pages, joins to categories, export, and changes as new versions of a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import BASELINE_MS, IST_MS, amount_index, reference_index, xored

LOW_CONFIDENCE = 0.6
SEARCHED = ("merchant", "merchant_normalized", "notes", "upi_id", "email_subject", "reference_number")
SORTS = ("occurred_at", "amount_paise", "merchant")
ROW_CAP = 10_000


@dataclass(frozen=True)
class Filters:
    """What a ledger query asks for; fields left out don't filter. like=True takes q as a LIKE pattern's middle."""

    user_id: object = None
    only_deleted: bool = False
    include_deleted: bool = False
    q: str | None = None
    like: bool = False
    category: str | None = None
    categories: tuple[str, ...] = ()
    low_confidence: bool = False
    category_source: str | None = None
    channel: str | None = None
    direction: str | None = None
    start: int | None = None
    end: int | None = None

    def condition(self) -> Column:
        out = F.lit(True)
        if self.user_id is not None:
            out = out & (F.col("user_id") == F.lit(self.user_id))
        if self.only_deleted:
            out = out & F.col("deleted_at").isNotNull()
        elif not self.include_deleted:
            out = out & F.col("deleted_at").isNull()
        q = (self.q or "").strip().lower()
        if q:
            hit = F.lit(False)
            for c in SEARCHED:
                one = F.lower(F.col(c)).like(f"%{q}%") if self.like else F.lower(F.col(c)).contains(q)
                hit = hit | F.coalesce(one, F.lit(False))
            out = out & hit
        if self.category == "uncategorized":
            out = out & F.col("category_id").isNull()
        elif self.category:
            out = out & (F.col("category_id") == self.category)
        if self.categories:
            out = out & F.col("category_id").isin(*self.categories)
        if self.low_confidence:
            out = out & (F.col("merchant_confidence") < LOW_CONFIDENCE)
        if self.category_source == "generic":
            out = out & (F.col("category_source") == "generic")
        if self.channel:
            out = out & (F.col("channel") == self.channel)
        if self.direction in ("debit", "credit"):
            out = out & (F.col("direction") == self.direction)
        if self.start:
            out = out & (F.col("occurred_at") >= self.start)
        if self.end:
            out = out & (F.col("occurred_at") <= self.end)
        return out


def filtered(txns: DataFrame, filters: Filters) -> DataFrame:
    return txns.filter(filters.condition())


def order(sort: str = "occurred_at", descending: bool = True, nulls_last: bool = False) -> list[Column]:
    """Nulls as Postgres has them (last when rising, first when falling), or always last; id makes the order total."""
    c = F.col(sort if sort in SORTS else "occurred_at")
    if descending:
        first = c.desc_nulls_last() if nulls_last else c.desc_nulls_first()
    else:
        first = c.asc_nulls_last()
    return [first, F.col("created_at").desc_nulls_last(), F.col("id").asc()]


def page(txns: DataFrame, sort: str = "occurred_at", descending: bool = True, number: int = 1, size: int = 50) -> DataFrame:
    """One page; the number is at least 1 and the size from 1 to 200."""
    size = min(max(size, 1), 200)
    return txns.orderBy(*order(sort, descending)).offset((max(number, 1) - 1) * size).limit(size)


def with_category(txns: DataFrame, categories: DataFrame) -> DataFrame:
    named = categories.select(F.col("id").alias("_cid"), F.col("name").alias("category_name"), F.col("color").alias("category_color"))
    return txns.join(named, F.col("category_id") == F.col("_cid"), "left").drop("_cid")


def with_message_flag(txns: DataFrame) -> DataFrame:
    """txns with has_message: whether a mail tells of the row."""
    return txns.withColumn("has_message", F.col("gmail_message_id").isNotNull())


def with_connection(users: DataFrame, connections: DataFrame) -> DataFrame:
    """users with connected: whether there is a connection, however many; users without one stay."""
    held = connections.select("user_id").distinct().withColumn("_held", F.lit(True))
    return users.join(held, "user_id", "left").withColumn("connected", F.coalesce("_held", F.lit(False))).drop("_held")


def with_rows(keyed: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Those of keyed that have rows, once each."""
    return keyed.join(rows.select(key), key, "left_semi")


def stalest_first(rows: DataFrame, at: str) -> DataFrame:
    """Rows never handled come first, then those handled longest ago."""
    return rows.orderBy(F.col(at).asc_nulls_first(), "id")


def after_baseline(txns: DataFrame) -> DataFrame:
    return txns.filter(F.col("occurred_at") >= BASELINE_MS)


def export(txns: DataFrame, categories: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """The eight columns of an export, without duplicates; write with any of Spark's writers."""
    rows = with_category(filtered(txns, filters).filter("duplicate_of_id IS NULL"), categories)
    at = F.timestamp_millis(F.col("occurred_at") + IST_MS)
    blank = F.lit("")
    return rows.select(
        "id",
        F.date_format(at, "yyyy-MM-dd").alias("date"),
        F.date_format(at, "HH:mm:ss").alias("time"),
        F.coalesce("channel", blank).alias("channel"),
        F.coalesce("merchant", "upi_id", blank).alias("party"),
        (F.col("amount_paise") / 100).alias("amount"),
        F.when(F.col("direction") == "debit", "Debit").otherwise("Credit").alias("direction"),
        F.coalesce("category_name", blank).alias("category"),
        F.coalesce("notes", blank).alias("notes"),
    )


def rate(events: DataFrame, user: str = "user_id", at: str = "created_at", window_ms: int = 60_000) -> DataFrame:
    """events with recent: how many of the user's lie in the window that ends with each."""
    recent = Window.partitionBy(user).orderBy(at).rangeBetween(-window_ms, 0)
    return events.withColumn("recent", F.count(F.lit(1)).over(recent))


# Changes


def insert_new(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("user_id", "gmail_message_id")) -> DataFrame:
    """The rows of incoming that are to be inserted: of a key the first by (created_at, id), none that exists; null keys never collide."""
    user, message = keys
    first = Window.partitionBy(*keys).orderBy("created_at", "id")
    named = incoming.filter(F.col(message).isNotNull()).withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
    return named.join(existing.select(*keys), list(keys), "left_anti").unionByName(incoming.filter(F.col(message).isNull()))


def unseen(messages: DataFrame, existing: DataFrame) -> DataFrame:
    return messages.join(existing.select("user_id", F.col("gmail_message_id").alias("message_id")), ["user_id", "message_id"], "left_anti")


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row a key: the latest; at one time an incoming row wins over one that is there."""
    latest = Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col("_new").desc())
    both = existing.withColumn("_new", F.lit(False)).unionByName(incoming.withColumn("_new", F.lit(True)))
    return both.withColumn("_rn", F.row_number().over(latest)).filter("_rn = 1").drop("_rn", "_new")


def add_counters(existing: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Counters of both summed by key."""
    counts = [c for c in existing.columns if c != key]
    return existing.unionByName(delta.select(existing.columns)).groupBy(key).agg(*[F.sum(c).alias(c) for c in counts])


def patch(txns: DataFrame, changes: DataFrame) -> DataFrame:
    """A new version of txns: changes (id, set: map of column to text; a null value clears) are applied."""
    fields = {"category_id": "string", "notes": "string", "deleted_at": "long", "duplicate_of_id": dict(txns.dtypes)["duplicate_of_id"]}
    df = txns.join(changes.select("id", F.col("set").alias("_set")), "id", "left")
    has = lambda c: F.coalesce(F.map_contains_key("_set", F.lit(c)), F.lit(False))
    return df.withColumns({c: F.when(has(c), F.try_element_at("_set", F.lit(c)).cast(k)).otherwise(F.col(c)) for c, k in fields.items()}).drop("_set").select(txns.columns)


def delete_category(txns: DataFrame, category_id: str) -> DataFrame:
    return txns.withColumn("category_id", F.nullif(F.col("category_id"), F.lit(category_id)))


def without_tenant(table: DataFrame, user_id) -> DataFrame:
    return table.filter(~F.col("user_id").eqNullSafe(F.lit(user_id)))


SEALED = ("amount_paise", "merchant", "merchant_normalized", "notes", "upi_id", "reference_number", "email_subject", "bank", "card_last4", "channel", "raw")


def keyring(keys: DataFrame) -> DataFrame:
    """keys (user_id, key: 32 octets) with what sealing takes from each: a key for payloads and the two blocks of a keyed digest."""
    own = lambda use: F.unhex(F.sha2(F.concat(F.col("key"), F.encode(F.lit(use), "UTF-8")), 256))
    return keys.select("user_id", own("payload").alias("_key"), own("index").alias("_index")).select("user_id", "_key", xored(F.col("_index"), 0x36).alias("_inner"), xored(F.col("_index"), 0x5C).alias("_outer"))


def gcm(text: Column, key: Column, bound: Column) -> Column:
    """AES in Galois/counter mode under a fresh nonce, bound to a text that must be the same when it is opened."""
    return F.concat(F.lit("v1."), F.base64(F.aes_encrypt(text, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), bound)))


def opened(sealed: Column, key: Column, bound: Column) -> Column:
    return F.aes_decrypt(F.unbase64(F.substring(sealed, 4, 1 << 30)), key, F.lit("GCM"), F.lit("DEFAULT"), bound).cast("string")


def _bound() -> Column:
    return F.concat_ws(":", F.col("user_id").cast("string"), F.col("id").cast("string"))


def seal(txns: DataFrame, keys: DataFrame, codec=gcm) -> DataFrame:
    """Rows not yet sealed get their payload sealed under their tenant's key, blind indexes, and lose the plain columns.

    keys (user_id, key) is a table, so that keys are data and never stand in a plan, an event log or a UI. codec takes
    the JSON, the key and what the payload is bound to (tenant and id). Rows of tenants without a key stay as they are.
    """
    df = txns.join(keyring(keys), "user_id", "left")
    todo = F.col("enc_payload").isNull() & F.col("_key").isNotNull()
    held = [c for c in SEALED if c in txns.columns]
    digest = F.col("_inner"), F.col("_outer")
    new = {
        "enc_payload": codec(F.to_json(F.struct(*held)), F.col("_key"), _bound()),
        "amount_bidx": amount_index(F.col("user_id"), F.col("direction"), F.col("amount_paise"), *digest),
        "ref_bidx": reference_index(F.col("user_id"), F.col("reference_number"), *digest),
    }
    return df.withColumns({c: F.when(todo, v).otherwise(F.col(c)) for c, v in new.items()} | {c: F.when(~todo, F.col(c)) for c in held}).select(txns.columns)


def unseal(txns: DataFrame, keys: DataFrame) -> DataFrame:
    """txns with payload: the JSON of sealed rows; a wrong key, or a payload put under another row, is an error."""
    df = txns.join(keyring(keys).select("user_id", "_key"), "user_id", "left")
    return df.withColumn("payload", opened(F.col("enc_payload"), F.col("_key"), _bound())).drop("_key")


def unsealed(*tables: DataFrame) -> DataFrame:
    """How many rows of all tables are still to be sealed."""
    parts = [t.select(F.col("enc_payload").isNull().cast("long").alias("n")) for t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("remaining"))
