"""The dashboard's aggregates. Each is one aggregation over filtered, narrow rows; no row is sorted but the few that come out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import half_up, ist_day, ist_month, percent_delta, share

NONE, OTHER, UNKNOWN, GREY = "__none__", "Other", "unknown", "#8e8e93"


@dataclass(frozen=True)
class Slice:
    start: int
    end: int
    year_ago: int
    category: str | None = None
    channel: str | None = None
    merchant: str | None = None

    def matches(self) -> Column:
        out = F.lit(True)
        if self.category is not None:
            out = out & (F.coalesce("category_id", F.lit(NONE)) == self.category)
        if self.channel is not None:
            out = out & (F.coalesce("channel", F.lit(OTHER)) == self.channel)
        if self.merchant is not None:
            out = out & (merchant_key() == self.merchant)
        return out

    def in_range(self) -> Column:
        return F.col("occurred_at").between(self.start, self.end)

    def before(self) -> Column:
        return F.col("occurred_at").between(max(0, self.start - (self.end - self.start)), self.start)


def merchant_key() -> Column:
    return F.coalesce("merchant_normalized", "merchant", F.lit(UNKNOWN))


def _sum(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("amount_paise"))), F.lit(0)).cast("long")


def debit() -> Column:
    return F.col("direction") == "debit"


def base(txns: DataFrame, s: Slice, sliced: bool = True) -> DataFrame:
    """Rows that count: neither deleted nor duplicates, within reach of the range and the year before."""
    rows = txns.filter("deleted_at IS NULL AND duplicate_of_id IS NULL").filter(F.col("occurred_at").between(min(s.start, s.year_ago), s.end))
    rows = rows.select("id", "user_id", "occurred_at", "amount_paise", "direction", "category_id", "channel", "merchant_normalized", "merchant")
    return rows.filter(s.matches()) if sliced else rows


def totals(txns: DataFrame, s: Slice) -> DataFrame:
    out = base(txns, s).filter(s.in_range()).agg(_sum(debit()).alias("debit"), _sum(~debit()).alias("credit"), F.count(F.lit(1)).alias("count"))
    return out.withColumn("net", F.col("credit") - F.col("debit"))


def previous(txns: DataFrame, s: Slice) -> DataFrame:
    """The period before, as long, both ends included; nulls if the range has no beginning."""
    rows = txns.filter("deleted_at IS NULL AND duplicate_of_id IS NULL").filter(s.matches()).filter(s.before())
    if s.start <= 0:
        return rows.agg(F.lit(None).cast("long").alias("debit"), F.lit(None).cast("long").alias("credit"))
    return rows.agg(_sum(debit()).alias("debit"), _sum(~debit()).alias("credit"))


def deltas(txns: DataFrame, s: Slice) -> DataFrame:
    """Change of debits and credits from the period before, in percent; one scan with conditional sums."""
    rows = txns.filter("deleted_at IS NULL AND duplicate_of_id IS NULL").filter(s.matches()).filter(s.in_range() | s.before())
    sums = rows.agg(*[_sum(when & kind).alias(f"{name}_{side}") for name, when in (("now", s.in_range()), ("before", s.before())) for side, kind in (("debit", debit()), ("credit", ~debit()))])
    return sums.select(*[percent_delta(F.col(f"now_{side}"), F.col(f"before_{side}")).alias(f"{side}_percent") for side in ("debit", "credit")])


def by_category(txns: DataFrame, categories: DataFrame, s: Slice) -> DataFrame:
    sums = base(txns, s).filter(s.in_range() & debit()).groupBy(F.coalesce("category_id", F.lit(NONE)).alias("id")).agg(F.sum("amount_paise").alias("total"))
    named = sums.join(categories.select(F.col("id").alias("_cid"), F.col("name").alias("_name"), F.col("color").alias("_color")), F.col("id") == F.col("_cid"), "left")
    none = F.col("id") == NONE
    out = named.select("id", F.when(none, "Uncategorized").otherwise(F.coalesce("_name", F.lit("Unknown"))).alias("name"), F.when(none, GREY).otherwise(F.coalesce("_color", F.lit(GREY))).alias("color"), "total")
    return out.orderBy(F.desc("total"), "id")


def by_channel(txns: DataFrame, s: Slice) -> DataFrame:
    return base(txns, s).filter(s.in_range() & debit()).groupBy(F.coalesce("channel", F.lit(OTHER)).alias("channel")).agg(F.sum("amount_paise").alias("total")).orderBy(F.desc("total"), "channel")


def channel_shares(txns: DataFrame, s: Slice) -> DataFrame:
    """Each channel's percent of all debits; the few channels are summed again for the whole."""
    per = by_channel(txns, s)
    whole = per.agg(F.sum("total").alias("whole"))
    return per.join(F.broadcast(whole)).select("channel", "total", share(F.col("total"), F.col("whole")).alias("percent"))  # one row is broadcast


def top_merchants(txns: DataFrame, s: Slice, n: int = 10) -> DataFrame:
    """The label is that of the earliest row, then of the smallest id."""
    rows = base(txns, s).filter(s.in_range() & debit()).withColumn("key", merchant_key())
    out = rows.groupBy("key").agg(F.min_by(F.coalesce("merchant", "key"), F.struct("occurred_at", "id")).alias("label"), F.sum("amount_paise").alias("total"), F.count(F.lit(1)).alias("count"))
    return out.orderBy(F.desc("total"), "key").limit(n)


def _two_sides(rows: DataFrame, key: Column, name: str) -> DataFrame:
    credit = F.col("direction") == "credit"
    return rows.groupBy(key.alias(name)).agg(_sum(debit()).alias("debit"), _sum(credit).alias("credit")).orderBy(name)


def by_day(txns: DataFrame, s: Slice) -> DataFrame:
    return _two_sides(base(txns, s).filter(s.in_range()), ist_day(F.col("occurred_at")), "date")


def by_month(txns: DataFrame, s: Slice) -> DataFrame:
    """From a year ago on, whatever the range's beginning."""
    return _two_sides(base(txns, s).filter(F.col("occurred_at") >= s.year_ago), ist_month(F.col("occurred_at")), "month")


def dashboard(txns: DataFrame, s: Slice) -> DataFrame:
    """Totals by category, channel, merchant and day for every tenant in one pass (GROUPING SETS)."""
    rows = base(txns, s).filter(s.in_range()).select("user_id", "amount_paise", "direction", F.coalesce("category_id", F.lit(NONE)).alias("category"), F.coalesce("channel", F.lit(OTHER)).alias("channel"), F.coalesce("merchant_normalized", "merchant", F.lit("unknown")).alias("merchant"), ist_day(F.col("occurred_at")).alias("day"))
    keys = [F.col(c) for c in ("category", "channel", "merchant", "day")]
    sets = [[F.col("user_id"), k] for k in keys] + [[F.col("user_id")]]
    out = rows.groupingSets(sets, F.col("user_id"), *keys).agg(F.grouping_id().alias("gid"), _sum(debit()).alias("debit"), _sum(~debit()).alias("credit"), F.count(F.lit(1)).alias("count"))
    kind = F.when(F.col("category").isNotNull(), "category").when(F.col("channel").isNotNull(), "channel").when(F.col("merchant").isNotNull(), "merchant").when(F.col("day").isNotNull(), "day").otherwise("total")
    return out.select("user_id", kind.alias("kind"), F.coalesce("category", "channel", "merchant", "day", F.lit("")).alias("key"), "debit", "credit", "count")


def category_counts(categories: DataFrame, txns: DataFrame) -> DataFrame:
    """All transactions count, deleted ones and duplicates too; categories without any count 0. Rows are counted before the join."""
    counts = txns.filter("category_id IS NOT NULL").groupBy(F.col("category_id").alias("id")).agg(F.count("id").alias("_n"))
    return categories.join(counts, "id", "left").select("id", "name", F.coalesce("_n", F.lit(0)).cast("long").alias("count"))


def parse_health(inserted: DataFrame) -> DataFrame:
    hit = lambda c: F.count(F.col(c)).alias(f"{c}_hits")
    out = inserted.groupBy("provider").agg(F.count(F.lit(1)).alias("total"), hit("merchant"), hit("upi_id"), hit("reference_number"), hit("category_id"))
    return out


def health_percent(health: DataFrame) -> DataFrame:
    names = [c for c in health.columns if c.endswith("_hits")]
    return health.select("provider", "total", *[F.when(F.col("total") > 0, half_up(F.col(c) / F.col("total") * 100)).otherwise(0).alias(c.replace("_hits", "_percent")) for c in names])


def import_summary(rows: DataFrame) -> DataFrame:
    """Counts by outcome (inserted, duplicate, skipped)."""
    count = lambda o: F.count(F.when(F.col("outcome") == o, 1)).alias(o)
    return rows.groupBy("user_id").agg(count("inserted"), count("duplicate"), count("skipped"))


def samples_with_users(samples: DataFrame, users: DataFrame) -> DataFrame:
    """Messages kept as samples, with the address of the user that each is of, if that user is still there."""
    return samples.join(users.select(F.col("id").alias("user_id"), F.col("email").alias("user_email")), "user_id", "left")
