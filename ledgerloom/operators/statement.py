"""Bank statements: where the columns are, and rows as payments or the reason why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions.scalars import BASELINE_MS, IST_MS, half_up
from ledgerloom.operators import extract as X
from ledgerloom.rules import messages as R

HEADER_ROWS, HEADER_MATCHES = 25, 3
MAPPING = tuple(R.HEADERS)


def detect_headers(rows: DataFrame) -> DataFrame:
    """(file, header_row, mapping): of each file's first rows the first that names a date, a narration and an amount.

    rows: file, row_index, cells. The mapping holds places from 0, null for columns that aren't there.
    """
    cells = T.trimmed(F.col("cells"))
    place = lambda p: F.nullif(F.array_position(F.transform(cells, lambda c: c.rlike(p)), F.lit(True)) - 1, F.lit(-1)).cast("int")
    found = rows.filter(F.col("row_index") < HEADER_ROWS).select("file", "row_index", F.struct(*[place(p).alias(k) for k, p in R.HEADERS.items()]).alias("mapping"))
    m = lambda k: F.col(f"mapping.{k}").isNotNull()
    number = sum((m(k).cast("int") for k in MAPPING[1:]), m(MAPPING[0]).cast("int"))
    good = found.filter(complete() & (number >= HEADER_MATCHES))
    return good.groupBy("file").agg(F.min_by("mapping", "row_index").alias("mapping"), F.min("row_index").alias("header_row"))


def complete() -> Column:
    """Whether a mapping suffices: date, narration, and a column of amounts."""
    m = lambda k: F.col(f"mapping.{k}").isNotNull()
    return m("date") & m("narration") & (m("debit") | m("credit") | m("amount"))


def parse_date(raw: Column) -> Column:
    """Noon in India of a day-first date, in ms; days past a month's end roll over; null if it isn't a date."""
    numeric, named = r"\A(\d{1,2})[-/](\d{1,2})[-/](\d{2,4})\z", r"(?i)\A(\d{1,2})[-\s]([a-z]{3,9})[-\s](\d{2,4})\z"
    groups = lambda s: F.array(*[F.coalesce(T.extract(s, numeric, i), T.extract(s, named, i)) for i in (1, 2, 3)])
    parts = lambda g: F.struct(g[0].cast("int").alias("d"), X.month_number(g[1]).alias("m"), F.when(g[2].cast("int") < 100, g[2].cast("int") + 2000).otherwise(g[2].cast("int")).alias("y"))
    noon = lambda p: F.when(p["m"].between(1, 12) & p["d"].between(1, 31), X.utc_ms(p["y"], p["m"], p["d"], 12) - IST_MS)
    return T.let(T.let(T.let(F.trim(raw), groups), parts), noon)


def parse_amount(raw: Column) -> Column:
    """struct(paise, direction); direction is null where the cell doesn't tell, the whole null if there's no number."""
    return T.let(F.trim(raw), _amount)


def _amount(s: Column) -> Column:
    told = F.when(s.rlike(r"(?i)\bcr\.?\b"), "credit").when(s.rlike(r"(?i)\bdr\.?\b"), "debit")
    s = F.trim(F.regexp_replace(s, r"(?i)\bcr\.?\b|\bdr\.?\b", ""))
    negative = s.rlike(r"\A\(.*\)\z") | s.startswith("-")
    s = F.regexp_replace(F.regexp_replace(s, r"\A\((.*)\)\z", "$1"), r"\A-", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[,\s₹]", ""), r"(?i)\ARs\.?", "")
    value = F.regexp_substr(s, F.lit(r"\A(\d+\.?\d*|\.\d+)")).try_cast("double")
    return T.let(value, lambda v: F.when(v.isNotNull(), F.struct(half_up(v * 100).alias("paise"), F.coalesce(told, F.when(negative, "debit")).alias("direction"))))


def vpa_segment(narration: Column) -> Column:
    """The first whole segment between dashes or slashes that is a VPA."""
    return F.lower(F.get(F.filter(T.trimmed(F.split(narration, "[-/]")), lambda s: s.rlike(R.VPA_SEGMENT)), F.lit(0)))


def normalize(rows: DataFrame) -> DataFrame:
    """rows (row_index, cells, mapping) with ok, reason, and the fields of a payment."""
    cell = lambda k: F.coalesce(F.get("cells", F.col(f"mapping.{k}")), F.lit(""))
    df = rows.withColumns({"narration": F.trim(cell("narration")), "occurred_at": parse_date(cell("date")), "_d": parse_amount(cell("debit")), "_c": parse_amount(cell("credit")), "_a": parse_amount(cell("amount"))})
    two = F.col("mapping.debit").isNotNull() | F.col("mapping.credit").isNotNull()
    spent, got = F.col("_d.paise") > 0, F.col("_c.paise") > 0
    word = F.lower(F.trim(cell("crDr")))
    df = df.withColumns(
        {
            "amount_paise": F.when(two & spent, F.col("_d.paise")).when(two & got, F.col("_c.paise")).when(~two, F.col("_a.paise")),
            "direction": F.when(two & spent, "debit").when(two & got, "credit").when(~two, F.coalesce(F.col("_a.direction"), F.when(word.startswith("cr"), "credit").when(word.startswith("dr"), "debit"))),
        }
    ).drop("_d", "_c", "_a")
    reason = (
        F.when(F.col("occurred_at").isNull(), "bad-date")
        .when(F.col("occurred_at") < BASELINE_MS, "before-baseline")
        .when(F.coalesce(F.col("amount_paise"), F.lit(0)) == 0, "bad-amount")
        .when(F.col("direction").isNull(), "no-direction")
    )
    n = F.col("narration")
    df = df.withColumns({"reason": reason, "_told": X.narration(n)}).withColumn("ok", F.col("reason").isNull())
    df = df.withColumn("upi_id", F.coalesce(vpa_segment(n), F.col("_told.upi_id"), X.upi_id(n))).withColumn("_m", X.merchant(n, F.col("_told.merchant"), F.col("upi_id")))
    return df.withColumns(
        {
            "merchant": F.coalesce(F.col("_m.name"), F.col("upi_id")),
            "merchant_source": F.coalesce(F.col("_m.source"), F.when(F.col("upi_id").isNotNull(), "upi-id")),
            "merchant_confidence": F.when(F.col("_m").isNotNull(), 0.7).when(F.col("upi_id").isNotNull(), 0.6).otherwise(0.0),
            "reference_number": F.coalesce(T.nullif_empty(F.trim(cell("ref"))), F.col("_told.ref"), X.reference(n)),
            "channel": X.channel(n, X.upi_id(n), X.card_last4(n), F.lit(None).cast("string")),
        }
    ).drop("_told", "_m")


def summary(rows: DataFrame) -> DataFrame:
    """Rows of each file that are new, duplicates, or bad."""
    count = lambda c: F.count(F.when(c, 1))
    dup = F.col("existing_id").isNotNull()
    return rows.groupBy("file").agg(count(F.col("ok") & ~dup).alias("new"), count(F.col("ok") & dup).alias("duplicates"), count(~F.col("ok")).alias("bad"))


def below_header(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """The rows below each file's header, with its mapping; one small row a file is joined."""
    return rows.join(headers, "file").filter(F.col("row_index") > F.col("header_row"))


def numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy("occurred_at", "id")))
