"""Fields of a payment message, as column expressions over its text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions.scalars import IST_MS, half_up
from ledgerloom.operators.classify import payments
from ledgerloom.rules import messages as R

DAY_MS = 86_400_000
#: A parsed date further from arrival than this is not believed.
FURTHEST_MS = 400 * DAY_MS


# Each field's values that cost a regular expression are found first, those that rest on them after. `parse` keeps the
# first as columns; the functions on a text bind them with `let`.


def _hits(text: Column) -> Column:
    """struct(between, whole): the lengths of the pieces between amounts, and the amounts."""
    pattern = f"(?i){R.AMOUNT_VALUE}"
    return F.struct(F.transform(F.split(text, pattern, -1), F.length).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"))


def _amounts(text: Column, hits: Column) -> Column:
    total = lambda of, n: F.aggregate(F.slice(of, F.lit(1), n), F.lit(0), lambda s, x: s + x)
    lengths = F.transform(hits["whole"], F.length)
    digits = lambda v: F.regexp_replace(v, r"\A[^0-9,]*[.\s]*|,", "")
    hit = lambda v, i: F.struct(half_up(digits(v).try_cast("double") * 100).alias("paise"), (total(hits["between"], i + 1) + total(lengths, i)).alias("place"))
    before = lambda h: F.substring(text, F.greatest(h["place"] - 40, F.lit(0)) + 1, F.least(h["place"], F.lit(40)))
    return F.filter(F.transform(hits["whole"], hit), lambda h: (h["paise"] > 0) & ~before(h).rlike(f"(?i){R.BALANCE}"))


def amounts(text: Column) -> Column:
    """Array of (paise, place) of the amounts that aren't balances, limits or points; place counts from 0.

    The pieces between matches and the matches give the places.
    """
    return T.let(_hits(text), lambda h: _amounts(text, h))


def _phrases(text: Column) -> Column:
    return T.let(F.lower(text), lambda low: F.struct(T.first_place(text, low, R.DEBIT).alias("debit"), T.first_place(text, low, R.CREDIT).alias("credit"), T.matches(text, low, R.REFUND).alias("refund")))


def _direction(p: Column) -> Column:
    debit, credit = p["debit"], p["credit"]
    is_debit = ~p["refund"] & (debit >= 0) & ((credit < 0) | (debit <= credit))
    name = F.when(is_debit, "debit").when(p["refund"] | (credit >= 0), "credit")
    return F.struct(name.alias("direction"), F.when(is_debit, debit).otherwise(credit).alias("place"))


def direction(text: Column) -> Column:
    """struct(direction, place): refunds are credits, else the earlier phrase decides, debit at a tie."""
    return T.let(_phrases(text), _direction)


def amount(hits: Column, place: Column) -> Column:
    """The amount nearest the phrase, the earlier of two as near; the first if there is no phrase."""
    near = F.transform(hits, lambda h, i: F.struct(F.when(place < 0, F.lit(0)).otherwise(F.abs(h["place"] - place)).alias("far"), i.alias("nth"), h["paise"].alias("paise")))
    return F.array_min(near)["paise"]


def upi_id(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(f"(?i){R.VPA}"), F.lit(1)), F.lower)
    return F.get(F.filter(found, lambda v: ~F.substring_index(v, "@", -1).isin(R.EMAIL_PROVIDERS)), F.lit(0))


def _first_kept(values: list[Column], keep) -> Column:
    """The first of the texts that isn't empty and is kept."""
    return F.get(F.filter(F.array(*values), lambda x: (x != "") & keep(x)), F.lit(0))


def reference(text: Column) -> Column:
    return T.let(F.lower(text), lambda low: _first_kept([T.found(text, low, p, flags="(?i)") for p in R.REFERENCE], lambda x: ~x.rlike(r"\A\d{1,2}[-/]\d{1,2}")))


def card_last4(text: Column) -> Column:
    return T.let(F.lower(text), lambda low: _first_kept([T.found(text, low, p) for p in R.CARD], lambda x: F.lit(True)))


def channel(text: Column, vpa: Column, card: Column, hint: Column) -> Column:
    """A VPA in the text is better evidence of UPI than the bare word, which boilerplate has too."""
    return T.let(F.lower(text), lambda low: _channel(text, low, vpa, card, hint))


def _channel(text: Column, low: Column, vpa: Column, card: Column, hint: Column) -> Column:
    out = F.when(vpa.isNotNull() | low.contains("vpa") & text.rlike(r"(?i)\bvpa\b"), "UPI").when(card.isNotNull() & text.rlike(r"(?i)\bcard\b"), "Card")
    for pattern, name in R.CHANNEL_WORDS:
        out = out.when(T.matches(text, low, pattern), name)
    return out.otherwise(hint)


def narration(text: Column) -> Column:
    """struct(ref, merchant, upi_id) of a bank's slash- or dash-separated narration."""
    return T.let(F.regexp_extract(text, R.NARRATION, 0), _narration)


def _narration(whole: Column) -> Column:
    part = lambda i: F.regexp_extract(whole, R.NARRATION, i)
    return F.struct(T.nullif_empty(part(1)).alias("ref"), T.clean_merchant(part(2)).alias("merchant"), T.nullif_empty(F.lower(part(4))).alias("upi_id"))


def _vpa_names(text: Column, vpa: Column) -> list[Column]:
    """What a pattern of this very VPA finds; such a pattern is only made where one of any VPA has a match."""
    quoted = F.concat(F.lit(r"\Q"), vpa, F.lit(r"\E"))
    after_in = F.concat(F.lit("(?i)"), quoted, F.lit(r"\s*\(([^)]{2,50})\)"))
    after = F.concat(quoted, F.lit(r"\s+([A-Z][\w\s.&-]{2,40}?)(?=\s+on\b|[.,;\n]|\z)"))
    before = F.concat(F.lit(r"(?i)([A-Z][\w .&'-]{2,40}?)\s*\(\s*VPA[:\s]*"), quoted, F.lit(r"\s*\)"))
    found = lambda any_, this: F.when(vpa.isNotNull() & text.rlike(any_), F.call_function("regexp_extract", text, this, F.lit(1)))
    return [found(r"@[^\s(]+\s*\(", after_in), found(r"@\S+\s+[A-Z]", after), found(r"(?i)\(\s*VPA", before)]


def vpa_beneficiary(text: Column, vpa: Column) -> Column:
    """The name next to this very VPA: in brackets after it, capitalised after it, or before its brackets."""
    return F.get(F.array_compact(F.transform(F.array(*_vpa_names(text, vpa)), T.clean_merchant)), F.lit(0))


def merchant(text: Column, told: Column, vpa: Column) -> Column:
    """struct(name, source): narration, then the VPA's beneficiary, then the patterns in order."""
    return T.let(F.lower(text), lambda low: _merchant(text, low, told, vpa))


def _merchant(text: Column, low: Column, told: Column, vpa: Column) -> Column:
    found = lambda name, source: F.struct(name.alias("raw"), F.lit(source).alias("source"))
    raw = [found(told, "narration"), *[found(x, "vpa-name") for x in _vpa_names(text, vpa)], *[found(T.found(text, low, p), s) for p, s in R.MERCHANT]]
    short = lambda x: F.when(x["source"].isin("narration", "vpa-name"), x["raw"]).otherwise(T.until_stop_word(T.clean_merchant(x["raw"])))
    cleaned = lambda x: T.let(T.clean_merchant(short(x)), lambda name: F.when(name.isNotNull(), F.struct(name.alias("name"), x["source"].alias("source"))))
    none = F.lit(None).cast("struct<name: string, source: string>")
    return F.aggregate(F.filter(F.array(*raw), lambda x: x["raw"] != ""), none, lambda first, x: F.coalesce(first, cleaned(x)))


def named(paid: DataFrame) -> DataFrame:
    """Payments (with text) with `vpa` and `m`, their merchant as struct(name, source), null where none is told. Each a step of its own, as in `parse`."""
    df = paid.withColumns({"_told": F.regexp_extract("text", R.NARRATION, 0), "_upi": upi_id(F.col("text"))}).withColumn("_told", _narration(F.col("_told")))
    df = df.withColumns({"vpa": F.coalesce("_told.upi_id", "_upi"), "_told": F.col("_told.merchant")})
    return df.withColumn("m", merchant(F.col("text"), F.col("_told"), F.col("vpa"))).drop("_told", "_upi")


def looks_like_a_name(s: Column) -> Column:
    """Fewer than four words, and none that mixes letters with four digits or more."""
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    mixed = F.exists(words, lambda w: w.rlike("[A-Za-z]") & (F.length(F.regexp_replace(w, r"\D", "")) >= 4))
    return (F.size(words) < 4) & ~mixed


def source_confidence(source: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in R.SOURCE_CONFIDENCE.items() for x in pair])
    return F.coalesce(F.element_at(known, source), F.lit(0.0))


def utc_ms(year: Column, month: Column, day: Column, hour: Column | int = 0, minute: Column | int = 0, second: Column | int = 0) -> Column:
    """Milliseconds of a wall-clock time read as UTC; days past a month's end roll over."""
    days = F.unix_date(F.make_date(year, month, F.lit(1))) + day - 1
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return (days.cast("long") * 86_400 + lit(hour) * 3600 + lit(minute) * 60 + lit(second)) * 1000


def whole_number(text: Column) -> Column:
    """Null where text is no number. Without a digit it isn't cast: Spark raises and catches an error for each such text, which costs more than all else here."""
    return F.when(text.rlike("[0-9]"), text.try_cast("int"))


def month_number(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for i, m in enumerate(R.MONTHS) for x in (m, i + 1)])
    return F.coalesce(whole_number(name), F.element_at(known, F.lower(F.substring(name, 1, 3))), F.lit(0))


def _told_times(text: Column) -> Column:
    """struct(iso, date, time): the stretches of text that hold them, empty where there is none."""
    return F.struct(*[F.regexp_extract(text, p, 0).alias(n) for n, p in (("iso", R.ISO_DATE), ("date", R.DATE), ("time", R.TIME))])


def _time_parts(told: Column) -> Column:
    """The same as arrays of the patterns' groups, which one pass over such a stretch puts side by side."""
    all_ = lambda k: "|".join(f"${i}" for i in range(1, k + 1))
    groups = lambda n, p, k: F.when(told[n] == "", F.array(*[F.lit("")] * k)).otherwise(F.split(F.regexp_replace(told[n], p, all_(k)), r"\|", -1)).alias(n)
    return F.struct(groups("iso", R.ISO_DATE, 6), groups("date", R.DATE, 7), groups("time", R.TIME, 4))


def _times(g: Column, arrived: Column) -> Column:
    """struct(iso, ms, precise) in milliseconds, each null where it isn't told or is no time."""
    number = lambda x: F.coalesce(whole_number(x), F.lit(0))
    valid = lambda month, day: month.between(1, 12) & day.between(1, 31)

    def clock(g: Column, at: int) -> Column:
        """Seconds of the day of hour, minute, second and half at those places; null if there is no hour."""
        half, hour = F.lower(g[at + 3]), number(g[at])
        hour = F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
        return F.when(g[at] != "", hour * 3600 + number(g[at + 1]) * 60 + number(g[at + 2]))

    iso, date = g["iso"], g["date"]
    from_iso = F.when((iso[0] != "") & valid(number(iso[1]), number(iso[2])), utc_ms(number(iso[0]), number(iso[1]), number(iso[2]), number(iso[3]), number(iso[4]), number(iso[5])) - IST_MS)
    told = F.coalesce(clock(date, 3), clock(g["time"], 0))
    month, day, year = month_number(date[1]), number(date[0]), number(date[2])
    arrival = F.floor(F.pmod(arrived + IST_MS, F.lit(DAY_MS)) / 1000)
    from_date = F.when((date[0] != "") & valid(month, day), utc_ms(F.when(year < 100, year + 2000).otherwise(year), month, day) + F.coalesce(told, arrival) * 1000 - IST_MS)
    return F.struct(from_iso.cast("long").alias("iso"), from_date.cast("long").alias("ms"), told.isNotNull().alias("precise"))


def _believed(t: Column, arrived: Column) -> Column:
    near = lambda ms: F.coalesce(F.abs(ms - arrived) <= FURTHEST_MS, F.lit(False))
    told = lambda ms, parsed, precise: F.struct(ms.cast("long").alias("ms"), F.lit(parsed).alias("parsed"), precise.alias("precise"))
    return F.when(near(t["iso"]), told(t["iso"], True, F.lit(True))).when(near(t["ms"]), told(t["ms"], True, t["precise"])).otherwise(told(arrived, False, F.lit(False)))


def occurred_at(text: Column, arrived: Column) -> Column:
    """struct(ms, parsed, precise): the message's own time where it has one that is believed, else its arrival."""
    return T.let(T.let(T.let(_told_times(text), _time_parts), lambda g: _times(g, arrived)), lambda t: _believed(t, arrived))


def parse(classified: DataFrame) -> DataFrame:
    """From classified messages (with arrived_at) the payments, with every field that could be found.

    What rests on a value that takes a regular expression is a step of its own, so that Spark keeps the value as a column.
    """
    text, c = F.col("text"), F.col
    df = payments(classified).withColumns({"_phrases": _phrases(text), "_hits": _hits(text)})
    df = df.withColumns({"_by": _direction(c("_phrases")), "_amounts": _amounts(text, c("_hits"))}).withColumn("_paise", amount(c("_amounts"), c("_by.place")))
    # a generator, as a filter would be pushed below the columns that it reads and compute them again
    money = F.when(c("_by.direction").isNotNull() & c("_paise").isNotNull(), F.array(F.struct(c("_by.direction").alias("direction"), c("_paise").alias("amount_paise"))))
    df = df.select(*classified.columns, F.inline(money))
    df = df.withColumns({"_told": F.regexp_extract(text, R.NARRATION, 0), "_upi": upi_id(text), "card_last4": card_last4(text), "_ref": reference(text), "_when": _told_times(text)})
    df = df.withColumns({"_told": _narration(c("_told")), "_when": _time_parts(c("_when")), "channel": channel(text, c("_upi"), c("card_last4"), c("channel_hint"))})
    # bound, as the code that Spark writes for this step by itself is one method too large for the JVM to compile
    when = T.let(c("_when"), lambda g: F.when((g["iso"][0] != "") | (g["date"][0] != ""), _times(g, c("arrived_at"))))
    df = df.withColumns({"_when": when, "_vpa": F.coalesce("_told.upi_id", "_upi"), "reference_number": F.coalesce("_told.ref", "_ref")})
    df = df.withColumns({"_when": _believed(c("_when"), c("arrived_at")), "_m": merchant(text, c("_told.merchant"), c("_vpa"))})
    doubtful = F.coalesce((c("_m.source") == "info-freetext") & c("_vpa").isNotNull() & ~looks_like_a_name(c("_m.name")), F.lit(False))
    df = df.withColumn("_doubtful", doubtful)
    sure = lambda field: F.when(~c("_doubtful"), c(field))
    fields = {
        "upi_id": c("_vpa"),
        "card_last4": c("card_last4"),
        "merchant": F.coalesce(sure("_m.name"), c("_vpa")),
        "merchant_source": F.coalesce(sure("_m.source"), F.when(c("_vpa").isNotNull(), "upi-id")),
        "reference_number": c("reference_number"),
        "channel": c("channel"),
        "occurred_at": c("_when.ms"),
        "occurred_at_precise": c("_when.precise"),
        "_dated": c("_when.parsed"),
    }
    df = df.select(*[x for x in classified.columns if x not in ("is_txn", "channel_hint")], "direction", "amount_paise", *[v.alias(k) for k, v in fields.items()])
    points = reduce(lambda a, b: a + b, [F.when(x, F.lit(w)).otherwise(0) for x, w in ((c("provider") != "generic", 25), (c("merchant").isNotNull(), 12), (c("reference_number").isNotNull(), 10), (c("channel").isNotNull(), 5), (c("_dated"), 5))])
    return df.withColumns({"merchant_confidence": source_confidence(c("merchant_source")), "confidence": F.least(points + 40, F.lit(97)) / 100, "currency": F.lit("INR")}).drop("_dated")
