"""Scalar functions of the ledger, as column expressions."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

#: India's fixed offset from UTC, and 2026-01-01 00:00 there.
IST_MS, BASELINE_MS = 19_800_000, 1_767_205_800_000
MIN_REFERENCE = 6


def ist_day(ms: Column) -> Column:
    """yyyy-MM-dd in India; needs a UTC session."""
    return F.date_format(F.timestamp_millis(ms + IST_MS), "yyyy-MM-dd")


def ist_month(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms + IST_MS), "yyyy-MM")


def half_up(x: Column) -> Column:
    """Rounds halves up, also negative ones."""
    return F.floor(x + 0.5).cast("long")


def paise(rupees: Column) -> Column:
    return half_up(rupees.cast("double") * 100)


def percent_delta(now: Column, before: Column) -> Column:
    """Null where there is nothing before, or the change rounds to 0."""
    return F.nullif(F.when(before != 0, half_up((now - before) / before * 100)), F.lit(0))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, half_up(part / whole * 100)).otherwise(F.lit(0))


def normalized_reference(ref: Column) -> Column:
    return F.regexp_replace(F.lower(ref), "[^a-z0-9]", "")


def external_id(prefix: str, *parts: Column) -> Column:
    """prefix:sha256 of the parts joined by |; a null part is an empty one."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.concat(F.lit(f"{prefix}:"), F.sha2(F.concat_ws("|", *texts), 256))


def minute(ms: Column) -> Column:
    return F.floor(ms / 60_000).cast("long")


def distance(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def xored(key: Column, pad: int) -> Column:
    """A key of at most 64 octets, filled with zeros to 64, each octet xor pad."""
    digits = F.rpad(F.hex(key), 128, "0")
    octet = lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(pad))
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(octet(i)), 2, "0")), ""))


def keyed(text: Column, inner: Column, outer: Column) -> Column:
    """HMAC of SHA-256 by its definition, in lowercase hexadecimal digits; inner and outer are the key `xored` with 0x36 and 0x5C.

    They are columns, not literals, so that no key stands in a plan.
    """
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)


def amount_index(user: Column, direction: Column, amount: Column, inner: Column, outer: Column) -> Column:
    """Blind index of an amount: a keyed digest that is equal for equal amounts of a user and direction."""
    return keyed(F.concat_ws(":", user.cast("string"), direction, amount.cast("string")), inner, outer)


def reference_index(user: Column, ref: Column, inner: Column, outer: Column) -> Column:
    """Null for references too short to trust."""
    clean = normalized_reference(ref)
    return keyed(F.when(F.length(clean) >= MIN_REFERENCE, F.concat(user.cast("string"), F.lit(":ref:"), clean)), inner, outer)


def grouped_indian(number: Column) -> Column:
    """Digits of a whole number in groups: the last three, then twos."""
    digits = number.cast("string")
    head = F.substring(digits, F.lit(1), F.greatest(F.length(digits) - 3, F.lit(0)))
    tail = F.right(digits, F.lit(3))
    twos = F.regexp_replace(head, r"(?<=\d)(?=(\d\d)+\z)", ",")
    return F.when(F.length(head) > 0, F.concat(twos, F.lit(","), tail)).otherwise(digits)


def format_inr(amount: Column) -> Column:
    """Paise as rupees in Indian grouping; no decimals for whole rupees."""
    whole, rest = F.floor(F.abs(amount) / 100).cast("long"), F.abs(amount) % 100
    decimals = F.when(rest == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(rest.cast("string"), 2, "0")))
    return F.concat(F.when(amount < 0, "-").otherwise(""), F.lit("₹"), grouped_indian(whole), decimals)


def range_preset(name: str, now_ms: int) -> tuple[int, int]:
    """(from, to) of a dashboard range; year and month begin in India."""
    import datetime as dt

    day = 86_400_000
    if name in ("7d", "30d", "90d"):
        return now_ms - int(name[:-1]) * day, now_ms
    if name == "all":
        return 0, now_ms
    local = dt.datetime.fromtimestamp((now_ms + IST_MS) / 1000, dt.UTC)
    start = local.replace(day=1, hour=0, minute=0, second=0, microsecond=0, **({"month": 1} if name == "year" else {}))
    return int(start.timestamp() * 1000) - IST_MS, now_ms
