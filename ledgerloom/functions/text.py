"""Text functions: white space, HTML mail bodies, merchant names."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.rules import messages


def collapse_whitespace(text: Column) -> Column:
    """Runs of blanks and tabs become one blank, blank lines go, ends are trimmed."""
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n\s*\n+", "\n")
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def html_to_text(html: Column) -> Column:
    """Tags become blanks or line ends, references their characters; unknown named ones a blank.

    Decimal references below 65,536 are decoded one distinct code at a time.
    """
    text = F.regexp_replace(html, r"(?is)<style.*?</style>", " ")
    text = F.regexp_replace(text, r"(?is)<script.*?</script>", " ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"(?i)</(p|div|tr|li|h[1-6])>", "\n")
    text = F.regexp_replace(text, "<[^>]+>", " ")
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(\d+);"), F.lit(1)))
    number = lambda c: F.coalesce(c.try_cast("int"), F.lit(0)) % 65536
    to_char = lambda c: F.decode(F.unhex(F.lpad(F.hex(number(c)), 4, "0")), "UTF-16BE")
    text = F.aggregate(codes, text, lambda t, c: F.replace(t, F.concat(F.lit("&#"), c, F.lit(";")), to_char(c)))
    names = F.array_distinct(F.regexp_extract_all(text, F.lit("(?i)&[a-z#0-9]+;"), F.lit(0)))
    known = F.create_map(*[F.lit(x) for pair in messages.ENTITIES.items() for x in pair])
    text = F.aggregate(names, text, lambda t, n: F.replace(t, n, F.coalesce(F.element_at(known, F.lower(n)), F.lit(" "))))
    return collapse_whitespace(text)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def trimmed(texts: Column) -> Column:
    """Each text of an array without blanks at its ends. (F.trim itself takes a second argument, so transform would hand it the place.)"""
    return F.transform(texts, lambda t: F.trim(t))


def nullif_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def extract(text: Column, pattern: str | Column, group: int = 1) -> Column:
    """The group's text, or null if the pattern doesn't match or the group is empty."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return nullif_empty(F.call_function("regexp_extract", text, pattern, F.lit(group)))


def may_match(low: Column, pattern: str) -> Column:
    """Whether a text, of which low is the lower case, holds a word that the pattern needs (`NEEDS`)."""
    words = messages.NEEDS.get(pattern)
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words]) if words else F.lit(True)


def matches(text: Column, low: Column, pattern: str) -> Column:
    """Whether the pattern matches, without case."""
    return may_match(low, pattern) & text.rlike(f"(?i){pattern}")


def any_match(text: Column, low: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [matches(text, low, p) for p in patterns])


def first_place(text: Column, low: Column, patterns: list[str]) -> Column:
    """Where the earliest match begins, from 0, without case; -1 if there is none."""
    return F.coalesce(F.least(*[F.when(may_match(low, p), F.nullif(F.regexp_instr(text, F.lit(f"(?i){p}")), F.lit(0))) for p in patterns]) - 1, F.lit(-1))


def found(text: Column, low: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    """The group's text, empty if the pattern doesn't match."""
    return F.when(~may_match(low, pattern), "").otherwise(F.regexp_extract(text, f"{flags}{pattern}", group))


def normalize_merchant(raw: Column) -> Column:
    """One key for the ways a merchant is written; null if nothing is left."""
    s = let(F.trim(F.lower(raw)), lambda s: F.when(s.rlike(r"\A[a-z0-9._-]+@[a-z0-9]+\z"), F.substring_index(s, "@", 1)).otherwise(s))
    s = F.regexp_replace(s, "[*_]", " ")
    s = F.regexp_replace(s, r"[^a-z0-9@ .&-]", " ")
    s = F.regexp_replace(s, messages.NOISE_WORDS, " ")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return nullif_empty(F.trim(F.regexp_replace(s, r"\s+\d{2,}\z", "")))


def clean_merchant(raw: Column) -> Column:
    """A captured name without honorifics and aggregator codes; null if it can't be a name."""
    s = F.regexp_replace(raw, r"\s+", " ")
    s = F.regexp_replace(s, r"\A[\s:\-–—]+|[\s:\-–—.]+\z", "")
    s = F.regexp_replace(s, r"(?i)\A(?:m/s|mr|mrs|ms)\.?\s+", "")
    s = F.trim(F.regexp_replace(s, r"\A[A-Z0-9]{2,10}\s*\*\s*", ""))
    return F.get(F.filter(F.transform(F.array(s), lambda s: F.when(s.rlike("[a-zA-Z]") & ~s.rlike(r"\A\d[\d\s-]{6,}"), F.trim(F.substring(s, 1, 60)))), lambda s: F.length(s) >= 2), F.lit(0))


def until_stop_word(s: Column) -> Column:
    return let(s, lambda s: F.substring(s, F.lit(1), F.regexp_instr(s, F.lit(messages.MERCHANT_STOP)) - 1))


def strip_suffixes(name: Column) -> Column:
    """Without corporate words at the end; unchanged if nothing would be left."""
    return F.coalesce(nullif_empty(F.trim(F.regexp_replace(name, messages.DISPLAY_SUFFIX, ""))), name)
