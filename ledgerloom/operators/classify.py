"""Is a message a completed payment, and whose? Ordered decision lists as CASE expressions, no Python at run time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.rules import messages as R


def scanned(subject: Column, body: Column) -> Column:
    """Subject and body, cut to what is looked at; no-break spaces count as blanks."""
    whole = F.concat(F.coalesce(subject, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))
    return F.translate(F.substring(whole, 1, R.SCAN), "\u00a0", " ")


def reason(text: Column) -> Column:
    """`ok`, or why not. Hard negatives come before the amount, soft ones last."""
    return T.let(F.lower(text), lambda low: _reason(text, low))


def _reason(text: Column, low: Column) -> Column:
    first, *rest = R.HARD_NEGATIVE
    out = F.when(T.matches(text, low, first[0]), first[1])
    for pattern, name in rest:
        out = out.when(T.matches(text, low, pattern), name)
    out = out.when(~text.rlike(f"(?i){R.AMOUNT}"), "no-amount")
    out = out.when(~T.any_match(text, low, R.STRONG_POSITIVE), "no-transaction-phrase")
    out = out.when(T.any_match(text, low, R.SOFT_NEGATIVE) & ~T.matches(text, low, R.DEFINITIVE), "promo")
    return out.otherwise("ok")


def _by_provider(sender: Column, values: list[str | None], otherwise: str | None) -> Column:
    out = None
    for (_, _, _, pattern, _), value in zip(R.PROVIDERS, values, strict=True):
        match = sender.rlike(f"(?i){pattern}")
        out = F.when(match, F.lit(value)) if out is None else out.when(match, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def provider(sender: Column) -> Column:
    return _by_provider(sender, [p[0] for p in R.PROVIDERS], "generic")


def bank(sender: Column) -> Column:
    return _by_provider(sender, [p[1] for p in R.PROVIDERS], None)


def channel_hint(sender: Column) -> Column:
    return _by_provider(sender, [p[2] for p in R.PROVIDERS], None)


def looks_relevant(sender: Column) -> Column:
    """By sender alone, so that bodies need not be read."""
    return F.coalesce(provider(sender) != "generic", F.lit(False))


def sender_query(providers: list[str] | None = None, after: str | None = None, newer_than: str | None = None, extra: str = "") -> str:
    """The mailbox query for the known senders; no or empty choice means all."""
    chosen = [p for p in R.PROVIDERS if not providers or p[0] in providers]
    domains = dict.fromkeys(d for p in chosen for d in p[4])
    parts = ["(" + " OR ".join(f"from:({d})" for d in domains) + ")"]
    parts += [f"after:{after}"] if after else [f"newer_than:{newer_than}"] if newer_than else []
    return " ".join([*parts, *([extra] if extra else [])])


def classify(messages: DataFrame) -> DataFrame:
    """messages (sender, subject, body) with text, reason, is_txn, provider, bank and channel_hint."""
    out = messages.withColumn("text", scanned(F.col("subject"), F.col("body")))
    return out.withColumns({"reason": reason(F.col("text")), "provider": provider(F.col("sender")), "bank": bank(F.col("sender")), "channel_hint": channel_hint(F.col("sender"))}).withColumn("is_txn", F.col("reason") == "ok")


def kept(df: DataFrame, condition: Column) -> DataFrame:
    """The rows where condition holds. By a generator: a filter would be pushed below what it reads, also below an exchange
    that spreads the rows, and compute all that once more for each place where it is named."""
    one = F.when(condition, F.array(F.struct(F.lit(True).alias("_kept"))))
    return df.select(*df.columns, F.inline(one)).drop("_kept")


def payments(classified: DataFrame) -> DataFrame:
    """The rows that are completed payments."""
    return kept(classified, F.col("is_txn"))
