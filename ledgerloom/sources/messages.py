"""Where payments come from: mail, pushed SMS, wallet events, logged expenses and statement rows, all as rows of one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions.scalars import external_id, minute, paise
from ledgerloom.operators import classify as C
from ledgerloom.operators import extract as X

PAYMENT = ("user_id", "external_id", "source", "provider", "bank", "occurred_at", "occurred_at_precise", "amount_paise", "currency", "direction", "merchant", "merchant_source", "merchant_confidence", "channel", "reference_number", "upi_id", "card_last4", "email_subject", "confidence", "raw", "created_at")

SMS_JSON = "type string, sender string, body string, timestamp string"
WALLET_JSON = "type string, merchant string, amount double, card string, timestamp string"
SHORTCUT_JSON = "amount double, category string, notes string, direction string, timestamp string"


def body_of(parts: Column) -> Column:
    """The text of a mail from its flattened MIME parts (mime, text): plain text if there is any, else HTML as text."""
    first = lambda mime: F.get(F.transform(F.filter(parts, lambda p: (p["mime"] == mime) & (F.length(p["text"]) > 0)), lambda p: p["text"]), F.lit(0))
    return F.coalesce(T.collapse_whitespace(first("text/plain")), T.html_to_text(first("text/html")), F.lit(""))


def from_mime(mails: DataFrame) -> DataFrame:
    """Mails (user_id, message_id, arrived_at, headers map, parts) as messages."""
    head = lambda name: F.coalesce(F.try_element_at("headers", F.lit(name)), F.lit(""))
    return mails.select("user_id", "message_id", "arrived_at", head("From").alias("sender"), head("Subject").alias("subject"), body_of(F.col("parts")).alias("body"))


def arrived(timestamp: Column, received: Column) -> Column:
    """The time a push names, else when it was received, in ms."""
    return F.coalesce(F.unix_millis(timestamp.try_cast("timestamp")), received)


def pushed(pushes: DataFrame, schema: str) -> DataFrame:
    """Pushes (user_id, received_at, json) with their fields read; rows that aren't JSON have nulls."""
    return pushes.select("user_id", "received_at", F.from_json("json", schema).alias("p")).select("user_id", "received_at", "p.*")


def sms(pushes: DataFrame) -> DataFrame:
    """SMS (user_id, sender, body, timestamp, received_at) as messages; the id comes from sender, body and minute."""
    at = arrived(F.col("timestamp"), F.col("received_at"))
    sender, body = F.coalesce("sender", F.lit("")), F.substring("body", 1, 6000)
    return pushes.filter("length(body) > 0").select("user_id", external_id("sms", sender, body, minute(at)).alias("message_id"), at.alias("arrived_at"), sender.alias("sender"), F.lit("").alias("subject"), body.alias("body"))


def payments(messages: DataFrame, source: str) -> DataFrame:
    """The payments among messages, in the common shape."""
    df = X.parse(C.classify(messages))
    raw = F.to_json(F.struct(F.col("sender").alias("from"), "subject", F.substring("body", 1, 2000).alias("body"), "provider", F.col("arrived_at").alias("internalDate")))
    return df.withColumns({"external_id": F.col("message_id"), "source": F.lit(source), "email_subject": F.col("subject"), "raw": raw if source == "gmail" else F.lit(None).cast("string"), "created_at": F.col("arrived_at")}).select(*PAYMENT)


def wallet(pushes: DataFrame) -> DataFrame:
    """Wallet events (user_id, merchant, amount, card, timestamp, received_at): always card debits."""
    at, amount = arrived(F.col("timestamp"), F.col("received_at")), paise(F.col("amount"))
    none = F.lit(None).cast("string")
    df = pushes.filter("amount > 0").withColumns({"occurred_at": at, "amount_paise": amount, "external_id": external_id("wallet", F.col("merchant"), amount, minute(at))})
    fixed = {"source": "wallet", "provider": "generic", "currency": "INR", "direction": "debit", "merchant_source": "pattern", "merchant_confidence": 0.9, "channel": "Card", "confidence": 0.95, "occurred_at_precise": True}
    df = df.withColumns({k: F.lit(v) for k, v in fixed.items()} | {k: none for k in ("bank", "reference_number", "upi_id", "email_subject", "raw")})
    return df.withColumns({"card_last4": X.card_last4(F.col("card")), "created_at": F.col("received_at")}).select(*PAYMENT)


def statement(rows: DataFrame) -> DataFrame:
    """Good rows of a statement (user_id, received_at and the fields of `statement.normalize`)."""
    none = F.lit(None).cast("string")
    key = external_id("stmt", F.col("occurred_at"), F.col("amount_paise"), F.col("direction"), F.lower("narration"))
    df = rows.filter("ok").withColumns({"external_id": key, "source": F.lit("statement"), "provider": F.lit("generic"), "currency": F.lit("INR"), "confidence": F.lit(0.6), "occurred_at_precise": F.lit(False), "raw": F.to_json("cells"), "created_at": F.col("received_at")})
    return df.withColumns({k: none for k in ("bank", "card_last4", "email_subject")}).select(*PAYMENT)


def shortcuts(pushes: DataFrame) -> DataFrame:
    """Logged expenses (user_id, amount, category, notes, direction, timestamp, received_at) as pending events."""
    at = arrived(F.col("timestamp"), F.col("received_at"))
    return pushes.filter("amount > 0").select("user_id", paise(F.col("amount")).alias("amount_paise"), F.coalesce("direction", F.lit("debit")).alias("direction"), F.col("category").alias("category_name"), "notes", F.lit("pending").alias("status"), at.alias("occurred_at"), F.col("received_at").alias("created_at"))


def to_fetch(listed: DataFrame, seen: DataFrame, cap: int | None = None) -> DataFrame:
    """Of listed messages (user_id, message_id, sender, nth) those that are relevant and not seen: by sender first, so bodies aren't read."""
    out = listed.filter(C.looks_relevant(F.col("sender"))).join(seen.select("user_id", F.col("gmail_message_id").alias("message_id")), ["user_id", "message_id"], "left_anti")
    return out if cap is None else out.orderBy("nth").limit(cap)
