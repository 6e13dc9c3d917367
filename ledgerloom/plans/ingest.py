"""From payments to ledger rows: contacts, merchants, categories, insertion, duplicates; and deriving old rows anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import categorize, dedup, ledger, resolve
from ledgerloom.operators import classify as C
from ledgerloom.operators import extract as X
from ledgerloom.session import written

PARSER_VERSION = 1


def enriched(payments: DataFrame, contacts: DataFrame, categories: DataFrame, rules: DataFrame) -> DataFrame:
    """payments (the common shape, plus id) with final merchant and category. They are written before, as contacts read them twice and
    most of the work is to parse them, and between, as categories read them three times."""
    named = written(resolve.resolve_merchant(resolve.with_contacts(written(payments), contacts)))
    return categorize.categorize(named, categories, rules).drop("contact_name")


def ingest(existing: DataFrame, payments: DataFrame, contacts: DataFrame, categories: DataFrame, rules: DataFrame) -> DataFrame:
    """The ledger after ingesting payments: existing rows as they are, new ones with their duplicates flagged.

    Flagging reads the batch and its possible twins, not the whole ledger.
    """
    rows = enriched(payments, contacts, categories, rules).withColumnRenamed("external_id", "gmail_message_id")
    empty = {"deleted_at": F.lit(None).cast("long"), "duplicate_of_id": F.lit(None).cast(dict(rows.dtypes)["id"]), "notes": F.lit(None).cast("string")}
    fresh = ledger.insert_new(existing, rows.withColumns(empty))
    fresh = written(fresh.select(existing.columns))
    flagged = fresh.drop("duplicate_of_id").join(dedup.flag_duplicates(fresh, existing), "id", "left")
    return existing.unionByName(flagged.select(existing.columns))


def reprocess(txns: DataFrame, contacts: DataFrame, categories: DataFrame, rules: DataFrame) -> DataFrame:
    """Mail rows derived anew from their raw message; others as they are.

    Amount, direction and currency stay. Merchant fields, time and confidence are replaced; VPA, channel,
    reference, card and bank only if found; the category only if there is none.
    """
    always = ["merchant", "merchant_normalized", "merchant_source", "merchant_confidence", "occurred_at", "confidence"]
    if_found = ["upi_id", "channel", "reference_number", "card_last4", "bank"]
    schema = "`from` string, subject string, body string, internalDate long"
    due = txns.filter("source = 'gmail' AND raw IS NOT NULL AND deleted_at IS NULL")
    # by a generator, as a filter would be pushed below the columns that it reads and read the JSON once more
    read = due.select("id", "user_id", F.inline(F.array_compact(F.array(F.from_json("raw", schema))))).withColumnsRenamed({"from": "sender", "internalDate": "arrived_at"})
    parsed = X.parse(C.classify(read)).select("id", "user_id", F.col("subject").alias("email_subject"), *[c for c in [*always, *if_found] if c != "merchant_normalized"])
    new = enriched(parsed, contacts, categories, rules)
    held = new.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in [*always, *if_found, "category_id", "category_source"]])
    df = txns.join(held, "id", "left")
    blank = F.col("category_id").isNull() & F.col("_category_id").isNotNull()
    out = {c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in always} | {c: F.coalesce(f"_{c}", c) for c in if_found}
    out |= {c: F.when(blank, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("category_id", "category_source")}
    return df.withColumns({c: v for c, v in out.items() if c in txns.columns}).select(txns.columns)


def due_for_reprocess(users: DataFrame, version: int = PARSER_VERSION) -> DataFrame:
    return users.filter(F.coalesce("parser_version_applied", F.lit(0)) < version)


def reprocess_due(txns: DataFrame, users: DataFrame, contacts: DataFrame, categories: DataFrame, rules: DataFrame, version: int = PARSER_VERSION) -> tuple[DataFrame, DataFrame]:
    """(rows of the tenants whose rows are from an older parser, derived anew; users with the version that is applied then).

    Other tenants' rows aren't read into parsing. Write the rows before the users: a job that is cut between the two does the same again.
    """
    behind = due_for_reprocess(users, version).select(F.col("id").alias("user_id"))
    rows = reprocess(txns.join(behind, "user_id", "left_semi").select(txns.columns), contacts, categories, rules)
    return rows, users.withColumn("parser_version_applied", F.greatest(F.coalesce("parser_version_applied", F.lit(0)), F.lit(version)))
