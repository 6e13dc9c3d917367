"""SQL of the ordered folds for DuckDB: a recursive table takes one row of each group a step and carries what it keeps as a list."""

from __future__ import annotations

from ledgerloom.plans import tables as B


def recursive(ctes: str, steps: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}, {steps} {body}"


#: Duplicates: a row of a tenant is held against the rows before it that are neither duplicates nor deleted.
FLAGGED = """
rows AS (SELECT id, user_id, amount_paise, direction, reference_number AS ref, occurred_at AS ms, occurred_at_precise AS precise, deleted_at IS NOT NULL AS gone,
  row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS n FROM ledger),
fold AS (
  SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::BIGINT AS dup, []::STRUCT(id BIGINT, amount BIGINT, direction VARCHAR, ref VARCHAR, ms BIGINT, precise BOOLEAN)[] AS held FROM rows WHERE n = 1
  UNION ALL
  SELECT user_id, n, id, dup, CASE WHEN dup IS NULL AND NOT gone THEN list_append(held, {'id': id, 'amount': amount_paise, 'direction': direction, 'ref': ref, 'ms': ms, 'precise': precise}) ELSE held END
  FROM (
    SELECT r.*, f.held, coalesce(list_filter(f.held, lambda h: h.ref = r.ref)[1].id,
      list_filter(f.held, lambda h: h.amount = r.amount_paise AND h.direction = r.direction AND abs(h.ms - r.ms) <= CASE WHEN h.precise AND r.precise THEN 180000 ELSE 72000000 END)[1].id) AS dup
    FROM fold f JOIN rows r ON r.user_id = f.user_id AND r.n = f.n + 1)
)"""

_CHOOSE = "CASE WHEN len(near) = 1 THEN near[1] WHEN len(list_filter(near, lambda x: abs(x.ms - ms) <= 1800000)) = 1 THEN list_filter(near, lambda x: abs(x.ms - ms) <= 1800000)[1] END"

#: Pending events of one amount; transactions take them in ingest order.
RESOLVED = recursive(
    B.LEDGER + "," + B.SHORTCUTS,
    f"""
pools AS (SELECT user_id, amount_paise, direction, list({{'id': id, 'ms': coalesce(occurred_at, created_at)}} ORDER BY id) AS pool FROM logged WHERE status = 'pending' GROUP BY ALL),
rows AS (SELECT id, user_id, amount_paise, direction, occurred_at AS ms, row_number() OVER (PARTITION BY user_id, amount_paise, direction ORDER BY created_at, id) AS n FROM ledger),
fold AS (
  SELECT user_id, amount_paise, direction, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::STRUCT(id BIGINT, ms BIGINT) AS chosen, pool FROM pools
  UNION ALL
  SELECT user_id, amount_paise, direction, n, id, chosen, CASE WHEN chosen IS NULL THEN pool ELSE list_filter(pool, lambda x: x.id <> chosen.id) END
  FROM (SELECT *, {_CHOOSE} AS chosen FROM (
    SELECT r.*, f.pool, list_filter(f.pool, lambda x: abs(x.ms - r.ms) <= 259200000) AS near
    FROM fold f JOIN rows r ON r.user_id = f.user_id AND r.amount_paise = f.amount_paise AND r.direction = f.direction AND r.n = f.n + 1))
)""",
    "SELECT id AS txn_id, chosen.id AS event_id FROM fold WHERE chosen IS NOT NULL",
)

#: Both kinds as they come: a transaction takes a waiting event, an event that finds a transaction doesn't wait.
STREAM_MATCHES = f"""
both_kinds AS (SELECT true AS is_txn, id, user_id, amount_paise, direction, occurred_at AS ms, created_at FROM ledger WHERE deleted_at IS NULL
  UNION ALL SELECT false, id, user_id, amount_paise, direction, coalesce(occurred_at, created_at), created_at FROM logged WHERE status = 'pending'),
rows AS (SELECT *, row_number() OVER (PARTITION BY user_id, amount_paise, direction ORDER BY created_at, is_txn, id) AS n FROM both_kinds),
fold AS (
  SELECT user_id, amount_paise, direction, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::BOOLEAN AS is_txn, NULL::STRUCT(id BIGINT, ms BIGINT) AS chosen, []::STRUCT(id BIGINT, ms BIGINT)[] AS txns, []::STRUCT(id BIGINT, ms BIGINT)[] AS waiting FROM rows WHERE n = 1
  UNION ALL
  SELECT user_id, amount_paise, direction, n, id, is_txn, chosen, CASE WHEN is_txn THEN list_append(txns, {{'id': id, 'ms': ms}}) ELSE txns END,
    CASE WHEN NOT is_txn AND chosen IS NULL THEN list_append(waiting, {{'id': id, 'ms': ms}}) WHEN is_txn AND chosen IS NOT NULL THEN list_filter(waiting, lambda x: x.id <> chosen.id) ELSE waiting END
  FROM (SELECT *, {_CHOOSE} AS chosen FROM (
    SELECT r.*, f.txns, f.waiting, list_filter(CASE WHEN r.is_txn THEN f.waiting ELSE f.txns END, lambda x: abs(x.ms - r.ms) <= 259200000) AS near
    FROM fold f JOIN rows r ON r.user_id = f.user_id AND r.amount_paise = f.amount_paise AND r.direction = f.direction AND r.n = f.n + 1))
)"""



def admitted(limit: int, window_ms: int) -> str:
    """Pushes of a user in order; of those let in the last `limit` are carried."""
    return recursive(
        B.LEDGER,
        f"""
rows AS (SELECT id, user_id, created_at AS ms, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS n FROM ledger),
fold AS (
  SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::BIGINT AS recent, []::BIGINT[] AS held FROM rows WHERE n = 1
  UNION ALL
  SELECT user_id, n, id, recent, CASE WHEN recent < {limit} THEN list_append(kept, ms) ELSE kept END
  FROM (SELECT *, len(kept) AS recent FROM (SELECT r.*, list_filter(f.held, lambda x: x >= r.ms - {window_ms}) AS kept FROM fold f JOIN rows r ON r.user_id = f.user_id AND r.n = f.n + 1))
)""",
        f"SELECT id, user_id, recent, recent < {limit} AS admitted FROM fold WHERE id IS NOT NULL",
    )


#: Statement rows: the n-th of a reference with its n-th transaction; the rest of an amount by their best distance, each the nearest that is left.
STATEMENT = """
txns AS (SELECT id, user_id, amount_paise, direction, regexp_replace(lower(reference_number), '[^a-z0-9]', '', 'g') AS ref, occurred_at AS ms, row_number() OVER (PARTITION BY user_id ORDER BY occurred_at, id) AS nth FROM ledger),
lines AS (SELECT id AS i, user_id, amount_paise, direction, ref, ms + 10800000 AS ms FROM txns),
told AS (SELECT user_id, i, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ref ORDER BY i) AS k FROM lines WHERE length(ref) >= 6)
  JOIN (SELECT *, row_number() OVER (PARTITION BY user_id, ref ORDER BY nth) AS k FROM txns WHERE length(ref) >= 6) USING (user_id, ref, k)),
near AS (SELECT l.user_id, l.amount_paise, l.direction, l.i, list({'id': t.id} ORDER BY abs(t.ms - l.ms), t.nth) AS found, min(abs(t.ms - l.ms)) AS best
  FROM lines l JOIN txns t ON t.user_id = l.user_id AND t.amount_paise = l.amount_paise AND t.direction = l.direction AND abs(t.ms - l.ms) <= 86400000
  WHERE (l.user_id, l.i) NOT IN (SELECT user_id, i FROM told) AND (t.user_id, t.id) NOT IN (SELECT user_id, id FROM told) GROUP BY ALL),
rows AS (SELECT *, row_number() OVER (PARTITION BY user_id, amount_paise, direction ORDER BY best, i) AS n FROM near),
fold AS (
  SELECT user_id, amount_paise, direction, 0::BIGINT AS n, NULL::BIGINT AS i, NULL::BIGINT AS id, []::BIGINT[] AS used FROM rows WHERE n = 1
  UNION ALL
  SELECT user_id, amount_paise, direction, n, i, id, CASE WHEN id IS NULL THEN used ELSE list_append(used, id) END
  FROM (SELECT r.*, f.used, list_filter(r.found, lambda x: NOT list_contains(f.used, x.id))[1].id AS id
    FROM fold f JOIN rows r ON r.user_id = f.user_id AND r.amount_paise = f.amount_paise AND r.direction = f.direction AND r.n = f.n + 1)
)"""
STATEMENT_PAIRS = "SELECT user_id, i AS row_index, id AS existing_id FROM told UNION ALL SELECT user_id, i, id FROM fold WHERE id IS NOT NULL"

#: Contacts: every party of a tenant against every contact of it, by all that makes them one.
CONTACTS = """SELECT user_id, upi_id, merchant, contact_id, tier FROM (
  SELECT *, CASE WHEN lp = mail THEN 2
    WHEN least(length(lp), length(mail)) >= 6 AND (starts_with(lp, mail) OR starts_with(mail, lp)) THEN 3
    WHEN len(list_filter(words, lambda w: length(w) < 5 OR NOT contains(letters, w))) = 0 AND (len(words) > 1 OR length(letters) > length(words[1])) THEN 4
    WHEN norm = name THEN 5
    WHEN 1 - levenshtein(norm, name) / greatest(length(norm), length(name)) >= 0.78
      OR norm IS NOT NULL AND len(list_filter(CASE WHEN len(own) <= len(words) THEN own ELSE words END, lambda w: NOT list_contains(CASE WHEN len(own) <= len(words) THEN words ELSE own END, w))) = 0 THEN 6 END AS tier
  FROM (SELECT *, string_split(name, ' ') AS words, string_split(norm, ' ') AS own, regexp_replace(lp, '[^a-z]', '', 'g') AS letters
    FROM (SELECT user_id, upi_id, merchant, lower(split_part(upi_id, '@', 1)) AS lp, NORM AS norm FROM (SELECT DISTINCT user_id, upi_id, merchant FROM ledger))
    JOIN (SELECT user_id, user_id AS contact_id, coalesce(NORM, 'someone') AS name, mail FROM (SELECT user_id, max(merchant) AS merchant, split_part(min(upi_id), '@', 1) AS mail FROM ledger WHERE upi_id IS NOT NULL GROUP BY 1)) USING (user_id)))
WHERE tier IS NOT NULL"""

#: Rupees: the last three digits, before them twos.
RUPEES = """SELECT id, '₹' || CASE WHEN length(w) > 3 THEN reverse(rtrim(regexp_replace(reverse(w[:-4]), '(\\d\\d)', '\\1,', 'g'), ',')) || ',' || w[-3:] ELSE w END
  || CASE WHEN amount_paise % 100 = 0 THEN '' ELSE '.' || lpad(CAST(amount_paise % 100 AS VARCHAR), 2, '0') END AS text
FROM (SELECT *, CAST(amount_paise // 100 AS VARCHAR) AS w FROM ledger)"""


#: The key of the sealed rows, and HMAC by its definition.
def _xored(pad: int) -> str:
    return f"unhex(list_aggregate(list_transform(range(64), lambda i: printf('%02x', xor(CAST('0x' || substr(key || repeat('0', 64), 2 * i + 1, 2) AS INT), {pad}))), 'string_agg', ''))"


def _hmac(text: str) -> str:
    return f"sha256(outer_block || unhex(sha256(inner_block || encode({text}))))"


_FIELD = lambda c: f"""'"{c}":"' || {c} || '"'"""

#: Sealed rows: the payload as JSON without null fields, and keyed digests of amount and reference.
SEALED = f"""SELECT id, NULL::BIGINT AS amount_paise, '{{' || concat_ws(',', '"amount_paise":' || amount_paise, {", ".join(map(_FIELD, ("merchant", "merchant_normalized", "notes", "upi_id", "reference_number", "email_subject", "channel")))}) || '}}' AS payload,
  {_hmac("user_id || ':' || direction || ':' || amount_paise")} AS amount_bidx, {_hmac("user_id || ':ref:' || ref")} AS ref_bidx
FROM (SELECT *, {_xored(0x36)} AS inner_block, {_xored(0x5C)} AS outer_block FROM (SELECT DISTINCT user_id, sha256(unhex(sha256('key of ' || user_id)) || encode('index')) AS key FROM ledger))
JOIN (SELECT *, regexp_replace(lower(reference_number), '[^a-z0-9]', '', 'g') AS ref FROM ledger) USING (user_id)"""
