"""Parsing of payment texts in DuckDB's SQL, from the text alone: nothing here knows which wording a text was made of.

Its patterns know no look-ahead. One at a pattern's end becomes part of the match, as only a group before it is taken; one
that forbids a word is met by spelling that word's neighbour differently in a copy of the text of the same length.
"""

from __future__ import annotations

from ledgerloom.rules import messages as R

IST = 19_800_000


def quoted(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def place(text: str, patterns: list[str]) -> str:
    """Where the earliest match begins, from 0; -1 if there is none."""
    either = "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"
    return f"CASE WHEN regexp_matches({text}, {quoted(either)}, 'i') THEN length(regexp_extract({text}, {quoted('(?i)^((?s:.*?))' + either)}, 1)) ELSE -1 END"


_FORBIDDEN = (r"(?!\s+card\b)", r"(?!\s+(?:card|limit|score)\b)")
_CARDS = quoted(r"(?i)\bdebit(ed)?(\s+card\b)")
_CREDITS = quoted(r"(?i)\bcredit(ed)?(\s+(?:card|limit|score)\b)")


def _plain(patterns: list[str]) -> list[str]:
    for ahead in _FORBIDDEN:
        patterns = [p.replace(ahead, "") for p in patterns]
    return patterns


_SPLIT = quoted("(?i)" + R.AMOUNT)

#: From `ok` (texts that are payments): direction and the amounts that count, with their places.
MONEY = f"""
phrased AS (SELECT *, {place(f"regexp_replace(text, {_CARDS}, 'd_bit' || chr(92) || '1' || chr(92) || '2', 'g')", _plain(R.DEBIT))} AS debit_at, {place(f"regexp_replace(text, {_CREDITS}, 'cr_dit' || chr(92) || '1' || chr(92) || '2', 'g')", _plain(R.CREDIT))} AS credit_at,
  regexp_matches(text, {quoted(R.REFUND)}, 'i') AS refund, string_split_regex(text, {_SPLIT}) AS gaps, regexp_extract_all(text, {_SPLIT}) AS whole FROM ok),
directed AS (SELECT *, NOT refund AND debit_at >= 0 AND (credit_at < 0 OR debit_at <= credit_at) AS is_debit FROM phrased),
valued AS (SELECT *, CASE WHEN is_debit THEN 'debit' WHEN refund OR credit_at >= 0 THEN 'credit' END AS direction, CASE WHEN is_debit THEN debit_at ELSE credit_at END AS told_at,
  list_filter(list_transform(range(1, len(whole) + 1), lambda i: {{'paise': CAST(floor(CAST(nullif(replace(regexp_extract(whole[i], {quoted('(?i)' + R.AMOUNT_VALUE)}, 1), ',', ''), '') AS DOUBLE) * 100 + 0.5) AS BIGINT),
    'place': CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda w: length(w))), 0) AS BIGINT)}}),
    lambda h: h.paise > 0 AND NOT regexp_matches(substr(text, greatest(h.place - 40, 0) + 1, least(h.place, 40)), {quoted(R.BALANCE)}, 'i')) AS hits FROM directed),
money AS (SELECT *, list_sort(list_transform(range(1, len(hits) + 1), lambda i: {{'far': CASE WHEN told_at < 0 THEN 0 ELSE abs(hits[i].place - told_at) END, 'nth': i, 'paise': hits[i].paise}}))[1].paise AS amount_paise FROM valued)"""


def _clock(hour: str, minute: str, second: str, half: str) -> str:
    n = lambda x: f"coalesce(try_cast({x} AS INT), 0)"
    return f"CASE WHEN {hour} <> '' THEN (CASE WHEN lower({half}) = 'pm' AND {n(hour)} < 12 THEN {n(hour)} + 12 WHEN lower({half}) = 'am' AND {n(hour)} = 12 THEN 0 ELSE {n(hour)} END) * 3600 + {n(minute)} * 60 + {n(second)} END"


def _groups(pattern: str, n: int) -> str:
    return "[" + ", ".join(f"regexp_extract(text, {quoted(pattern)}, {i})" for i in range(1, n + 1)) + "]"


_N = lambda x: f"coalesce(try_cast({x} AS INT), 0)"
_MONTH = f"coalesce(try_cast(d[2] AS INT), list_position([{', '.join(map(quoted, R.MONTHS))}], lower(substr(d[2], 1, 3))), 0)"
_MS = lambda y, m, day: f"epoch_ms(make_timestamp(CAST({y} AS BIGINT), CAST({m} AS BIGINT), 1, 0, 0, 0.0)) + ({day} - 1)::BIGINT * 86400000"

#: From `ok`: the message's own time, whether there is one and whether it has a clock.
TIMES = f"""
stamped AS (SELECT *, {_groups(R.ISO_DATE, 6)} AS s, {_groups(R.DATE, 7)} AS d, {_groups(R.TIME, 4)} AS c FROM ok),
clocked AS (SELECT *, coalesce({_clock('d[4]', 'd[5]', 'd[6]', 'd[7]')}, {_clock('c[1]', 'c[2]', 'c[3]', 'c[4]')}) AS clock, {_MONTH} AS month,
  CASE WHEN s[1] <> '' AND {_N('s[2]')} BETWEEN 1 AND 12 AND {_N('s[3]')} BETWEEN 1 AND 31 THEN {_MS(_N('s[1]'), _N('s[2]'), _N('s[3]'))} + ({_N('s[4]')} * 3600 + {_N('s[5]')} * 60 + {_N('s[6]')})::BIGINT * 1000 - {IST} END AS iso_ms FROM stamped),
dated AS (SELECT *, CASE WHEN d[1] <> '' AND month BETWEEN 1 AND 12 AND {_N('d[1]')} BETWEEN 1 AND 31
  THEN {_MS(f"(CASE WHEN {_N('d[3]')} < 100 THEN {_N('d[3]')} + 2000 ELSE {_N('d[3]')} END)", 'month', _N('d[1]'))} + coalesce(clock, (arrived_at + {IST}) % 86400000 // 1000)::BIGINT * 1000 - {IST} END AS date_ms FROM clocked),
timed AS (SELECT *, CASE WHEN abs(iso_ms - arrived_at) <= 34560000000 THEN iso_ms WHEN abs(date_ms - arrived_at) <= 34560000000 THEN date_ms ELSE arrived_at END AS occurred_at,
  coalesce(abs(iso_ms - arrived_at) <= 34560000000, false) OR coalesce(abs(date_ms - arrived_at) <= 34560000000, false) AS parsed,
  CASE WHEN abs(iso_ms - arrived_at) <= 34560000000 THEN true WHEN abs(date_ms - arrived_at) <= 34560000000 THEN clock IS NOT NULL ELSE false END AS precise FROM dated)"""


def _bound(value: str, body: str) -> str:
    """body with s for value, which is computed once."""
    return f"list_transform([{value}], lambda s: {body})[1]"


def cleaned(raw: str) -> str:
    s = f"regexp_replace({raw}, {quoted(chr(92) + 's+')}, ' ', 'g')"
    s = f"regexp_replace({s}, {quoted(r'\A[\s:\-–—]+|[\s:\-–—.]+\z')}, '', 'g')"
    s = f"regexp_replace({s}, {quoted(r'(?i)\A(?:m/s|mr|mrs|ms)\.?\s+')}, '')"
    s = f"trim(regexp_replace({s}, {quoted(r'\A[A-Z0-9]{2,10}\s*\*\s*')}, ''))"
    return _bound(s, f"CASE WHEN regexp_matches(s, '[a-zA-Z]') AND NOT regexp_matches(s, {quoted(r'\A\d[\d\s-]{6,}')}) AND length(trim(substr(s, 1, 60))) >= 2 THEN trim(substr(s, 1, 60)) END")


def stopped(name: str) -> str:
    return f"regexp_extract({name}, {quoted('(?i)\\A((?s:.*?))(?:' + R.MERCHANT_STOP.removeprefix('(?i)') + ')')}, 1)"


def stripped(name: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace({name}, {quoted(R.DISPLAY_SUFFIX)}, '')), ''), {name})"


_NO_VPA = quoted(r"(?i)\b(?:to|from|towards)(\s+VPA\b)")


def _captured(pattern: str) -> str:
    text = f"regexp_replace(text, {_NO_VPA}, '##' || chr(92) || '1', 'g')" if r"(?!VPA\b)" in pattern else "text"
    return f"regexp_extract({text}, {quoted(pattern.replace(chr(40) + '?!VPA' + chr(92) + 'b)', '').replace('(?=', '(?:'))}, 1)"


_ESC = "regexp_escape(vpa)"
_NEAR_VPA = [
    f"regexp_extract(text, '(?i)' || {_ESC} || {quoted(r'\s*\(([^)]{2,50})\)')}, 1)",
    f"regexp_extract(text, {_ESC} || {quoted(r'\s+([A-Z][\w\s.&-]{2,40}?)(?:\s+on\b|[.,;\n]|\z)')}, 1)",
    f"regexp_extract(text, {quoted(r'(?i)([A-Z][\w .&' + chr(39) + r'-]{2,40}?)\s*\(\s*VPA[:\s]*')} || {_ESC} || {quoted(r'\s*\)')}, 1)",
]


def merchants(of: str, vpa: str) -> str:
    """From the table `of`: m, the merchant's name and where it was found; vpa is SQL for the row's VPA."""
    told = lambda i: f"regexp_extract(text, {quoted(R.NARRATION)}, {i})"
    found = [(cleaned(told(2)), "narration"), *[(f"CASE WHEN vpa IS NOT NULL THEN {x} END", "vpa-name") for x in _NEAR_VPA], *[(_captured(p), s) for p, s in R.MERCHANT]]
    raws = ", ".join(f"{{'raw': {x}, 'source': '{s}'}}" for x, s in found)
    return f"""
payees AS (SELECT *, coalesce(lower(nullif({told(4)}, '')), {vpa}) AS vpa FROM {of}),
raws AS (SELECT *, list_filter([{raws}], lambda x: x.raw <> '') AS found FROM payees),
cuts AS (SELECT *, list_transform(found, lambda x: {{'raw': CASE WHEN x.source IN ('narration', 'vpa-name') THEN x.raw ELSE {stopped(cleaned('x.raw'))} END, 'source': x.source}}) AS short FROM raws),
named AS (SELECT *, list_filter(list_transform(short, lambda x: {{'name': {cleaned('x.raw')}, 'source': x.source}}), lambda x: x.name IS NOT NULL)[1] AS m FROM cuts)"""


#: Whether a remark names more than it should: few words, none that mixes letters with four digits or more.
DOUBTFUL = "coalesce(m.source = 'info-freetext' AND vpa IS NOT NULL AND NOT (len(list_filter(regexp_split_to_array(m.name, '\\s+'), lambda w: w <> '')) < 4 AND len(list_filter(regexp_split_to_array(m.name, '\\s+'), lambda w: regexp_matches(w, '[A-Za-z]') AND length(regexp_replace(w, '\\D', '', 'g')) >= 4)) = 0), false)"
