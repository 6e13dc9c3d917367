"""Duplicates, matching, statements, files and streams against plain models."""

import hmac
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.operators import analytics, dedup, ledger, match, statement
from ledgerloom.plans.queries import QUERIES
from ledgerloom.sources import files
from ledgerloom.streaming import state

H = 3_600_000
TXN = "id long, user_id long, created_at long, amount_paise long, direction string, reference_number string, occurred_at long, occurred_at_precise boolean, deleted_at long"


def some_txns(seed, n=400):
    r = random.Random(seed)
    return [(i, r.randrange(3), 1000 + i // 2, r.choice([100, 200, 300]), r.choice(["debit", "credit"]), r.choice([None, None, f"R{r.randrange(60)}"]), r.randrange(0, 60 * H, 40_000), r.random() < 0.8, None if r.random() < 0.9 else 1) for i in range(n)]


def fold(rows):
    out, seen = {}, []
    for i, u, created, a, d, ref, at, precise, deleted in sorted(rows, key=lambda x: (x[2], x[0])):
        mine = [x for x in seen if x[1] == u]
        twin = next((x[0] for x in mine if ref and x[5] == ref), None)
        if twin is None:
            twin = next((x[0] for x in mine if x[3] == a and x[4] == d and abs(x[6] - at) <= (3 * 60_000 if precise and x[7] else 20 * H)), None)
        out[i] = twin
        if twin is None and deleted is None:
            seen.append((i, u, created, a, d, ref, at, precise))
    return out


@pytest.mark.parametrize(("seed", "together"), [(1, 0), (2, 0), (3, 0), (2, 100_000)])
def test_duplicates_are_the_ordered_fold(spark, seed, together):
    """With nothing taken together, recurring references are decided by rounds alone."""
    rows = some_txns(seed)
    got = {r.id: r.duplicate_of_id for r in dedup.flag_duplicates(spark.createDataFrame(rows, TXN), together=together).collect()}
    assert got == fold(rows)
    assert sum(v is not None for v in got.values()) > 20
    assert dedup.flag_duplicates(spark.createDataFrame([], TXN)).count() == 0


def parted(i, j):
    """Two rows of an amount hours apart, and two amounts that share a reference."""
    return 2 * i + j, 1, 1000 + i, i + 1, "debit", "R" if j == 0 and i < 2 else f"R{2 * i + j}", (i + j * 5) * H, False, None


@pytest.mark.parametrize("batch", [False, True])
def test_a_part_stays_in_one_task(spark, batch):
    """The parts with tied references are few, so that Spark turns the join that parts them from the rest into a broadcast at run time."""
    rows = [parted(i, j) for i in range(400) for j in (0, 1)]
    held = [(10_000 + i, 2, 1, 5, "debit", None, i * 100 * H, False, None) for i in range(20)]
    existing = spark.createDataFrame([(*r, None) for r in held], TXN + ", duplicate_of_id long") if batch else None
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        got = {r.id: r.duplicate_of_id for r in dedup.flag_duplicates(spark.createDataFrame(rows, TXN), existing).collect()}
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert got == fold(rows)


@pytest.mark.parametrize("seed", [4, 5])
def test_a_batch_is_flagged_as_with_the_whole_ledger(spark, seed):
    rows = sorted(some_txns(seed), key=lambda x: (x[2], x[0]))
    old, new, want = rows[:300], rows[300:], fold(rows)
    ledger = spark.createDataFrame([(*r, want[r[0]]) for r in old], TXN + ", duplicate_of_id long")
    batch = spark.createDataFrame(new, TXN)
    assert {r.id: r.duplicate_of_id for r in dedup.flag_duplicates(batch, ledger).collect()} == {r[0]: want[r[0]] for r in new}
    assert dedup.possible_twins(ledger, batch.limit(1)).count() < sum(want[r[0]] is None and r[8] is None for r in old)
    assert dedup.flag_duplicates(batch.filter("id < 0"), ledger).count() == 0


@pytest.mark.parametrize("batch", [False, True])
def test_large_ids_stay_exact(spark, batch):
    """What a reference tells goes through pandas, where whole numbers beside nulls would be floats and lose their last digits."""
    rows = sorted(((2**60 + x[0], *x[1:]) for x in some_txns(6, 200)), key=lambda x: (x[2], x[0]))
    old, new, want = rows[:100] if batch else [], rows[100:] if batch else rows, fold(rows)
    existing = spark.createDataFrame([(*r, want[r[0]]) for r in old], TXN + ", duplicate_of_id long") if batch else None
    got = {r.id: r.duplicate_of_id for r in dedup.flag_duplicates(spark.createDataFrame(new, TXN), existing, together=0).collect()}
    assert got == {r[0]: want[r[0]] for r in new}


def test_ingest_adds_flagged_rows(spark, sf):
    from ledgerloom.plans import ingest, tables

    ledger = tables.ledger(spark, sf)
    rows = ledger.limit(40).collect()
    first, again = spark.createDataFrame(rows, ledger.schema), spark.createDataFrame(rows[:10], ledger.schema)
    known = first.withColumns({"deleted_at": F.lit(None).cast("long"), "duplicate_of_id": F.lit(None).cast("long")})
    told = again.withColumns({"id": F.col("id") + 10**9, "gmail_message_id": F.concat(F.lit("new"), F.col("id")), "created_at": F.col("created_at") + 10**12, "merchant_source": F.lit("vpa"), "email_subject": F.lit(None).cast("string")}).drop("deleted_at", "duplicate_of_id", "notes", "category_id", "category_source")
    contacts = spark.createDataFrame([], "id long, user_id long, name string, name_normalized string, phones string, emails string, created_at long")
    categories = spark.createDataFrame([], "id string, user_id long, name string")
    rules = spark.createDataFrame([], "id long, user_id long, pattern string, category_id string, created_at long")
    got = ingest.ingest(known, told.withColumnRenamed("gmail_message_id", "external_id"), contacts, categories, rules).collect()
    assert len(got) == 50 and all(r.duplicate_of_id is not None for r in got if r.id >= 10**9)
    assert all(r.duplicate_of_id is None for r in got if r.id < 10**9)


def test_duplicate_windows(spark):
    rows = [(1, 1, 1, 100, "debit", None, 50 * H, True, None), (2, 1, 2, 100, "debit", None, 50 * H + 180_000, True, None), (3, 1, 3, 100, "debit", None, 50 * H + 180_001, True, None), (4, 1, 4, 100, "debit", None, 62 * H, False, None), (5, 2, 5, 100, "debit", None, 50 * H, True, None)]
    got = {r.id: r.duplicate_of_id for r in dedup.flag_duplicates(spark.createDataFrame(rows, TXN)).collect()}
    assert got == {1: None, 2: 1, 3: None, 4: 1, 5: None}


def test_stream_equals_batch(spark, tmp_path):
    rows = sorted(some_txns(3, 200), key=lambda x: (x[2], x[0]))
    for part in range(4):
        spark.createDataFrame(rows[part * 50 : part * 50 + 50], TXN).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = state.stateful(spark).readStream.schema(TXN).parquet(f"{tmp_path}/in")
        state.write_once(state.flag_duplicates(stream), f"{tmp_path}/out", f"{tmp_path}/cp", ["id"]).awaitTermination()
    got = {r.id: r.duplicate_of_id for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == fold(rows)


def test_a_new_tenant_asks_the_store_for_no_entry():
    """Rows of a tenant without state are flagged without a call of the store for each; with state they find it."""
    import pandas as pd

    class Held(dict):
        asked = 0

        def exists(self):
            return bool(self)

        def getValue(self, key):  # noqa: N802
            self.asked += 1
            return self.get(key)

        def updateValue(self, key, value):  # noqa: N802
            self[key] = value

    fold_ = state._Canonicals(None)
    fold_.references, fold_.amounts = Held(), Held()
    rows = pd.DataFrame([(i, 1, i, 100 + i // 2, "debit", "R" if i in (0, 9) else None, i * 1000, True, False) for i in range(10)], columns=["id", "user_id", "created_at", "amount_paise", "direction", "reference_number", "occurred_at", "occurred_at_precise", "deleted"])
    flags = [list(df.duplicate_of_id.fillna(-1)) for part in (rows[:6], rows[6:]) for df in [pd.concat(fold_.handleInputRows((1,), iter([part]), None))] if part is not None]
    assert flags == [[-1, 0, -1, 2, -1, 4], [-1, 6, -1, 0]]
    fold_.references, fold_.amounts = Held(), Held()
    list(fold_.handleInputRows((1,), iter([rows]), None))
    assert fold_.references.asked == fold_.amounts.asked == 0


def test_a_sink_reads_only_the_parts_it_touches(spark, tmp_path):
    frame = lambda ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, v string")
    path = f"{tmp_path}/out"
    state.append_once(frame(range(50)), path, ["id"], 8)
    for bucket in tmp_path.glob("out/_bucket=*"):
        if f"_bucket={spark.range(1).selectExpr('pmod(xxhash64(7L), 8)').first()[0]}" != bucket.name:
            for file in bucket.glob("*.parquet"):
                file.write_bytes(b"not parquet")
            for crc in bucket.glob(".*.crc"):
                crc.unlink()
    state.append_once(frame([7, 7]), path, ["id"], 8)  # reads one part; another one would fail
    state.append_once(frame([1000 + i for i in range(40)]), f"{tmp_path}/new", ["id"], 8)
    state.append_once(frame([1000 + i for i in range(20, 60)]), f"{tmp_path}/new", ["id"], 8)
    assert sorted(r.id for r in state.written_once(spark, f"{tmp_path}/new", "id long, v string").collect()) == list(range(1000, 1060))


def test_statement_pairs(spark):
    r = random.Random(5)
    rows = [(1, i, r.choice([100, 200]), "debit", r.choice([None, None, f"REF 00{r.randrange(9)}1"]), r.randrange(0, 90 * H, H)) for i in range(60)]
    have = [(1, 100 + i, r.choice([100, 200]), "debit", r.choice([None, f"ref00{r.randrange(9)}1"]), r.randrange(0, 90 * H, H), i) for i in range(50)]
    got = {x.row_index: x.existing_id for x in dedup.statement_duplicates(spark.createDataFrame(rows, "user_id long, row_index long, amount_paise long, direction string, reference_number string, occurred_at long"), spark.createDataFrame(have, "user_id long, id long, amount_paise long, direction string, reference_number string, occurred_at long, nth int")).collect()}
    clean = lambda x: "".join(c for c in (x or "").lower() if c.isalnum())
    want, used = {}, set()
    for _, i, _, _, ref, _ in rows:
        twin = next((t[1] for t in have if ref and len(clean(ref)) >= 6 and t[1] not in used and clean(t[4]) == clean(ref)), None)
        if twin:
            want[i] = twin
            used.add(twin)
    near = lambda a, at: [t for t in have if t[1] not in used and t[2] == a and abs(t[5] - at) <= 24 * H]
    waiting = sorted((min(abs(t[5] - at) for t in near(a, at)), i, a, at) for _, i, a, _, _, at in rows if i not in want and near(a, at))
    for _, i, a, at in waiting:
        if left := near(a, at):
            want[i] = min(left, key=lambda t: (abs(t[5] - at), t[6]))[1]
            used.add(want[i])
    assert got == want


def test_pairs_take_the_nearest_left_whatever_the_ties():
    """Against a plain search, with many rows and transactions at the same times."""
    r = random.Random(9)
    for step in (H, 12 * H, 24 * H):
        txns = [(r.randrange(0, 200 * H, step), r.randrange(5), i) for i in range(300)]
        rows = [(i, r.randrange(0, 200 * H, step)) for i in range(300)]
        near = lambda at, used: [(abs(t - at), n, i) for t, n, i in txns if i not in used and abs(t - at) <= 24 * H]  # noqa: B023, E731
        used, want = set(), []
        for _, i, at in sorted((min(near(at, ()))[0], i, at) for i, at in rows if near(at, ())):
            if left := near(at, used):
                used.add(min(left)[2])
                want.append((i, min(left)[2]))
        assert list(dedup._nearest(txns, rows)) == want


def test_one_amount_of_many_days_is_many_parts(spark):
    """A day's pause without a row that reaches on ends a part; transactions that no row reaches are left out."""
    at = lambda *x: [(1, 100, "debit", *y) for y in x]
    items = at(*[(True, d, d * 60 * H, 0) for d in range(40)], *[(False, 100 + d, d * 60 * H + H, d) for d in range(40)], *[(False, 500 + d, 30 * H + d * 60 * H, d) for d in range(39)])
    parts = dedup._days(spark.createDataFrame(items, "user_id long, amount_paise long, direction string, is_row boolean, id long, occurred_at long, nth int")).groupBy("part").count().collect()
    assert len(parts) == 40 and {x["count"] for x in parts} == {2}


def test_recurring_references_stay_many_parts(spark):
    """Monthly references tie many amounts: no part grows beyond its own stretch, and two rounds decide all."""
    rows = [(m * 100 + k, 1, 1000 + m, 100 * k + m, "debit", f"RENT{k}", m * 700 * H, True, None) for m in range(30) for k in range(20)]
    txns = spark.createDataFrame(rows, TXN)
    got = {r.id: r.duplicate_of_id for r in dedup.flag_duplicates(txns, together=0).collect()}
    assert got == {r[0]: None if r[0] < 100 else r[0] % 100 for r in rows}
    parts = dedup._stretches(txns).groupBy("part").count().collect()
    assert len(parts) == 600


EVENTS = "id long, user_id long, amount_paise long, direction string, category_id string, notes string, status string, matched_transaction_id long, occurred_at long, created_at long"
T0 = 1000 * H


@pytest.mark.parametrize(
    "times,want",
    [([], None), ([71 * H], 0), ([73 * H], None), ([5 * 60_000, H], 0), ([5 * 60_000, 10 * 60_000], None), ([30 * 60_000, 30 * 60_000 + 1], 0)],
)
def test_auto_match(spark, times, want):
    txns = spark.createDataFrame([(i, 1, 1, 100, "debit", None, T0 + t, True, None, None) for i, t in enumerate(times)], TXN + ", category_id string")
    events = spark.createDataFrame([(9, 1, 100, "debit", "c", "n", "pending", None, None, T0)], EVENTS)
    got = match.auto_match(events, txns).collect()
    assert [r.txn_id for r in got] == ([] if want is None else [want])
    if want is not None:
        new, done = match.apply_matches(txns.withColumn("notes", F.lit(None).cast("string")), events, match.auto_match(events, txns))
        assert new.filter(f"id = {want}").first().category_id == "c" and done.first().status == "matched"


def test_apply_closes_every_event_of_a_transaction(spark):
    txns = spark.createDataFrame([(1, 1, 1, 100, "debit", None, T0, True, None, None, "old")], TXN + ", category_id string, notes string")
    events = [(7, 1, 100, "debit", "late", None, "pending", None, None, T0 + 5), (8, 1, 100, "debit", "early", "n", "pending", None, None, T0 + 1), (9, 1, 100, "debit", "late too", None, "pending", None, None, T0 + 5)]
    table = spark.createDataFrame(events, EVENTS)
    new, done = match.apply_matches(txns, table, match.auto_match(table, txns))
    assert [(r.category_id, r.notes) for r in new.collect()] == [("late too", "n")]
    assert {(r.id, r.status, r.matched_transaction_id) for r in done.collect()} == {(i, "matched", 1) for i in (7, 8, 9)}


def test_mat4_gives_what_is_applied(spark, sf):
    got = QUERIES["mat4_apply"](spark, sf).toPandas()
    events, txns = got[got.kind == "event"], got[got.kind == "transaction"]
    assert len(events) == len(txns) and events.id.is_unique and txns.id.is_unique
    assert set(events.status) == {"pending", "resolved", "matched"}
    assert set(events[events.id % 9 == 1_000_000_000 % 9].status) == {"resolved"}
    matched = events[events.status == "matched"]
    assert events.matched_transaction_id.notna().sum() == len(matched)
    touched = txns[txns.id.isin(matched.matched_transaction_id)]
    assert len(touched) and set(touched.category_id) == {"rent"} and touched.notes.str.startswith("logged ").all()


def test_candidates_order(spark):
    rows = [(1, T0 + H, "x", None), (2, T0 - H, None, None), (3, T0, "x", 5), (4, T0 + 2 * H, None, None)]
    txns = spark.createDataFrame([(i, 1, 1, 100, "debit", None, at, True, gone, cat) for i, at, cat, gone in rows], TXN + ", category_id string")
    events = spark.createDataFrame([(9, 1, 100, "debit", "c", "n", "pending", None, T0, 0)], EVENTS)
    got = [r.txn_id for r in match.top_candidates(events, txns).orderBy("rank").collect()]
    assert got == [2, 1, 4]


def test_pending_events_are_taken_once(spark):
    r = random.Random(9)
    txns = [(i, 1, i, r.choice([1, 2]), "debit", None, r.randrange(0, 900 * H, H), True, None) for i in range(60)]
    events = [(100 + i, 1, r.choice([1, 2]), "debit", "c", "n", "pending", None, r.randrange(0, 900 * H, H), 0) for i in range(40)]
    pool, want = [(e[8], e[0], e[2]) for e in events], set()
    for i, _, _, a, _, _, at, _, _ in txns:
        near = [x for x in pool if x[2] == a and abs(x[0] - at) <= 72 * H]
        close = [x for x in near if abs(x[0] - at) <= H / 2]
        hit = near[0] if len(near) == 1 else close[0] if len(close) == 1 else None
        if hit:
            pool.remove(hit)
            want.add((i, hit[1]))
    got = {(x.txn_id, x.event_id) for x in match.resolve_pending(spark.createDataFrame(txns, TXN), spark.createDataFrame(events, EVENTS)).collect()}
    assert got == want and len(want) > 3


def test_statement_cells(spark):
    amounts = {"1,23,456.78": (12345678, None), "500 Cr": (50000, "credit"), "500.00 Dr.": (50000, "debit"), "(500.00)": (50000, "debit"), "-5": (500, "debit"), "Rs.7": (700, None), "": None, "abc": None}
    df = spark.createDataFrame([(k,) for k in amounts], "x string")
    got = {r.x: r.a and tuple(r.a) for r in df.select("x", statement.parse_amount(F.col("x")).alias("a")).collect()}
    assert got == amounts
    dates = {"01/06/26": 1_780_295_400_000, "05-Jul-2026": 1_783_233_000_000, "5 july 2026": 1_783_233_000_000, "31/02/2026": 1_772_519_400_000, "n/a": None, "": None, "05/13/2026": None}
    df = spark.createDataFrame([(k,) for k in dates], "x string")
    assert {r.x: r.a for r in df.select("x", statement.parse_date(F.col("x")).alias("a")).collect()} == dates


def test_statement_file(spark):
    text = 'Bank of "Somewhere"\r\nAddress, line\n\n , \nDate,Narration,"Withdrawal ""Amt""",Deposit,Ref No\n05/07/2026,UPI-SHOP-shop@icici-512345678901,450.00,,\n06/07/2026,Salary,,"1,000.00",AB1234\n06/07/2020,x,1,,\nn/a,x,1,,\n07/07/2026,x,,,\n'
    rows = files.csv_rows(spark.createDataFrame([("f", text)], "file string, value string"))
    heads = statement.detect_headers(rows)
    head = heads.first()
    assert head.header_row == 3 and (head.mapping.date, head.mapping.debit, head.mapping.credit, head.mapping.ref) == (0, 2, 3, 4)
    got = statement.normalize(statement.below_header(rows, heads)).orderBy("row_index").collect()
    assert [r.reason for r in got] == [None, None, "before-baseline", "bad-date", "bad-amount"]
    assert (got[0].upi_id, got[0].amount_paise, got[0].direction, got[0].merchant_source) == ("shop@icici", 45000, "debit", got[0].merchant_source)
    assert (got[1].reference_number, got[1].direction, got[1].amount_paise) == ("AB1234", "credit", 100000)


def test_xlsx(spark, tmp_path):
    import io
    import zipfile

    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c></row><row r="2"><c r="A2" s="1"><v>46208</v></c><c r="B2"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>'
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><r><t>Da</t></r><r><t>te</t></r></si></sst>'
    styles = '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, body in (("xl/worksheets/sheet1.xml", sheet), ("xl/sharedStrings.xml", shared), ("xl/styles.xml", styles)):
            z.writestr(name, body)
    assert files.parse_xlsx(data.getvalue()) == [["Date", "", "in"], ["2026-07-05", "2"]]
    (tmp_path / "good.xlsx").write_bytes(data.getvalue())
    (tmp_path / "cut.xlsx").write_bytes(data.getvalue()[:200])
    (tmp_path / "text.xlsx").write_bytes(b"Date,Amount")
    read = files.statement_xlsx(spark, str(tmp_path)).collect()
    assert [(r.file.rsplit("/", 1)[1], r.row_index, r.cells) for r in read] == [("good.xlsx", 0, ["Date", "", "in"]), ("good.xlsx", 1, ["2026-07-05", "2"])]
    bad = files.unreadable(files.workbooks(spark, str(tmp_path))).collect()
    assert sorted(r.file.rsplit("/", 1)[1] for r in bad) == ["cut.xlsx", "text.xlsx"]


def test_vcards(spark):
    text = "BEGIN:VCARD\r\nFN:Asha\r\n  Rao\r\nTEL;TYPE=CELL:+91 99902 65771\r\nEMAIL:a@b.c\r\nEND:VCARD\nBEGIN:VCARD\nN:Das;Ravi;K;;\nNOTE:x\\:y\\, z\nEND:VCARD\nBEGIN:VCARD\nTEL:1\nEND:VCARD\n"
    got = files.cards(spark.createDataFrame([("f", text)], "file string, value string")).orderBy("nth").collect()
    assert [(r.name, r.phones, r.emails) for r in got] == [("Asha Rao", ["+91 99902 65771"], ["a@b.c"]), ("Ravi K Das", [], [])]


def test_csv_cells():
    assert files.parse_csv('a,"b,\n""c""",d\r\n\n  \nx') == [["a", 'b,\n"c"', "d"], ["x"]]
    assert files.parse_csv("") == [] and files.parse_csv("a,\n") == [["a", ""]]


def test_csv_stays_in_spark(spark):
    """Files are split by expressions as `parse_csv` has it, without a worker of Python that would hold them."""
    draw = random.Random(3)
    texts = ["".join(draw.choices(['"', ",", "\n", "\r", "a", " ", "\x01", "1", "\u2003", "\x1c", "é"], k=draw.randrange(30))) for _ in range(400)]
    rows = files.csv_rows(spark.createDataFrame(list(enumerate(texts)), "file long, value string"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in sorted(rows.collect()):
        got.setdefault(r.file, []).append(r.cells)
    for i, text in enumerate(texts):
        assert got.get(i, []) == files.parse_csv(text), text


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(scalars.format_inr(F.lit(12345678))) == "₹1,23,456.78" and one(scalars.format_inr(F.lit(-50000))) == "-₹500"
    assert one(scalars.ist_day(F.lit(1_767_205_800_000))) == "2026-01-01" and one(scalars.ist_day(F.lit(1_767_205_799_999))) == "2025-12-31"
    assert one(scalars.paise(F.lit(1.005))) == 100 and one(scalars.half_up(F.lit(-2.5))) == -2
    assert one(scalars.percent_delta(F.lit(5), F.lit(0))) is None and one(scalars.percent_delta(F.lit(50), F.lit(100))) == -50
    blocks = [scalars.xored(F.lit(b"k" * 32), pad) for pad in (0x36, 0x5C)]
    assert one(scalars.reference_index(F.lit("u"), F.lit("12-3"), *blocks)) is None
    told = one(scalars.reference_index(F.lit("u"), F.lit("1234 56"), *blocks))
    assert told == one(scalars.reference_index(F.lit("u"), F.lit("123456"), *blocks)) == hmac.new(b"k" * 32, b"u:ref:123456", "sha256").hexdigest()


def test_boundaries(spark):
    s = analytics.Slice(100, 200, 0)
    rows = [(i, 1, at, 10, d, None, None, None, None, None, None) for i, (at, d) in enumerate([(99, "debit"), (100, "debit"), (200, "credit"), (201, "debit"), (0, "debit")])]
    t = spark.createDataFrame(rows, "id long, user_id long, occurred_at long, amount_paise long, direction string, category_id string, channel string, merchant_normalized string, merchant string, deleted_at long, duplicate_of_id long")
    assert tuple(analytics.totals(t, s).first()) == (10, 10, 2, 0)
    assert tuple(analytics.previous(t, s).first()) == (30, 0)
    assert tuple(analytics.previous(t, analytics.Slice(0, 200, 0)).first()) == (None, None)
    assert tuple(analytics.totals(t.filter("id < 0"), s).first()) == (0, 0, 0, 0)
    assert analytics.top_merchants(t, s).first().label == "unknown"
    assert ledger.Filters(q="  ").condition() is not None


def test_incoming_rows_win_ties(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "k long, at long, v string")
    got = ledger.upsert_latest(frame((1, 5, "old"), (2, 9, "old"), (3, 1, "old")), frame((1, 5, "new"), (2, 8, "new"), (4, 1, "new")), ["k"], "at")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 5, "new"), (2, 9, "old"), (3, 1, "old"), (4, 1, "new")]


def test_a_stream_forgets_only_what_it_is_told_to(spark, tmp_path):
    """Matches far apart in creation are made with nothing forgotten, and lost with a short memory."""
    # the clock of the key goes on with the second row, which is too far away to match
    rows = [("txn", 1, 1, 100, "debit", 1000 * H, 0), ("txn", 2, 1, 100, "debit", 0, 80 * 24 * H), ("event", 50, 1, 100, "debit", 1000 * H, 90 * 24 * H)]
    schema = "kind string, id long, user_id long, amount_paise long, direction string, at long, created_at long"
    for name, keep, want in (("all", None, [(1, 1, 50)]), ("short", 30 * 24 * H, [])):
        for row in rows:
            spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}-in")
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}-in")
            state.write_once(state.match_events(stream, keep), f"{tmp_path}/{name}", f"{tmp_path}/{name}-cp", ["event_id"], 2).awaitTermination()
        assert [tuple(r) for r in state.written_once(spark, f"{tmp_path}/{name}", "user_id long, txn_id long, event_id long").select("user_id", "txn_id", "event_id").collect()] == want


def test_stream_matches_share_calls(spark, tmp_path):
    """Keys of a slice are folded by one call and don't meet each other; what they hold outlasts a batch."""
    schema = "kind string, id long, user_id long, amount_paise long, direction string, at long, created_at long"
    key = lambda i: (i % 3, 100 + i // 3 % 50, "debit" if i < 150 else "credit")
    first = [("txn", i, *key(i), 1000 * H, i) for i in range(300)] + [("event", 1000 + i, *key(i), 1000 * H, 400) for i in range(0, 300, 3)]
    second = [("event", 2000 + i, *key(i), 1000 * H, 500) for i in range(1, 300, 3)]
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        run = state.write_once(state.match_events(stream, slices=4), f"{tmp_path}/out", f"{tmp_path}/cp", ["event_id"], 2)
        run.awaitTermination()
        assert sum(x["numRowsTotal"] for x in run.lastProgress["stateOperators"]) <= 8  # a batch may be read twice
    got = state.written_once(spark, f"{tmp_path}/out", "user_id long, txn_id long, event_id long").select("user_id", "txn_id", "event_id").collect()
    assert sorted(map(tuple, got)) == sorted([(i % 3, i, 1000 + i) for i in range(0, 300, 3)] + [(i % 3, i, 2000 + i) for i in range(1, 300, 3)])
