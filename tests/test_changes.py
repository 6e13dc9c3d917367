"""Tables in parts, sealing under tenants' keys and the index of tenants' own rules against plain models."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import categorize, ledger
from ledgerloom.sources import parts

ROWS = "id long, user_id long, category_id string, notes string, deleted_at long, duplicate_of_id long, created_at long"


def rows(spark, ids):
    return spark.createDataFrame([(i, None if i % 50 == 49 else i % 7, "food", f"n{i}", None, None, i) for i in ids], ROWS)


def files_of(table):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{table.path}/*/*.parquet")}


def held(table, spark):
    return {(r.user_id, r.id): (r.notes, r.created_at) for r in table.read(spark).collect()}


def test_changes_leave_other_parts(spark, tmp_path):
    table = parts.stored(rows(spark, range(300)), f"{tmp_path}/t", tenants=8, rows=4)
    want, before = held(table, spark), files_of(table)
    assert len(want) == 300
    changes = spark.createDataFrame([(3, 10, {"notes": None}), (3, 17, {"notes": "x"}), (3, 9999, {"notes": "no such row"})], "user_id long, id long, set map<string,string>")
    for _ in range(2):  # twice gives the same
        parts.patch(table, changes)
        want |= {(3, 10): (None, 10), (3, 17): ("x", 17)}
        assert held(table, spark) == want
    after = files_of(table)
    touched = {os.path.dirname(p) for p in set(before) - set(after)}
    assert 1 <= len(touched) <= 3 and all(after[p] == t for p, t in before.items() if os.path.dirname(p) not in touched)


def test_upsert_and_removal(spark, tmp_path):
    table = parts.stored(rows(spark, range(100)), f"{tmp_path}/t", tenants=4, rows=2)
    want = held(table, spark)
    late = spark.createDataFrame([(10, 3, "food", "new", None, None, 10), (17, 3, "food", "old", None, None, 1), (1000, 3, "food", "first", None, None, 5)], ROWS)
    for _ in range(2):
        parts.upsert_latest(table, late, ["user_id", "id"], "created_at")
        want |= {(3, 10): ("new", 10), (3, 1000): ("first", 5)}
        assert held(table, spark) == want
    parts.remove_tenant(table, spark, 3)
    assert held(table, spark) == {k: v for k, v in want.items() if k[0] != 3}
    for tenant in (0, 1, 2, 4, 5, 6):  # parts without rows go, rows without a tenant stay
        parts.remove_tenant(table, spark, tenant)
    assert {k[0] for k in held(table, spark)} == {None} and len(held(table, spark)) == 2


def test_an_empty_table_in_parts(spark, tmp_path):
    table = parts.stored(rows(spark, range(0)), f"{tmp_path}/t")
    assert held(table, spark) == {}
    parts.patch(table, spark.createDataFrame([(1, 1, {"notes": "x"})], "user_id long, id long, set map<string,string>"))
    parts.remove_tenant(table, spark, 1)
    parts.upsert_latest(table, rows(spark, range(3)), ["user_id", "id"], "created_at")
    assert len(held(table, spark)) == 3


def test_tenants_without_rows_apart(spark, tmp_path):
    """A table by tenant alone, as that of cursors."""
    cursors = spark.createDataFrame([(u, u * 10) for u in range(20)], "user_id long, at long")
    table = parts.stored(cursors, f"{tmp_path}/c", id=None, tenants=8, rows=1)
    parts.upsert_latest(table, spark.createDataFrame([(4, 1), (5, 99), (30, 7)], "user_id long, at long"), ["user_id"], "at")
    assert {r.user_id: r.at for r in table.read(spark).collect()} == {u: u * 10 for u in range(20)} | {5: 99, 30: 7}


def test_sealing(spark, tmp_path):
    held = {c: "x" for c in ledger.SEALED if c not in ("amount_paise", "reference_number")}
    base = [{"id": i, "user_id": u, "direction": "debit", "amount_paise": 500, "reference_number": "AB-1234567", "enc_payload": None, "amount_bidx": None, "ref_bidx": None} | held for i, u in ((1, 1), (2, 1), (3, 2), (4, 3))]
    names = list(base[0])
    txns = spark.createDataFrame([tuple(r[c] for c in names) for r in base], ", ".join(f"{c} {'long' if c in ('id', 'user_id', 'amount_paise') else 'string'}" for c in names))
    keys = spark.createDataFrame([(1, b"a" * 32), (2, b"b" * 32)], "user_id long, key binary")
    sealed = ledger.seal(txns, keys)
    keys.write.parquet(f"{tmp_path}/keys")
    plan = ledger.seal(txns, spark.read.parquet(f"{tmp_path}/keys"))._jdf.queryExecution().toString().lower()
    assert "a" * 8 not in plan and "61" * 8 not in plan
    kept = spark.createDataFrame(sealed.collect(), sealed.schema)
    got = {r.id: r for r in ledger.unseal(kept, keys).collect()}
    assert '"amount_paise":500' in got[1].payload and got[1].amount_paise is None and got[1].enc_payload != got[2].enc_payload
    assert got[1].amount_bidx == got[2].amount_bidx != got[3].amount_bidx and got[1].ref_bidx == got[2].ref_bidx != got[3].ref_bidx
    assert got[4].enc_payload is None and got[4].amount_paise == 500  # no key yet
    again = {r.id: r.enc_payload for r in ledger.seal(kept, keys).collect()}
    assert again == {i: r.enc_payload for i, r in got.items()}
    moved = kept.withColumn("id", F.col("id") + 1)
    with pytest.raises(Exception, match="(?i)crypto|tag"):
        ledger.unseal(moved.filter("enc_payload IS NOT NULL"), keys).collect()


def brute(texts, rules):
    out = {}
    for user, hay in texts:
        hits = sorted((r[4], r[0]) + (r[3],) for r in rules if r[1] == user and r[2] is not None and r[2].lower() in hay)
        if hay and hits:
            out[user, hay] = hits[0][2]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_rule_index_is_exact(spark, seed):
    pick = random.Random(seed)
    word = lambda least, most: "".join(pick.choice("abcÄ. ") for _ in range(pick.randint(least, most)))
    rules = [(i, pick.randint(1, 3), None if i % 40 == 7 else word(0 if i % 60 == 5 else 1, 6), f"c{i % 9}", pick.randint(1, 20)) for i in range(120)]
    rules = [r for r in rules if r[2] != "" or r[1] == 3]
    texts = [(pick.randint(1, 4), word(0, 14).lower()) for _ in range(300)]
    told = categorize.own_rules(spark.createDataFrame(texts, "user_id long, _hay string"), spark.createDataFrame(rules, "id long, user_id long, pattern string, category_id string, created_at long"))
    assert {(r.user_id, r._hay): r._u for r in told.collect()} == brute(texts, rules)


def test_many_rules_cost_by_hits(spark):
    """10,000 rules of a tenant: a text is compared with those that share their rarest group of letters with it."""
    pick = random.Random(5)
    word = lambda: "".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    rules = [(i, 1, word(), f"c{i % 9}", i) for i in range(10_000)]
    texts = [(1, f"paid {pick.choice(rules)[2] if i % 2 else word()} today") for i in range(400)]
    frames = spark.createDataFrame(texts, "user_id long, _hay string"), spark.createDataFrame(rules, "id long, user_id long, pattern string, category_id string, created_at long")
    assert {(r.user_id, r._hay): r._u for r in categorize.own_rules(*frames).collect()} == brute(texts, rules)
    index = categorize.rule_index(frames[1])
    assert index.count() == 10_000 and index.groupBy("_group").count().agg(F.max("count")).first()[0] <= 40


def test_texts_move_whole_in_pieces(spark):
    """A text isn't copied once a group of its letters, whatever the pieces; of equal patterns the first counts."""
    pick = random.Random(9)
    word = lambda most: "".join(pick.choice("01") for _ in range(pick.randint(1, most)))
    rules = [(i, i % 3, word(4), None if i % 7 == 0 else f"c{i % 9}", pick.randint(1, 20)) for i in range(200)]
    texts = [(pick.randint(0, 3), f"x{word(9)}{i % 50}") for i in range(400)]
    frames = spark.createDataFrame(texts, "user_id long, _hay string"), spark.createDataFrame(rules, "id long, user_id long, pattern string, category_id string, created_at long")
    plan = categorize.own_rules(*frames)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Generate" in line and "_hay" in line]
    for piece in (1, 7, 1000):
        assert {(r.user_id, r._hay): r._u for r in categorize.own_rules(*frames, piece=piece).collect()} == brute(texts, rules)
