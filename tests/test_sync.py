"""The mailbox source, resumed syncs, outcomes of records and admission of pushes against plain models."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import admission
from ledgerloom.sources import mailbox
from ledgerloom.streaming import outcomes, state

DAY = 86_400_000
KNOWN = "alerts@hdfcbank.net"


def mails(spark, ids, at=lambda i: i * 3_600_000):
    rows = [(i % 3, i * 10, i, at(i), 200, KNOWN if i % 2 else "me@example.org", f"s{i}", f"body {i}") for i in ids]
    return spark.createDataFrame(rows, mailbox.MAIL)


def test_filters_reach_pages_and_headers(spark, tmp_path):
    path = f"{tmp_path}/mail"
    for k in range(4):
        mailbox.store(mails(spark, range(k * 25, k * 25 + 25)).coalesce(1), path)
    terms = [("history_id", ">", 500), ("history_id", "<=", 740)]
    assert {p.group for p in mailbox.pages(path, terms)} and len(mailbox.pages(path, terms)) < len(mailbox.pages(path, []))
    assert mailbox.newest(path) == {"history": 990, "at": 99 * 3_600_000}
    session = mailbox.registered(spark)
    got = mailbox.mail(session, path).filter((F.col("arrived_at") >= 30 * 3_600_000) & (F.col("sender") == KNOWN) & (F.length("body") > 0))
    assert {r.message_id for r in got.collect()} == {i for i in range(30, 100) if i % 2}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "(arrived_at" not in plan.split("BatchScan")[0].replace("isnotnull(arrived_at", "")  # the source has taken it over
    assert mailbox.mail(session, path, "").count() == 100
    assert {r.message_id for r in mailbox.mail(session, path, "nobody").collect()} == set()


def test_an_expired_offset_goes_back_a_day(spark, tmp_path):
    session, path = mailbox.registered(spark), f"{tmp_path}/mail"

    def run():
        state.write_once(mailbox.mail_stream(session, path), f"{tmp_path}/out", f"{tmp_path}/cp", ["message_id"]).awaitTermination()
        return sorted(r.message_id for r in state.written_once(spark, f"{tmp_path}/out", mailbox.MAIL).collect())

    mailbox.store(mails(spark, range(60)), path)
    assert run() == list(range(1, 60, 2))
    assert run() == list(range(1, 60, 2))
    mailbox.store(mails(spark, range(60, 80)), path)
    mailbox.expire(path, 700)  # the offset is 590
    reader = mailbox.MailStream(path, [])
    replayed = sorted(i for p in reader.partitions({"history": 590, "at": 59 * 3_600_000}, reader.latestOffset()) for b in reader.read(p) for i in b.column("message_id").to_pylist())
    assert replayed == list(range(35, 80))
    assert run() == list(range(1, 80, 2))
    assert reader.partitions(reader.latestOffset(), reader.latestOffset()) == []


def test_a_sync_that_is_cut_goes_on(spark, tmp_path):
    session, path = mailbox.registered(spark), f"{tmp_path}/mail"
    mailbox.store(mails(spark, range(50)), path)
    ticks = itertools.count()
    runs = [mailbox.sync(session, path, f"{tmp_path}/out", f"{tmp_path}/cursor", 2.5, 100, clock=lambda: next(ticks)) for _ in range(2)]
    assert runs == [False, False]
    some = state.written_once(spark, f"{tmp_path}/out", mailbox.MAIL).count()
    assert 0 < some < 25
    mailbox.store(mails(spark, range(50, 60)), path)
    while not mailbox.sync(session, path, f"{tmp_path}/out", f"{tmp_path}/cursor", 2.5, 100, clock=lambda: next(ticks)):
        pass
    assert sorted(r.message_id for r in state.written_once(spark, f"{tmp_path}/out", mailbox.MAIL).collect()) == list(range(1, 60, 2))
    assert mailbox.sync(session, path, f"{tmp_path}/out", f"{tmp_path}/cursor", 0, 100)


def test_a_large_page_is_read_in_stretches(spark, tmp_path, monkeypatch):
    """A page of many mails is never held whole, and none of its mails is lost at the ends of stretches."""
    import pyarrow.parquet as pq

    path = str(tmp_path / "mail")
    mailbox.store(mails(spark, range(100)).coalesce(1), path)
    monkeypatch.setattr(mailbox, "HELD", 7)
    monkeypatch.setattr(pq.ParquetFile, "read_row_group", None)
    found = mailbox.pages(path, [("sender", "like", mailbox.KNOWN), ("history_id", ">", 3)])
    got = [b for page in found for b in mailbox._fetched(path, page)]
    assert max(b.num_rows for b in got) <= 7
    want = {r.message_id for r in mails(spark, range(100)).collect() if r.history_id > 3 and mailbox.re.search(mailbox.KNOWN, r.sender, 2)}
    assert sorted(i for b in got for i in b.column("message_id").to_pylist()) == sorted(want)


def test_records_are_tried_again_with_growing_pauses(spark):
    records = spark.createDataFrame([(i,) for i in range(8)], "id long")
    fetch = lambda due: due.withColumn("outcome", outcomes.of_status(F.when(F.col("id") == 7, 404).when(F.col("attempts") < F.col("id"), 503).otherwise(200), F.col("id") != 1))
    done, queue = outcomes.attempt(outcomes.queued(records, 0), fetch, 0)
    assert {(r.id, r.outcome) for r in done.collect()} == {(0, "ok"), (7, "gone")}
    assert {(r.attempts, r.next_at) for r in queue.collect()} == {(1, 500)}
    early, queue = outcomes.attempt(queue, fetch, 499)
    assert early.count() == 0 and queue.count() == 6
    _, queue = outcomes.attempt(queue, fetch, 500)
    assert {(r.attempts, r.next_at) for r in queue.collect()} == {(2, 1500)}
    got = {r.id: (r.outcome, r.attempts) for r in outcomes.settled(records, fetch).collect()}
    assert got == {0: ("ok", 1), 1: ("bad", 2), 2: ("ok", 3), 3: ("ok", 4), 4: ("ok", 5), 5: ("dead", 5), 6: ("dead", 5), 7: ("gone", 1)}


def test_pushes_that_cannot_be_read(spark):
    rows = [(1, 1, '{"sender": "a", "body": "x"}'), (1, 2, '{"sender": "a"'), (1, 3, '{"sender": "a", "body": ""}'), (1, 4, None), (1, 5, "[]")]
    out = outcomes.pushed(spark.createDataFrame(rows, "user_id long, received_at long, json string"), "sender string, body string", {"body": F.length("body") > 0}).collect()
    assert [(r.received_at, r.outcome, r.reason) for r in out] == [(1, "ok", None), (2, "bad", "json"), (3, "bad", "body"), (4, "bad", "json"), (5, "bad", "json")]


def plain(rows, limit, window):
    out, held = {}, {}
    for i, user, at in sorted(rows, key=lambda r: (r[2], r[0])):
        mine = [t for t in held.get(user, []) if t >= at - window]
        out[i] = (len(mine), len(mine) < limit)
        held[user] = mine + [at] if len(mine) < limit else mine
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_admission_is_the_plain_fold(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(i, r.randrange(3), r.choice([r.randrange(0, 900_000), r.randrange(0, 120_000, 5000), 600_000 + r.randrange(0, 90_000)])) for i in range(600)]
    rows += [(1000 + i, 9, i * 70_000) for i in range(20)]
    frame = spark.createDataFrame(rows, "id long, user_id long, created_at long")
    want = plain(rows, 20, 60_000)
    assert sum(not a for _, a in want.values()) > 20 and sum(a for _, a in want.values()) > 200
    assert {x.id: (x.recent, x.admitted) for x in admission.admitted(frame, 20).collect()} == want
    assert admission.admitted(frame.filter("id < 0")).count() == 0
    ordered = sorted(rows, key=lambda x: (x[2], x[0]))
    for part in range(2):
        spark.createDataFrame(ordered[part * 310 : part * 310 + 310], frame.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
        state.write_once(admission.admitted_stream(stream, 20), f"{tmp_path}/out", f"{tmp_path}/cp", ["id"]).awaitTermination()
    assert {x.id: (x.recent, x.admitted) for x in state.written_once(spark, f"{tmp_path}/out", "id long, user_id long, recent long, admitted boolean").collect()} == want
