"""Registered queries, called by name over a small table, against DuckDB's SQL and plain Python."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import __spark_entry__

QUERIES = __spark_entry__.queries()


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The smallest documents, odd texts, and texts made of pieces of personal data; embeddings as they are."""
    pick = random.Random(11)
    bits = ["a.b@c.de", "x@y", "@", "10.0.0.1", "256.1.1.1", "1.2.3", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "6011000990139424", "+1 (555) 010-9999", "+12", "+491701234567", "+1 555 01", "word", "12", "é", "\n", " ", ",", "-"]
    made = ["".join(pick.choice(bits) + pick.choice(["", " ", " ", "\t"]) for _ in range(pick.randint(0, 25))) for _ in range(150)]
    odd = [None, "", " \t\n", "one", "one", "ONE", "a b c d", "A b C d e", "x" * 5000, "é𝕏 " * 700, *made]
    base = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.createDataFrame([(10_000_000 + i, t, "en", "hot" if i % 3 else None, None if t is None else len(t)) for i, t in enumerate(odd)], base.schema)
    path = tmp_path_factory.mktemp("by_name")
    base.unionByName(more).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf}/embeddings.parquet").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def test_op7_base_counts_equal_sql(spark, folder, duck):
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({digits})[i]::INT WHEN reverse({digits})[i]::INT > 4 THEN reverse({digits})[i]::INT * 2 - 9 ELSE reverse({digits})[i]::INT * 2 END)) % 10 = 0"
    sql = f"""SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')),
      len(list_filter(regexp_extract_all(t, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)'), lambda m: list_max(list_transform(string_split(m, '.'), lambda p: p::HUGEINT)) <= 255)),
      len(list_filter(regexp_extract_all(t, '[0-9]([ -]?[0-9])+'), lambda m: length({digits}) BETWEEN 16 AND 19 AND {luhn})),
      len(list_filter(regexp_extract_all(t, '\\+[0-9][ ().0-9-]+[0-9]'), lambda m: length({digits}) BETWEEN 8 AND 15))
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""
    want = {r[0]: tuple(r[1:]) for r in duck.execute(sql).fetchall()}
    got = QUERIES["op7_skip_chain_pii"](spark, folder).collect()
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got} == want and len(got) == len(want)
    assert min(sum(x[k] for x in want.values()) for k in range(4)) > 20


def test_op7_base_spans_equal_patterns(spark, folder, texts):
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub(r"\D", "", m)) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub(r"\D", "", m)) <= 15),
    }
    for r in QUERIES["op7_skip_chain_pii"](spark, folder).collect():
        base = [f"{kind}:{m.start()}:{m.end()}" for kind, (p, good) in rules.items() for m in re.finditer(p, texts[r.doc_id]) if good(m[0])]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
        assert set(base) <= set(r.spans.split(",")) | {""}


def test_op9_sizes_sums_and_evenness(spark, folder, duck, texts):
    got = QUERIES["op9_flow_reshard"](spark, folder).collect()
    assert {r.doc_id: r["size"] for r in got} == dict(duck.execute("SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 FROM documents").fetchall())
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None for r in got) and len(got) == len(texts)
    slots, held = {}, {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        held[r.shard] = held.get(r.shard, 0) + r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    assert max(held.values()) - min(held.get(s, 0) for s in range(24)) <= 2 * max(r["size"] for r in got)


def test_op3_pieces_are_the_documents(spark, folder, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    got = QUERIES["op3_hilbert_pack"](spark, folder).collect()
    at, held = dict.fromkeys(ids, 0), {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        at[r.doc_id] += r.length
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {i: len(x) for i, x in ids.items()}
    for pieces in held.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
    padded = sum(1024 if (n := sum(x for _, x in p)) & (n - 1) else n for p in held.values())
    assert padded <= 1.02 * sum(map(len, ids.values())) + 1024


def test_op4_components_by_all_pairs(spark, folder, texts):
    prints = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t))
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(texts)
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    got = QUERIES["op4_simhash_tiles"](spark, folder).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", top(i)) for i in texts}


def test_op1_recall_and_scores(spark, folder, duck):
    got = QUERIES["op1_pruned_graph_ann"](spark, folder).collect()
    rows = [(i, np.array(e, float)) for i, e in duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()]
    rows = [(i, e) for i, e in rows if e is not None and e.any() and np.isfinite(e).all()]
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    for q, own in rows:
        if q % 100 == 0:
            want = sorted((float(math.dist(own, e)), i) for i, e in rows if i != q)[:10]
            mine = [found[q][k] for k in range(1, len(want) + 1)]
            far = {i: float(math.dist(own, e)) for i, e in rows}
            assert all(abs(s - far[v]) <= 1e-9 * max(1, s) for v, s in mine) and [s for _, s in mine] == sorted(s for _, s in mine)
            hits += len({v for v, _ in mine} & {i for _, i in want}) / len(want)
    assert hits / len(found) >= 0.95
