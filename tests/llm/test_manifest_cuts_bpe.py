"""Merkle manifest, fill-in-middle and prefix BPE: the queries against SQL or the library, odd rows against brute force."""

import glob
import hashlib
import json
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import bpe_prefix, fill_in_middle, merkle_manifest
from ledgerloom.llm.queries import QUERIES, SQL

BPE = public_tokenizers.path("byte_bpe_50k.json")
CLASH = ["grp", "pos", "n", "node", "carried", "held", "block", "tree", "id", "path", "top", "_m", "_part", "key", "z", "rows", "low", "high", "ids", "part", "times", "decoded", "output"]
TEXTS = ["The Quick fox", None, "", "The Quick fox", "x <P> y", "naïve 𝕏 ☃\n\n and  more", "ÀÉ " * 9_000, " \t", "a<|endoftext|>b", "é"]
ROWS = [(i, f"src{i % 3}" if i % 4 else None, [None, "en", "de", ""][i % 4] if i != 7 else "zz", i * 3 if i % 5 else None, TEXTS[i % len(TEXTS)]) for i in range(45)]
ROWS += [ROWS[3], ROWS[3], (5, "other", "en", 1, "Same id"), (None, None, None, None, None), (None, "s", "en", 2, "no id")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, source string, lang string, n_chars long, text string")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_fill_in_middle"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*'}')")
    df = QUERIES[name](spark, sf)
    found = con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert len(got) >= 200 and Counter(got) == Counter(found)


# Merkle manifest


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _climb(nodes):
    """Root, and of each node its siblings from below."""
    sides, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = i // 8 * 8
            sides[leaf].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 8])))
        nodes, at = [_h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [i // 8 for i in at]
    return nodes[0], sides


def _manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault("" if r[2] is None else "=" + r[2], []).append(r)
    names = sorted(groups, key=str.encode)
    roots, sides = {}, {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        roots[g], sides[g] = _climb([_leaf(r) for r in groups[g]])
    root, above = _climb([roots[g] for g in names])
    return [(r[0], _leaf(r), tuple(sides[g][i] + above[k]), roots[g], root) for k, g in enumerate(names) for i, r in enumerate(groups[g])]


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest_is_the_plain_tree(docs, monkeypatch, levels):
    monkeypatch.setattr(merkle_manifest, "LEVELS", levels)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 8**levels)
    got = [(r.id, r.leaf, tuple((s.left, s.right) for s in r.path), r.subroot, r.root) for r in merkle_manifest.manifest(docs).collect()]
    assert Counter(got) == Counter(_manifest(ROWS))


def test_manifest_of_many_groups_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "LEVELS", 1)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 8)
    monkeypatch.setattr(merkle_manifest, "SENT", 0)
    rows = [(i, "s", f"lang{i % 70}" if i % 3 else "hot", 1, f"text {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = [(r.id, r.leaf, tuple((s.left, s.right) for s in r.path), r.subroot, r.root) for r in merkle_manifest.manifest(df).collect()]
    assert Counter(got) == Counter(_manifest(rows))


def test_manifest_of_one_row_and_none(docs):
    one = merkle_manifest.manifest(docs.filter("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].path == [] and one[0].leaf == one[0].subroot == one[0].root
    assert merkle_manifest.manifest(docs.filter("doc_id = -1")).count() == 0


def test_tampering_is_seen(docs):
    m = merkle_manifest.manifest(docs, carried=F.unhex(F.sha2(F.col("text"), 256)))
    m = m.withColumns({"own": merkle_manifest.folded(F.col("leaf"), F.col("path")), "other": merkle_manifest.folded(F.lower(F.hex("carried")), F.col("path"))}).collect()
    assert all(r.own == r.root for r in m)
    assert all(r.other != r.root for r in m if r.carried is not None)
    assert {i for i in range(40) if zlib.crc32(str(i).encode()) % 3 == 0} == {r.i for r in docs.sparkSession.range(40).select(F.col("id").alias("i")).filter(F.crc32(F.col("i").cast("string").cast("binary")) % 3 == 0).collect()}


# Fill in the middle


def test_elias_fano_selects_every_place():
    rng = np.random.default_rng(3)
    for steps in ([1], [1, 2, 3, 4], [4], [1, 9, 200], [70_000]):
        for n in (1, 2, 63, 64, 65, 2000):
            values = np.concatenate([[0], np.cumsum(rng.choice(steps, n - 1))]).astype(np.int64)
            found = fill_in_middle.EliasFano(*fill_in_middle.EliasFano.packed(values)).select(np.arange(n))
            assert found.tolist() == values.tolist()
    text = "aé☃𝕏" * 700
    bits, low, high = fill_in_middle.EliasFano.packed(fill_in_middle.boundaries(text.encode()))
    assert 8 * (len(low) + len(high)) < 4 * len(text) + 128


def _cut(i, t, rate=90, first=20):
    h = [int(hashlib.sha256(f"1:{i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return i, n, "plain", None, None, t
    if h[3] % 100 < first:
        return i, n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return i, n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


@pytest.mark.parametrize("key", [fill_in_middle.by_hash, fill_in_middle.by_content])
@pytest.mark.parametrize("hot", [1, 1000])
def test_cuts_are_the_plain_ones(docs, monkeypatch, key, hot):
    """Also where a text is many entries, and where texts are grouped by their content."""
    monkeypatch.setattr(fill_in_middle, "HOT", hot)
    out = fill_in_middle.transformed(docs, key=key).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    known = [(r[0], r[4] or "") for r in ROWS if r[0] is not None]
    assert Counter(tuple(r)[:6] for r in out) == Counter(_cut(*r) for r in known)
    assert Counter((r.id, r.back) for r in out) == Counter(known)


def test_texts_that_share_a_key_are_told_apart(docs):
    with pytest.raises(Exception, match="two texts share a key"):
        fill_in_middle.transformed(docs, key=lambda t: F.length(t).cast("string").cast("binary")).collect()


def test_cuts_of_none_and_of_texts_as_ids(docs):
    assert fill_in_middle.transformed(docs.filter("doc_id = -1")).count() == 0
    named = docs.filter("doc_id = 5 AND lang = 'en'").select(F.lit("doc-5").alias("name"), "text")
    assert {tuple(r) for r in fill_in_middle.transformed(named, "name").collect()} == {_cut("doc-5", r.text or "") for r in named.collect()}


def test_batches_of_a_long_text_stay_small(spark, monkeypatch):
    monkeypatch.setattr(fill_in_middle, "BATCH_BYTES", 1000)
    rows = [(i, "long text " * 50) for i in range(200)]
    out = fill_in_middle.transformed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in out} == {_cut(*r) for r in rows}


# BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def test_every_token_and_random_texts(library):
    own, rng = bpe_prefix.loaded(BPE), random.Random(11)
    pieces = [s.decode("utf-8", "ignore") for s in own.octets.values()]
    alphabets = ["ab", "abc ", "aA1 '\n\t", "日本語テキスト ", "é́ñ𝕏☃ ", "0123456789 ", "  　x", "!?.,;-=*#", "a՘ቆ\U0003fc3f1!"]
    texts = pieces + ["".join(rng.choice(pieces) for _ in range(20)) for _ in range(2000)] + ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(0, 300))) for _ in range(2000)]
    texts += ["<|endoftext|>" * 2 + " x<|endoftext|", "a" * 50_000, "don't we'll 'tis", "\r\n  ​"]
    for text, known in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == known.ids, text
        assert own.decode(ids) == library.decode(known.ids, skip_special_tokens=False)


def test_bpe_query_equals_library(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    want = set()
    for d, e in zip(docs, library.encode_batch([d.text for d in docs], add_special_tokens=False), strict=True):
        back = library.decode(e.ids, skip_special_tokens=False)
        want.add((d.doc_id, len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert {tuple(r) for r in QUERIES["op13_bpe_prefix"](spark, sf).collect()} == want


def test_bpe_of_odd_rows(docs, library):
    both = bpe_prefix.decode(bpe_prefix.encode(docs.drop("ids"), BPE), BPE, out_col="back").select("text", "ids", "back").collect()
    assert len(both) == len(ROWS)
    assert all(r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.back == (r.text or "") for r in both)
    assert bpe_prefix.encode(docs.filter("doc_id = -1"), BPE).count() == 0
    assert bpe_prefix.loaded(BPE).decode(np.array([999_999, 64], "<u4").tobytes()) == library.decode([64])


def test_bpe_remembers_within_bounds(monkeypatch, library):
    monkeypatch.setattr(bpe_prefix, "TABLE_BYTES", 2000)
    monkeypatch.setattr(bpe_prefix, "PAIRS", 10)
    own = bpe_prefix.Bpe(BPE)
    text = " ".join(f"word{i} {i * i} naïve" for i in range(500))
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text).ids and len(own.table) < 20 and len(own.pairs) <= 10


def test_merges_without_a_made_token_and_ties(tmp_path):
    """A small vocabulary with runs of one letter, and one whose merge can't be followed."""
    letters = {b: c for c, b in bpe_prefix.byte_letters().items()}
    vocab = {letters[b]: b for b in range(256)}
    merges = [("a", "a"), ("b", "a"), ("aa", "a"), ("aa", "aa"), ("b", "aa"), ("a", "b")]
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    with open(BPE, encoding="utf-8") as f:
        told = json.load(f)
    told["model"] |= {"vocab": vocab, "merges": [list(m) for m in merges]}
    told["added_tokens"] = []
    path = tmp_path / "small.json"
    path.write_text(json.dumps(told))
    own, known, rng = bpe_prefix.Bpe(str(path)), Tokenizer.from_file(str(path)), random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choices("aab ", k=rng.randint(0, 14)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == known.encode(text).ids, text
    told["model"]["merges"] = [["aa", "b"], ["a", "a"]]
    told["model"]["vocab"]["aab"] = len(vocab)
    path.write_text(json.dumps(told))
    with pytest.raises(ValueError, match="before the merge"):
        bpe_prefix.Bpe(str(path))
    told["model"]["byte_fallback"] = True
    path.write_text(json.dumps(told))
    with pytest.raises(ValueError, match="option"):
        bpe_prefix.Bpe(str(path))
