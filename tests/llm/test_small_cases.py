"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import itertools
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import alike_sets, flow_reshard, fst_sentencepiece, hilbert_pack, kneser_ney, lz_fingerprint, pruned_graph_ann, simhash_tiles, skip_chain_pii, tag_path_html, warc_zip

BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Columns whose names operators use inside.
CLASH = "bucket int, key long, shard string, slot string, fp string, lang string, source string, n_chars long, " + ", ".join(
    f"{c} string" for c in "_id _hash _size _old _block _crc _at _bases _mid _rn _shard _row _text_hash text_hash kept_id kept_hash root component_id z ids n part _pii _base _spans bits threshold keep good place query_id rank score _d at file sk".split()
)
N_CLASH = CLASH.count(",") + 1
ROWS = [
    (5, "The quick brown fox, jumps over the lazy dog. Mail a.b@example.com now"),
    (3, None),
    (9, ""),
    (4, "The quick brown fox, jumps over the lazy dog. Mail a.b@example.com now"),
    (4, "The quick brown fox, jumps over the lazy dog. Mail a.b@example.com now"),
    (None, "no id"),
    (7, "   \t\n "),
    (8, "été " * 30_000),
    (2, "a <|endoftext|> b<|endoftext|><|endoftext|>\n<|endof text|> é<|endoftext|>x"),
    (6, "naïve 𝕏 ☃ words\n\n  and  +1 (555) 010-9999, 10.0.0.255 or 4111 1111 1111 1111"),
]


@pytest.fixture(scope="module")
def docs(spark):
    extra = (1, 2, "x", "y", "z", "en", "s", 0, *["w"] * (N_CLASH - 8))
    return spark.createDataFrame([(i, t, *extra) for i, t in ROWS], f"doc_id long, text string, {CLASH}")


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("doc_id = -1")


KNOWN = [(i, t or "") for i, t in ROWS if i is not None]


def test_lz_chain(docs, none):
    got = sorted(map(tuple, lz_fingerprint.edit_chain(docs).collect()))
    order = sorted(KNOWN, key=lambda r: (-r[0], r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, changed, follows = (np.frombuffer(bytes.fromhex(lz_fingerprint.fingerprint(x)), ">u2") for x in (t, edited, after))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), lz_fingerprint.fingerprint(t), lz_fingerprint.fingerprint(edited), float((own == changed).mean()), float((own == follows).mean())))
    assert got == sorted(want)
    assert lz_fingerprint.edit_chain(none).count() == 0
    assert lz_fingerprint.with_fingerprints(docs).count() == len(ROWS)


def plain_lz(text):
    """Fingerprint by the definition in whole numbers: phrases by slices, polynomial hashes, the smallest of each slot."""
    known, start, end = set(), 0, 1
    while end <= len(text):
        if text[start:end] in known:
            end += 1
        else:
            known.add(text[start:end])
            start, end = end, end + 1
    whole = (1 << 64) - 1
    slots = [None] * 64
    for phrase in known:
        h = (sum((ord(c) + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(phrase)) + len(phrase)) & whole
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> shift)) * factor & whole
        h ^= h >> 31
        slot, rest = h >> 58, h >> 42 & 0xFFFF
        slots[slot] = rest if slots[slot] is None else min(slots[slot], rest)
    if not known:
        return "ffff" * 64
    lent = []
    for i in range(64):
        far = next(d for d in range(64) if slots[(i + d) % 64] is not None)
        lent.append((slots[(i + far) % 64] + far * 0x9E37) & 0xFFFF)
    return "".join(f"{x:04x}" for x in lent)


def test_lz_query_equals_plain_numbers(spark, tmp_path):
    """The registered query over a small table, its fingerprints and likeness from a parse of its own."""
    pick = np.random.default_rng(3)
    texts = [None, "", "a", "aaaaaaa", "ab" * 200, "é𝕏" * 50] + ["".join(pick.choice(list("ab cé\n"), int(n))) for n in pick.integers(1, 900, 14)]
    spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in lz_fingerprint.op10_lz_fingerprint(spark, str(tmp_path)).collect()}
    clean = [t or "" for t in texts]
    share = lambda a, b: sum(a[k : k + 4] == b[k : k + 4] for k in range(0, 256, 4)) / 64
    for i, t in enumerate(clean):
        other, half = clean[i - 1], len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        own, changed = plain_lz(t), plain_lz(edited)
        want = (len(t), hashlib.sha256(edited.encode()).hexdigest(), own, changed, share(own, changed), share(own, plain_lz(other)))
        assert tuple(got[i * 3])[1:] == want
    assert len(got) == len(texts)


def test_lz_likeness_follows_jaccard():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    a = " ".join(rng.choice(words, 2000))
    b = a[:6000] + " ".join(rng.choice(words, 1000))

    def phrases(t):
        found = {}
        lz_fingerprint.parse(found, "", t)
        return set(found)

    exact = len(phrases(a) & phrases(b)) / len(phrases(a) | phrases(b))
    sign = lambda t: np.frombuffer(bytes.fromhex(lz_fingerprint.fingerprint(t)), ">u2")
    assert abs(lz_fingerprint.likeness(sign(a), sign(b)) - exact) < 0.2


def test_flow_is_least_and_layout_even(docs, none, tmp_path, spark):
    for sizes, room in (([10, 0, 5], [5, 5, 5]), ([7, 7, 1, 0], [4, 4, 4, 3]), ([100], [50, 50])):
        flow = flow_reshard.min_cost_flow(sizes, room, lambda i, j: int(i != j))
        assert all(sum(v for (a, _), v in flow.items() if a == i) == s for i, s in enumerate(sizes))
        stay = sum(min(s, r) for s, r in zip(sizes, room, strict=False))
        assert sum(v for (i, j), v in flow.items() if i != j) == sum(sizes) - stay
    layout, _ = flow_reshard.rewrite(docs, flow_reshard.by_source(4), str(tmp_path / "a"), 4, 64)
    assert sorted(layout.columns) == sorted(docs.columns)
    rows = layout.collect()
    assert all(r["_size"] == r["_rn"] == r["_row"] == "w" for r in rows)
    assert sorted((r.doc_id, r.text or "") for r in rows) == sorted(KNOWN)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    many = spark.range(2000).selectExpr("id AS doc_id", "repeat('x', cast(id % 50 as int)) AS text", "IF(id % 3 = 0, 'hot', cast(id % 7 as string)) AS source")
    layout, _ = flow_reshard.rewrite(many, flow_reshard.by_source(6), str(tmp_path / "b"), 6, 500)
    sizes = {r["shard"]: r["b"] for r in layout.groupBy("shard").agg({"text": "count"}).withColumnRenamed("count(text)", "b").collect()}
    by_bytes = Counter()
    for r in layout.collect():
        by_bytes[r["shard"]] += len(r["text"]) + 8
    assert len(sizes) == 6 and max(by_bytes.values()) - min(by_bytes.values()) < 600
    assert flow_reshard.assign(none, flow_reshard.by_source())[0].count() == 0


def test_shards_grow_with_rows_alone():
    assert [pruned_graph_ann.shards_of(n) for n in (0, 1, 5000, 5001, 50_000, 5_000_000, 20_000_000, 10**9)] == [1, 1, 1, 2, 10, 1000, 1000, 50_000]
    counts = [pruned_graph_ann.shards_of(n) for n in range(0, 40_000_000, 99_991)]
    assert counts == sorted(counts)
    assert pruned_graph_ann.shards_of(1400, 700) == 2


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/é\n", "<p>x</p>"), (2, None, None), (3, "http://b", "<p>x</p>"), (4, "", ""), (4, "", ""), (None, "u", "v"), (5, "http://c", "é" * 200_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    archives = warc_zip.write_archives(pages, f"file://{tmp_path}/w")
    got = {}
    for r in warc_zip.read_records(archives).collect():
        got.setdefault(r.page_id, []).append(r)
    assert {k: len(v) for k, v in got.items()} == {1: 1, 2: 1, 3: 1, 4: 2, 5: 1}
    for i, _, html in rows:
        if i is not None:
            data = (html or "").encode()
            for r in got[i]:
                assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
                assert (r.payload is None) == (r.record_type == "revisit") and (r.payload is None or bytes(r.payload) == data)
    assert got[1][0].record_type == "revisit" and got[1][0].refers_to == 3 and got[2][0].refers_to == 4
    assert warc_zip.read_records(warc_zip.write_archives(pages.filter("page_id = -1"), f"file://{tmp_path}/e")).count() == 0


def test_zip64_directory(tmp_path, monkeypatch):
    import zipfile

    from pyarrow import fs

    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    path = tmp_path / "z.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("first", b"a" * 100)
        z.writestr("second", b"b" * 50)
        z.writestr(zipfile.ZipInfo("packed"), b"c" * 99, zipfile.ZIP_DEFLATED)
    assert b"PK\x06\x06" in path.read_bytes()
    with fs.LocalFileSystem().open_input_file(str(path)) as file:
        members = warc_zip.directory(file)
        assert {k: m["size"] for k, m in members.items()} == {"first": 100, "second": 50, "packed": 99}
        file.seek(warc_zip.start_of(file, members["second"]))
        assert file.read(50) == b"b" * 50
        with pytest.raises(ValueError):
            warc_zip.start_of(file, members["packed"])


def test_simhash_against_brute_force(docs, none):
    def fingerprint(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64(x.encode(), 42).intdigest() for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = {(i, fingerprint(t)) for i, t in KNOWN}
    root = {r: r[0] for r in rows}
    for _ in rows:
        for a in rows:
            for b in rows:
                if (a[1] ^ b[1]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    got = {(r.doc_id, int(r.fingerprint, 16)): r.component_id for r in simhash_tiles.near_duplicates(docs).collect()}
    assert got == root and simhash_tiles.near_duplicates(docs).count() == len(KNOWN)
    assert simhash_tiles.near_duplicates(none).count() == 0


def test_simhash_long_chain(spark):
    edges = [(i.to_bytes(4), (i + 1).to_bytes(4)) for i in range(200)] + [((1000).to_bytes(4), (900).to_bytes(4))]
    roots = {int.from_bytes(r.node): int.from_bytes(r.root) for r in simhash_tiles.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert roots == {**dict.fromkeys(range(201), 0), 1000: 900, 900: 900}


def test_keep_one(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(3000)]
    bases = [list(rng.choice(words, 300)) for _ in range(30)]
    rows = [(i, " ".join(b)) for i, b in enumerate(bases)]
    for i, b in enumerate(bases[:10]):
        near = list(b)
        for k in rng.choice(300, 3, replace=False):
            near[k] = "changed"
        rows += [(100 + i, " ".join(near)), (200 + i, " ".join(b)), (200 + i, " ".join(b))]
    kept = simhash_tiles.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(30)) and kept.columns == ["doc_id", "text"]


def test_keep_one_repeated_ids(docs, none, spark):
    """Near texts of one id are a group; other texts of that id are another."""
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(1, near), (1, near + " more"), (1, "quite another text with words of its own that nobody shares at all"), (2, near), (1, near)]
    kept = sorted(map(tuple, simhash_tiles.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert len(kept) == 2 and [r[0] for r in kept] == [1, 1] and len({r[1] for r in kept} & {near, near + " more"}) == 1
    kept = simhash_tiles.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6, 8]
    assert simhash_tiles.keep_one(none).count() == 0


def test_keep_one_is_exact(spark):
    """Pairs just above and below a likeness of 0.8, short texts, and a passage that one copy repeats."""
    rng = np.random.default_rng(5)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    rows = []
    for i in range(240):
        base = fresh(9 if i % 4 == 0 else int(rng.integers(10, 300)))
        if i % 4 == 0:
            other = base[:-1] if i % 8 else base[:-2]  # 4 of 5 shingles, or 3
        elif i % 4 == 1:
            other = base + base[:8] * 20  # few shingles more, counted often
        else:
            shingles, other = len(base) - 4, list(base)
            cut = max(1, round(shingles * rng.uniform(0.1, 0.13)))
            other[-cut:] = fresh(cut)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    likeness = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 480, 2)]
    assert sum(0.75 < x < 0.8 for x in likeness) > 20 and sum(0.8 <= x < 0.85 for x in likeness) > 40
    kept = simhash_tiles.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == set(range(0, 480, 2)) | {2 * i + 1 for i, x in enumerate(likeness) if x < 0.8}


def test_keep_one_misses_no_pair(spark):
    """Four shingles of five, whose fingerprints of 128 bits differ in 43 to 46."""
    text = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [(10 * i + n, text(i, n)) for i in (6332, 30278, 67602, 97903, 140651) for n in (8, 9)]
    kept = simhash_tiles.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [x[0] for x in rows[::2]]


def test_alike_sets_compare_few(spark, tmp_path):
    """Two large groups of near copies and unlike texts with a passage in common: the links join what all pairs would, by few candidates."""
    rng = np.random.default_rng(11)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    passage, texts = fresh(30), []
    for base in (fresh(80), fresh(80)):
        for _ in range(150):
            near = list(base)
            near[rng.integers(80)] = fresh(1)[0]
            texts.append(near)
    texts += [fresh(40) + passage for _ in range(300)]
    sets = [alike_sets.shingles(" ".join(t)) for t in texts]
    assert all(len(x) == len({tuple(t[k : k + 5]) for k in range(len(t) - 4)}) for x, t in zip(sets, texts, strict=True))
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string").coalesce(1)
    found = rows.mapInPandas(alike_sets.with_sets(f"file://{tmp_path}/sets"), f"id long, fp binary, {alike_sets.PLACE}")
    found.write.parquet(f"{tmp_path}/prints")
    links = alike_sets.links(spark.read.parquet(f"{tmp_path}/prints"), f"file://{tmp_path}", f"file://{tmp_path}/sets", simhash_tiles.components)
    roots = {r.node: r.root for r in simhash_tiles.components(links).collect()}

    def joined(label):
        groups = {}
        for i in range(len(texts)):
            groups.setdefault(label(i), set()).add(i)
        return sorted(map(sorted, groups.values()))

    own = list(range(len(texts)))
    for i in range(300):
        for j in range(i):
            if own[i] != own[j] and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])):
                own = [own[j] if x == own[i] else x for x in own]
    assert len(set(own)) == 302 and joined(lambda i: roots.get(i, i)) == joined(lambda i: own[i])
    candidates = spark.read.parquet(f"{tmp_path}/lists").filter("list = -1").select("a", "b").distinct().count()
    assert candidates < 20 * len(texts)


def test_alike_sets_long_list_of_any_part():
    """A long list in a part of a high number, as of large tables, is held against texts of its own."""
    rows = alike_sets.pd.DataFrame({"part": [9_999_999], "base": [0], "shingle": [np.full(100, 2**32 - 1, "<u4").tobytes()], "text": [alike_sets._planes(np.diff(np.arange(100), prepend=0))], "n": [alike_sets._planes(np.full(100, 50))], "place": [alike_sets._planes(np.zeros(100))]})
    found = alike_sets._lists(rows)
    assert (found.list == (9_999_999 << 32) + 2**32 - 1).sum() == 100 and (found.list == -1).sum() == 99 + 98 + 97 + 96


def test_html_blocks():
    main = tag_path_html.main_text
    assert main(None) == main("") == main("  \n") == main("<p></p><script>x</script>") == ""
    assert main("only text &amp; more") == "only text & more"
    page = """<html><head><title>t</title></head><body><header><h2>Site</h2></header><nav>menu</nav><div class="cookie-notice">We use cookies, really.</div>
      <div id=content><h1>Head</h1><p>First, a long paragraph with much text, indeed.<p>Second\n one &lt;b&gt;, also long enough, as it is.<br>more</div>
      <div class="sidebar"><p>Side text, which is long, too, and has commas, many.</p></div><form><p>Your mail?</p></form>
      <section id="comments"><p>A reader says, with many words, that this is nice, very nice.</p></section><footer>&copy; x</footer></body>"""
    assert main(page) == "Head\nFirst, a long paragraph with much text, indeed.\nSecond one <b>, also long enough, as it is. more"
    assert main("<nav>" + "menu, " * 500 + "</nav><article><p>Hi.</p></article>") == "Hi."


def test_html_drops_nothing_else():
    story = "<p>A first paragraph, long enough to be the story, with commas.</p>"
    for tag, attributes in (("article", 'style="overflow:hidden"'), ("div", 'class="overflow-hidden"'), ("body", "style='overflow-x:hidden'"), ("div", 'data-title="not hidden"'), ("section", 'id="related-work"'), ("div", 'id="share-prices"')):
        assert "A first paragraph" in tag_path_html.main_text(f"<html><{tag} {attributes}>{story}</{tag}></html>"), attributes
    page = f'<article>{story}<h2 id="share-prices">Share prices</h2>{story}<section id="search"><h2 id="search">Search</h2>{story}</section></article>'
    assert {"Share prices", "Search"} < set(tag_path_html.main_text(page).split("\n"))
    for attributes in ("hidden", 'hidden=""', "HIDDEN id=x", 'class="big hidden"', 'aria-hidden="true"', 'style="display: none"', 'style="visibility:hidden"', 'class="ad"', 'class="cookie-banner"', 'role="navigation"', 'id="comments"'):
        assert "Other" not in tag_path_html.main_text(f"<body>{story}<div {attributes}><p>Other text, that is not of it.</p></div>{story}</body>"), attributes


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "<article>a</article>", "x"), (2, None, "<article>a</article>", "x")], "page_id long, url string, html string, text string")
    assert [r.text for r in tag_path_html.extract(pages).orderBy("page_id").collect()] == ["", "a", "a"]
    assert tag_path_html.extract(pages.filter("page_id = 9")).count() == 0


def _plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
        if 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_pii_rules():
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("a@.1-+( )25é"), 60)) for _ in range(4000)] + [t for _, t in KNOWN] + ["a@b.c@d.e", "x@@y.zz", "00000255.1.1.1 256.1.1.1", "9" * 5000 + ".1.1.1"[:0]]
    for t in texts:
        assert skip_chain_pii.base_spans(t) == _plain_spans(t), t


def test_pii_field_adds_repeats(docs, none, spark):
    rows = [(i, f"word {i} call +1 (555) 010-{1000 + i} or write to some.{i}@mail.example.com from 10.0.0.{i} and 2026 others {i * 7919}") for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    field = skip_chain_pii.train(table)
    text = "Call +1 (555) 010-1234 now. Later call 555-010-1234 again; mail the.65@mail7.example.com or the.65@mail7 in 2026."
    base, spans = skip_chain_pii.find(text, field)
    added = {text[a:b] for k, a, b in spans if (k, a, b) not in base}
    assert set(base) <= set(spans) and "the.65@mail7" in added and "2026" not in added
    tagged = skip_chain_pii.tag(docs, skip_chain_pii.train(docs)).collect()
    assert [r["_base"] for r in tagged] == [skip_chain_pii.joined(_plain_spans(t or "")) for _, t in ROWS]
    assert skip_chain_pii.train(none) is None and skip_chain_pii.tag(none, None).count() == 0
    clean = skip_chain_pii.redact(docs, None).filter("doc_id = 6").first().text
    assert clean == "naïve 𝕏 ☃ words\n\n  and  <phone>, <ip> or <card>"
    assert skip_chain_pii.redact(docs, None).filter("doc_id = 3").first().text is None


def test_pii_field_reaches_far_mentions():
    size = len(skip_chain_pii.LABELS)
    field = skip_chain_pii.Field({}, np.eye(size)[0] * 0.5, np.zeros((size, size)), 5 * np.eye(size))
    variants = " ".join(f"then the.65@mail{k} came" for k in range(7, 57))
    for text in (f"mail the.65@mail7.example.com first {variants}", f"first {variants} mail the.65@mail7.example.com"):
        base, spans = skip_chain_pii.find(text, field)
        assert len(base) == 1 and len(spans) == 51


def test_pii_joins_words_that_no_rule_takes_together(docs, spark):
    """A phone number that runs into an address fails its rule; the field finds its words and joins them."""
    rows = [(i, f"call +1 (555) 010-{1000 + i} or ring +1 ({200 + i}) 555-{4000 + i} now, from 10.0.0.{i} in {2000 + i}") for i in range(200)]
    field = skip_chain_pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    text = "Des +1 (843) 555-7672 170.106.47.218 Et in 2026, 17 of 19."
    base, spans = skip_chain_pii.find(text, field)
    assert [text[a:b] for _, a, b in base] == ["170.106.47.218"]
    assert [(k, text[a:b]) for k, a, b in spans if (k, a, b) not in base] == [("phone", "+1 (843) 555-7672")]


def _exact(score, pairs):
    """Marginals by enumeration; pairs are (i, j, potential)."""
    n, size = score.shape
    total = np.zeros((n, size))
    for labels in itertools.product(range(size), repeat=n):
        w = np.exp(sum(score[i, x] for i, x in enumerate(labels)) + sum(p[labels[i], labels[j]] for i, j, p in pairs))
        for i, x in enumerate(labels):
            total[i, x] += w
    return total / total.sum(axis=1, keepdims=True)


def test_pii_marginals_against_enumeration():
    """Equal on chains and trees of skips; close where edges close loops."""
    rng = np.random.default_rng(14)
    size = len(skip_chain_pii.LABELS)
    none = np.zeros(size)
    for trial in range(40):
        n = 6
        unary = {f"f{i}": rng.normal(0, 1.5, size) for i in range(n)}
        chain = [(0, 1), (1, 2), (3, 4)] if trial % 2 else [(i, i + 1) for i in range(n - 1)]
        skips = [(2, 3), (1, 5)] if trial % 2 else [(0, 3), (2, 5)]
        field = skip_chain_pii.Field(unary, rng.normal(0, 0.5, size), rng.normal(0, 0.5, (size, size)), rng.normal(0, 0.3, (size, size)) + np.eye(size))
        known = [0, 0, 0, 0, 2, 0] if trial % 3 == 0 else [0] * n
        if trial % 4 == 0:
            skips = []
        got = field.marginals([[f"f{i}"] for i in range(n)], chain, skips, known)
        score = np.array([field.prior + unary.get(f"f{i}", none) for i in range(n)])
        for i, k in enumerate(known):
            if k:
                score[i] = np.where(np.arange(size) == k, 0, -50)
        want = _exact(score, [(i, j, field.chain) for i, j in chain] + [(i, j, field.skip) for i, j in skips])
        tree = trial % 2 or not skips
        assert np.abs(got - want).max() < (5e-3 if tree else 0.1), trial


def test_pii_time_grows_with_the_text():
    size = len(skip_chain_pii.LABELS)
    field = skip_chain_pii.Field({}, np.eye(size)[0], np.zeros((size, size)), np.eye(size))
    for text in ("a" * 500_000 + "1" + "b" * 500_000, "1" * 1_000_000, "1.1.1." * 150_000, "+1 2(3" * 80_000, "a@" * 300_000, " ".join(f"a{i}@b{i}.com" for i in range(8000)), "x" * 900_000 + "@@@@ 1", "é" * 1_000_000 + "1"):
        began = time.process_time()
        skip_chain_pii.find(text, field)
        assert time.process_time() - began < 5, text[:20]


def test_pii_field_works_without_evidence():
    """Two mentions of one malformed address, and no base span in the text."""
    size = len(skip_chain_pii.LABELS)
    field = skip_chain_pii.Field({"at=1.0": np.eye(size)[1] * 3.0}, np.eye(size)[0] * 0.5, np.zeros((size, size)), 3 * np.eye(size))
    text = "write to jo@mail or else to jo@mail2 soon; room 12"
    base, spans = skip_chain_pii.find(text, field)
    assert base == [] and [text[a:b] for _, a, b in spans] == ["jo@mail", "jo@mail2"]
    assert skip_chain_pii.find("write to jo@mail", field)[1] == []


def test_sentencepiece_equals_the_library(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list(" \n  abcdeéth☃𝕏0129.,;▁\t"), 50)) for _ in range(500)] + [t for _, t in KNOWN]
    t = fst_sentencepiece.compiled(SP)
    for x in texts:
        ids = t.encode(x).tolist()
        assert ids == sp.encode(x) and t.decode(np.array(ids, np.int64)) == sp.decode(ids)
    both = fst_sentencepiece.decode(fst_sentencepiece.encode(docs, SP), SP, out_col="back").collect()
    assert [r.back for r in both] == [r.text or "" for r in both]
    assert fst_sentencepiece.digests(none, SP).count() == 0


def _proto(field: int, value: bytes | int) -> bytes:
    """One field of a protocol-buffer message."""

    def number(v: int) -> bytes:
        out = b""
        while v > 127:
            out, v = out + bytes([v & 127 | 128]), v >> 7
        return out + bytes([v])

    return number(field << 3) + number(value) if isinstance(value, int) else number(field << 3 | 2) + number(len(value)) + value


def _model(path, kind: int, rule: str) -> str:
    """The model at hand with the library's character rules; as a unigram model with weights by id."""
    import sentencepiece

    out = b""
    with open(SP, "rb") as file:
        parts = list(fst_sentencepiece._fields(file.read()))
    for i, value in enumerate(v for k, v in parts if k == 1):
        x = dict(fst_sentencepiece._fields(value))
        score = x[2] if kind == 2 else np.float32(-3 - (i * 7919 % 1009) / 128).tobytes()
        out += _proto(1, _proto(1, x[1]) + b"\x15" + score + _proto(3, x.get(3, 1)))
    out += _proto(2, _proto(3, kind) + _proto(35, 1))
    out += _proto(3, sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec() + _proto(3, 1) + _proto(4, 1) + _proto(5, 1))
    path.write_bytes(out)
    return str(path)


@pytest.mark.parametrize(("kind", "rule"), [(2, "nmt_nfkc"), (2, "nmt_nfkc_cf"), (1, "nmt_nfkc"), (1, "identity")])
def test_sentencepiece_character_rules_and_unigram(tmp_path, kind, rule):
    import sentencepiece

    path = _model(tmp_path / "m.model", kind, rule)
    sp, t = sentencepiece.SentencePieceProcessor(model_file=path), fst_sentencepiece.Transducer(path)
    rng = np.random.default_rng(3)
    chars = [*" \n  abcdeÉth☃𝕏0129.,;\t ​½ﬁ㍿Ｈｶﾞßİ한각", "e\u0301", "\u0308", "the ", "ing", "\x01"]
    for x in ["".join(rng.choice(chars, rng.integers(0, 40))) for _ in range(1500)] + ["", " ", "\x01", "▁", "a▁ "]:
        ids = t.encode(x).tolist()
        assert ids == sp.encode(x), x
        assert t.decode(np.array(ids, np.int64)) == sp.decode(ids), x


def test_sentencepiece_refuses_other_models(tmp_path):
    with open(SP, "rb") as file:
        whole = file.read()
    for extra in (_proto(1, _proto(1, b"mine") + _proto(3, 4)), _proto(2, _proto(3, 4)), _proto(3, _proto(5, 0))):
        (tmp_path / "m.model").write_bytes(extra + whole if extra[0] >> 3 > 1 else whole + extra)
        with pytest.raises(ValueError):
            fst_sentencepiece.Transducer(str(tmp_path / "m.model"))
    (tmp_path / "m.model").write_bytes(_proto(1, _proto(1, b"a")))
    with pytest.raises(ValueError):
        fst_sentencepiece.Transducer(str(tmp_path / "m.model"))


def test_hilbert_curve_and_packing(docs, none):
    points = np.array(list(itertools.product(range(8), repeat=3)))
    walk = points[np.argsort(hilbert_pack.hilbert_key(points, 3))]
    assert set(np.abs(np.diff(walk, axis=0)).sum(axis=1)) == {1}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    rows = hilbert_pack.pack(docs, BPE, 64).collect()
    for i, t in set(KNOWN):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        copies = sum(k == i for k, _ in KNOWN)
        cover = Counter()
        for r in pieces:
            assert r.ids == ids[r.start : r.start + r.length] and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            cover.update(range(r.start, r.start + r.length))
        assert cover == dict.fromkeys(range(len(ids)), copies)
    for s in {r.sequence_id for r in rows}:
        own = sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset)
        size = sum(r.length for r in own)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
        assert size <= 64 and size & (size - 1) == 0
    assert hilbert_pack.pack(none, BPE).count() == 0


def test_pieces_equal_whole_texts(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list(" \n  abcdeéth☃0129.,'s\t\x1c　"), 60)) for _ in range(1500)]
    texts += ["".join(rng.choice(["<|endoftext|>", "<|end", "oftext|>", " ", "\n", "a", "é.", "1"], 12)) for _ in range(800)]
    texts += ["x" * 100_000, "é1" * 30_000 + " <|endoftext|>"]
    from tokenizers import Tokenizer

    p = hilbert_pack.Pieces(BPE)
    monkeypatch.setattr(hilbert_pack, "CACHE_BYTES", 20_000)
    assert [p.encode(t).tolist() for t in texts] == [e.ids for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    assert p.held <= 20_000 + 300 and max(map(len, [*p.first, *p.later])) <= hilbert_pack.LONGEST


def _kneser_ney(train, text):
    """Perplexity bits of text by the definition, with counts in dictionaries, for characters below 2045."""
    n = kneser_ney.ORDER
    pad = lambda t: [1] * (n - 1) + [ord(c) + 3 for c in t] + [2]
    top = Counter(tuple(x[i - n + 1 : i + 1]) for x in map(pad, train) for i in range(n - 1, len(x)))
    tables = {n: top}
    for k in range(n - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in {h[-(k + 1) :] for h in top})
    bits = 0.0
    x = pad(text)
    for i in range(n - 1, len(x)):
        p = 1 / 4096
        for k in range(1, n + 1):
            g = tuple(x[i - k + 1 : i + 1])
            t = tables[k]
            d = kneser_ney.discounts(np.array(list(t.values())))
            own = {h: c for h, c in t.items() if h[:-1] == g[:-1]}
            total = sum(own.values())
            if total:
                c = own.get(g, 0)
                p = max(c - d[min(c, 3)], 0) / total * (c > 0) + sum(d[min(v, 3)] for v in own.values()) / total * p
        bits -= np.log2(p)
    return bits


def test_kneser_ney_against_definition(spark):
    train = ["abcab abd", "the cat sat", "", "aaaa", "abcab abd"]
    rows = [(i, "en", t) for i, t in enumerate(train)] + [(10, None, "abc sat"), (11, "de", None), (12, "en", "zzz q"), (None, "en", "abc")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(5)] + [(10, 0), (12, None), (None, 1)], "doc_id long, quality int")
    for bucket_bytes, group in ((kneser_ney.BUCKET_BYTES, kneser_ney.GROUP), (6, 1024), (6, 3)):
        got = {r.doc_id: (r.n, r.bits) for r in kneser_ney.scores(docs, kneser_ney.trusted_ids(labels), bucket_bytes, group).collect()}
        assert set(got) == {0, 1, 2, 3, 4, 10, 11, 12}
        for i, _, t in rows[:-1]:
            assert got[i][0] == len(t or "") + 1 and got[i][1] == pytest.approx(_kneser_ney(train, t or ""), rel=1e-5)
    folds = {r.text: r.fold for r in docs.select("text", F.pmod(F.xxhash64("text"), F.lit(kneser_ney.FOLDS)).alias("fold")).collect()}
    held = {r.doc_id: r.held_bits for r in kneser_ney.scores(docs, kneser_ney.trusted_ids(labels), 6, 3).collect()}
    for i, t in enumerate(train):
        assert held[i] == pytest.approx(_kneser_ney([x for x in train if folds[x] != folds[t]], t), rel=1e-5)
    assert all(held[i] is None for i in (10, 11, 12))


def test_kneser_ney_does_not_depend_on_the_dealing(spark, sf):
    docs, trusted = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    trusted = kneser_ney.trusted_ids(trusted)
    one, many = ({(r.doc_id, r.text_hash): (r.bits, r.held_bits) for r in kneser_ney.scores(docs, trusted, *how).collect()} for how in ((1 << 30, 1024), (1 << 15, 5)))
    assert one.keys() == many.keys()
    for k, (bits, held) in one.items():
        assert many[k] == (pytest.approx(bits, rel=1e-6), held if held is None else pytest.approx(held, rel=1e-6))


def test_kneser_ney_decisions(docs, none, spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(200)]
    rows = [(i, ["en", "fr"][i % 2], " ".join(rng.choice(words, 80))) for i in range(300)] + [(1000 + i, "en", "".join(rng.choice(list("!$%&XYZ0123 "), 300))) for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 300, 3)], "doc_id long, quality int")
    kept = {r.doc_id for r in kneser_ney.keep_good(table, labels).collect()}
    assert kept == set(range(300))
    nobody = labels.filter("quality = 0")
    assert kneser_ney.keep_good(docs, nobody).count() == len(KNOWN)
    assert kneser_ney.keep_good(none, labels).count() == 0


def test_kneser_ney_rare_languages(spark):
    """Clean text stays in a language with three trusted documents and in one with none; noise in a common one goes."""
    rng = np.random.default_rng(9)
    texts = {}
    for lang, letters, n in (("en", "abcdefghijklmnop", 200), ("el", "αβγδεζηθικλμνξοπρστυφχψω", 40), ("zh", "的一是不了人我在有他这中大来上国", 20)):
        words = ["".join(rng.choice(list(letters), 5)) for _ in range(400)]
        texts[lang] = [" ".join(rng.choice(words, 40)) for _ in range(n)]
    rows = [(1000 * k + i, lang, t) for k, lang in enumerate(texts) for i, t in enumerate(texts[lang])]
    noise = [(5000 + i, "en", "".join(rng.choice(list("!$%&XYZ0123#"), 300))) for i in range(10)]
    labels = spark.createDataFrame([(i, 1) for i in [*range(100), 1000, 1001, 1002]], "doc_id long, quality int")
    docs = spark.createDataFrame(rows + noise, "doc_id long, lang string, text string")
    assert {r.doc_id for r in kneser_ney.keep_good(docs, labels).collect()} == {r[0] for r in rows}


def test_ann_recall_and_exact_scores(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[500:1500] = x[500]  # a third of all rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [1.0, None]), (5400, [1.0, 2.0]), (None, [1.0] * 16), (0, x[0].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = pruned_graph_ann.build_index(table, shard_rows=700)
    got = {}
    for r in pruned_graph_ann.nearest(index, table.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r["rank"]))
    y = x.astype(np.float64)
    hits = total = 0
    for q in range(0, 3000, 100):
        far = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        want = [v for _, v in sorted((d, v) for v, d in enumerate(far) if v != q)[:10]]
        assert [r for _, _, r in got[q]] == list(range(1, 11))
        assert all(s == pytest.approx(far[v], rel=1e-12) for v, s, _ in got[q])
        hits += len(set(want) & {v for v, _, _ in got[q]})
        total += 10
    assert hits / total >= 0.95 and set(got) == set(range(0, 3000, 100))
    assert got[500] and [v for v, _, _ in got[500]] == list(range(501, 511))
    few = table.filter("vec_id in (1, 2, 100)")
    assert pruned_graph_ann.nearest(pruned_graph_ann.build_index(few), few.filter("vec_id = 100")).count() == 2
    empty = table.filter("vec_id = -1")
    assert pruned_graph_ann.nearest(pruned_graph_ann.build_index(empty), empty).count() == 0
