"""Tag-path ratios against a plain computation over the standard library's parser."""

import math
import re
import time
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq

from ledgerloom.llm import tag_path_html as T


class Tree(HTMLParser):
    """Blocks of well-formed pages, as (elements from the root, text)."""

    def __init__(self):
        super().__init__()
        self.stack, self.blocks, self.text, self.n = [], [], [], 0

    def flush(self):
        joined = re.sub(r"\s+", " ", "".join(self.text)).strip()
        self.text = []
        if joined:
            self.blocks.append((tuple(self.stack), joined))

    def handle_starttag(self, tag, attrs):
        if tag in T.BLOCK:
            self.flush()
            if tag == "p" and self.stack and self.stack[-1][0] == "p":
                self.stack.pop()
            bad = tag in T.BOILERPLATE or bool(set(re.findall("[a-z]+", dict(attrs).get("class") or "")) & T.MARKS)
            self.n += 1
            self.stack.append((tag, bad, self.n))
        elif tag in ("script", "style", "title"):
            self.flush()
            self.stack.append((tag, True, -1))
        elif tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.stack):
            if tag in ("script", "style", "title"):
                self.text = []
            self.flush()
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.text.append(data)


def plain(page):
    """The text by the definition, path by path."""
    tree = Tree()
    tree.feed(page)
    tree.close()
    tree.flush()
    path = lambda stack: tuple((t, b) for t, b, _ in stack)

    def holder(p):
        p = list(p)
        while p and p[-1][0] in T.FLOW and not p[-1][1]:
            p.pop()
        return tuple(p)

    order = list(dict.fromkeys(path(s) for s, _ in tree.blocks))
    texts = {p: [t for s, t in tree.blocks if path(s) == p] for p in order}
    length = [sum(map(len, texts[p])) / len(texts[p]) for p in order]
    marks = [(sum(c in ",.;:!?¡¿、。，" for t in texts[p] for c in t) + 1) / len(texts[p]) for p in order]

    def smooth(x, i):
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(order) and holder(order[j]) == holder(order[i])]
        return (x[i] + sum(x[j] for j in near) / 2) / (1 + len(near) / 2)

    score = {p: 0.0 if any(b for _, b in p) else smooth(length, i) * math.sqrt(smooth(marks, i)) * math.log1p(sum(map(len, texts[p]))) for i, p in enumerate(order)}
    least = T.THRESHOLD * max(score.values(), default=0)
    if not least:
        return ""
    content = [(s, t) for s, t in tree.blocks if score[path(s)] >= least]
    total = sum(len(t) for _, t in content)
    prefixes = {s[:k] for s, _ in content for k in range(len(s) + 1)}
    article = max((p for p in prefixes if sum(len(t) for s, t in content if s[: len(p)] == p) >= T.ENCLOSED * total), key=len)
    while article and article[-1][0] in T.FLOW:
        article = article[:-1]
    if any(t in T.ARTICLE for t, _, _ in article):
        article = article[: min(i for i, x in enumerate(article) if x[0] in T.ARTICLE) + 1]
    within = [(s, t) for s, t in tree.blocks if s[: len(article)] == article]
    mean = sum(score[path(s)] * len(t) for s, t in within) / sum(len(t) for _, t in within)

    def value(s):
        own = score[path(s)]
        return max(own, 0 if any(b for _, b in path(s)) else (own + mean) / 2) if s[: len(article)] == article else own

    return "\n".join(t for s, t in tree.blocks if value(s) >= least)


def made(rng, article="article"):
    """A page without marks: menu, short notice and credits are told from the story by their ratios alone."""
    word = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    story = [f"<p>{word(25)}, {word(12)}. {word(9)}.</p>" for _ in range(int(rng.integers(3, 9)))]
    menu = "".join(f"<li><a href=x>{word(1)}</a></li>" for _ in range(int(rng.integers(3, 12))))
    inner = f"<h1>{word(6)}</h1>{''.join(story[:2])}<h2>{word(3)}</h2>{''.join(story[2:])}<ul><li>{word(2)}</li><li>{word(3)}</li></ul>"
    return f"<html><body><div><ul>{menu}</ul></div><div>{word(4)}</div><{article}>{inner}</{article}><div><div>{word(5)}</div></div></body></html>", inner


def test_against_plain_computation():
    rng = np.random.default_rng(11)
    pages = [made(rng, a)[0] for a in ("article", "div", "section", "main") for _ in range(30)]
    pages += [p for p in pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist() if p]
    for page in pages:
        assert T.main_text(page) == plain(page)


def test_ratios_decide(monkeypatch):
    """Without an article element and without any name to go by, the story comes out; with flat ratios it doesn't."""
    rng = np.random.default_rng(12)
    pages = [made(rng, "div") for _ in range(40)]
    want = ["\n".join(re.sub("<[^>]*>", "\n", inner).split("\n")).strip() for _, inner in pages]
    want = ["\n".join(x for x in w.split("\n") if x) for w in want]
    assert [T.main_text(p) for p, _ in pages] == want
    table = [p for p in pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist() if p]
    was = [T.main_text(p) for p in table]
    monkeypatch.setattr(T, "fused", lambda page, paths, sums: np.ones(len(paths)))
    assert all(T.main_text(p) != w for (p, _), w in zip(pages, want, strict=True))
    assert all(T.main_text(p) != w for p, w in zip(table, was, strict=True))


def test_time_grows_with_the_page():
    """Unclosed quotes, deep nesting and unmatched tags: a page of a megabyte takes seconds at most."""
    pages = ['<a b="' * 170_000, '<a b=">x</a' * 90_000, "<div>" * 100_000 + "<p>short, text.</p>" * 25_000, "<a \"'>x" * 150_000, "<ul><li>" * 70_000, "<div>" * 100_000 + "</p>" * 120_000, "<!--" * 250_000, "<" * 1_000_000, "<p>Some text, here.</p>" * 45_000]
    for page in pages:
        began = time.process_time()
        T.main_text(page)
        assert time.process_time() - began < 6, page[:20]


def test_query(spark, sf):
    got = {r.page_id: r for r in T.op5_tag_path_html(spark, sf).collect()}
    table = pq.read_table(f"{sf}/pages.parquet").to_pylist()
    assert set(got) == {r["page_id"] for r in table}
    for r in table:
        assert got[r["page_id"]].text == plain(r["html"] or "") and got[r["page_id"]].n_chars == len(plain(r["html"] or ""))
