"""Personal data by rules and a skip-chain conditional random field (after Sutton and McCallum, 2004).

Rules find the base spans: emails, IP addresses, card numbers and phone numbers. A conditional random field
then labels the words of each text with one of these kinds or none. Neighbouring words share a potential (the
chain) and so do distant words that repeat one another or hold the same digits (the skips), so that an entity
found at one place raises its repeats elsewhere, as where a later mention leaves out the country code or
misspells the top-level domain. Loopy message passing gives each word's marginals; a word of a kind at CERTAIN or
more that an edge ties to others becomes a span of the method where no base span is, with the words next to it that are of
that kind at LIKELY or more. Base spans stay.

Words that hold no digit and no "@" are of no kind (a hard zero), so only the words that may be of a kind are
nodes; chain edges join those that stand next to each other in the text. Weights are fitted piecewise (Sutton
and McCallum, 2005) on the words of a sample of at most 2 x TRAIN_ROWS documents, labelled by the rules.

Cases: null text counts as empty; empty texts have no spans; rows without an id take no part; repeated rows
stay; other columns are ignored; on an empty table, or one without personal data, there is no model and the
base spans are the result. Reading and labelling take time in proportion to a text, also where it has no blanks; a round
of message passing to its words, and there are FREE rounds and one for each word, at most FREE + FAR.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Documents aimed at for fitting, by a hash of their id; the bound is twice that.
TRAIN_ROWS = 2000
#: Marginals from which a word becomes a span, and joins that of the word next to it.
CERTAIN, LIKELY = 0.9, 0.7
#: Message passing ends when no message changes by this, or after FREE rounds and one for each word up to FAR: what comes
#: from further away along a chain has passed through so many potentials that it says nothing, and mentions are tied to the evidence directly.
SETTLED, FREE, FAR = 1e-3, 50, 500
#: Pairs of repeats with one label that are counted in advance for each label.
AGREE = 20
#: Digits at their ends that link two words; each word is linked to the last such word before it.
SAME_DIGITS = 7

_DIGIT = re.compile("[0-9@]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # a match inside a run of digits would match from its start
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_REST = re.compile(r"\S*")
_NOT_DIGIT = re.compile("[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches: for each @ the whole run of local characters before it, back to the match before."""
    free = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield "email", start, m.end()
            free = at = m.end()
        else:
            at += 1


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    if not _DIGIT.search(text):
        return []
    out = list(emails(text))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0]) if m.end() - m.start() >= 16 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# The field


def features(word: str, before: str, after: str) -> list[str]:
    """What the unary potential of a word sees: its shape, its length and its neighbours' shapes."""
    shape = lambda w: re.sub(r"[A-Z]+", "A", re.sub(r"[a-zà-ÿ]+", "a", re.sub(r"[0-9]+", "9", w)))[:24]
    digits = sum(c.isdigit() for c in word)
    return [f"shape={shape(word)}", f"digits={min(digits, 20)}", f"long={min(len(word) // 3, 12)}", f"at={word.count('@')}.{word.count('.')}", f"first={shape(word[:1])}", f"before={shape(before)[:6] if _DIGIT.search(before) or '+' in before else '-'}", f"after={shape(after)[:6] if _DIGIT.search(after) else '-'}"]


def nodes(text: str) -> list[tuple[int, int]]:
    """The words that hold a digit or an @."""
    out, end = [], 0
    while m := _DIGIT.search(text, end):
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = _REST.match(text, m.start()).end()
        out.append((start, end))
    return out


def described(text: str, spots: list[tuple[int, int]]) -> list[list[str]]:
    out = []
    for start, end in spots:
        before = text[max(0, start - 24) : start].split()
        after = text[end : end + 24].split()
        out.append(features(text[start:end], before[-1] if before else "", after[0] if after else ""))
    return out


def rule_labels(spots: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    """The label of each word by the base spans that it overlaps, the first kind where several do."""
    labels, ends = [0] * len(spots), [b for _, b in spots]
    for kind, start, end in reversed(spans):
        i = bisect_right(ends, start)
        while i < len(spots) and spots[i][0] < end:
            labels[i] = LABELS.index(kind)
            i += 1
    return labels


def chain_edges(spots: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Words with at most one character between them."""
    return [(i, i + 1) for i, (a, b) in enumerate(pairwise(spots)) if b[0] - a[1] <= 1]


def skip_edges(text: str, spots: list[tuple[int, int]], known: list[int] | None = None) -> list[tuple[int, int]]:
    """Each word and the last one before it that is equal but for case and outer punctuation, ends in the same digits, or has the same local part.

    With known labels also each word and, for every label, the first word of the same key that has it, so that all
    mentions are one step from the evidence, however many there are.
    """
    out, last = [], {}
    mentions: dict[str, list[int]] = {}
    evidence: dict[str, dict[int, int]] = {}
    for i, (a, b) in enumerate(spots):
        word = text[a:b].strip(".,;:!?()[]{}<>\"'|*#%&$").lower()
        digits = _NOT_DIGIT.sub("", word)
        keys = [word, *([digits[-SAME_DIGITS:]] if len(digits) >= SAME_DIGITS else []), *([word.partition("@")[0] + "@"] if "@" in word[1:] else [])]
        out += {(last[k], i) for k in keys if k in last}
        last |= dict.fromkeys(keys, i)
        for k in keys if known else ():
            mentions.setdefault(k, []).append(i)
            if known[i]:
                evidence.setdefault(k, {}).setdefault(known[i], i)
    for k, firsts in evidence.items():
        out += [(min(i, j), max(i, j)) for j in firsts.values() for i in mentions[k] if not known[i]]
    return sorted(set(out) - set(chain_edges(spots)))


class Field:
    """Log potentials: unary by feature, chain, and skip."""

    def __init__(self, unary: dict[str, np.ndarray], prior: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.prior, self.chain, self.skip = unary, prior, chain, skip

    def marginals(self, described: list[list[str]], chain: list[tuple[int, int]], skips: list[tuple[int, int]], known: list[int]) -> np.ndarray:
        """Sum-product by flooding, damped; words that a rule has labelled are evidence."""
        none = np.zeros(len(LABELS))
        score = np.array([self.prior + sum((self.unary.get(f, none) for f in fs), none) for fs in described])
        for i, k in enumerate(known):
            if k:
                score[i] = np.where(np.arange(len(LABELS)) == k, 0, -50)
        edges = np.array([*chain, *skips], int).reshape(-1, 2)
        if not len(edges):
            return _softmax(score)
        pair = np.concatenate([np.broadcast_to(self.chain, (len(chain), *self.chain.shape)), np.broadcast_to(self.skip, (len(skips), *self.skip.shape))])
        source, to = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
        back = np.roll(np.arange(len(source)), len(edges))
        message = np.zeros((len(source), len(LABELS)))
        for _ in range(FREE + min(len(score), FAR)):
            belief = score.copy()
            np.add.at(belief, to, message)
            new = np.logaddexp.reduce((belief[source] - message[back])[:, :, None] + pair, axis=1)
            step = 0.5 * (new - new.max(axis=1, keepdims=True) - message)
            message = message + step
            if np.abs(step).max() < SETTLED:
                break
        np.add.at(score, to, message)
        return _softmax(score)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(counts: dict[str, np.ndarray], chain: np.ndarray, skip: np.ndarray, steps: int = 300) -> Field:
    """Piecewise fit: multinomial logistic regression for the words, log odds of label pairs for the edges.

    counts has for each set of features (joined by blanks) how often it came with each label.
    """
    names = sorted({f for k in counts for f in k.split(" ")})
    index = {f: i for i, f in enumerate(names)}
    x, y = np.zeros((len(counts), len(names)), np.float32), np.array(list(counts.values()), np.float32)
    for row, k in enumerate(counts):
        x[row, [index[f] for f in k.split(" ")]] = 1
    n, total = y.sum(axis=1, keepdims=True), y.sum()
    weights, bias = np.zeros((len(names), len(LABELS)), np.float32), np.zeros(len(LABELS), np.float32)
    for _ in range(steps):
        gap = (y - n * _softmax(x @ weights + bias)) / total
        weights += 2.0 * (x.T @ gap - 1e-4 * weights)
        bias += 2.0 * gap.sum(axis=0)
    odds = lambda c: np.log(c * c.sum() / (c.sum(axis=1, keepdims=True) * c.sum(axis=0, keepdims=True)))
    return Field({f: weights[i].astype(float) for f, i in index.items()}, bias.astype(float), odds(chain + 1), odds(skip + 1 + AGREE * np.eye(len(LABELS))))


def _examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of (features, label), chain pairs and skip pairs."""
    for batch in batches:
        found: dict[tuple[str, int], int] = {}
        for text in batch.text:
            spots = nodes(text)
            labels = rule_labels(spots, base_spans(text))
            for fs, label in zip(described(text, spots), labels, strict=True):
                key = (" ".join(fs), label)
                found[key] = found.get(key, 0) + 1
            for name, edges in (("chain", chain_edges(spots)), ("skip", skip_edges(text, spots))):
                for i, j in edges:
                    key = (name, len(LABELS) * labels[i] + labels[j])
                    found[key] = found.get(key, 0) + 1
        yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["what", "label", "n"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Field | None:
    """A field fitted on about `rows` of the documents that hold a digit or an @, at most twice as many."""
    held = docs.filter(F.col(text_col).rlike("[0-9@]"))
    n = held.select(id_col).count()
    if not n:
        return None
    chosen = held.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(min(1, rows / n) * (1 << 30))).limit(2 * rows).select(F.col(text_col).alias("text"))
    # bounded by the bounded sample
    found = chosen.mapInPandas(_examples, "what string, label int, n long").groupBy("what", "label").agg(F.sum("n").alias("n")).collect()
    counts: dict[str, np.ndarray] = {}
    pairs = {k: np.zeros(len(LABELS) ** 2) for k in ("chain", "skip")}
    for r in sorted(found):
        (pairs[r.what] if r.what in pairs else counts.setdefault(r.what, np.zeros(len(LABELS))))[r.label] += r.n
    if not sum(c[1:].sum() for c in counts.values()):
        return None
    size = len(LABELS)
    return fit(counts, pairs["chain"].reshape(size, size), pairs["skip"].reshape(size, size))


def find(text: str, field: Field | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    spots = nodes(text) if field and _DIGIT.search(text) else []
    if not spots:
        return base, base
    known = rule_labels(spots, base)
    skips, chain = skip_edges(text, spots, known), chain_edges(spots)
    if not skips and not chain:  # then no word is tied to another, and none is added
        return base, base
    marginal = field.marginals(described(text, spots), chain, skips, known)
    taken: list[tuple[int, int]] = []  # disjoint
    for _, a, b in sorted(base, key=lambda s: s[1]):
        taken[-1:] = [(taken[-1][0], max(b, taken[-1][1]))] if taken and a <= taken[-1][1] else [*taken[-1:], (a, b)]
    ends = [b for _, b in taken]
    linked = {i for e in (*skips, *chain) for i in e}
    label, sure = marginal.argmax(axis=1).tolist(), marginal.max(axis=1).tolist()
    runs: list[list[int]] = []
    for i, (a, b) in enumerate(spots):
        k = bisect_right(ends, a)
        if label[i] and not known[i] and sure[i] >= LIKELY and not (k < len(taken) and taken[k][0] < b):
            if runs and runs[-1][-1] == i - 1 and label[i - 1] == label[i] and a - spots[i - 1][1] <= 1:
                runs[-1].append(i)
            else:
                runs.append([i])
    extra: list[Span] = []
    for run in runs:
        if any(sure[i] >= CERTAIN and i in linked for i in run):
            a, b = spots[run[0]][0], spots[run[-1]][1]
            while a < b and not (text[a].isalnum() or text[a] in "+("):
                a += 1
            while b > a and not text[b - 1].isalnum():
                b -= 1
            if a < b:
                extra.append((LABELS[label[run[0]]], a, b))
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + extra, key=lambda s: (order[s[0]], s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def tag(docs: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """docs with _base and _spans, the base spans and all spans joined as kind:start:end. No shuffle.

    The field's size is bounded by that of its sample.
    """

    def spans(column: pd.Series) -> pd.DataFrame:
        found = [find(t or "", field) for t in column]
        return pd.DataFrame({"base": [joined(b) for b, _ in found], "spans": [joined(s) for _, s in found]}, dtype=object)

    both = F.pandas_udf(spans, "base string, spans string")(F.coalesce(F.col(text_col), F.lit("")))
    return docs.withColumn("_pii", both).withColumns({"_base": F.col("_pii.base"), "_spans": F.col("_pii.spans")}).drop("_pii")


def redact(docs: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """docs with every span's text replaced by its kind in angle brackets."""

    def clean(column: pd.Series) -> pd.Series:
        out = []
        for text in column:
            if text:
                end = len(text)
                for kind, a, b in sorted(find(text, field)[1], key=lambda s: (-s[1], -s[2])):
                    if b <= end:
                        text, end = f"{text[:a]}<{kind}>{text[b:]}", a
                    elif a < end:  # spans of two kinds overlap: the earlier part goes too
                        text, end = f"{text[:a]}<{kind}>{text[end:]}", a
            out.append(text)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, F.pandas_udf(clean, "string")(F.col(text_col)))


def op7_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.identified(common.table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tagged = tag(docs, train(docs))
    count = lambda kind: F.size(F.filter(F.split("_base", ","), lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")
    return tagged.select("doc_id", *[count(k) for k in KINDS], F.sha2("_base", 256).alias("base_sha256"), F.col("_spans").alias("spans"))
