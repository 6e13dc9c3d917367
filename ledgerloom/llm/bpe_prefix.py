"""Byte-level BPE by dynamic programming over prefixes.

Of a text's encoding, each prefix ends in one token that depends on nothing behind it: the token t for which the encoding
of what comes before t ends in a token u such that u and t stay apart. So the last token of every prefix is stored, and the
ids follow by going back from the end. Tokens that end at a place come from a suffix automaton of the vocabulary, built once
a worker: the state reached by the longest piece of any token, and its suffix links, name them from the longest to the
shortest. Whether u and t stay apart is read off the right edge of u and the left edge of t, which are taken apart merge by
merge, the latest first: no pair across the border may merge while both of its sides exist.

Texts are cut into words by the tokenizer's own pattern first, so that a prefix is one of a word. Words up to LONGEST
octets are remembered with their ids; the table is emptied when it holds TABLE_BYTES.

Cases: added tokens that a text spells out (such as <|endoftext|>) get their own ids; null text counts as empty, and an empty
text has no ids and decodes to an empty text; unknown ids decode to nothing; rows without an id take no part in the query;
repeated rows are encoded each; other columns are kept; an empty table gives an empty result. Tokenizers other than
byte-level BPE without normalizer, dropout, unknown token, prefix or suffix of words, and vocabularies in which a merge
uses a token before the merge that makes it, raise ValueError.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Fixed value: the published pattern of byte-level BPE's words
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of the longest word that is remembered, and octets of words, ids and their objects (ENTRY a word) that a worker holds.
LONGEST, TABLE_BYTES, ENTRY = 64, 256 << 20, 180
#: Characters whose new words are learnt in one go.
RUN = 2 << 20
#: Answers on pairs of tokens that a worker holds.
PAIRS = 1 << 19
_NEVER = 1 << 60
_WORDS = regex.compile(WORDS)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Suffixes:
    """The suffix automaton of many strings: a state is the set of pieces that occur at the same ends, a link the longest suffix that occurs elsewhere too."""

    def __init__(self, strings: list[bytes]):
        self.step: dict[int, int] = {}  # state * 256 + octet
        self.link, self.length, out = [-1], [0], [[]]
        for s in strings:
            at = 0
            for c in s:
                at = self._added(at, c, out)
        #: the string that a state ends, by its number
        self.ends = [-1] * len(self.link)
        for i, s in enumerate(strings):
            at = 0
            for c in s:
                at = self.step[at << 8 | c]
            self.ends[at] = i

    def _state(self, length: int, link: int, out: list[list[int]]) -> int:
        self.length.append(length)
        self.link.append(link)
        out.append([])
        return len(self.link) - 1

    def _copied(self, p: int, c: int, q: int, out: list[list[int]]) -> int:
        """A state for the shorter pieces of q, which p and the states above it reach by c."""
        new = self._state(self.length[p] + 1, self.link[q], out)
        out[new] = list(out[q])
        for x in out[q]:
            self.step[new << 8 | x] = self.step[q << 8 | x]
        while p >= 0 and self.step.get(p << 8 | c) == q:
            self.step[p << 8 | c] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def _added(self, last: int, c: int, out: list[list[int]]) -> int:
        q = self.step.get(last << 8 | c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._copied(last, c, q, out)
        new, p = self._state(self.length[last] + 1, 0, out), last
        while p >= 0 and (q := self.step.get(p << 8 | c)) is None:
            self.step[p << 8 | c] = new
            out[p].append(c)
            p = self.link[p]
        if p >= 0:
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copied(p, c, q, out)
        return new


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Bpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, cut = told["model"], told["pre_tokenizer"] or {}
        if model["type"] != "BPE" or told["normalizer"] or cut.get("type") != "ByteLevel" or not cut.get("use_regex", True):
            raise ValueError(f"{path} isn't byte-level BPE without normalizer")
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path} has an option that isn't followed")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]):
            raise ValueError(f"{path} has an added token that takes more than its own text")
        self.prefix = " " if cut["add_prefix_space"] else ""
        #: only to split texts with characters that Python's tables haven't assigned, as other tables may class them differently
        self.splitter, self.assigned = Tokenizer.from_file(path).pre_tokenizer, set()
        self.added = {t["content"]: t["id"] for t in told["added_tokens"] if t["content"]}
        self.marks = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        letters = byte_letters()
        vocab = {bytes(map(letters.__getitem__, t)): i for t, i in model["vocab"].items() if t not in self.added and all(x in letters for x in t)}
        self.octets = {i: s for s, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        self._learn(vocab, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], letters)
        self.table: dict[str, bytes] = {}
        self.held = 0
        #: the word looked at last: of its prefixes the last token, and the automaton's state with the length matched
        self.before, self.last, self.states = b"", [-1], [(0, 0)]
        self.pairs: dict[int, bool] = {}

    def _learn(self, vocab: dict[bytes, int], merges: list[tuple[str, str]], letters: dict[str, int]) -> None:
        single = [vocab.get(bytes([b])) for b in range(256)]
        if None in single:
            raise ValueError("the vocabulary lacks an octet")
        self.rank = dict.fromkeys(single, -1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.merge: dict[int, int] = {}
        for r, (a, b) in enumerate(merges):
            a, b = (bytes(map(letters.__getitem__, x)) for x in (a, b))
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if left not in self.rank or right not in self.rank:
                raise ValueError("a merge uses a token before the merge that makes it")
            self.merge.setdefault(left << 32 | right, r)
            if whole not in self.rank and self.apart(left, right, r):
                self.rank[whole], self.halves[whole] = r, (left, right)
        strings = sorted((i for i in vocab.values() if i in self.rank), key=lambda i: len(self.octets[i]))
        self.automaton = Suffixes([self.octets[i] for i in strings])
        #: of each state the tokens that its longest piece ends in, longest first, and those of its shorter ones
        self.whole, self.shorter = [()] * len(self.automaton.link), [()] * len(self.automaton.link)
        for at in sorted(range(1, len(self.whole)), key=self.automaton.length.__getitem__):
            k = self.automaton.ends[at]
            self.shorter[at] = self.whole[self.automaton.link[at]]
            self.whole[at] = ((strings[k], self.automaton.length[at]), *self.shorter[at]) if k >= 0 else self.shorter[at]
        self.size = {i: len(self.octets[i]) for i in strings}

    def apart(self, u: int, t: int, before: int = _NEVER) -> bool:
        """Whether no merge of a rank below `before` joins the end of u and the start of t before both are whole."""
        rank, halves, merge = self.rank, self.halves, self.merge
        until_u = until_t = before
        while True:
            r = merge.get(u << 32 | t)
            # of equal pairs the left one merges first, so u's side is gone at its parent's rank, t's side isn't yet
            if r is not None and r < until_u and (r < until_t or r == until_t != before):
                return False
            if rank[u] > rank[t]:
                until_u, u = rank[u], halves[u][1]
            elif rank[t] >= 0:
                until_t, t = rank[t], halves[t][0]
            else:
                return True

    def word(self, octets: bytes) -> list[int]:
        """Ids of a word: the last token of every prefix, then back from the end. What it shares with the word before is kept."""
        step, link, length = self.automaton.step, self.automaton.link, self.automaton.length
        whole, shorter, pairs, last, states = self.whole, self.shorter, self.pairs, self.last, self.states
        shared, before = 0, self.before
        for a, b in zip(before, octets, strict=False):
            if a != b:
                break
            shared += 1
        del last[shared + 1 :], states[shared + 1 :]
        known, (state, matched) = pairs.get, states[shared]
        for i in range(shared + 1, len(octets) + 1):
            c = octets[i - 1]
            to = step.get(state << 8 | c)
            while to is None:
                state = link[state]
                matched = length[state]
                to = step.get(state << 8 | c)
            state, matched = to, matched + 1
            for t, n in whole[state] if length[state] == matched else shorter[state]:
                if n == i:
                    break
                u = last[i - n]
                fits = known(u << 32 | t)
                if fits is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    fits = pairs[u << 32 | t] = self.apart(u, t)
                if fits:
                    break
            last.append(t)
            states.append((state, matched))
        self.before = octets
        out, size, i = [], self.size, len(octets)
        while i:
            out.append(last[i])
            i -= size[last[i]]
        if len(octets) > LONGEST:
            self.before, self.last, self.states = b"", [-1], [(0, 0)]
        return out[::-1]

    def _learnt(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that the table lacks, in order, so that neighbours share prefixes. The table remembers the short ones."""
        found = {}
        for w in sorted(words):
            found[w] = _packed(self.word(w.encode()))
        short = {w: ids for w, ids in found.items() if len(w) <= LONGEST}
        self.held += sum(ENTRY + 2 * len(w) + len(ids) for w, ids in short.items())
        if self.held > TABLE_BYTES:
            self.table, self.held = {}, 0
        else:
            self.table |= short
        return found

    def _words(self, text: str) -> list[str]:
        text = text if text.startswith(" ") else self.prefix + text
        if not text.isascii():
            new = set(text) - self.assigned
            if any(unicodedata.category(c) == "Cn" for c in new):
                return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]
            self.assigned |= new
        return _WORDS.findall(text)

    def _parts(self, text: str) -> Iterator[tuple[str, bytes]]:
        """Stretches of text, each followed by the ids of an added token."""
        at = 0
        for m in self.marks.finditer(text):
            yield text[at : m.start()], _packed([self.added[m[0]]])
            at = m.end()
        yield text[at:], b""

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; texts are split in runs of RUN characters or so, whose new words are learnt together."""
        out, held = [], []

        def flush() -> None:
            table = self.table  # what it holds now stays in reach if it is emptied meanwhile
            new = self._learnt({w for parts in held for words, _ in parts for w in words if w not in table})
            out.extend(b"".join([b"".join([table.get(w) or new[w] for w in words]) + mark for words, mark in parts]) for parts in held)
            held.clear()

        octets = 0
        for text in texts:
            held.append([(self._words(t) if t else [], mark) for t, mark in self._parts(text)])
            octets += len(text)
            if octets > RUN:
                flush()
                octets = 0
        flush()
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        get = self.octets.get
        return b"".join([get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", out_col: str = "ids", packed: bool = False) -> DataFrame:
    """docs and their ids, as an array or packed as little-endian unsigned 32-bit integers; tokenizer is a path that every machine has."""
    if packed:
        udf = F.pandas_udf(lambda texts: pd.Series(loaded(tokenizer).encode_all([t or "" for t in texts]), dtype=object), "binary")
    else:
        udf = F.pandas_udf(lambda texts: pd.Series([np.frombuffer(x, "<u4").astype(np.int32) for x in loaded(tokenizer).encode_all([t or "" for t in texts])], dtype=object), "array<int>")
    return docs.withColumn(out_col, udf(F.col(text_col)))


def decode(docs: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """docs and the texts of their ids, which are an array or packed; null ids give an empty text."""

    def text(ids) -> str:
        return loaded(tokenizer).decode(b"" if ids is None else bytes(ids) if isinstance(ids, (bytes, bytearray)) else np.asarray(ids, "<u4").tobytes())

    udf = F.pandas_udf(lambda ids: pd.Series([text(x) for x in ids], dtype=object), "string")
    return docs.withColumn(out_col, udf(F.col(ids_col)))


def op13_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = common.identified(common.table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = decode(encode(docs, path, packed=True), path, out_col="decoded")
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
