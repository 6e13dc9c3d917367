"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model file is compiled into three machines: the normaliser (a prefix tree of the file's character rules with the
identity for all else, blanks squeezed if the model asks, white space becomes U+2581 and one is put in front), the
pieces (a prefix tree with ids at its ends), and the byte fallback (one arc for each character that is no piece, with
its octets' ids). A text is composed with the normaliser first; that is deterministic, the longest rule wins, so
that one path is left. Its output is composed with the other two on the fly to a lattice, whose path of least weight
in the tropical semiring (weights add along a path, the least path wins) gives the ids.

For a unigram model an arc weighs its piece's negated score. In a byte-pair model scores only say which
merge comes first, and sums of them rank paths wrongly. There the transducer remembers the last piece, and an
arc weighs 0 if merging the two pieces' joined text gives just these two, else infinity: a sequence of pieces
is the byte-pair encoding of a text if and only if each neighbouring pair is that of its own text (Berglund
and van der Merwe, "Formalizing BPE Tokenization", 2023). For every prefix one state then is left, so that
composition takes time in proportion to the text.

Where two characters stand next to each other in no piece of the model, no arc spans them and the transducer
is back in its first state. Texts are cut there, at blanks and line ends first, and the paths of words and of
their parts are remembered in tables of at most CACHE entries, of LONGEST characters at most; they are emptied when full
and change no result.

Models with user-defined pieces, with white space at the ends of words, or without byte pieces raise ValueError.

Cases: null text counts as empty; an empty text has no ids; a text's own U+2581 decodes to a blank, as in the
original; rows without an id take no part; repeated rows stay; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = "▁"
#: Words whose paths an executor's worker remembers.
CACHE, LONGEST = 600_000, 48
#: By how much the fallback of a character outweighs the heaviest piece of a unigram model.
PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[i : i + n]
            i += n


def rules(table: bytes) -> dict[str, str]:
    """The character rules of a model file: a double-array trie of their octets, then what they give, ended by zeros."""
    if not table:
        return {}
    size = int.from_bytes(table[:4], "little")
    units, gives = np.frombuffer(table, "<u4", size // 4, 4).astype(np.int64), table[4 + size :]
    offset = (units >> 10) << ((units & 512) >> 6)
    label, leaf = units & (1 << 31 | 255), (units >> 8 & 1).astype(bool)
    found, octets, todo = {}, np.arange(1, 256), [(int(offset[0]), b"")]
    while todo:
        at, key = todo.pop()
        near = at ^ octets
        near = near[near < len(units)]
        for child in near[label[near] == (at ^ near)].tolist():
            longer, below = key + bytes([at ^ child]), child ^ int(offset[child])
            if leaf[child]:
                start = int(units[below]) & (1 << 31) - 1
                found[longer.decode()] = gives[start : gives.index(0, start)].decode()
            todo.append((below, longer))
    return found


class Normaliser:
    """The first machine. Its arcs are the prefixes of the rules' characters, with the output where a rule ends."""

    def __init__(self, spec: dict):
        if not spec.get(5, 1):
            raise ValueError("a model that keeps blanks as they are isn't supported")
        found = rules(spec.get(2, b""))
        self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        self.arcs: dict[str, str | None] = {k[:i]: None for k in found for i in range(1, len(k))} | found
        self.first = re.compile("[" + "".join(map(re.escape, sorted({k[0] for k in found}))) + "]") if found else None

    def ruled(self, text: str) -> str:
        arcs, out, done, n = self.arcs, [], 0, len(text)
        for m in self.first.finditer(text):
            i = m.start()
            if i < done:
                continue
            end, gives = 0, ""
            for j in range(i + 1, n + 1):
                p = text[i:j]
                if p not in arcs:
                    break
                if arcs[p] is not None:
                    end, gives = j, arcs[p]
            if end:
                out += [text[done:i], gives]
                done = end
        return "".join(out) + text[done:]

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        if self.first:
            text = self.ruled(text)
        if self.squeeze:
            text = re.sub(" {2,}", " ", text).lstrip(" ")
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        return text.rstrip(SPACE) if self.squeeze else text


class Transducer:
    """Compiled from a model file. ids of bytes, control and unknown pieces are never made from text by a piece arc."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            parts = list(_fields(file.read()))
        self.pieces: dict[str, int] = {}
        self.weights: list[float] = []
        self.bytes: dict[int, int] = {}
        self.out: list[bytes] = []
        spec = dict(_fields(next((v for k, v in parts if k == 2), b"")))
        self.byte_pair = spec.get(3, 1) == 2
        if spec.get(3, 1) not in (1, 2) or spec.get(24, 0):
            raise ValueError("only unigram and byte-pair models with white space before words are supported")
        self.normalised = Normaliser(dict(_fields(next((v for k, v in parts if k == 3), b""))))
        for i, value in enumerate(v for k, v in parts if k == 1):
            x = dict(_fields(value))
            piece, kind = x.get(1, b"").decode(), x.get(3, 1)
            self.weights.append(-float(np.frombuffer(x.get(2, b"\0\0\0\0"), "<f4")[0]))
            if kind == 4:
                raise ValueError("a model with user-defined pieces isn't supported")
            if kind == 6:
                self.bytes[int(piece[1:-1], 16)] = i
                self.out.append(bytes([int(piece[1:-1], 16)]))
            elif kind == 1:
                self.pieces[piece] = i
                self.out.append(piece.replace(SPACE, " ").encode())
            else:
                self.out.append(b"")
        if len(self.bytes) < 256:
            raise ValueError("a model without byte pieces isn't supported")
        #: Weight of a fallback arc in a unigram model.
        self.fallback = max((self.weights[i] for i in self.pieces.values()), default=0.0) + PENALTY
        joins = any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        line = "" if any("\n" in p for p in self.pieces) else "\n"
        self.words = re.compile(".+", re.S) if joins else re.compile(f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + ("|\n" if line else ""))
        #: Characters that are neighbours in a piece.
        self.bonds = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        #: The arcs as a prefix tree: every prefix of a piece, with the piece's id if it is one and may be used.
        self.tree: dict[str, int | None] = {p[:i]: None for p in self.pieces for i in range(1, len(p))}
        self.cache: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        #: Pieces that merging never makes can stand in no path.
        self.dead = {p for p in self.pieces if len(p) > 1 and self.merged(p) != [p]} if self.byte_pair else set()
        self.tree |= {p: i for p, i in self.pieces.items() if p not in self.dead}

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging of a short text, literally: the pair of least weight first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = math.inf, -1
            for i in range(len(parts) - 1):
                k = self.pieces.get(parts[i] + parts[i + 1])
                if k is not None and self.weights[k] < best:
                    best, at = self.weights[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, a: str, b: str) -> bool:
        """Whether the arc of b after a weighs 0 in a byte-pair model; remembered."""
        if len(self.pairs) >= CACHE:
            self.pairs.clear()
        whole = a + b
        found = self.pairs[a, b] = (whole not in self.pieces or whole in self.dead) and self.merged(whole) == [a, b]
        return found

    def shortest(self, word: str) -> list[str]:
        """The outputs of the least path through the lattice of one word. A state is (place, last piece)."""
        n, tree, pairs = len(word), self.tree, self.pairs
        weight: list[float] = [0.0] + [math.inf] * n
        back: list[str] = [""] * (n + 1)
        for i in range(n):
            if weight[i] == math.inf:
                continue
            last = back[i]
            for j in range(i + 1, n + 1):
                p = word[i:j]
                if p in tree:
                    k = tree[p]
                    if k is None and j > i + 1:
                        continue
                elif j > i + 1:
                    break
                else:
                    k = None
                if self.byte_pair:
                    if weight[j] == math.inf:
                        fits = not last or pairs.get((last, p))
                        if fits is None:
                            fits = self.fit(last, p)
                        if fits:
                            weight[j], back[j] = 0.0, p
                else:
                    w = weight[i] + (self.fallback if k is None else self.weights[k])
                    if w < weight[j]:
                        weight[j], back[j] = w, p
        out = []
        while n:
            out.append(back[n])
            n -= len(back[n])
        return out[::-1]

    def part_ids(self, part: str) -> bytes:
        ids: list[int] = []
        for p in self.shortest(part):
            k = self.pieces.get(p)
            ids += [self.bytes[b] for b in p.encode()] if k is None else [k]
        found = np.array(ids, "<u4").tobytes()
        if len(part) <= LONGEST:
            if len(self.parts) >= CACHE:
                self.parts.clear()
            self.parts[part] = found
        return found

    def word_ids(self, word: str) -> bytes:
        cuts = [0, *(i + 1 for i in range(len(word) - 1) if word[i : i + 2] not in self.bonds), len(word)]
        get, find = self.parts.get, self.part_ids
        found = b"".join([get(p) or find(p) for p in (word[i:j] for i, j in pairwise(cuts))])
        if len(word) <= LONGEST:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        get, find = self.cache.get, self.word_ids
        return np.frombuffer(b"".join([get(w) or find(w) for w in self.words.findall(self.normalised(text))]), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.out.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if (self.normalised.prefix or self.normalised.squeeze) and text.startswith(" ") else text


_compiled: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    """One transducer for each model and worker."""
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def encode(docs: DataFrame, model: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs and their ids; model is a path that every machine has."""
    udf = F.pandas_udf(lambda texts: texts.map(lambda t: compiled(model).encode(t or "").astype(np.int32)), "array<int>")
    return docs.withColumn(out_col, udf(F.col(text_col)))


def decode(docs: DataFrame, model: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    udf = F.pandas_udf(lambda ids: ids.map(lambda x: compiled(model).decode(np.asarray([] if x is None else x, np.int64))), "string")
    return docs.withColumn(out_col, udf(F.col(ids_col)))


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Number and CRC-32 (little-endian unsigned 32-bit) of each text's ids, and the SHA-256 of their decoding, in one pass."""

    def each(texts: pd.Series) -> pd.DataFrame:
        t, out = compiled(model), []
        for text in texts:
            ids = t.encode(text or "")
            back = t.decode(ids)
            out.append((len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == (text or "")))
        return pd.DataFrame(out, columns=["n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    udf = F.pandas_udf(each, "n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
    return docs.withColumn("_d", udf(F.col("text"))).select("doc_id", "_d.*")


def op6_fst_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.identified(common.table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return digests(docs, public_tokenizers.path("piece_bpe_32k.model"))
