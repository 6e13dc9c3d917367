"""Packing along a space-filling curve: neighbouring documents share sequences, without padding.

A document's tokens are hashed into a vector of DIMS counts, projected to AXES coordinates by fixed random
directions, and placed on a Hilbert curve. Documents are sorted over the cluster in ranges of that key, and each
range is one stream of tokens cut every `length`. What is left at a range's end is cut into powers of two,
so that no sequence needs padding. There are as many ranges as their tokens need at RANGE_BYTES each, and at least as
many as shuffle partitions.

Tokenizing comes first and is written once (16-bit ids where the vocabulary allows), since sorting by range
reads its input twice.

Cases: added tokens that a text spells out (such as <|endoftext|>) get their own ids, as from the tokenizer on the
whole text; null text counts as empty; an empty text has the end token alone; rows without an id take no part;
repeated rows are packed each, and equal ids stand in the order of their tokens; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH, END = 1024, 0
#: Hashed counts of a document, coordinates, and bits of each.
DIMS, AXES, BITS = 256, 4, 8
#: Octets of ids in a range, aimed at.
RANGE_BYTES = 64 << 20
#: Octets of pieces of text and their ids that a worker remembers, those of each entry's own objects (ENTRY), and characters
#: of the longest piece that is remembered. The tables are emptied when full; no result depends on them.
CACHE_BYTES, ENTRY, LONGEST = 192 << 20, 160, 64

_OTHER_SPACE = re.compile(r"[^\S \n]")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: A letter before a last comma or full stop, which so begins a new word of the tokenizer; and words of letters alone.
_STOPPED = re.compile(r".*[A-Za-zÀ-ÖØ-öø-ÿ][.,]", re.S)
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The characters for which byte-level vocabularies let each byte stand: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def plain(text: str) -> bool:
    """Whether all white space is single blanks and line ends between other characters."""
    if not text or text[0].isspace() or text[-1].isspace() or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return not _OTHER_SPACE.search(text)


class Pieces:
    """Ids of texts, piece by piece. Byte-level BPE first cuts a text into words with the blank before them, so a
    text may be cut at a single blank or line end between two other characters, and a word before its last comma
    or full stop, without changing its ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        #: whether a text may be cut at its added tokens, and the pattern of these
        self.free = not any(t.lstrip or t.rstrip or t.single_word or t.normalized and self.tokenizer.normalizer for t in added.values())
        self.marks = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        self.kind = np.dtype("<u4" if self.tokenizer.get_vocab_size() > 1 << 16 else "<u2")
        self.code = "I" if self.kind.itemsize == 4 else "H"
        self.letters = _byte_letters()
        self.slots = slots(self.tokenizer.get_vocab_size())
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.held = 0
        self.line_end = self._ids("\n")
        self.stops = {c: self._ids(c) for c in ".,"}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _piece(self, table: dict[str, bytes], piece: str, before: str) -> bytes:
        if _STOPPED.fullmatch(piece):
            core = piece[:-1]
            found = (table.get(core) or self._piece(table, core, before)) + self.stops[piece[-1]]
        elif _LETTERS.fullmatch(piece):
            spelled = (before + piece).encode().decode("latin-1").translate(self.letters)
            found = array(self.code, [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()
        else:
            found = self._ids(before + piece)
        if len(piece) <= LONGEST:
            self.held += ENTRY + 2 * len(piece) + len(found)
            if self.held > CACHE_BYTES:
                self.first.clear()
                self.later.clear()
                self.held = 0
            table[piece] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self._whole(text), self.kind)

    def _whole(self, text: str) -> bytes:
        if not self.marks.search(text):
            return self._unmarked(text)
        if not self.free:
            return self._ids(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [self._unmarked(text[at : m.start()]), np.array([self.added[m[0]]], self.kind).tobytes()]
            at = m.end()
        return b"".join([*out, self._unmarked(text[at:])])

    def _unmarked(self, text: str) -> bytes:
        first, later, piece = self.first, self.later, self._piece
        lines = [x.split(" ") for x in text.split("\n")] if plain(text) else [_CUT.split(text)]
        out = []
        for i, line in enumerate(lines):
            if i:
                out.append(self.line_end)
            w = line[0]
            out.append(first.get(w) or piece(first, w, ""))
            out += [later.get(w) or piece(later, w, " ") for w in line[1:]]
        return b"".join(out)


_loaded: dict[str, Pieces] = {}


def directions() -> np.ndarray:
    return np.random.default_rng(42).standard_normal((DIMS, AXES))


def slots(size: int) -> np.ndarray:
    """Of each id its place among twice DIMS counts: those that add and those that take away."""
    h = np.arange(size, dtype=np.uint32) * np.uint32(2654435761)
    return ((h >> np.uint32(32 - DIMS.bit_length() + 1)) + DIMS * ((h >> np.uint32(8)) & 1)).astype(np.int64)


def coordinates(ids: list[np.ndarray], place: np.ndarray) -> np.ndarray:
    """A row of AXES numbers of BITS bits for each document; place comes from slots()."""
    both = np.array([np.bincount(place[x], minlength=2 * DIMS) for x in ids]).reshape(len(ids), 2 * DIMS)
    counts = both[:, :DIMS] - both[:, DIMS:]
    vectors = np.sign(counts) * np.log1p(np.abs(counts))
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    projected = vectors @ directions() / np.where(length > 0, length, 1)
    return np.clip((1 / (1 + np.exp(-1.7 * projected))) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)  # about uniform


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each point along the Hilbert curve of its cube (Skilling, "Programming the Hilbert curve", 2004)."""
    x = points.astype(np.int64).T.copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(axes):
            on = (x[i] & bit) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(on, below, swap)
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] & (1 << level)) > 0, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, key, n, ids): n ids, little-endian, END included; written once."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = _loaded.get(tokenizer) or _loaded.setdefault(tokenizer, Pieces(tokenizer))
        end = np.array([END], pieces.kind).tobytes()
        for batch in batches:
            if len(batch):
                ids = [pieces.encode(t) for t in batch.text]
                yield pd.DataFrame({"doc_id": batch.doc_id, "key": hilbert_key(coordinates(ids, pieces.slots)), "n": [len(x) + 1 for x in ids], "ids": [x.tobytes() + end for x in ids]})

    rows = common.identified(docs, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return common.staged(rows.mapInPandas(each, "doc_id long, key long, n long, ids binary"))


def powers(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


Piece = tuple[int, int, np.ndarray, int]  # doc_id, start, ids, tokens of the document


def cut(stream: Iterator[tuple[int, np.ndarray]], length: int) -> Iterator[list[Piece]]:
    """Sequences, as lists of pieces, of a stream of documents."""
    held: list[Piece] = []
    room = length
    for doc_id, ids in stream:
        at = 0
        while at < len(ids):
            part = ids[at : at + room]
            held.append((doc_id, at, part, len(ids)))
            at += len(part)
            room -= len(part)
            if not room:
                yield held
                held, room = [], length
    for size in powers(length - room):
        sequence, room = [], size
        while room:
            doc_id, at, part, total = held.pop(0)
            sequence.append((doc_id, at, part[:room], total))
            if len(part) > room:
                held.insert(0, (doc_id, at + room, part[room:], total))
            room -= len(sequence[-1][2])
        yield sequence


_PIECES = "doc_id long, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, keep_ids: bool = True) -> DataFrame:
    """A row for each piece of a document in a sequence; keep_ids adds the piece's ids.

    sequence_id counts sequences within a range, above the range's number shifted by 40 bits.
    """
    spark = docs.sparkSession
    held = tokenized(docs, tokenizer)
    import tokenizers

    kind = "<u4" if tokenizers.Tokenizer.from_file(tokenizer).get_vocab_size() > 1 << 16 else "<u2"
    octets = (held.agg(F.sum("n")).first()[0] or 0) * np.dtype(kind).itemsize
    ranged = held.drop("n").repartitionByRange(max(common.partitions(spark), -(-octets // RANGE_BYTES)), "key", "doc_id").sortWithinPartitions("key", "doc_id", "ids").withColumn("part", F.spark_partition_id())

    def sequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = 0

        def stream() -> Iterator[tuple[int, np.ndarray]]:
            nonlocal part
            for batch in batches:
                for doc_id, ids, p in zip(batch.doc_id, batch.ids, batch.part, strict=True):
                    part = int(p)
                    yield doc_id, np.frombuffer(ids, kind)

        out: list[tuple] = []
        for number, sequence in enumerate(cut(stream(), length)):
            offset = 0
            for doc_id, start, ids, total in sequence:
                out.append((doc_id, start, len(ids), ids.astype(np.int32) if keep_ids else None, zlib.crc32(ids.astype("<u4").tobytes()), total, (part << 40) + number, offset))
                offset += len(ids)
            if len(out) >= 2000:
                yield pd.DataFrame(out, columns=[x.split()[0] for x in _PIECES.split(", ")])
                out = []
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _PIECES.split(", ")])

    return ranged.select("doc_id", "ids", "part").mapInPandas(sequences, _PIECES)


def op3_hilbert_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
