"""Fill-in-middle cuts from an index of the distinct texts.

Identical texts are one entry of the index. Texts are compressed in tasks and grouped by their SHA-256, and an entry counts as
one text only if the smallest and the largest of its compressed texts are the same octets. Documents join the index by their
ids alone, dealt as the entries are, so a text moves once, and copies in one task not at all. For an entry the places in
UTF-8 at which its code points begin are made into an Elias-Fano list, once for all documents with that text: the low bits of
each place packed, the high ones as a bitmap in which the k-th set bit gives the k-th place. Each document picks its two cuts
by selecting in the list, and the text is sliced there.

A text that many documents share is one entry for every `limit` of them (HOT, or a MOST-th of all rows if that is more), and
its documents are dealt over these entries, so no task has more of one text; at most MOST texts are so, which bounds what is
broadcast. Ids that repeat with one text are counted first.

Cases: a null text counts as empty; an empty text, and one that spells out a tag, stays plain; rows without an id take no
part; repeated rows come out as often as they stand there; other columns are ignored; an empty table gives an empty result. Two
texts with one key raise ValueError (for SHA-256 none are known); `by_content` as key can't collide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Tags before prefix, suffix and middle.
TAGS = ("<P>", "<S>", "<M>")
#: Of 100 documents those that are cut, and of 100 cut ones those whose suffix stands first.
RATE, SUFFIX_FIRST = 90, 20
SEED = 1
#: Documents that share a text and are one entry of the index, and most texts that are more than one.
HOT, MOST = 1000, 100_000
#: Octets of outputs in a batch, about.
BATCH_BYTES = 8 << 20


class EliasFano:
    """A rising list of whole numbers: `bits` low bits of each packed, the rest in a bitmap."""

    def __init__(self, bits: int, low: bytes, high: bytes):
        self.bits, self.low, self.high = bits, np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint64)
        #: how many bits are set in each word and those before it
        self.ones = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)

    @classmethod
    def packed(cls, values: np.ndarray) -> tuple[int, bytes, bytes]:
        """(bits, low, high) of values, which rise from 0 and aren't empty."""
        n, most = len(values), int(values[-1])
        bits = max(0, (most // n).bit_length() - 1)
        marks = np.zeros((((most >> bits) + n) // 64 + 1) * 64, bool)
        marks[(values >> bits) + np.arange(n)] = True
        low = (values[:, None] >> np.arange(bits)) & 1
        return bits, np.packbits(low.astype(bool).ravel(), bitorder="little").tobytes(), np.packbits(marks, bitorder="little").tobytes()

    def select(self, k: np.ndarray) -> np.ndarray:
        """The values at places k."""
        word = np.searchsorted(self.ones, k, side="right")
        before = np.where(word > 0, self.ones[word - 1], 0)
        spread = np.unpackbits(self.high[word].view(np.uint8).reshape(len(k), 8), axis=1, bitorder="little")
        bit = (np.cumsum(spread, axis=1) > (k - before)[:, None]).argmax(axis=1)
        value = (word * 64 + bit - k) << self.bits
        for b in range(self.bits):
            at = k * self.bits + b
            value |= ((self.low[at >> 3] >> (at & 7)) & 1).astype(np.int64) << b
        return value


def boundaries(octets: bytes) -> np.ndarray:
    """Where the code points of UTF-8 begin, and its end."""
    starts = np.flatnonzero((np.frombuffer(octets, np.uint8) & 0xC0) != 0x80)
    return np.append(starts, len(octets)).astype(np.int64)


def by_hash(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def by_content(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def hot_keys(keyed: DataFrame) -> DataFrame:
    """(key, parts) of texts that more than `limit` rows share: HOT, or a MOST-th of all rows if that is more. So they are MOST at most."""
    counts = common.staged(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")))
    limit = max(HOT, (counts.agg(F.sum("rows")).first()[0] or 0) // MOST)
    return F.broadcast(counts.filter(F.col("rows") > limit).select("key", F.ceil(F.col("rows") / limit).alias("parts")))


def index(keyed: DataFrame) -> DataFrame:
    """(key, part, z, verified): an entry for each key and part of rows (key, part, text); z is the text, compressed, and
    verified tells whether all texts of the entry are the same octets."""
    zipped = F.pandas_udf(lambda texts: texts.map(lambda t: zstandard.compress(t.encode(), 3)), "binary")
    groups = keyed.select("key", "part", zipped("text").alias("z")).groupBy("key", "part")
    return groups.agg(F.min("z").alias("z"), (F.min("z") == F.max("z")).alias("verified"))


def seeded(seed: int, doc_id) -> tuple[int, int, int, int]:
    """The first four 32-bit groups of the seed's and the id's SHA-256."""
    return tuple(np.frombuffer(hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()[:16], ">u4").tolist())


def _cut(batches: Iterator[pd.DataFrame], seed: int, tags: tuple[str, ...], rate: int, suffix_first: int) -> Iterator[pd.DataFrame]:
    """Entries with the ids of their documents: the list of an entry is made once, and each document selects in it."""
    p, s, m = marks = [t.encode() for t in tags]
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
    whole = {"prefix_chars": "Int64", "middle_chars": "Int64"}
    out, held = [], 0
    for batch in batches:
        for z, verified, ids in zip(batch.z, batch.verified, batch.ids, strict=True):
            if not verified:
                raise ValueError("two texts share a key; group by their content (key=by_content)")
            octets = zstandard.decompress(z)
            starts = boundaries(octets)
            n, places, tagged = len(starts) - 1, EliasFano(*EliasFano.packed(starts)), any(x in octets for x in marks)
            h = [seeded(seed, x["id"]) for x in ids]
            cuts = np.sort(np.array([(a % (n + 1), b % (n + 1)) for a, b, _, _ in h], np.int64), axis=1)
            at = places.select(cuts.ravel()).reshape(cuts.shape)
            for x, (_, _, c, d), (i, j), (a, b) in zip(ids, h, cuts.tolist(), at.tolist(), strict=True):
                if not n or tagged or c % 100 >= rate:
                    row = (x["id"], n, "plain", None, None, octets.decode())
                elif d % 100 < suffix_first:
                    row = (x["id"], n, "spm", i, j - i, b"".join((s, octets[b:], p, octets[:a], m, octets[a:b])).decode())
                else:
                    row = (x["id"], n, "psm", i, j - i, b"".join((p, octets[:a], s, octets[b:], m, octets[a:b])).decode())
                for _ in range(x["times"]):
                    out.append(row)
                    held += len(octets) + 200
                    if held > BATCH_BYTES:
                        yield pd.DataFrame(out, columns=names).astype(whole)
                        out, held = [], 0
    if out:
        yield pd.DataFrame(out, columns=names).astype(whole)


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, tags: tuple[str, ...] = TAGS, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, key: Callable[[Column], Column] = by_hash) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): every document's text with its middle moved to the end, or plain."""
    docs = common.identified(docs, id_col).select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    keyed = docs.withColumn("key", key(F.col("text")))
    hot = hot_keys(keyed.select("key"))
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).alias("part")
    ids = keyed.groupBy("key", "id").agg(F.count(F.lit(1)).alias("times")).join(hot, "key", "left")
    ids = ids.groupBy("key", part).agg(F.collect_list(F.struct("id", "times")).alias("ids"))
    # both sides are dealt by key and part when they are grouped, so the texts aren't moved again
    entries = index(keyed.join(hot, "key", "left").select("key", part, "text")).join(ids, ["key", "part"])
    schema = f"id {dict(docs.dtypes)['id']}, n long, form string, prefix_chars long, middle_chars long, output string"
    return entries.select("z", "verified", "ids").mapInPandas(lambda b: _cut(b, seed, tags, rate, suffix_first), schema)


def restored(output: Column, form: Column, tags: tuple[str, ...] = TAGS) -> Column:
    """The text that an output was made from."""
    part = F.split(output, "|".join(f"\\Q{t}\\E" for t in tags), -1)
    at = lambda *i: F.concat(*[F.get(part, F.lit(x)) for x in i])
    return F.when(form == "psm", at(1, 3, 2)).when(form == "spm", at(2, 3, 1)).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    back = F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return transformed(docs).select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), back)


_H = lambda i: f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT"

OP12_SQL = f"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents WHERE doc_id IS NOT NULL),
cuts AS (SELECT *, least({_H(0)} % (n + 1), {_H(1)} % (n + 1)) AS a, greatest({_H(0)} % (n + 1), {_H(1)} % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_H(2)} % 100 >= {RATE} THEN 'plain' WHEN {_H(3)} % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM hashed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256, sha256(t) AS restored_sha256
FROM cuts"""
