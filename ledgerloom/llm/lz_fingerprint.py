"""Lempel-Ziv phrase fingerprints (Raff and Nicholas, "An Alternative to NCD for Large Sequences", 2017).

A text is parsed into dictionary phrases: the shortest piece not yet in the dictionary enters it and the
parse goes on behind it. The phrases are hashed and the set is kept as a one-permutation minimum-hash
signature of SLOTS slots; the share of equal slots estimates the Jaccard likeness of two phrase sets,
which follows how well one text's dictionary compresses the other.

Cases: a null text counts as empty; an empty text has no phrases and the signature of all ones, so two
empty texts are alike to 1.0; equal texts have equal fingerprints; rows without an id take no part; rows
that repeat an id stand in the order of their texts; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import common

#: Slots of a signature, a power of two, and bits kept of each slot's smallest hash.
SLOTS, SLOT_BITS = 64, 16
#: Most ranges of doc_id; larger tables have longer ranges, which tasks stream through.
RANGES = 16_384
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 14, 1 << int(n).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        steps = np.ones((2, size), np.uint64)
        steps[:, 1:] = np.array([[_BASE], [inverse]], np.uint64)
        _powers[:] = np.cumprod(steps, axis=1, dtype=np.uint64)
    return _powers[0], _powers[1]


def _mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def parse(phrases: dict[str, None], begun: str, text: str) -> str:
    """Parse on through text; phrases gets the new ones in order. Returns the phrase still open."""
    for c in text:
        begun += c
        if begun not in phrases:
            phrases[begun] = None
            begun = ""
    return begun


def phrase_hashes(text: str, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of the phrases, with those lengths, that text begins with."""
    if not len(lengths):
        return np.empty(0, np.uint64)
    ends = np.cumsum(lengths)
    codes = np.frombuffer(text[: int(ends[-1])].encode("utf-32-le"), np.uint32).astype(np.uint64)
    up, down = _tables(len(codes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * up[: len(codes)], dtype=np.uint64)])
    starts = ends - lengths
    return _mix((sums[ends] - sums[starts]) * down[starts] + lengths.astype(np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash of each slot; a slot that got none borrows from the next that did, going round."""
    if not len(hashes):
        return np.full(SLOTS, (1 << SLOT_BITS) - 1, np.uint16)
    shift = 64 - SLOTS.bit_length() + 1
    h = np.sort(hashes)
    edges = np.searchsorted(h, np.arange(SLOTS, dtype=np.uint64) << np.uint64(shift))
    full = np.append(edges[1:], len(h)) > edges
    rest = (h[np.minimum(edges, len(h) - 1)] >> np.uint64(shift - SLOT_BITS)).astype(np.uint16)
    if not full.all():
        have = np.flatnonzero(full)
        source = have[np.searchsorted(have, np.arange(SLOTS)) % len(have)]
        rest = rest[source] + (((source - np.arange(SLOTS)) % SLOTS) * 0x9E37).astype(np.uint16)
    return rest


def to_hex(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprint(text: str | None) -> str:
    phrases: dict[str, None] = {}
    parse(phrases, "", text or "")
    return to_hex(signature(phrase_hashes(text or "", np.fromiter(map(len, phrases), np.int64, len(phrases)))))


def with_fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """docs and their fingerprints, without a shuffle."""
    return docs.withColumn(out_col, F.pandas_udf(lambda texts: texts.map(fingerprint), StringType())(F.col(text_col)))


def _both(text: str, other: str) -> tuple[int, str, np.ndarray, np.ndarray]:
    """Code points and edited text's SHA-256; signatures of text and of its edited form, which share the parse of the first half."""
    n, half = len(text), len(text) // 2
    edited = text[: n - half] + other[:half]
    phrases: dict[str, None] = {}
    begun = parse(phrases, "", text[: n - half])
    shared = len(phrases)
    parse(phrases, begun, text[n - half :])
    names = list(phrases)
    lengths = np.fromiter(map(len, names), np.int64, len(names))
    own = phrase_hashes(text, lengths)
    for x in names[shared:]:
        del phrases[x]
    parse(phrases, begun, edited[n - half :])
    changed = np.fromiter(map(len, phrases), np.int64, len(phrases))
    return n, hashlib.sha256(edited.encode()).hexdigest(), signature(own), signature(phrase_hashes(edited, changed))


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by bucket, doc_id falling; the last of a bucket is the guest whose text the row before it needs."""
    held = None  # (bucket, doc_id, text) whose successor hasn't come
    waiting = None  # the finished row whose near_next needs the successor's signature
    for batch in batches:
        out = []
        for bucket, doc_id, text, guest in zip(batch.bucket, batch.doc_id, batch.text, batch.guest, strict=True):
            if held and held[0] == bucket:
                n, sha, own, edited = _both(held[2], text)
                if waiting:
                    out.append((*waiting[:-1], likeness(waiting[-1], own)))
                waiting = (held[1], n, sha, to_hex(own), to_hex(edited), likeness(own, edited), own)
            if guest:
                if waiting:
                    phrases: dict[str, None] = {}
                    parse(phrases, "", text)
                    end = signature(phrase_hashes(text, np.fromiter(map(len, phrases), np.int64, len(phrases))))
                    out.append((*waiting[:-1], likeness(waiting[-1], end)))
                held = waiting = None
            else:
                held = (bucket, doc_id, text)
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _SCHEMA.split(", ")])


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many bounds lie below value, by their blocks' first bounds and then one block: two short searches."""
    if not bounds:
        return F.lit(0)
    size = max(1, round(len(bounds) ** 0.5))
    blocks = [bounds[i : i + size] for i in range(0, len(bounds), size)]
    below = lambda edges: F.size(F.filter(edges, lambda e: e < value))
    block = F.greatest(below(F.array(*[F.lit(x[0]) for x in blocks])) - 1, F.lit(0))
    inner = F.get(F.array(*[F.array(*map(F.lit, x)) for x in blocks]), block)
    return (block * size + below(inner)).cast("int")


def edit_chain(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likeness and that to the next document's.

    The next document is the one with the next smaller doc_id, after the smallest the largest. Ranges of
    doc_id are dealt out, one shuffle of the texts; a range gets a copy of the first row of the next one,
    so that what the driver holds is a bound and a first id for each range.
    """
    spark = docs.sparkSession
    rows = common.identified(docs, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = common.partitions(spark)
    ranges = min(4 * n, RANGES)
    bounds = sorted({int(x) for x in rows.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges)})
    rows = rows.withColumn("bucket", _bucket(F.col("doc_id"), bounds))
    firsts = {r.bucket: r.first for r in rows.groupBy("bucket").agg(F.max("doc_id").alias("first")).collect()}
    if not firsts:
        return spark.createDataFrame([], _SCHEMA)
    order = sorted(firsts, reverse=True)
    after = [(firsts[order[(i + 1) % len(order)]], b) for i, b in enumerate(order)]
    # one row for each range, so its size is bounded by the number of ranges
    guests = F.broadcast(spark.createDataFrame(after, "doc_id long, into int"))
    chosen = rows.drop("bucket").join(guests, "doc_id").groupBy("doc_id", "into").agg(F.min("text").alias("text"))
    both = rows.withColumn("guest", F.lit(False)).unionByName(chosen.select("doc_id", "text", F.col("into").alias("bucket"), F.lit(True).alias("guest")))
    dealt = both.repartition(n, "bucket").sortWithinPartitions("bucket", "guest", F.desc("doc_id"), "text")
    return dealt.mapInPandas(_chain, _SCHEMA)


def op10_lz_fingerprint(spark, sf_dir):
    return edit_chain(common.table(spark, sf_dir, "documents"))
