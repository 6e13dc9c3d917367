"""Near-duplicates by SimHash, compared exactly in tiles with exclusive-or and bit counts.

Every text gets a fingerprint of its word shingles (64 or 128 bits). Distinct fingerprints are sorted by the
bit counts of their 16-bit blocks and cut into tiles. Two fingerprints that differ in at most `radius` bits
have bit counts that differ by at most `radius`, in all and summed over blocks; pairs of tiles, and pairs of
strips within them, whose counts lie further apart are skipped, the others are compared in full with numpy.
A tile is a file in the shared folder, so that pairs of tiles are dealt out by name and nothing but names and
links is shuffled. Each tile pair returns only the links that join what wasn't joined within it, so that a
large group of near copies gives a link for each member and tile, not all its pairs. Components are found by repeated contraction
of the links, written to the shared folder each round.

A fingerprint tells likeness only roughly. `keep_one`, which asks for a likeness of shingle sets, so links by these sets themselves
(`alike_sets`); its links have components of the same kind.

Cases: null text counts as empty; texts without words have fingerprint zero and are linked like any other;
texts with fewer words than a shingle have one shingle; repeated rows and exact copies share a fingerprint and
so a component; rows without an id take no part; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alike_sets, common

#: Fingerprints aimed at for a tile, and those of a strip of a tile.
TILE, STRIP = 8192, 256
RADIUS = 4


def shingle_hashes(text: str | None, words: int, bits: int) -> np.ndarray:
    """Rows of bits / 64 unsigned words: XXH64, or XXH3 of 128 bits, of every shingle."""
    parts = (text or "").encode().lower().split()  # bytes: only A-Z and the six ASCII spaces are meant
    if not parts:
        return np.empty((0, bits // 64), np.uint64)
    line, k = b" ".join(parts), min(words, len(parts))
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    spans = zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    if bits == 64:
        digest = xxhash.xxh64_intdigest
        return np.array([digest(line[a:b], 42) for a, b in spans], np.uint64).reshape(-1, 1)
    wide = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([wide(line[a:b], 42) for a, b in spans]), ">u8").astype(np.uint64).reshape(-1, 2)


def simhash(hashes: np.ndarray) -> bytes:
    """Big-endian; a bit is 1 if it is set in over half the hashes."""
    n, width = hashes.shape
    ones = np.zeros(64 * width, np.int64)
    for i in range(0, n, 4096):
        octets = hashes[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8 * width)
        ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(words: int, bits: int, text_col: str = "text") -> Column:
    return F.pandas_udf(lambda texts: pd.Series([simhash(shingle_hashes(t, words, bits)) for t in texts], dtype=object), "binary")(F.col(text_col))


# Tiles


def block_counts(prints: np.ndarray) -> np.ndarray:
    """Bits set in each 16-bit block."""
    return np.bitwise_count(np.ascontiguousarray(prints).view(np.uint16).reshape(len(prints), -1)).astype(np.int16)


def apart(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """Least difference of block counts, summed over blocks, between boxes: a bound on the bits that differ."""
    return np.maximum(np.maximum(low - other_high, other_low - high), 0).sum(axis=-1)


def join_up(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the components of a[i] and b[i]; a label is the least member's place."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b = a[differ], b[differ]
        x, y = x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def strips(prints: np.ndarray) -> list[tuple[slice, np.ndarray, np.ndarray]]:
    counts = block_counts(prints)
    return [(slice(i, min(i + STRIP, len(prints))), counts[i : i + STRIP].min(axis=0), counts[i : i + STRIP].max(axis=0)) for i in range(0, len(prints), STRIP)]


class Tile(NamedTuple):
    prints: np.ndarray
    label: np.ndarray


def link(a: Tile, b: Tile, label: np.ndarray, radius: int, same: bool) -> np.ndarray:
    """Labels over the places of a and then b, after linking those at most radius bits apart."""
    a_prints, b_prints = a.prints, b.prints
    right = strips(b_prints)
    for i, (rows, low, high) in enumerate(strips(a_prints)):
        for j, (cols, other_low, other_high) in enumerate(right):
            if same and j < i or apart(low, high, other_low, other_high) > radius:
                continue
            differ = np.bitwise_count(a_prints[rows, None, 0] ^ b_prints[None, cols, 0])
            for w in range(1, a_prints.shape[1]):
                differ = differ + np.bitwise_count(a_prints[rows, None, w] ^ b_prints[None, cols, w])
            x, y = np.nonzero(differ <= radius)
            x, to = x + rows.start, y + cols.start + (0 if same else len(a_prints))
            apart_yet = label[x] != label[to]
            if apart_yet.any():
                label = join_up(label, x[apart_yet], to[apart_yet])
    return label


def _save(uri: str, tile: Tile) -> None:
    system, path = pafs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    data = io.BytesIO()
    np.savez(data, **tile._asdict())
    with system.open_output_stream(path) as out:
        out.write(data.getbuffer())


def _load(uri: str) -> Tile:
    system, path = pafs.FileSystem.from_uri(uri)
    with system.open_input_stream(path) as file:
        held = np.load(io.BytesIO(file.read()))
        return Tile(**{k: held[k] for k in Tile._fields})._replace(label=held["label"].astype(np.int64))


_HEADS = "tile string, least int, most int, low array<int>, high array<int>"


def _tiles(folder: str, radius: int):
    """A file, named uniquely so that repeated tasks don't meet, and a row for each partition of sorted fingerprints."""

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [batch for batch in batches if len(batch)]
        if held:
            rows = pd.concat(held)
            prints = np.frombuffer(b"".join(rows.fp), ">u8").astype(np.uint64).reshape(len(rows), -1)
            prints = prints[np.lexsort(block_counts(prints).T[::-1])]
            for i in range(0, len(prints), 2 * TILE):  # ranges are cut from a sample, so one may be long
                p = np.ascontiguousarray(prints[i : i + 2 * TILE])
                c = block_counts(p)
                tile = Tile(p, np.arange(len(p)))
                label = link(tile, tile, tile.label, radius, True)
                total, name = c.sum(axis=1), f"{folder}/tile-{uuid.uuid4().hex}.npz"
                _save(name, tile._replace(label=label.astype(np.uint32)))
                yield pd.DataFrame({"tile": [name], "least": [int(total.min())], "most": [int(total.max())], "low": [c.min(axis=0).tolist()], "high": [c.max(axis=0).tolist()]})

    return tiles


def _edges(prints: np.ndarray, places: np.ndarray, targets: np.ndarray) -> pd.DataFrame:
    octets = prints.astype(">u8").tobytes()
    size = 8 * prints.shape[1]
    at = lambda i: octets[i * size : (i + 1) * size]
    return pd.DataFrame({"a": [at(i) for i in places.tolist()], "b": [at(i) for i in targets.tolist()]}, dtype=object)


def _within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for name in batch.tile:
            tile = _load(name)
            moved = np.flatnonzero(tile.label != np.arange(len(tile.label)))
            yield _edges(tile.prints, moved, tile.label[moved])


def _between(radius: int):
    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Tile] = {}
        for batch in batches:
            for name, other in zip(batch.tile, batch.tile2, strict=True):
                held = {k: held[k] if k in held else _load(k) for k in (name, other)}
                a, b = held[name], held[other]
                start = np.concatenate([a.label, b.label + len(a.prints)])
                label = link(a, b, start.copy(), radius, False)
                roots = np.flatnonzero(start == np.arange(len(start)))
                moved = roots[label[roots] != roots]
                yield _edges(np.concatenate([a.prints, b.prints]), moved, label[moved])

    return between


def links(prints: DataFrame, bits: int, radius: int, folder: str) -> DataFrame:
    """From distinct fingerprints (fp) the links (a, b) that span every component. They are read from tiles in folder."""
    spark, width = prints.sparkSession, bits // 64
    n = prints.count()
    tiles = max(-(-n // TILE), min(-(-n // (TILE // 4)), common.partitions(spark)), 1)
    # Sorted by bit counts of the whole, then of the first blocks
    count = lambda a, b: F.length(F.regexp_replace(F.conv(F.hex(F.substring("fp", a, b)), 16, 2), "0", ""))
    whole = sum((count(i, 4) for i in range(5, 8 * width, 4)), count(1, 4))
    ranged = prints.withColumns({"_n": whole, "_c1": count(1, 2), "_c2": count(3, 2)}).repartitionByRange(tiles, "_n", "_c1", "_c2", "fp")
    heads = common.staged(ranged.select(*prints.columns).mapInPandas(_tiles(f"{folder}/tiles", radius), _HEADS), f"{folder}/heads")
    # Tiles meet at a bit count: those of a tile, and from radius below to radius above
    own = heads.withColumn("at", F.explode(F.sequence("least", "most")))
    near = heads.withColumn("at", F.explode(F.sequence(F.col("least") - radius, F.col("most") + radius)))
    near = near.select("at", *[F.col(c).alias(f"{c}2") for c in ("tile", "low", "high")])
    gap = F.aggregate(F.zip_with(F.zip_with("low", "high2", lambda x, y: x - y), F.zip_with("low2", "high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0))), F.lit(0), lambda s, x: s + x)
    met = own.join(near, "at").filter(F.col("tile") < F.col("tile2")).filter(gap <= radius)
    pairs = met.select("tile", "tile2").distinct().repartition(max(common.partitions(spark), tiles))
    across = pairs.sortWithinPartitions("tile").mapInPandas(_between(radius), "a binary, b binary")
    return heads.select("tile").mapInPandas(_within, "a binary, b binary").unionByName(across)


# Components


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link, by contraction: each round every node moves to its least
    neighbour's own choice, until no link is left. The number of rounds grows with the logarithm of a component's width."""
    edges = common.staged(edges.filter("a <> b"))
    moved: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = common.staged(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("to")))
        jump = step.select(F.col("a").alias("to"), F.col("to").alias("far"))
        step = common.staged(step.join(jump, "to", "left").select("a", F.coalesce("far", "to").alias("to")))
        ends = step.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        if moved is None:
            moved = step.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            moved = common.staged(moved.join(step.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        edges = common.staged(edges.join(step, "a").join(ends, "b").select(F.col("to").alias("a"), F.col("to_b").alias("b")).filter("a <> b").distinct())
    if moved is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return moved


def _hashed(docs: DataFrame) -> DataFrame:
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    return common.identified(docs, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), text_hash.alias("text_hash"), "text")


def _owned(prints: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """(fp, root, component_id): root names the component, component_id is its smallest doc_id."""
    named = prints.select(*dict.fromkeys(["fp", node]), "first").join(roots.withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return common.staged(named.select("fp", "root").join(least, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 64, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id reachable by links."""
    folder = common.shared_dir(docs.sparkSession)
    rows = common.staged(_hashed(docs).select("doc_id", fingerprints(words, bits).alias("fp")))
    prints = common.staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(prints.drop("first"), bits, radius, folder))
    common.remove(docs.sparkSession, folder)  # the links are written
    found = rows.join(_owned(prints, roots, "fp"), "fp")
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def alike_members(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, root, component_id) by links of texts whose sets of shingles are alike."""
    folder = common.shared_dir(docs.sparkSession)
    sets = f"{folder}/sets"
    rows = common.staged(_hashed(docs).mapInPandas(alike_sets.with_sets(sets), f"doc_id long, text_hash long, fp binary, {alike_sets.PLACE}"))
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(F.struct("n", "file", "at")).alias("_s")).select("fp", "first", "_s.*")
    prints = common.staged(prints.sortWithinPartitions("file", "at").withColumn("id", F.monotonically_increasing_id()))
    roots = components(alike_sets.links(prints, folder, sets, components))
    common.remove(docs.sparkSession, folder)  # the links are written; sets are as large as the texts
    return rows.select("doc_id", "text_hash", "fp").join(_owned(prints, roots, "id"), "fp").drop("fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without copies and near copies (five-word shingles alike to 0.8 or more): of each group one row stays, with all
    columns: that with the smallest id and, where texts of one group share that id, the text of the smallest hash.
    Rows equal in id and text are copies; rows of one id whose texts aren't near each other stay each; rows without an id go."""
    own_hash, kept_id, kept_hash = common.unused(docs, "text_hash", "kept_id", "kept_hash")
    first = alike_members(docs).filter("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("x"))
    kept = first.select(F.col("x.doc_id").alias(kept_id), F.col("x.text_hash").alias(kept_hash))
    own = docs.withColumn(own_hash, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = (F.col("doc_id").cast("long") == F.col(kept_id)) & (F.col(own_hash) == F.col(kept_hash))
    return own.join(kept, same, "left_semi").dropDuplicates(["doc_id", own_hash]).drop(own_hash)


def op4_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
