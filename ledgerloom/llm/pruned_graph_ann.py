"""Approximate nearest neighbours by robust-pruned directed graphs (Subramanya et al., "DiskANN", 2019).

Rows are dealt into shards by a hash of their id: of about SHARD_ROWS, from SHARDS of them on growing with the rows up to
SHARD_MOST, since every query goes to every shard; the rows alone say how many, no setting does. In each shard a directed graph is grown:
from a random graph, greedy searches for each vector propose neighbours, and relaxed distance pruning keeps
one only if no kept neighbour is RELAX times nearer to it than the vector itself, so that edges point in
diverse directions; reverse edges are added and pruned alike. The index is a table of vectors and edges. A
query is searched by beam in every shard's graph, and the shards' finds are merged. Queries meet a shard in chunks of about
CHUNK, each with the shard's index, so that no group grows with the number of queries.

Distances in the graph are of single precision; what the beams find is ranked by double-precision distances
of the original vectors. Equal vectors are one node that carries its K + 1 smallest ids: no larger id can
come among the K nearest, so nothing is lost.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an
id; vectors of different lengths are never compared; a query with fewer than K candidates gets all; ties
go to the smaller id; rows that repeat an id and its vector count once; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 10
SHARD_ROWS, SHARD_MOST, SHARDS = 5000, 20_000, 1000
#: Queries in a group, aimed at.
CHUNK = 20_000
#: Edges of a node, beam of the searches that build and that answer, and the two rounds' relaxations.
DEGREE, BUILD_BEAM, BEAM, RELAX = 32, 64, 128, (1.0, 1.2)
#: Vectors searched at a time, and beam entries expanded at a time.
BATCH, WIDTH = 512, 4
#: Distances between candidates that pruning holds at a time.
PAIRS = 4_000_000


def _squares(x: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of each q to its own list of places; places of -1 are infinitely far."""
    d = x[np.maximum(at, 0)] - q[:, None, :]
    return np.where(at < 0, np.float32(np.inf), np.einsum("ijk,ijk->ij", d, d))


def search(x: np.ndarray, edges: np.ndarray, entry: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy beam search for a batch of queries: (places, squared distances) of each beam, nearest first; -1 where it isn't full."""
    n, rows = len(q), np.arange(len(q))[:, None]
    beam = min(beam, len(x))
    seen = np.zeros((n, len(x) + 1), bool)  # the last column stands for -1
    seen[:, -1] = True
    seen[:, entry] = True
    at = np.full((n, beam), -1, np.int64)
    at[:, 0] = entry
    far = _squares(x, q, at)
    done = at < 0
    while True:
        order = np.argsort(np.where(done, np.inf, far), axis=1, kind="stable")[:, :WIDTH]
        go = ~np.take_along_axis(done, order, 1)
        if not go.any():
            return at, far
        np.put_along_axis(done, order, True, 1)
        new = np.where(go[:, :, None], edges[np.maximum(np.take_along_axis(at, order, 1), 0)], -1).reshape(n, -1)
        new = np.sort(new, axis=1)
        fresh = ~seen[rows, new]
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        new = np.where(fresh, new, -1)
        seen[rows, new] = True
        all_at = np.concatenate([at, new], axis=1)
        all_far = np.concatenate([far, _squares(x, q, new)], axis=1)
        all_done = np.concatenate([done, new < 0], axis=1)
        best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        at, far, done = (np.take_along_axis(a, best, 1) for a in (all_at, all_far, all_done))
        done |= at < 0


def prune(x: np.ndarray, places: np.ndarray, candidates: np.ndarray, relax: float) -> np.ndarray:
    """DEGREE diverse neighbours of each place, out of its candidates (-1: none)."""
    candidates = np.sort(np.where(candidates == places[:, None], -1, candidates), axis=1)
    again = np.zeros_like(candidates, bool)
    again[:, 1:] = candidates[:, 1:] == candidates[:, :-1]
    far = _squares(x, x[places], np.where(again, -1, candidates))
    order = np.argsort(far, axis=1, kind="stable")
    candidates, far = np.take_along_axis(candidates, order, 1), np.take_along_axis(far, order, 1)
    v = x[np.maximum(candidates, 0)]
    norms = np.einsum("ijk,ijk->ij", v, v)
    between = norms[:, :, None] + norms[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
    alive, out = np.isfinite(far), np.full((len(places), DEGREE), -1, np.int64)
    lines = np.arange(len(places))
    for slot in range(DEGREE):
        first = alive.argmax(axis=1)
        have = alive[lines, first]
        if not have.any():
            break
        out[have, slot] = candidates[lines, first][have]
        alive[lines, first] = False
        alive &= ~((relax * relax * between[lines, first] <= far) & have[:, None])
    return out


def build(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Edges of a shard's graph (-1: none) and the node at which searches begin, that nearest the mean."""
    n, random = len(x), np.random.default_rng(42)
    middle = x.mean(axis=0)
    entry = int(((x - middle) ** 2).sum(axis=1).argmin())
    edges = random.integers(0, n, (n, DEGREE))
    edges[:, 0] = (np.arange(n) + 1) % n  # so that every node can be reached
    edges = np.where(edges == np.arange(n)[:, None], -1, edges)
    for relax in RELAX:
        order = random.permutation(n)
        for i in range(0, n, BATCH):
            places = order[i : i + BATCH]
            found, _ = search(x, edges, entry, x[places], BUILD_BEAM)
            edges[places] = prune(x, places, np.concatenate([found, edges[places]], axis=1), relax)
            source, target = np.repeat(places, DEGREE), edges[places].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            targets, first, count = np.unique(target[by], return_index=True, return_counts=True)
            by_count = np.argsort(count, kind="stable")  # nodes that many found have many candidates: few of those at a time
            while len(by_count):
                width = DEGREE + int(count[by_count[: max(1, BATCH // 8)]].max())
                now, by_count = np.split(by_count, [max(1, min(BATCH // 8, PAIRS // width**2))])
                extra = np.full((len(now), int(count[now].max())), -1, np.int64)
                for k in range(extra.shape[1]):
                    more = count[now] > k
                    extra[more, k] = source[by][first[now][more] + k]
                edges[targets[now]] = prune(x, targets[now], np.concatenate([edges[targets[now]], extra], axis=1), relax)
    return edges, entry


# Spark


def usable(vector: Column) -> Column:
    """Whether every component is finite and one isn't zero."""
    odd = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def valid(vectors: DataFrame) -> DataFrame:
    rows = common.identified(vectors, "vec_id").filter(usable(F.col("embedding")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.float64)


_INDEX = "dim int, shard int, place int, vec_ids array<long>, embedding array<double>, neighbours array<int>, entry boolean"


def _grow(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("low", kind="stable").reset_index(drop=True)
    edges, entry = build(_matrix(rows.embedding).astype(np.float32))
    return pd.DataFrame({"dim": rows.dim, "shard": rows.shard, "place": np.arange(len(rows), dtype=np.int32), "vec_ids": rows.vec_ids, "embedding": rows.embedding, "neighbours": [e[e >= 0].astype(np.int32) for e in edges], "entry": np.arange(len(rows)) == entry})


def shards_of(rows: int, shard_rows: int = SHARD_ROWS) -> int:
    """How many shards so many distinct vectors are dealt into."""
    return max(1, -(-rows // min(max(shard_rows, -(-rows // SHARDS)), max(shard_rows, SHARD_MOST))))


def build_index(vectors: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index, written once: a row for each distinct vector with the ids that have it, of each the k + 1 smallest."""
    rows = valid(vectors).distinct()
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    nodes = rows.withColumn("_nth", nth).filter(F.col("_nth") <= k + 1).groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("vec_ids"))
    nodes = common.staged(nodes.withColumns({"low": F.element_at("vec_ids", 1), "dim": F.size("embedding")}))
    shards = {r["dim"]: shards_of(r["n"], shard_rows) for r in nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length of vector
    count = F.create_map(*[F.lit(v) for x in (shards or {0: 1}).items() for v in x])
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("low"), F.element_at(count, F.col("dim"))).cast("int"))
    # a range a shard: hashes of a few shards would leave tasks idle
    return common.staged(dealt.repartitionByRange(max(1, sum(shards.values())), "dim", "shard").groupBy("dim", "shard").applyInPandas(_grow, _INDEX))


_FOUND = "query_id long, vec_id long, score double"


def _ask(k: int, beam: int):
    def ask(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(queries):
            index = index.sort_values("place")
            exact = _matrix(index.embedding)
            x, edges = exact.astype(np.float32), np.full((len(index), DEGREE), -1, np.int64)
            for row, near in zip(edges, index.neighbours, strict=True):
                row[: len(near)] = near
            entry, ids = int(index.entry.to_numpy().argmax()), index.vec_ids.tolist()
            q = _matrix(queries.embedding)
            for i in range(0, len(q), BATCH):
                found, _ = search(x, edges, entry, q[i : i + BATCH].astype(np.float32), beam)
                for query_id, own, places in zip(queries.query_id.iloc[i : i + BATCH], q[i : i + BATCH], found, strict=True):
                    places = places[places >= 0]
                    score = np.sqrt(((exact[places] - own) ** 2).sum(axis=1))
                    hits = [(s, v) for s, p in zip(score, places, strict=True) for v in ids[p] if v != query_id]
                    out += [(query_id, v, s) for s, v in sorted(hits)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return ask


def nearest(index: DataFrame, queries: DataFrame, k: int = K, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query (vec_id, embedding) but for rows of its own id.

    Every query is sent to each shard of its vector's length; a shard returns k finds a query.
    """
    asked = valid(queries).distinct().select(F.col("vec_id").alias("query_id"), "embedding", F.size("embedding").alias("to_dim"))
    last = {r["dim"]: r["last"] for r in index.groupBy("dim").agg(F.max("shard").alias("last")).collect()}  # a row for each length of vector
    last = F.create_map(*[F.lit(v) for x in (last or {0: 0}).items() for v in x])
    chunks = max(1, -(-asked.count() // CHUNK))
    asked = asked.withColumn("to_chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
    sent = asked.withColumn("_last", F.element_at(last, F.col("to_dim"))).withColumn("to", F.explode(F.sequence(F.lit(0), "_last"))).drop("_last")
    index = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    found = index.groupBy("dim", "shard", "chunk").cogroup(sent.groupBy("to_dim", "to", "to_chunk")).applyInPandas(_ask(k, beam), _FOUND)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_pruned_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return nearest(build_index(vectors), vectors.filter("vec_id % 100 = 0"))
