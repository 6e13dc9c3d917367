"""Resharding by minimum-cost flow: from old shard sizes and new capacities to the fewest bytes moved.

Old shards supply their bytes, new shards take up to their capacity, and a byte costs nothing where it is
and 1 elsewhere. The flow between at most a few hundred shards is solved on the driver; its answer says how
many bytes of each old shard go where. Every old shard is a line of blocks (rows by hash of their id, about
block_bytes each); running sums of bytes along the line give each row its place, and the flow's cuts of the
line give it its new shard. Only files of shards that gain or lose rows are rewritten.

The law is `bytes`: shard sizes are equal to within a row at each cut. Copies of a text are rows like any
other, so that a group holding a third of all rows is spread as the bytes ask.

Cases: null text has no bytes (its row still counts 8); rows without an id take no part; repeated rows stay
one row each; ties in order are between rows alike in id, text checksum and size, which are interchangeable;
columns named shard or slot are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 24
#: Aimed bytes of a block: about the text that one task handles.
BLOCK_BYTES = 16 << 20


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard at the least total cost(i, j), by successive shortest paths.

    Capacities must hold the supply. Dijkstra with potentials; each path is augmented by its bottleneck.
    """
    n, m = len(supply), len(capacity)
    source, sink, size = n + m, n + m + 1, n + m + 2
    graph: list[list[int]] = [[] for _ in range(size)]
    to, left, price = [], [], []

    def edge(a: int, b: int, room: int, c: int) -> None:
        for x, y, r, p in ((a, b, room, c), (b, a, 0, -c)):
            graph[x].append(len(to))
            to.append(y), left.append(r), price.append(p)

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
    first = len(to)
    for i in range(n):
        for j in range(m):
            edge(i, n + j, sum(supply), cost(i, j))
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    potential, rest = [0] * size, sum(supply)
    while rest > 0:
        far, via = [None] * size, [-1] * size
        far[source] = 0
        queue = [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for e in graph[a]:
                if left[e] > 0 and (far[to[e]] is None or d + price[e] + potential[a] - potential[to[e]] < far[to[e]]):
                    far[to[e]], via[to[e]] = d + price[e] + potential[a] - potential[to[e]], e
                    heapq.heappush(queue, (far[to[e]], to[e]))
        if far[sink] is None:
            raise ValueError("the capacities don't hold the supply")
        potential = [p + (f or 0) for p, f in zip(potential, far, strict=True)]
        path, b = [], sink
        while b != source:
            path.append(via[b])
            b = to[via[b] ^ 1]
        by = min(rest, *(left[e] for e in path))
        for e in path:
            left[e] -= by
            left[e ^ 1] += by
        rest -= by
    return {(i, j): left[(first + 2 * (i * m + j)) ^ 1] for i in range(n) for j in range(m) if left[(first + 2 * (i * m + j)) ^ 1]}


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def plan(sizes: list[int], capacity: list[int]) -> tuple[list[list[tuple[int, int]]], set[int]]:
    """Of each old shard the stretches (end, new shard) of its line, those that stay first; the affected new shards."""
    flow = min_cost_flow(sizes, capacity, lambda i, j: int(i != j))
    lines, affected = [], set()
    for i in range(len(sizes)):
        at, line = 0, []
        for j in sorted((j for k, j in flow if k == i), key=lambda j: (j != i, j)):
            at += flow[i, j]
            line.append((at, j))
            if i != j:
                affected |= {i, j}
        lines.append(line or [(0, i if i < len(capacity) else 0)])
    return lines, {j for j in affected if j < len(capacity)} | {i for i in range(len(sizes)) if i >= len(capacity)}


def _nested(values: list[list[int]], kind: str) -> Column:
    """At most shards x shards numbers of the plan, as a literal."""
    return F.array(*[F.array(*[F.lit(x).cast(kind) for x in v]) for v in values])


def assign(docs: DataFrame, old: Column, shards: int = SHARDS, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, set[int]]:
    """docs with shard and slot (gapless from 0 in each shard), and the shards whose files change.

    old gives each row's old shard, from 0. Texts are shuffled once; the passes before read only sizes.
    """
    # a row's own columns are packed, so that none can clash with those used here
    size, crc = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8, F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    rows = common.identified(docs, "doc_id")
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), "doc_id", old.cast("int").alias("_old"), size.alias("_size"), crc.alias("_crc"))
    found = {r._old: r.b for r in rows.groupBy("_old").agg(F.sum("_size").alias("b")).collect()}
    sizes = [found.get(i, 0) for i in range(max([shards - 1, *found]) + 1)]
    lines, affected = plan(sizes, even(sum(sizes), shards))
    blocks = F.array(*[F.lit(max(1, -(-s // block_bytes))) for s in sizes])
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("doc_id"), F.get(blocks, F.col("_old"))).cast("int"))

    ends, news = _nested([[e for e, _ in x] for x in lines], "long"), _nested([[j for _, j in x] for x in lines], "int")
    in_block = Window.partitionBy("_old", "_block").orderBy("doc_id", "_crc", "_size")

    def placed(df: DataFrame) -> DataFrame:
        """df has _at, the bytes of its shard's blocks before its own."""
        upto = F.sum("_size").over(in_block.rowsBetween(Window.unboundedPreceding, 0))
        df = df.withColumns({"_mid": F.col("_at") + upto - F.floor(F.col("_size") / 2), "_rn": F.row_number().over(in_block)})
        nth = F.size(F.filter(F.get(ends, F.col("_old")), lambda e: e < F.col("_mid")))
        own = F.get(news, F.col("_old"))
        return df.withColumn("_shard", F.get(own, F.least(nth, F.size(own) - 1)))

    narrow = rows.select("doc_id", "_old", "_block", "_size", "_crc")
    before = F.sum("_b").over(Window.partitionBy("_old").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = narrow.groupBy("_old", "_block").agg(F.sum("_size").alias("_b")).withColumn("_at", F.coalesce(before, F.lit(0))).drop("_b")
    cut = placed(narrow.join(starts, ["_old", "_block"])).groupBy("_old", "_block", "_shard").agg(F.count(F.lit(1)).alias("_n"), F.min("_rn").alias("_first"), F.min("_at").alias("_at"))
    ahead = F.sum("_n").over(Window.partitionBy("_shard").orderBy("_old", "_block").rowsBetween(Window.unboundedPreceding, -1))
    cut = cut.withColumn("_base", F.coalesce(ahead, F.lit(0)) - F.col("_first"))
    # at most `shards` entries for each block
    table = common.staged(cut.groupBy("_old", "_block").agg(F.min("_at").alias("_at"), F.map_from_entries(F.collect_list(F.struct("_shard", "_base"))).alias("_bases")))
    out = placed(rows.join(table, ["_old", "_block"]))
    return out.select("_row.*", F.col("_shard").alias("shard"), (F.element_at("_bases", F.col("_shard")) + F.col("_rn")).alias("slot")), affected


def rewrite(docs: DataFrame, old: Column, path: str, shards: int = SHARDS, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, set[int]]:
    """Write the affected shards' files anew under path, a folder a shard; returns all rows of the new layout and the affected shards.

    A task holds one or two blocks, so it writes to few shards' folders.
    """
    moved, affected = assign(docs, old, shards, block_bytes)
    names = sorted(affected)
    moved.filter(F.col("shard").isin(names)).write.partitionBy("shard").parquet(path)
    fresh = docs.sparkSession.read.schema(moved.schema).parquet(path)
    return (fresh if len(names) == shards else fresh.unionByName(moved.filter(~F.col("shard").isin(names)))), affected


def by_source(shards: int = SHARDS) -> Column:
    """The old layout of `documents`: a source's rows lie in one shard."""
    return F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(shards))


def op9_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    layout, _ = rewrite(docs, by_source(), common.shared_dir(spark))
    text = F.coalesce("text", F.lit(""))
    return layout.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
