"""Merkle manifest of a dataset: a tree of hashes a language, one tree over their roots, and a proof for every row.

A row is a leaf, the SHA-256 of its fields, each after its length in octets, so that no two rows read alike. Leaves stand
in order of doc_id in their language; every ARITY nodes become the hash of their joined hex digests until one is left.
Ordered leaves are dealt into blocks of ARITY ** LEVELS, which are arrays of fixed size: `aggregate` over a `sequence` of
levels collapses a block with `transform` and `slice`, all inside Spark's own expressions, and the roots of the blocks are
leaves of the next round. A block holds BLOCK nodes whatever the language, so a language with a third of all rows is as
many small arrays as its rows need. Places in a language come from ranges: rows are sorted in ranges of (language, doc_id),
counted a range, and the counts are summed, so no language is ever one task's.

Cases: each null field is "-", and a null doc_id or language sorts before all others; rows that repeat an id stand in the
order of their leaves, and equal rows are leaves each; other columns are ignored; an empty table gives an empty manifest;
the only row of a table is its own root, and its proof hashes no siblings (the hash of the empty text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Children of a node, and levels that a block collapses.
ARITY, LEVELS = 8, 3
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows up to which a small table (counts a range, roots a language) is sent to all tasks; beyond, it is joined by key.
SENT = 10_000
_PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return digest(F.concat(*map(field, values)))


def collapsed(nodes: Column) -> Column:
    """The level above nodes: the hash of every ARITY of them, of fewer at the end."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), "")))


def levels(nodes: Column, height: Column) -> Column:
    """nodes and the height levels above them, lowest first."""
    steps = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(nodes), lambda held, _: F.concat(held, F.array(collapsed(F.element_at(held, -1)))))


def height(n: Column) -> Column:
    """Levels above n nodes until one is left; n is a long."""
    return F.size(F.filter(F.array(*[F.lit(ARITY**i) for i in range(21)]), lambda most: most < n))


def siblings(tree: Column, steps: Column, i: Column) -> Column:
    """What stands left and right of the i-th node, and of those above it, in each one's run: lowest level first."""

    def at(level: Column) -> Column:
        place = F.call_function("shiftright", i, level * (ARITY.bit_length() - 1))
        run = F.slice(F.element_at(tree, level + 1), place - place % ARITY + 1, F.lit(ARITY))
        k = place % ARITY
        return F.struct(F.array_join(F.slice(run, F.lit(1), k), "").alias("left"), F.array_join(F.slice(run, k + 2, F.lit(ARITY)), "").alias("right"))

    return F.when(steps > 0, F.transform(F.sequence(F.lit(0), steps - 1), at)).otherwise(F.array().cast(_PATH))


def folded(node: Column, path: Column) -> Column:
    """The root that node leads to along path."""
    return F.aggregate(path, node, lambda below, s: digest(F.concat(s["left"], below, s["right"])))


def proof(path: Column) -> Column:
    """The hash of all siblings on path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def _sent(small: DataFrame) -> DataFrame:
    """small, which is staged, as a broadcast if its counted rows allow it."""
    return F.broadcast(small) if small.limit(SENT + 1).count() <= SENT else small


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows, which are staged, with `pos`, their place from 0 in their group's order, and `n`, the group's rows."""
    dealt = rows.repartitionByRange(common.partitions(rows.sparkSession), group, *order).sortWithinPartitions(group, *order)
    dealt = common.staged(dealt.withColumn("_m", F.monotonically_increasing_id()))
    # the id counts rows from a task's first, above the task's number shifted by 33 bits
    at = dealt.withColumn("_part", F.shiftright("_m", 33)).withColumn("_row", F.col("_m") % (1 << 33))
    own = Window.partitionBy(group)
    counts = at.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_c"), F.min("_row").alias("_first"))
    counts = counts.withColumn("n", F.sum("_c").over(own)).withColumn("_before", F.sum("_c").over(own.orderBy("_part")) - F.col("_c"))
    counts = common.staged(counts.select(group, "_part", "n", (F.col("_before") - F.col("_first")).alias("_shift")))
    return at.join(_sent(counts), [group, "_part"]).withColumn("pos", F.col("_row") + F.col("_shift")).drop("_m", "_part", "_row", "_shift")


def blocks(rows: DataFrame) -> DataFrame:
    """(grp, block, n, steps, held): rows (grp, pos, n, node, carried) in arrays of BLOCK, in order; n counts the group's rows."""
    dealt = rows.groupBy("grp", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "node", "carried"))).alias("held"))
    return common.staged(dealt.withColumn("steps", F.least(height(F.col("n")), F.lit(LEVELS))))


def _tree(held: DataFrame) -> DataFrame:
    return held.withColumn("tree", levels(F.transform("held", lambda x: F.lower(F.hex(x["node"]))), F.col("steps")))


def climbed(held: DataFrame) -> DataFrame:
    """(grp, block, up, top): of each of these blocks the siblings above its root, and its group's root."""
    tops = _tree(held).select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.unhex(F.get(F.element_at("tree", -1), F.lit(0))).alias("node"), F.lit(None).cast("string").alias("carried"))
    if held.filter(F.col("n") > BLOCK).isEmpty():
        return common.staged(tops.select("grp", F.col("pos").alias("block"), F.array().cast(_PATH).alias("up"), F.lower(F.hex("node")).alias("top")))
    above = blocks(tops)
    return common.staged(paths(above, climbed(above)).select("grp", F.col("pos").alias("block"), F.col("path").alias("up"), "top"))


def paths(held: DataFrame, up: DataFrame) -> DataFrame:
    """(grp, pos, node, carried, path, top) of every node of the blocks, path from the node to its group's root, top.

    A block's paths are made inside one array, so that no row carries the block's tree.
    """

    def row(x: Column, i: Column) -> Column:
        path = F.concat(siblings(F.col("tree"), F.col("steps"), i), F.col("up"))
        return F.struct(x["pos"].alias("pos"), F.lower(F.hex(x["node"])).alias("node"), x["carried"].alias("carried"), path.alias("path"))

    each = _tree(held).join(up, ["grp", "block"])
    return each.select("grp", "top", F.inline(F.transform("held", row)))


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, carried: Column | None = None) -> DataFrame:
    """(id, leaf, path, subroot, root, carried): every row's leaf and the siblings from it to the root of all.

    path starts in the language's tree and ends in that of the languages. carried, a text or binary of the row, comes along.
    """
    # nulls before all others, bytewise: "" and "=" before the name
    grp = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    carried = F.lit(None).cast("string") if carried is None else carried
    rows = docs.select(grp.alias("grp"), F.col(id_col).alias("id"), F.unhex(leaf([F.col(c) for c in fields])).alias("node"), carried.alias("_c"))
    rows = common.staged(rows)
    placed = ranked(rows, "grp", ["id", "node", "_c"])
    held = blocks(placed.select("grp", "pos", "n", "node", F.struct("id", F.col("_c").alias("carried")).alias("carried")))
    up = climbed(held)
    tops = up.filter("block = 0").select(F.lit(0).alias("all"), F.col("grp").alias("name"), F.unhex("top").alias("node"))
    order = ranked(common.staged(tops), "all", ["name"])
    roots = blocks(order.select(F.col("all").cast("string").alias("grp"), "pos", "n", "node", F.col("name").alias("carried")))
    crown = common.staged(paths(roots, climbed(roots)).select(F.col("carried").alias("grp"), F.col("path").alias("above"), F.col("top").alias("root")))
    out = paths(held, up).join(_sent(crown), "grp")
    return out.select(F.col("carried.id").alias("id"), F.col("node").alias("leaf"), F.concat("path", "above").alias("path"), F.col("top").alias("subroot"), "root", F.col("carried.carried").alias("carried"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(*FIELDS)
    upper = "".join(map(chr, range(65, 91)))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.unhex(leaf([F.translate("text", upper, upper.lower()) if c == "text" else F.col(c) for c in FIELDS])))
    m = manifest(docs, carried=tampered)
    m = m.withColumn("folded_root", folded(F.coalesce(F.lower(F.hex("carried")), "leaf"), F.col("path")))
    return m.select(F.col("id").cast("long").alias("doc_id"), "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_BITS = "list_reduce(range(8), lambda v, u: xor(v >> 1, 3988292384 * (v & 1)), xor(c, d))"
_CRC = f"xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT), lambda c, d: {_BITS}, 4294967295), 4294967295)"
_LEAF = "sha256(concat(" + ", ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in FIELDS) + "))"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The same by recursion: the levels of each language, those over the languages, every leaf's siblings, and what they fold to.
OP11_SQL = f"""
WITH RECURSIVE hashed AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_LEAF} AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF.replace("text::", f"{_LOWER}::")} END AS changed FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM hashed),
tree AS (
  SELECT g, 0 AS level, pos, leaf AS node, n FROM leaves
  UNION ALL SELECT g, level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (n + 7) // 8 FROM tree WHERE n > 1 GROUP BY g, level, n, pos // 8),
subroots AS (SELECT g, level AS height, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
crown AS (
  SELECT 0 AS level, pos, subroot AS node, n FROM subroots
  UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (n + 7) // 8 FROM crown WHERE n > 1 GROUP BY level, n, pos // 8),
steps AS (
  SELECT l.g, l.pos, t.level, coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos < l.pos // (8 ** t.level)::BIGINT), '') AS a, coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos > l.pos // (8 ** t.level)::BIGINT), '') AS z
  FROM leaves l JOIN tree t ON t.g = l.g AND t.n > 1 AND t.pos // 8 = l.pos // (8 ** (t.level + 1))::BIGINT GROUP BY ALL
  UNION ALL
  SELECT l.g, l.pos, s.height + c.level, coalesce(string_agg(c.node, '' ORDER BY c.pos) FILTER (c.pos < s.pos // (8 ** c.level)::BIGINT), ''), coalesce(string_agg(c.node, '' ORDER BY c.pos) FILTER (c.pos > s.pos // (8 ** c.level)::BIGINT), '')
  FROM leaves l JOIN subroots s ON s.g = l.g JOIN crown c ON c.n > 1 AND c.pos // 8 = s.pos // (8 ** (c.level + 1))::BIGINT GROUP BY ALL),
fold AS (
  SELECT g, pos, 0 AS level, coalesce(changed, leaf) AS node FROM leaves
  UNION ALL SELECT f.g, f.pos, f.level + 1, sha256(s.a || f.node || s.z) FROM fold f JOIN steps s ON s.g = f.g AND s.pos = f.pos AND s.level = f.level),
proofs AS (SELECT g, pos, sha256(string_agg(a || z, '' ORDER BY level)) AS proof FROM steps GROUP BY ALL),
ends AS (SELECT g, pos, arg_max(node, level) AS folded_root FROM fold GROUP BY ALL)
SELECT doc_id, leaf, subroot, node AS root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = node AS verified
FROM leaves JOIN ends USING (g, pos) LEFT JOIN proofs USING (g, pos) JOIN subroots s USING (g), (SELECT node FROM crown WHERE n = 1)"""
