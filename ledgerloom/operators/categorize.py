"""Categories by rules: a tenant's own, then brands, then generic words. Rule tables are literals, tenants' rules an index of letter groups."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.rules.categories import BRANDS, DEFAULT_CATEGORIES, GENERIC

#: Letters of a group at which a tenant's rules and texts meet.
GROUP = 3
#: Texts of a tenant that meet its rules in one go.
PIECE = 50_000


def haystack(*parts: Column) -> Column:
    """The parts that aren't empty, joined and in lower case."""
    return F.lower(F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " | "))


def _hits(hay: Column, rules: list[tuple], tight: Column | None = None) -> Column:
    """Names of the categories whose rules match, the longest pattern first, then in the table's order.

    One pattern finds the longest word that begins at each place; the shorter ones that begin there are its own beginnings.
    """
    ranked = sorted(rules, key=lambda r: -len(r[0]))
    words = list(dict.fromkeys(r[0].lower() for r in ranked))
    begun = lambda w, r: w == r or w.startswith(r) and r[-1].isalnum() != w[len(r)].isalnum()
    # tables as texts, which Spark folds to one literal each
    table = lambda values: F.split(F.lit("\x01".join(values)), "\x01")
    ranks = F.str_to_map(F.lit("\x01".join(f"{w}\x02{','.join(str(i) for i, r in enumerate(ranked) if begun(w, r[0].lower()))}" for w in words)), F.lit("\x01"), F.lit("\x02"))
    pattern = r"\b(?=(" + "|".join(map(re.escape, words)) + r")\b)"
    found = F.transform(F.regexp_extract_all(hay, F.lit(pattern), F.lit(1)), lambda w: F.split(F.element_at(ranks, w), ",").cast("array<int>"))
    hits = F.array_sort(F.array_distinct(F.flatten(found)))
    if tight is not None:
        unless = table([r[2] or "" for r in ranked])
        hits = F.filter(hits, lambda i: (F.get(unless, i) == "") | ~F.contains(tight, F.get(unless, i)))
    names = table([r[1].lower() for r in ranked])
    return F.array_distinct(F.transform(hits, lambda i: F.get(names, i)))


def rule_hits(txns: DataFrame) -> DataFrame:
    """txns with _brand and _generic: candidate category names in order. The subject counts for brands alone."""
    own = [F.col(c) for c in ("merchant_normalized", "merchant", "upi_id")]
    df = txns.withColumns({"_hay": haystack(*own, F.col("email_subject")), "_own": haystack(*own)})
    return df.withColumns({"_brand": _hits(F.col("_hay"), BRANDS, F.regexp_replace("_hay", r"\s+", "")), "_generic": _hits(F.col("_own"), GENERIC)})


def _groups(text: Column, least: Column) -> Column:
    """The distinct groups of least to GROUP letters that follow each other in a text; of none, the empty one."""
    places = lambda n: F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    of = lambda n: F.transform(places(n), lambda at: F.substring(text, at, n))
    return F.array_distinct(F.flatten(F.transform(F.sequence(least, F.lit(GROUP)), of)))


def rule_index(rules: DataFrame) -> DataFrame:
    """rules (id, user_id, pattern, category_id, created_at) with _group: of a pattern's groups of letters the one that the fewest of the tenant's rules hold.

    A pattern shorter than a group is its own group. Rules without a pattern match nothing and are left out.
    """
    low = rules.filter(F.col("pattern").isNotNull()).withColumn("pattern", F.lower("pattern"))
    size = F.least(F.length("pattern"), F.lit(GROUP))
    held = low.withColumn("_group", F.explode(_groups(F.col("pattern"), size))).filter(F.length("_group") == size)
    counts = held.groupBy("user_id", "_group").agg(F.count(F.lit(1)).alias("_n"))
    rarest = F.min(F.struct("_n", "_group"))["_group"].alias("_group")
    return held.join(counts, ["user_id", "_group"]).groupBy("user_id", "id", "pattern", "category_id", "created_at").agg(rarest)


class _Rules:
    """A tenant's rules in order. A text finds the first that it holds where it holds a rule's rarest group of letters: there the rule's
    place and length give the letters to look up, so that a look costs by likely hits and not by the number of rules."""

    def __init__(self, ordered: list[tuple]):
        self.first: dict[str, int] = {}
        self.shapes: dict[str, set[tuple]] = {}
        self.sizes: set[int] = set()
        self.categories = [category for _, _, category in ordered]
        for nth, (pattern, group, _) in enumerate(ordered):
            if self.nth(pattern) is None:  # else an earlier rule is held by whatever holds this one
                self.first[pattern] = nth
                self.shapes.setdefault(group, set()).add((pattern.index(group), len(pattern)))
                self.sizes.add(len(group))

    def nth(self, text: str) -> int | None:
        best = self.first.get("")
        for size in self.sizes:
            for at in range(len(text) - size + 1):
                for before, length in self.shapes.get(text[at : at + size], ()):
                    nth = self.first.get(text[at - before : at - before + length]) if at >= before else None
                    if nth is not None and (best is None or nth < best):
                        best = nth
        return best


def _first_rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of tenants come one by one, a tenant's rules in order and then texts; what is held is one tenant's rules."""
    piece, ordered, rules = None, [], None
    for rows in batches:
        out = []
        for user, salt, is_text, said, group, category in zip(rows.user_id, rows.salt, rows.is_text, rows.said, rows["_group"], rows.category_id, strict=True):
            if (user, salt) != piece:
                piece, ordered, rules = (user, salt), [], None
            if not is_text:
                ordered.append((said, group, category if isinstance(category, str) else None))
                continue
            rules = rules or _Rules(ordered)
            if (nth := rules.nth(said)) is not None:
                out.append((user, said, rules.categories[nth]))
        yield pd.DataFrame(out, columns=["user_id", "_hay", "_u"])


def own_rules(texts: DataFrame, rules: DataFrame, piece: int = PIECE) -> DataFrame:
    """(user_id, _hay, _u): of each distinct text of a tenant the category of the first created of the tenant's rules that it holds.

    rules are (id, user_id, pattern, category_id, created_at); of equal patterns the first stays, and those without one match
    nothing. A tenant's texts are dealt in pieces, each of which gets its rules: a text moves once, and as a piece has at least
    four texts a rule, so do all rules together. Texts of tenants without rules take no part.
    """
    first = F.min(F.struct("created_at", "id", F.col("category_id").cast("string").alias("category_id"))).alias("_r")
    index = rule_index(rules.groupBy("user_id", F.lower("pattern").alias("pattern")).agg(first).select("user_id", "pattern", "_r.*")).withColumnRenamed("pattern", "said")
    many = texts.groupBy("user_id").agg(F.count(F.lit(1)).alias("_texts"))
    pieces = index.groupBy("user_id").agg(F.count(F.lit(1)).alias("_rules")).join(many, "user_id")
    pieces = pieces.select("user_id", F.ceil(F.col("_texts") / F.greatest(F.lit(piece), F.col("_rules") * 4)).cast("int").alias("_pieces"))
    asked = texts.filter("_hay <> ''").select("user_id", "_hay").distinct().join(pieces, "user_id")
    asked = asked.select("user_id", F.pmod(F.xxhash64("_hay"), F.col("_pieces")).cast("int").alias("salt"), F.lit(True).alias("is_text"), F.col("_hay").alias("said"))
    told = index.join(pieces, "user_id").select("user_id", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)).alias("salt"), F.lit(False).alias("is_text"), "said", "_group", "created_at", "id", "category_id")
    both = told.unionByName(asked, allowMissingColumns=True).repartition("user_id", "salt").sortWithinPartitions("user_id", "salt", "is_text", "created_at", "id", "said")
    return both.select("user_id", "salt", "is_text", "said", "_group", "category_id").mapInPandas(_first_rules, f"user_id {dict(texts.dtypes)['user_id']}, _hay string, _u string")


def categorize(txns: DataFrame, categories: DataFrame, rules: DataFrame) -> DataFrame:
    """txns (id, user_id, merchant_normalized, merchant, upi_id, email_subject) with category_id and category_source.

    categories (id, user_id, name); rules (id, user_id, pattern, category_id, created_at): the first created that
    matches wins. Rules whose category is gone are passed over. A tenant's categories are gathered into one map a
    tenant; its rules meet pieces of its distinct texts (`own_rules`). txns is read three times: write it first where it is costly.
    """
    names = categories.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.lower("name").alias("k"), F.col("id").cast("string").alias("v"))))).alias("_ids"))
    alive = rules.join(categories.select(F.col("id").alias("category_id"), F.col("user_id")), ["user_id", "category_id"], "left_semi")
    df = rule_hits(txns)
    own = own_rules(df, alive)
    first = lambda hits: F.get(F.filter(F.transform(hits, lambda n: F.try_element_at("_ids", n)), lambda v: v.isNotNull()), F.lit(0))
    # names are looked up before texts move, so that what moves is short
    df = df.join(names, "user_id", "left").withColumns({"_b": first("_brand"), "_g": first("_generic")}).drop("_own", "_brand", "_generic", "_ids")
    df = df.join(own, ["user_id", "_hay"], "left")
    source = F.when(F.col("_u").isNotNull(), "user").when(F.col("_b").isNotNull(), "brand").when(F.col("_g").isNotNull(), "generic")
    return df.withColumns({"category_id": F.coalesce("_u", "_b", "_g"), "category_source": source}).drop("_hay", "_u", "_b", "_g")


def rules_with_category(rules: DataFrame, categories: DataFrame) -> DataFrame:
    """rules with their category's name; rules whose category is gone are left out."""
    return rules.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name")), "category_id")


def work_queue(txns: DataFrame) -> DataFrame:
    """Rows without a category, in the order in which they came."""
    return txns.filter("category_id IS NULL").orderBy("created_at", "id")


def apply_rule(txns: DataFrame, user_id, needle: str, category_id: str) -> DataFrame:
    """A new rule looks back: rows without category that hold the needle get it; their category_source stays."""
    fields = F.lower(F.concat_ws(" ", "merchant", "merchant_normalized", "upi_id", "email_subject"))
    hit = (F.col("user_id") == F.lit(user_id)) & F.col("category_id").isNull() & F.col("deleted_at").isNull() & fields.contains(needle.lower())
    return txns.withColumn("category_id", F.when(hit, F.lit(category_id)).otherwise(F.col("category_id")))


def default_categories(users: DataFrame, categories: DataFrame) -> DataFrame:
    """The default categories of the users that have none."""
    table = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("color")) for n, c in DEFAULT_CATEGORIES]))
    return users.join(categories, "user_id", "left_anti").select("user_id", table.alias("c")).select("user_id", "c.name", "c.color")


def find_category(categories: DataFrame, name: str) -> DataFrame:
    first = Window.partitionBy("user_id").orderBy("id")
    return categories.filter(F.lower(F.trim("name")) == name.strip().lower()).withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
