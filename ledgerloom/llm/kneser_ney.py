"""Quality by perplexity under an interpolated modified Kneser-Ney model (Chen and Goodman, 1998) of trusted text.

The model is over characters, in n-grams of ORDER, so that invented or rare words don't count against a text. A
character is a code of 12 bits (code points below 2045 have their own, the others share 2,048 by remainder),
and an n-gram a number of 12 bits each.

Documents are dealt into buckets of about BUCKET_BYTES by a hash of their id, as compressed texts.
The n-grams of trusted documents are counted in each bucket, then merged over the cluster by a hash of the n-gram.
From the distinct n-grams of the highest order come the lower orders' counts (of what stands before each), dealt by the
last two characters, and a table of n-grams and counts dealt into shards by context: a context has at most
4,096 n-grams, so no shard is hot. Discounts come from the counts of counts of all shards, four numbers an order and
model, so that they don't depend on how the work is dealt.

A bucket then asks the shards for its distinct n-grams; a shard answers with each n-gram's discounted share and its
context's weight for the next lower order. Back in the buckets the answers are interpolated from the lowest order up
and give each document's perplexity. Every GROUP buckets have a copy of the shards of their own: a context that all documents
hold is asked for by at most GROUP buckets, and rows between buckets and shards grow with the corpus, not with its square.

A document is kept if its perplexity is at most its language's threshold: SLACK times the QUANTILE of the
perplexities of that language's trusted documents, each scored by the model without its own fold. Folds are dealt by a
hash of the text, so that copies are held out together. A language's limit is drawn to that of even odds as if FEW
trusted characters more had it, so few trusted documents reject little. Short texts say little, so a text's mean log probability is
drawn to its language's median as if it had PRIOR more characters of that.

Cases: null text counts as empty, null language is a language of its own; documents of languages
without trusted documents have no threshold and are kept; rows without an id take no
part; equal rows share one decision; ids that repeat are trusted together; label rows that are null count
as not trusted; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER, CODE_BITS = 4, 12
BUCKET_BYTES = 12 << 20
#: Buckets that share a copy of the model's shards.
GROUP = 1024
#: Parts, at most, over which buckets' counts are merged.
PARTS = 1 << 14
QUANTILE, SLACK, PRIOR, FEW = 0.99, 1.3, 60, 1000
FOLDS = 2
#: Characters that a bucket works on at a time.
CHUNK = 1 << 20
#: Keys over which a language's rows are spread where they meet its threshold.
SALTS = 64
_BITS = np.uint64(CODE_BITS)
_BEGIN, _END = 1, 2


def _low(order: int) -> np.uint64:
    return np.uint64((1 << (CODE_BITS * order)) - 1)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end at each character and at each text's end mark, in order, and each text's number of them."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    joined = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    own = np.where(joined < 2045, joined + 3, 2048 + joined % 2048).astype(np.uint64)
    pad = ORDER - 1
    line = np.full(int(sizes.sum()) + pad * len(texts), _BEGIN, np.uint64)
    ends = np.cumsum(sizes + pad) - 1
    body = np.ones(len(line), bool)
    for k in range(pad):
        body[ends - sizes - k] = False
    marks = body.copy()
    marks[ends] = False
    line[marks], line[ends] = own, _END
    out = np.zeros(len(line), np.uint64)
    for k in range(ORDER):
        out[pad:] = (out[pad:] << _BITS) | line[k : len(line) - pad + k]
    return out[body], sizes


def shard_of(contexts: np.ndarray, order: int, shards: int) -> np.ndarray:
    h = (contexts + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(shards)).astype(np.int64)


def _parted(owner: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """Owners and what is dealt to each."""
    at = np.argsort(owner, kind="stable")
    cuts = np.flatnonzero(np.diff(owner[at])) + 1
    for part in np.split(at, cuts):
        if len(part):
            yield int(owner[part[0]]), *(v[part] for v in values)


def _chunks(texts: list[str]) -> Iterator[slice]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _summed(found: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, sorted, and the sums of their counts."""
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    distinct, where = np.unique(np.concatenate(found), return_inverse=True)
    return distinct, np.bincount(where, np.concatenate(counts), len(distinct)).astype(np.int64)


class Tally:
    """Counts of n-grams, merged whenever as many have come as are held."""

    def __init__(self):
        self.found, self.counts, self.new = [], [], 0

    def add(self, texts: list[str]) -> None:
        for part in _chunks(texts):
            more, n = np.unique(grams(texts[part])[0], return_counts=True)
            self.found.append(more)
            self.counts.append(n)
            self.new += len(more)
            if self.new > max(CHUNK, len(self.found[0])):
                self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        found, counts = _summed(self.found, self.counts)
        self.found, self.counts, self.new = [found], [counts], 0
        return found, counts


def _distinct(texts: list[str]) -> np.ndarray:
    tally = Tally()
    tally.add(texts)
    return tally.total()[0]


_unzip = zstandard.ZstdDecompressor()


def _texts(rows: pd.DataFrame) -> list[str]:
    return [_unzip.decompress(x).decode() for x in rows.z]


def _fold(docs: pd.DataFrame) -> np.ndarray:
    return (docs.text_hash.to_numpy() % FOLDS + 1).astype(int)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])


def _longs(blocks: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int64) for x in blocks]


def _grams(blocks: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in blocks]


# The model: held is 0 for that of all trusted text, k for that without fold k

_EVIDENCE = "part int, fold int, grams binary, counts binary"
_TABLE = "shard int, held int, ord int, grams binary, counts binary"


def _counted(parts: int):
    def counted(docs: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
        docs = docs[docs.doc_id.isin(set(labels.doc_id))]
        out, fold, texts = [], _fold(docs), _texts(docs)
        for k in range(1, FOLDS + 1):
            tally = Tally()
            tally.add([t for t, f in zip(texts, fold, strict=True) if f == k])
            found, counts = tally.total()
            out += [(p, k, g.tobytes(), c.tobytes()) for p, g, c in _parted(shard_of(found, 0, parts), found, counts)]
        return _frame(out, _EVIDENCE)

    return counted


def _merged(parts: int):
    """Sums over all buckets, dealt anew by the last two characters."""

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k in range(1, FOLDS + 1):
            own = rows[rows.fold == k]
            found, counts = _summed(_grams(own.grams), _longs(own.counts))
            out += [(p, k, g.tobytes(), c.tobytes()) for p, g, c in _parted(shard_of(found & _low(2), 0, parts), found, counts)]
        return _frame(out, _EVIDENCE)

    return merged


def _lowered(shards: int):
    """Counts of every order and model; those of single characters are this part's, still to be added up."""

    def lowered(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for held in range(FOLDS + 1):
            own = rows[rows.fold != held]
            found, counts = _summed(_grams(own.grams), _longs(own.counts))
            for order in range(ORDER, 0, -1):
                out += [(s, held, order, g.tobytes(), c.tobytes()) for s, g, c in _parted(shard_of(found >> _BITS, order, shards), found, counts)]
                found, counts = np.unique(found & _low(order - 1), return_counts=True)
        return _frame(out, _TABLE)

    return lowered


def _settled(rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for held, order in product(range(FOLDS + 1), range(1, ORDER + 1)):
        own = rows[(rows.held == held) & (rows.ord == order)]
        found, counts = _summed(_grams(own.grams), _longs(own.counts))
        if len(found):
            out.append((int(rows.shard.iloc[0]), held, order, found.tobytes(), counts.tobytes()))
    return _frame(out, _TABLE)


def counts_of_counts(counts: np.ndarray) -> np.ndarray:
    """How many n-grams have counts 1, 2, 3 and 4."""
    return np.bincount(counts[counts < 5], minlength=5)[1:]


def _tallied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([(h, o, *counts_of_counts(np.frombuffer(c, np.int64)).tolist()) for h, o, c in zip(batch.held, batch.ord, batch.counts, strict=True)], columns=["held", "ord", "n1", "n2", "n3", "n4"])


def discounts(counts: np.ndarray) -> np.ndarray:
    """Of counts 0, 1, 2, and 3 or more, by the counts of all n-grams of an order."""
    return discounts_by(counts_of_counts(counts))


def discounts_by(n: np.ndarray) -> np.ndarray:
    """The same by counts of counts; each stays between 0.1 and its count."""
    y = n[0] / max(1.0, n[0] + 2.0 * n[1])
    return np.array([0.0] + [min(max(i - (i + 1) * y * n[i] / max(1.0, n[i - 1]), 0.1), i) for i in (1, 2, 3)])


def model(counted: DataFrame, shards: int, parts: int) -> tuple[DataFrame, dict[tuple[int, int], np.ndarray]]:
    """The table of n-grams, written once, and the discounts of each model and order, from buckets' counts."""
    merged = counted.groupBy("part").applyInPandas(_merged(parts), _EVIDENCE)
    table = common.staged(merged.groupBy("part").applyInPandas(_lowered(shards), _TABLE).groupBy("shard").applyInPandas(_settled, _TABLE))
    total = table.select("held", "ord", "counts").mapInPandas(_tallied, "held int, ord int, n1 long, n2 long, n3 long, n4 long").groupBy("held", "ord").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(1, 5)])
    return table, {(r.held, r.ord): discounts_by(np.array(r[2:])) for r in total.collect()}  # a row a model and order


# Documents

#: The lists that a bucket asks for, in this order: n-grams of all its documents, and of each fold's trusted ones, by order.
LISTS = list(product(range(FOLDS + 1), range(1, ORDER + 1)))
#: sizes has the length of each list; ids are those of the bucket's trusted documents, sent along.
_SENT = "copy int, shard int, bucket int, ids binary, sizes binary, grams binary"


def asked_for(texts: list[str], fold: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams by shard, then list; the list of each; and their numbers by shard and list. The same each time it is made from the same texts."""
    tops = [_distinct([t for t, f in zip(texts, fold, strict=True) if f == k]) for k in range(FOLDS + 1)]
    tops[0] = np.unique(np.concatenate(tops))
    values = [np.unique(tops[k] & _low(order)) for k, order in LISTS]
    key = np.concatenate([shard_of(v >> _BITS, order, shards) * len(LISTS) + i for i, ((_, order), v) in enumerate(zip(LISTS, values, strict=True))])
    at = np.argsort(key, kind="stable")
    return np.concatenate(values)[at], key[at] % len(LISTS), np.bincount(key, minlength=shards * len(LISTS)).reshape(shards, -1)


def _ask(shards: int, group: int):
    def ask(docs: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(docs):
            bucket, trusted = int(docs.bucket.iloc[0]), docs.doc_id.isin(set(labels.doc_id)).to_numpy()
            values, _, sizes = asked_for(_texts(docs), np.where(trusted, _fold(docs), 0), shards)
            ends = np.cumsum(sizes.sum(axis=1))
            for shard in range(shards):
                ids = docs.doc_id[trusted].to_numpy(np.int64).tobytes() if shard == bucket % shards else None
                own = values[ends[shard] - sizes[shard].sum() : ends[shard]]
                if len(own) or ids is not None:
                    out.append((bucket // group, shard, bucket, ids, sizes[shard].astype(np.int64).tobytes(), own.tobytes()))
        return _frame(out, _SENT)

    return ask


def shares(grams_: np.ndarray, counts: np.ndarray, discount: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each n-gram asked for its discounted share, and its context's weight for the lower order (1 where it never came)."""
    if not len(grams_):
        return np.zeros(len(asked), np.float32), np.ones(len(asked), np.float32)
    own = discount[np.minimum(counts, 3)]
    contexts, where = np.unique(grams_ >> _BITS, return_inverse=True)
    total = np.bincount(where, counts)
    weight = np.bincount(where, own) / total
    share = (counts - own) / total[where]
    i = np.minimum(np.searchsorted(grams_, asked), len(grams_) - 1)
    j = np.minimum(np.searchsorted(contexts, asked >> _BITS), len(contexts) - 1)
    return np.where(grams_[i] == asked, share[i], 0).astype(np.float32), np.where(contexts[j] == asked >> _BITS, weight[j], 1).astype(np.float32)


_ANSWERS = "shard int, bucket int, ids binary, shares binary, weights binary"


def _answer(discount: dict[tuple[int, int], np.ndarray]):
    def answer(asked: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return _frame([], _ANSWERS)
        known = {(h, o): (np.frombuffer(g, np.uint64), np.frombuffer(c, np.int64)) for h, o, g, c in zip(table.held, table.ord, table.grams, table.counts, strict=True)}
        none = np.empty(0, np.uint64), np.empty(0, np.int64)
        values, sizes = np.concatenate(_grams(asked.grams)), np.concatenate(_longs(asked.sizes))
        of = np.repeat(np.tile(np.arange(len(LISTS)), len(asked)), sizes)
        share, weight = np.zeros(len(values), np.float32), np.ones(len(values), np.float32)
        for i, key in enumerate(LISTS):
            at = np.flatnonzero(of == i)
            if len(at):
                share[at], weight[at] = shares(*known.get(key, none), discount.get(key, np.zeros(4)), values[at])
        ends = np.cumsum(sizes.reshape(len(asked), -1).sum(axis=1))[:-1]
        return pd.DataFrame({"shard": asked.shard, "bucket": asked.bucket, "ids": asked.ids, "shares": [x.tobytes() for x in np.split(share, ends)], "weights": [x.tobytes() for x in np.split(weight, ends)]})

    return answer


_SCORES = "doc_id long, text_hash long, lang string, n long, bits double, held_bits double"


def _sums(texts: list[str], values: np.ndarray, share: np.ndarray, weight: np.ndarray, of: np.ndarray, held: int) -> np.ndarray:
    """Each text's bits by a model."""
    lower, lower_p = np.zeros(1, np.uint64), np.full(1, 1.0 / (1 << CODE_BITS))
    for order in range(1, ORDER + 1):
        at = np.flatnonzero(of == LISTS.index((held, order)))
        at = at[np.argsort(values[at])]
        x = values[at]
        p = share[at] + weight[at] * lower_p[np.searchsorted(lower, x & _low(order - 1))]
        lower, lower_p = x, p.astype(float)
    bits = -np.log2(lower_p)
    sums = []
    for part in _chunks(texts):
        g, sizes = grams(texts[part])
        sums.append(np.add.reduceat(bits[np.searchsorted(lower, g)], np.concatenate([[0], np.cumsum(sizes)[:-1]])))
    return np.concatenate(sums)


def _score(shards: int):
    def score(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return _frame([], _SCORES)
        answers, texts = answers.sort_values("shard"), _texts(docs)
        ids = b"".join(x for x in answers.ids if x is not None)
        fold = np.where(docs.doc_id.isin(np.frombuffer(ids, np.int64)), _fold(docs), 0)
        values, of, _ = asked_for(texts, fold, shards)
        share, weight = (np.frombuffer(b"".join(x), np.float32) for x in (answers.shares, answers.weights))
        held_bits = np.full(len(docs), np.nan)
        for k in np.unique(fold[fold > 0]).tolist():
            held_bits[fold == k] = _sums([t for t, f in zip(texts, fold, strict=True) if f == k], values, share, weight, of, k)
        return pd.DataFrame({"doc_id": docs.doc_id, "text_hash": docs.text_hash, "lang": docs.lang, "n": [len(t) + 1 for t in texts], "bits": _sums(texts, values, share, weight, of, 0), "held_bits": held_bits})

    return score


def bucket_count(spark: SparkSession, volume: int, bucket_bytes: int) -> int:
    """Buckets of bucket_bytes at most; smaller ones, to a quarter, where there would be fewer than shuffle partitions."""
    return max(1, -(-volume // bucket_bytes), min(common.partitions(spark), -(-4 * volume // bucket_bytes)))


def scores(docs: DataFrame, trusted: DataFrame, bucket_bytes: int = BUCKET_BYTES, group: int = GROUP) -> DataFrame:
    """(doc_id, text_hash, lang, n, bits, held_bits): each document's n-grams and their bits, and of trusted documents those by the
    model without their fold; trusted holds the doc_ids of trusted documents.

    The documents are dealt twice, for the model and for the scores; the second exchange is read twice. The rest moves distinct n-grams of buckets.
    Neither bits nor held_bits depend on bucket_bytes or group.
    """
    spark = docs.sparkSession
    rows = common.identified(docs, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    buckets = bucket_count(spark, rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0, bucket_bytes)
    shards = min(buckets, group)
    ids = trusted.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"))
    pressed = F.pandas_udf(lambda texts: texts.map(lambda t: zstandard.ZstdCompressor(level=3).compress(t.encode())), "binary")
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    dealt = rows.select(bucket.alias("bucket"), "doc_id", "text_hash", "lang", pressed("text").alias("z")).groupBy("bucket")
    both = dealt.cogroup(ids.select(bucket.alias("bucket"), "doc_id").groupBy("bucket"))
    table, discount = model(both.applyInPandas(_counted(min(buckets, PARTS)), _EVIDENCE), shards, min(buckets, group))
    asked = both.applyInPandas(_ask(shards, group), _SENT)
    copies = table.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit((buckets - 1) // group))))
    answers = asked.groupBy("copy", "shard").cogroup(copies.groupBy("copy", "shard")).applyInPandas(_answer(discount), _ANSWERS)
    return dealt.cogroup(answers.groupBy("bucket")).applyInPandas(_score(shards), _SCORES)


def _by_language(rows: DataFrame, small: DataFrame) -> DataFrame:
    """rows with the columns of small, a row for each language. A third of all rows may be of one language, so
    rows are spread over SALTS keys a language and small is repeated as often."""
    salt = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int")
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(repeated, ["lang", "_salt"]).drop("_salt")


def decide(scored: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """scored, written once, with perplexity, threshold and keep."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("good", F.lit(True))
    held = common.staged(scored.join(ids, "doc_id", "left").withColumns({"lang": F.coalesce("lang", F.lit("")), "good": F.coalesce("good", F.lit(False))}))
    mean = F.col("bits") / F.col("n")
    middle = held.filter("good").groupBy("lang").agg(F.percentile_approx(F.col("held_bits") / F.col("n"), 0.5, 10000).alias("middle"))
    middles = held.select("lang").distinct().join(middle, "lang", "left")
    near = lambda bits: (F.col(bits) + PRIOR * F.col("middle")) / (F.col("n") + PRIOR)
    drawn = common.staged(_by_language(held, middles).withColumns({"mean": F.coalesce(near("bits"), mean), "held_mean": near("held_bits")}))
    limit = drawn.filter("good").groupBy("lang").agg(F.percentile_approx("held_mean", quantile, 10000).alias("limit"), F.sum("n").alias("seen"))
    limit = limit.select("lang", (F.col("limit") + FEW * F.greatest(CODE_BITS - F.col("limit"), F.lit(0)) / (F.col("seen") + FEW)).alias("limit"))
    limits = middles.select("lang").join(limit, "lang", "left").select("lang", (F.pow(F.lit(2.0), F.col("limit")) * slack).alias("threshold"))
    out = _by_language(drawn, limits).withColumn("perplexity", F.pow(F.lit(2.0), F.col("mean")))
    return out.withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))).select("doc_id", "text_hash", "lang", F.col("n").alias("n_grams"), "perplexity", "threshold", "keep")


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    trusted = trusted_ids(labels)
    return decide(scores(docs, trusted), trusted)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, all columns."""
    own_id, own_hash = common.unused(docs, "kept_id", "kept_hash")
    kept = classify(docs, labels).filter("keep").select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).distinct()
    same = (F.col("doc_id").cast("long") == F.col(own_id)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(own_hash))
    return docs.join(kept, same, "left_semi")


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")).drop("text_hash")
