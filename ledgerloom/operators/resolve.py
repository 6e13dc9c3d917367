"""Who was paid: merchants by alias, people by saved contacts, contacts by import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.rules.categories import KNOWN_MERCHANTS
from ledgerloom.session import written

FUZZY, RELATED_LETTERS, EMBEDDED_LETTERS = 0.78, 6, 5
#: The cascade, strongest first.
PHONE, EMAIL, RELATED, EMBEDDED, EXACT, NEAR = range(1, 7)


def normalize_phone(raw: Column) -> Column:
    digits = F.regexp_replace(raw, r"\D", "")
    return F.when(F.length(digits) >= 10, F.right(digits, F.lit(10)))


def local_part(address: Column) -> Column:
    return F.lower(F.substring_index(address, "@", 1))


def phone_from_upi(upi: Column) -> Column:
    return normalize_phone(F.substring_index(upi, "@", 1))


def normalize_email(raw: Column) -> Column:
    email = F.lower(F.trim(raw))
    return F.when(email.contains("@"), email)


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def similarities(rows: DataFrame, by: list[str], id_: str, name: str, span: int = 1_000_000) -> DataFrame:
    """(a, b, similarity) of all ordered pairs of rows with equal `by`. Rows of one name within `span` ids are one list, so that names
    are compared once a pair of lists; pairs of rows are only unfolded. Pairs are many more than rows: partitions aren't coalesced."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = rows.repartition(n, *by).groupBy(*by, name, F.floor(F.col(id_) / span).alias("_span")).agg(F.collect_list(id_).alias("_ids"))
    left, right = (lists.select(*by, F.col(name).alias(x), F.col("_ids").alias(ids)) for x, ids in (("_x", "_as"), ("_y", "_bs")))
    met = left.join(right, by).select("_as", "_bs", similarity(F.col("_x"), F.col("_y")).alias("similarity"))
    return met.withColumn("a", F.explode("_as")).select("_bs", "similarity", "a").withColumn("b", F.explode("_bs")).select("a", "b", "similarity")


def token_subset(a: Column, b: Column) -> Column:
    """Whether every word of the shorter name can be paired with one of the longer, none of them twice: with its equal if
    that is free, else with the first that is its initial or has it as one; at least one pair must be equal."""
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")
    few, many = F.when(F.size(words(a)) <= F.size(words(b)), words(a)).otherwise(words(b)), F.when(F.size(words(a)) <= F.size(words(b)), words(b)).otherwise(words(a))
    start = F.struct(many.alias("free"), F.lit(True).alias("all"), F.lit(False).alias("one"))

    def pair(state: Column, word: Column) -> Column:
        initial = lambda x: ((F.length(word) == 1) | (F.length(x) == 1)) & (F.startswith(x, word) | F.startswith(word, x))
        equal = F.array_contains(state["free"], word)
        at = F.array_position(state["free"], F.when(equal, word).otherwise(F.get(F.filter(state["free"], initial), F.lit(0)))).cast("int")
        rest = F.when(at > 0, F.concat(F.slice(state["free"], F.lit(1), at - 1), F.slice(state["free"], at + 1, F.size(state["free"])))).otherwise(state["free"])
        return F.struct(rest.alias("free"), (state["all"] & F.coalesce(at > 0, F.lit(False))).alias("all"), (state["one"] | equal).alias("one"))

    return F.aggregate(few, start, pair, lambda s: s["all"] & s["one"])


def resolve_merchant(df: DataFrame) -> DataFrame:
    """df (merchant, merchant_source, merchant_confidence, upi_id, contact_name) with the final name and its key.

    A contact outranks all; else suffixes go from pattern and narration names, and known merchants get their own name.
    """
    contact = F.col("contact_name").isNotNull()
    plain = F.when(F.col("merchant_source").isin("pattern", "narration"), T.strip_suffixes(F.col("merchant"))).otherwise(F.col("merchant"))
    known = F.create_map(*[F.lit(x) for pair in KNOWN_MERCHANTS.items() for x in pair])
    df = df.withColumns({"_name": plain, "_alias": F.element_at(known, T.normalize_merchant(F.coalesce(plain, F.col("upi_id"))))})
    name = F.when(contact, F.col("contact_name")).otherwise(F.coalesce("_alias", "_name"))
    keyed = F.when(contact, F.col("contact_name")).otherwise(F.coalesce("_alias", "_name", "upi_id"))
    sure = F.col("merchant_confidence")
    return df.withColumns(
        {
            "merchant": name,
            "merchant_normalized": T.normalize_merchant(keyed),
            "merchant_source": F.when(contact, "contact").otherwise(F.col("merchant_source")),
            "merchant_confidence": F.when(contact, 1.0).when(F.col("_alias").isNotNull(), F.greatest(sure, F.lit(0.95))).otherwise(sure),
        }
    ).drop("_name", "_alias")


def _keys(*parts: tuple[str, Column]) -> Column:
    """Join keys of several kinds, distinct and without nulls."""
    def marked(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.concat(F.lit(f"{kind}:"), v))

    each = [marked(kind, values) for kind, values in parts]
    return F.array_distinct(F.filter(F.flatten(F.array(*each)), lambda k: k.isNotNull()))


def _grams(text: Column, n: int) -> Column:
    size = F.length(text) - n + 1
    return F.when(size > 0, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array(text))


def _rare_grams(parties: DataFrame, contacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(user_id, name, grams) for either side's names: of its pairs of neighbouring letters the ones that the fewest of the
    tenant's contacts have, as many as one change more than a name alike to FUZZY may have could touch.

    Names at d changes lack at most 2 d of each other's pairs, so the first 2 d + 1 by one order on both sides share one.
    """
    spread = lambda df: df.distinct().select("user_id", "name", F.explode(F.array_distinct(_grams(F.col("name"), 2))).alias("gram"))
    left, right = spread(parties), spread(contacts)
    held = right.groupBy("user_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    changes = F.floor(F.length("name") * ((1 - FUZZY) / FUZZY) + 1e-6)

    def rarest(df: DataFrame) -> DataFrame:
        ranked = df.join(held, ["user_id", "gram"], "left").groupBy("user_id", "name").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("all"))
        return ranked.select("user_id", "name", F.transform(F.slice("all", F.lit(1), (2 * changes + 1).cast("int")), lambda x: x["gram"]).alias("grams"))

    return rarest(left), rarest(right)


def _list(value: Column) -> Column:
    return F.when(value.isNotNull(), F.array(value)).otherwise(F.array().cast("array<string>"))


def parsed_contacts(contacts: DataFrame) -> DataFrame:
    """contacts (id, user_id, name, name_normalized, phones, emails, created_at) with their JSON lists read; broken JSON is an empty list."""
    read = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    nth = F.struct("created_at", "id")
    return contacts.select("user_id", F.col("id").alias("contact_id"), F.col("name").alias("contact_name"), F.col("name_normalized").alias("c_name"), read("phones").alias("phones"), F.transform(read("emails"), local_part).alias("locals"), nth.alias("nth"))


def _met(left: DataFrame, right: DataFrame, left_keys: Column, right_keys: Column) -> DataFrame:
    """The distinct pairs of a party and a contact of its tenant that share a key."""
    return left.withColumn("key", F.explode(left_keys)).join(right.withColumn("key", F.explode(right_keys)), ["user_id", "key"]).drop("key").dropDuplicates(["party", "contact_id"])


def _best(pairs: DataFrame, better: Column) -> DataFrame:
    """Of each party the contact of the lowest tier, then of the larger better, then the last or first as the tier has it."""
    last = F.col("tier").isin(PHONE, EMAIL, EXACT)
    best = Window.partitionBy("party").orderBy("tier", better.desc(), F.when(last, F.col("nth")).desc_nulls_last(), F.when(~last, F.col("nth")).asc_nulls_last())
    return pairs.withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").select("party", "user_id", "upi_id", "merchant", "contact_id", "contact_name", "tier")


def match_contacts(parties: DataFrame, contacts: DataFrame) -> DataFrame:
    """(user_id, upi_id, merchant, contact_id, contact_name, tier) of the distinct parties that match a contact of their tenant.

    Candidates come from an equi-join on keys that any match must share: the phone, the local part or its first
    six letters, five letters of an embedded name or a whole name; and, only for parties that these leave, a word of
    the name or a rare pair of neighbouring letters (`_rare_grams`). Parties are made distinct first and written, as
    both passes read them. Where a key is held by several contacts the last wins; longer shared parts and better
    scores win, then the first contact.
    """
    norm = T.normalize_merchant(F.col("merchant"))
    left = parties.select("user_id", "upi_id", "merchant").distinct()
    left = left.withColumns({"lp": T.nullif_empty(local_part(F.col("upi_id"))), "phone": phone_from_upi(F.col("upi_id")), "norm": norm, "party": F.xxhash64("user_id", "upi_id", "merchant")})
    left = written(left.withColumn("letters", F.regexp_replace("lp", "[^a-z]", "")))
    right = parsed_contacts(contacts).withColumn("words", F.filter(F.split("c_name", r"\s+"), lambda w: w != ""))
    none = F.array().cast("array<string>")

    lp, letters, name = F.col("lp"), F.col("letters"), F.col("c_name")
    long_words = F.forall("words", lambda w: F.length(w) >= EMBEDDED_LETTERS) & (F.size("words") > 0)
    six = lambda text: F.substring(text, 1, RELATED_LETTERS)
    pairs = _met(
        left,
        right,
        _keys(("p", _list(F.col("phone"))), ("e", _list(lp)), ("x", _list(F.when(F.length(lp) >= RELATED_LETTERS, six(lp)))), ("m", F.coalesce(_grams(letters, EMBEDDED_LETTERS), none)), ("n", _list(F.col("norm")))),
        _keys(("p", F.col("phones")), ("e", F.col("locals")), ("x", F.transform(F.filter("locals", lambda e: F.length(e) >= RELATED_LETTERS), six)), ("m", F.when(long_words, F.array(F.substring(F.get("words", F.lit(0)), 1, EMBEDDED_LETTERS))).otherwise(none)), ("n", F.array(name))),
    )
    shorter = lambda e: F.least(F.length(lp), F.length(e))
    related = F.filter("locals", lambda e: (e == lp) | ((shorter(e) >= RELATED_LETTERS) & (F.startswith(lp, e) | F.startswith(e, lp))))
    total = F.aggregate("words", F.lit(0), lambda s, w: s + F.length(w))
    inside = long_words & F.forall("words", lambda w: F.contains(letters, w)) & ((F.size("words") > 1) | (F.length(letters) > total))
    pairs = pairs.withColumn("_related", F.array_max(F.transform(related, shorter)))
    tier = (
        F.when(F.array_contains("phones", F.col("phone")), PHONE)
        .when(F.array_contains("locals", lp), EMAIL)
        .when(F.col("_related").isNotNull(), RELATED)
        .when(inside, EMBEDDED)
        .when(F.col("norm") == name, EXACT)
    )
    better = F.when(F.col("tier") == RELATED, F.col("_related")).when(F.col("tier") == EMBEDDED, total).otherwise(0).cast("double")
    sure = written(_best(pairs.withColumn("tier", tier).filter("tier IS NOT NULL"), better))

    rest, named = left.filter("norm IS NOT NULL").join(sure.select("party"), "party", "left_anti"), right.filter("c_name IS NOT NULL")
    l_grams, r_grams = _rare_grams(rest.select("user_id", F.col("norm").alias("name")), named.select("user_id", name.alias("name")))
    pairs = _met(
        rest.join(l_grams.withColumnRenamed("name", "norm"), ["user_id", "norm"], "left"),
        named.join(r_grams.withColumnRenamed("name", "c_name"), ["user_id", "c_name"], "left").withColumnRenamed("grams", "c_grams"),
        _keys(("w", F.split("norm", " ")), ("g", F.coalesce("grams", none))),
        _keys(("w", F.col("words")), ("g", F.coalesce("c_grams", none))),
    )
    pairs = pairs.withColumn("_score", F.when(token_subset(F.col("norm"), name), 0.95).otherwise(similarity(F.col("norm"), name)))
    near = _best(pairs.filter(F.col("_score") >= FUZZY).withColumn("tier", F.lit(NEAR)), F.col("_score"))
    return sure.unionByName(near).drop("party")


def with_contacts(txns: DataFrame, contacts: DataFrame) -> DataFrame:
    """txns with contact_name."""
    found = match_contacts(txns, contacts).select(F.col("user_id").alias("_u"), F.col("upi_id").alias("_v"), F.col("merchant").alias("_m"), "contact_name")
    return txns.join(found, (F.col("user_id") == F.col("_u")) & F.col("upi_id").eqNullSafe(F.col("_v")) & F.col("merchant").eqNullSafe(F.col("_m")), "left").drop("_u", "_v", "_m")


def merge_contacts(existing: DataFrame, cards: DataFrame) -> DataFrame:
    """Contacts after importing cards (user_id, nth, name, phones, emails as arrays).

    Cards of one normalized name are one contact: the name of the first, phones and emails in order without repeats.
    """
    clean = cards.select("user_id", F.col("name"), T.normalize_merchant(F.col("name")).alias("name_normalized"), F.transform("phones", normalize_phone).alias("phones"), F.transform("emails", normalize_email).alias("emails"), F.col("nth").cast("long").alias("nth"), F.lit(False).alias("saved")).filter("name_normalized IS NOT NULL")
    old = existing.select("user_id", "name", "name_normalized", F.from_json("phones", "array<string>").alias("phones"), F.from_json("emails", "array<string>").alias("emails"), F.lit(-1).cast("long").alias("nth"), F.lit(True).alias("saved"))
    grouped = old.unionByName(clean).groupBy("user_id", "name_normalized").agg(F.array_sort(F.collect_list(F.struct("nth", "name", "phones", "emails", "saved"))).alias("all"))
    union = lambda c: F.filter(F.array_distinct(F.flatten(F.transform("all", lambda x: F.coalesce(x[c], F.array().cast("array<string>"))))), lambda v: v.isNotNull())
    first = F.get("all", F.lit(0))
    grown = lambda c: F.size(F.col(c)) != F.size(F.coalesce(first[c], F.array().cast("array<string>")))
    out = grouped.select("user_id", "name_normalized", first["name"].alias("name"), union("phones").alias("phones"), union("emails").alias("emails"), first["saved"].alias("saved"), F.size("all").alias("n"), F.col("all"))
    grown_any = (F.size("phones") != F.size(F.coalesce(first["phones"], F.array().cast("array<string>")))) | grown("emails")
    return out.withColumn("outcome", F.when(~F.col("saved"), "imported").when(grown_any, "updated").otherwise("unchanged")).drop("saved", "n", "all")


def first_letter(name: Column) -> Column:
    """A to Z, or # for anything else."""
    letter = F.upper(F.substring(F.trim(name), 1, 1))
    return F.when(letter.rlike(r"\A[A-Z]\z"), letter).otherwise("#")


def by_letter(contacts: DataFrame) -> DataFrame:
    return contacts.groupBy("user_id", first_letter(F.col("name")).alias("letter")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("name")).alias("names"))
