"""Classification, extraction and resolution of messages, case by case."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import categorize, classify, extract, resolve
from ledgerloom.operators import statement as ST
from ledgerloom.plans import ingest
from ledgerloom.plans.queries import QUERIES
from ledgerloom.plans.wordings import WORDINGS
from ledgerloom.rules import messages as R
from ledgerloom.rules.categories import DEFAULT_CATEGORIES
from ledgerloom.sources import files

ARRIVED = 1_783_240_200_000  # 2026-07-05 14:00 in India

CLASSES = [
    ("UPI txn", "Rs.285.00 has been debited from account **7712 to VPA x@icici", "ok"),
    ("Alert", "Your card was used for a purchase of INR 1,899.00 at DECATHLON", "ok"),
    ("", "INR 50,000 credited to your account by NEFT", "ok"),
    ("", "Cashback of Rs 15 has been credited to your wallet", "ok"),
    ("", "Rs.500 has been debited from your account. Never share your OTP with anyone", "ok"),
    ("", "Rs.6802 was debited from card. Convert to EMI? special offer inside", "ok"),
    ("", "Your OTP is 123456 for the transaction of Rs 500", "otp"),
    ("Your e-statement", "Rs 500 debited", "statement"),
    ("", "Payment due on 5th: Rs 500", "reminder"),
    ("", "Rs 500 will be debited tomorrow", "future-debit"),
    ("", "Asha has requested Rs 500 from you", "collect-request"),
    ("", "Your payment of Rs 500 has failed", "failed"),
    ("", "Get flat Rs 100 cashback! Amount received by many Rs 5", "promo"),
    ("", "Your account has been debited", "no-amount"),
    ("", "Big news about Rs 500", "no-transaction-phrase"),
    ("", "Think of converting your transaction of Rs 9,000 done on\n05-07 into Flexipay EMIs", "emi-conversion-offer"),
    ("", "500 reward points credited, worth Rs 50", "reward-points"),
    ("", "Your limit changed to Rs 50,000", "limit-change"),
    (None, None, "no-amount"),
]


def test_classes(spark):
    rows = spark.createDataFrame([(i, "a@b.c", s, b) for i, (s, b, _) in enumerate(CLASSES)], "n int, sender string, subject string, body string")
    got = {r.n: r.reason for r in classify.classify(rows).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(CLASSES)}


def test_providers(spark):
    rows = spark.createDataFrame([("Alerts <alerts@HDFCBANK.net>",), ("x@amazon.in",), ("me@gmail.com",), (None,)], "s string")
    got = rows.select(classify.provider(F.col("s")).alias("p"), classify.channel_hint(F.col("s")).alias("h"), classify.looks_relevant(F.col("s")).alias("r")).collect()
    assert [tuple(r) for r in got] == [("hdfc", None, True), ("amazonpay", "Wallet", True), ("generic", None, False), ("generic", None, False)]
    q = classify.sender_query(["icici", "hdfc"], newer_than="30d", extra="-in:spam")
    assert q == "(from:(hdfcbank.net) OR from:(hdfcbank.com) OR from:(hdfcbank.bank.in) OR from:(icicibank.com)) newer_than:30d -in:spam"
    assert classify.sender_query([]).count("from:") == 28


def parsed(spark, body, subject="", sender="alerts@hdfcbank.net"):
    rows = spark.createDataFrame([(1, 1, ARRIVED, sender, subject, body)], "message_id long, user_id long, arrived_at long, sender string, subject string, body string")
    found = extract.parse(classify.classify(rows)).collect()
    return found[0] if found else None


FIELDS = [
    ("Rs.285.00 has been debited from account **7712 to VPA shop.one@icici SHOP ONE on 05-07-26. Your UPI transaction reference number is 412345678901.", dict(amount_paise=28500, direction="debit", channel="UPI", upi_id="shop.one@icici", reference_number="412345678901", merchant="SHOP ONE", merchant_source="vpa-name", merchant_confidence=0.85, provider="hdfc")),
    ("Rs.10 has been debited to VPA a.b@ybl (ASHA RAO) on 05-07-26", dict(merchant="ASHA RAO", upi_id="a.b@ybl")),
    ("Rs.10 has been credited. Sender: RAVI DAS (VPA: r.das@okaxis)", dict(merchant="RAVI DAS", direction="credit")),
    ("Your Credit Card XX4321 was used for a purchase of INR 1,899.00 at DECATHLON on 05-07-2026 at 14:32. Avl limit: INR 50,000", dict(amount_paise=189900, direction="debit", card_last4="4321", channel="Card", merchant="DECATHLON", occurred_at_precise=True, occurred_at=1_783_242_120_000)),
    ("Refund of Rs 99 processed; it was debited from your account in error", dict(direction="credit", amount_paise=9900)),
    ("Rs 99 has been debited from your account", dict(occurred_at=ARRIVED, occurred_at_precise=False)),
    ("Rs 99 has been debited on 04-07-26 from your account", dict(occurred_at=ARRIVED - 86_400_000, occurred_at_precise=False)),
    ("Rs 99 debited from account. Info: CORNER STORE ON MAIN ROAD", dict(merchant="CORNER STORE", merchant_source="info-freetext")),
    ("Rs 99 debited from account. Remarks: AB12345678 PAY X Y Z. To VPA cafe@ybl", dict(merchant="cafe@ybl", merchant_source="upi-id", merchant_confidence=0.6)),
    ("Sent Rs.214.00 From HDFC Bank A/C x1234 To BIGBASKET On 05/07/26 Ref 512345678901", dict(direction="debit", amount_paise=21400, reference_number="512345678901")),
    ("Rs.649 without OTP/PIN HDFC Bank Card x5323 At NETFLIX On 2026-06-28:10:34:11", dict(direction="debit", occurred_at_precise=True, occurred_at=1_782_623_051_000)),
    ("For NETFLIX Txn Amt:INR649.00 Dt:11/07/2026 Via:card", dict(merchant="NETFLIX", direction="debit", occurred_at=ARRIVED, occurred_at_precise=False)),
    ("UPI/DR/453212345678/SWIGGY LIMITED/YESB/swiggy@ybl/Pay: Rs 5 debited from account", dict(merchant="SWIGGY LIMITED", merchant_source="narration", reference_number="453212345678", upi_id="swiggy@ybl")),
    ("Rs 5 debited from account XXX0039 to ASHWIN BHATT with UPI Ref No 412345678901", dict(merchant="ASHWIN BHATT")),
    ("Rs 5 has been debited towards INDIAN CLEARING CORP/49391221 with UMRN", dict(merchant="INDIAN CLEARING CORP")),
    ("Your NETFLIX bill, set up by E-mandate, has been successfully paid: Rs 5 debited from card", dict(merchant="NETFLIX")),
    # 31 February is 3 March, 124 days before
    ("Rs 5 debited from account on 31-02-26", dict(occurred_at=ARRIVED - 124 * 86_400_000, occurred_at_precise=False)),
]


@pytest.mark.parametrize("body,want", FIELDS)
def test_fields(spark, body, want):
    row = parsed(spark, body)
    assert row is not None
    assert {k: row[k] for k in want} == want


def test_not_payments(spark):
    assert parsed(spark, "Your OTP is 1234 for Rs 5 debited") is None
    row = parsed(spark, "Rs 99 has been debited from your account", sender="x@unknown.org")
    assert row.provider == "generic" and row.confidence == 0.4


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("SWIGGY LIMITED", "swiggy"), ("Swiggy*Order", "swiggy order"), ("swiggy@ybl", "swiggy"), ("dmart 4421", "dmart"), ("Pvt Ltd", None), ("", None), ("e-commerce X", "x")])
def test_normalize(spark, raw, want):
    assert one(spark, T.normalize_merchant(F.lit(raw))) == want


@pytest.mark.parametrize("raw,want", [("Uber India Systems", "Uber"), ("Uber", "Uber"), ("India Gate Foods", "India Gate Foods"), ("Private", "Private")])
def test_suffixes(spark, raw, want):
    assert one(spark, T.strip_suffixes(F.lit(raw))) == want


def test_html_and_space(spark):
    html = "<style>x</style><p>A&nbsp;&#8377;5&amp;</p><br/>B&unknown;C &#65;<script>y</script>"
    assert one(spark, T.html_to_text(F.lit(html))) == "A ₹5&\nB C A"
    assert one(spark, T.collapse_whitespace(F.lit(" a \t b\n \n\n c  "))) == "a b\n c"
    assert len(one(spark, T.collapse_whitespace(F.lit("a" + " " * 200_000 + "b")))) == 3


CONTACTS = [(1, "Vansh Wadhwa", "vansh wadhwa", '["9990265771"]', '["tanya1999rathi@mail.example"]'), (2, "Devansh Rathi", "devansh rathi", "[]", "broken"), (3, "Abhinav", "abhinav", "[]", "[]"), (4, "Meenakshi", "meenakshi", "[]", "[]")]
PARTIES = [
    ("9990265771@ptsbi", "X", 1, 1),
    ("919990265771@bank", None, 1, 1),
    ("tanya1999rathi@okaxis", "Y", 1, 2),
    ("tanya1999rathi-2@okaxis", "Y", 1, 3),
    ("bajajabhinav2002@ybl", "BAJAJ A", 3, 4),
    ("meenakshi@ybl", None, None, None),
    ("sandeeprathi@ybl", None, None, None),
    (None, "VANSH WADHWA", 1, 5),
    (None, "Wadhwa Vansh", 1, 6),
    (None, "V Wadhwa", 1, 6),
    (None, "Vansh Wadhva", 1, 6),
    (None, "A", None, None),
    (None, "Somebody Else", None, None),
    (None, None, None, None),
]


def test_contacts(spark):
    contacts = spark.createDataFrame([(*c, 7, i) for i, c in enumerate(CONTACTS)], "id long, name string, name_normalized string, phones string, emails string, user_id long, created_at long")
    parties = spark.createDataFrame([(7, u, m) for u, m, _, _ in PARTIES] + [(8, "9990265771@ptsbi", "X")], "user_id long, upi_id string, merchant string")
    got = {(r.user_id, r.upi_id, r.merchant): (r.contact_id, r.tier) for r in resolve.match_contacts(parties, contacts).collect()}
    assert got == {(7, u, m): (c, t) for u, m, c, t in PARTIES if c}


def paired(a, b):
    small, big = sorted((a.split(), b.split()), key=len)
    best = False
    for order in itertools.permutations(big, len(small)):
        both = list(zip(small, order, strict=True))
        best = best or all(x == y or (min(len(x), len(y)) == 1 and x[0] == y[0]) for x, y in both) and any(x == y for x, y in both)
    return bool(small) and best


def changes(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_alike_names_are_all_found(spark):
    """Names one to four changes apart, against every pair; the first contact of the best score wins."""
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abnst") for _ in range(n))
    names = sorted({" ".join(word(r.randrange(3, 8)) for _ in range(r.randrange(1, 4))) for _ in range(120)} | {"aaaaaaaaaa", "abababababab", "nn"})
    parties = set(names[:10])
    for _ in range(250):
        x = list(r.choice(names))
        for _ in range(r.randrange(1, 5)):
            x[r.randrange(len(x))] = r.choice(["", "a", "z", "st"])
        parties.add(" ".join("".join(x).split()))
    contacts = spark.createDataFrame([(i, n, n, "[]", "[]", 7, i) for i, n in enumerate(names)], "id long, name string, name_normalized string, phones string, emails string, user_id long, created_at long")
    table = spark.createDataFrame([(7, None, p) for p in sorted(parties)], "user_id long, upi_id string, merchant string")
    norm = {x.merchant: x.n for x in table.select("merchant", T.normalize_merchant(F.col("merchant")).alias("n")).collect()}
    want = {}
    for p in parties:
        if not norm[p]:
            continue
        score = [1.0 if norm[p] == n else 0.95 if paired(norm[p], n) else 1 - changes(norm[p], n) / max(len(norm[p]), len(n)) for n in names]
        if max(score) >= resolve.FUZZY:
            want[p] = score.index(max(score))
    got = {x.merchant: x.contact_id for x in resolve.match_contacts(table, contacts).collect()}
    assert got == want and 60 < len(want) < len(parties)


@pytest.mark.parametrize("a,b", [("v wadhwa", "vansh wadhwa"), ("wadhwa vansh", "vansh wadhwa"), ("v w", "vansh wadhwa"), ("a a b", "a b b"), ("", "x"), ("x", ""), ("a", "a b c"), ("ann ann", "ann a bo"), ("j j smith", "john smith j")])
def test_pairs_of_words(spark, a, b):
    assert one(spark, resolve.token_subset(F.lit(a), F.lit(b))) == paired(a, b)


def test_import(spark):
    old = spark.createDataFrame([(7, "Vansh", "vansh", '["9990265771"]', "[]")], "user_id long, name string, name_normalized string, phones string, emails string")
    cards = spark.createDataFrame([(7, 0, "VANSH", ["+91 99902-65771", "99999 11111"], []), (7, 1, "New One", [], ["A@B.c"]), (7, 2, "Ltd", [], [])], "user_id long, nth int, name string, phones array<string>, emails array<string>")
    got = {r.name_normalized: (r.phones, r.emails, r.outcome) for r in resolve.merge_contacts(old, cards).collect()}
    assert got == {"vansh": (["9990265771", "9999911111"], [], "updated"), "new one": ([], ["a@b.c"], "imported")}


CATEGORIES = [
    (("swiggy", None, None, None), ("food", "brand")),
    (("amazonpay", None, "amazonpay@apl", None), (None, None)),
    (("amazon pay", None, None, "Amazon"), (None, None)),
    (("amazon", None, None, None), ("shopping", "brand")),
    (("uberx", None, None, None), (None, None)),
    (("la pinoz pizza", None, None, None), ("food", "generic")),
    (("pizza hut", None, None, None), ("food", "brand")),
    (("x", None, None, "a cafe"), (None, None)),
    (("x", None, None, "NETFLIX renewal"), ("subscriptions", "brand")),
    (("corner kirana", "MINE", None, None), ("rent", "user")),
    ((None, None, None, None), (None, None)),
]


def test_categories(spark):
    rows = spark.createDataFrame([(i, 7, *x) for i, (x, _) in enumerate(CATEGORIES)], "id int, user_id long, merchant_normalized string, merchant string, upi_id string, email_subject string")
    cats = spark.createDataFrame([(n.lower(), 7, n) for n, _ in DEFAULT_CATEGORIES if n != "Groceries"], "id string, user_id long, name string")
    rules = spark.createDataFrame([(1, 7, "mine", "gone", 1), (2, 7, "Mine", "rent", 2), (3, 7, "mine", "food", 3), (4, 8, "swiggy", "food", 0)], "id long, user_id long, pattern string, category_id string, created_at long")
    got = {r.id: (r.category_id, r.category_source) for r in categorize.categorize(rows, cats, rules).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CATEGORIES)}


def test_reprocess(spark):
    import json

    raw = json.dumps({"from": "a@hdfcbank.net", "subject": "Alert", "body": "Rs.285 has been debited to VPA swiggy@ybl SWIGGY LIMITED on 05-07-26", "internalDate": ARRIVED})
    cols = "id long, user_id long, source string, raw string, deleted_at long, merchant string, merchant_normalized string, merchant_source string, merchant_confidence double, occurred_at long, confidence double, upi_id string, channel string, reference_number string, card_last4 string, bank string, category_id string, category_source string, amount_paise long, email_subject string"
    row = lambda i, src, r, cat: (i, 7, src, r, None, "old", "old", "pattern", 0.7, 5, 0.5, None, None, "KEEP", None, None, cat, None, 1, "Alert")
    txns = spark.createDataFrame([row(1, "gmail", raw, None), row(2, "gmail", raw, "mine"), row(3, "sms", raw, None), row(4, "gmail", "not json", None)], cols)
    cats = spark.createDataFrame([("food", 7, "Food")], "id string, user_id long, name string")
    none = spark.createDataFrame([], "id long, user_id long, pattern string, category_id string, created_at long")
    contacts = spark.createDataFrame([], "id long, name string, name_normalized string, phones string, emails string, user_id long, created_at long")
    once = ingest.reprocess(txns, contacts, cats, none)
    got = {r.id: (r.merchant, r.category_id, r.reference_number, r.amount_paise) for r in once.collect()}
    assert got == {1: ("Swiggy", "food", "KEEP", 1), 2: ("Swiggy", "mine", "KEEP", 1), 3: ("old", None, "KEEP", 1), 4: ("old", None, "KEEP", 1)}
    assert sorted(map(tuple, ingest.reprocess(once, contacts, cats, none).collect())) == sorted(map(tuple, once.collect()))


def test_payments_are_parsed_once(spark, monkeypatch):
    """Contacts read the payments twice, so what they get is read from files, not parsed."""
    plans, with_contacts = [], resolve.with_contacts
    monkeypatch.setattr(resolve, "with_contacts", lambda payments, contacts: plans.append(payments._jdf.queryExecution().optimizedPlan().toString()) or with_contacts(payments, contacts))
    test_reprocess(spark)
    assert len(plans) == 2 and not any(word in plan for plan in plans for word in ("Generate", "from_json"))


def test_texts_without_a_digit_are_no_numbers(spark):
    texts = ["12", " 7", "-3", "", "nov", "x1", "1e3", "99999999999"]
    got = spark.createDataFrame([(x,) for x in texts], "t string").select(extract.whole_number(F.col("t")), F.col("t").try_cast("int")).collect()
    assert [r[0] for r in got] == [r[1] for r in got] == [12, 7, -3, None, None, None, None, None]


def test_places_in_a_list_are_not_cut_off(spark):
    """Trimming takes blanks alone, not digits that happen to equal a text's place."""
    card = "BEGIN:VCARD\nFN:Asha 11\nTEL:+91 99900 02222\nEND:VCARD"
    got = files.cards(spark.createDataFrame([("f", card)], "file string, value string")).first()
    assert (got.name, got.phones) == ("Asha 11", ["+91 99900 02222"])
    told = spark.createDataFrame([("UPI-1SHOP-2shop2@okicici2-x",)], "n string").select(ST.vpa_segment(F.col("n"))).first()[0]
    assert told == "2shop2@okicici2"


def test_names_are_compared_once_a_list(spark):
    """Rows of equal names are lists; every ordered pair comes, whatever ids a list spans."""
    rows = [(i, i % 2, ["ring", "rings", "bolt", ""][i // 2 % 4]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, brand long, name string")
    near = df.alias("l").join(df.alias("r"), "brand").select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), resolve.similarity(F.col("l.name"), F.col("r.name")).alias("similarity"))
    want = sorted(near.collect())
    for span in (3, 1_000_000):
        got = resolve.similarities(df, ["brand"], "id", "name", span)
        plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
        depth = lambda word: next(i for i, line in enumerate(plan) if word in line)
        assert depth("levenshtein") > depth("Generate")  # below what unfolds the lists
        assert sorted(got.collect()) == want


def test_a_pattern_needs_its_words():
    """No pattern matches a text without one of the words that are looked for first."""
    import re

    words = [*{w for p in R.NEEDS for w in re.findall(r"[A-Za-z]{2,}", re.sub(r"\\[a-zA-Z]", " ", p))}, *"s ed of to in Rs 1 123456789012 12 - : ( ) / @ & XX XX1234 rs.5 upi/ ly".split()]
    draw = random.Random(1)
    texts = [*WORDINGS, *(draw.choice(["", " "]).join(draw.choice([str.upper, str.lower])(w) for w in draw.choices(words, k=draw.randrange(2, 9))) for _ in range(3000))]
    hits = 0
    for pattern, needs in R.NEEDS.items():
        for text in texts:
            if needs and re.search(pattern.removeprefix("(?i)").replace(r"\z", r"\Z"), text, re.I):
                assert any(w in text.lower() for w in needs), (pattern, text)
                hits += 1
    assert hits > 1000


@pytest.mark.parametrize("name", ["ext9_suffixes", "ext14_doubtful_remarks"])
def test_messages_are_spread_before_they_are_read(spark, sf, name):
    """Nothing that looks for a name is pushed below the exchange that spreads messages, where one file is one task."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Repartition") :]
    assert "regexp" not in below and "RLIKE" not in below
