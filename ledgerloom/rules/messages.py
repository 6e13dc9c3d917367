"""Fixed values of message classification and extraction. They must stay as they are for results to be right."""

#: (pattern, reason); the first that matches rejects a message. Case doesn't count.
HARD_NEGATIVE = [
    (r"\botp\b\s*(?:is|:|number)|(?:enter|use|verify(?:ing)?\s+(?:using|with))\s+(?:the\s+)?\botp\b|one[-\s]?time\s?(password|passcode|pin)|verification code|security code", "otp"),
    (r"e-?statement|statement\s+(?:is|for|of|has been|generated|ready|attached)|combined statement", "statement"),
    (r"payment\s+(?:is\s+)?due|due\s+(?:date|on|by)|min(?:imum)?\s+(?:amount\s+)?due|bill\s+(?:is\s+)?(?:generated|ready)", "reminder"),
    (r"\breminder\b|overdue|last\s+date\s+to\s+pay", "reminder"),
    (r"will\s+be\s+(?:debited|charged|deducted|processed)|is\s+due\s+on|upcoming\s+(?:payment|debit|charge)|scheduled\s+(?:payment|debit)", "future-debit"),
    (r"reward\s+points?\s+(?:credited|earned)", "reward-points"),
    (r"limit\s+(?:modified|enhanced|changed|increased|decreased)|new\s+limit\s*[:.]?\s*(?:rs|inr|₹)", "limit-change"),
    (r"has\s+requested|payment\s+request|collect\s+request|requesting\s+(?:₹|rs|inr|money)", "collect-request"),
    (r"(?:transaction|payment|txn).{0,60}?(?:failed|declined|unsuccessful|could\s+not\s+be)", "failed"),
    (r"(?:failed|declined|unsuccessful)\s+(?:transaction|payment|txn)", "failed"),
    (r"e-?mandate\s+(?:has been\s+)?(?:created|registered|set|approved)|autopay\s+(?:is\s+)?(?:set|enabled|registered)", "mandate-setup"),
    (r"newsletter|webinar|invit(?:e|ation)\s+(?:to|for)", "newsletter"),
    (r"convert(?:ing)?\s+your\s+transaction\b[\s\S]{0,80}?\b(?:emis?|flexipay)\b", "emi-conversion-offer"),
]

AMOUNT = r"(?:₹|(?:rs|inr)\.?\s?)\s*[\d,]+(?:\.\d{1,2})?"

STRONG_POSITIVE = [
    r"(?:has\s+been|is|was|stands?|a\/c\s+\S*|account\s+\S*)\s+(?:debited|credited)",
    r"\b(?:debited|credited)\s+(?:from|to|with|by|for|in)\b",
    r"you\s+(?:have\s+)?(?:paid|sent|received)\b",
    r"(?:money|amount|payment)\s+(?:sent|received|transferred)",
    r"payment\s+(?:of|to|for)\b.{0,80}?(?:successful|completed|received|made|done|processed)",
    r"successful(?:ly)?\s+(?:paid|sent|transferred|made)",
    r"\bwithdrawn\b",
    r"(?:purchase|spent?)\s+(?:of|at|worth|using|on)",
    r"(?:refund|reversal)\s+(?:of|for|processed|credited)",
    r"transaction\s+(?:of|alert|for)\b",
    r"\btxn\b.{0,40}?(?:₹|rs\.?|inr)",
    r"\bdeposited\b",
    r"\b(?:sent|spent|paid|received)\s+(?:₹|rs\.?|inr)\s?[\d,]",
    r"(?:₹|rs\.?|inr)\s?[\d,]+(?:\.\d{1,2})?\s+without\s+otp\s*\/?\s*pin",
    r"\btxn\s*amt\s*[:.]?\s*(?:₹|rs\.?|inr)",
]

SOFT_NEGATIVE = [
    r"(?:win|get|avail|earn|grab|enjoy|unlock|save)\s+(?:flat\s+|upto\s+|up\s+to\s+)?(?:₹|rs\.?|inr)?\s*[\d,]+\s*(?:%)?\s*(?:off|cashback|discount|reward|bonus)",
    r"(?:flat|upto|up\s+to)\s+\d+%\s*(?:off|cashback|discount)",
    r"exclusive\s+offer|limited\s+(?:time|period)\s+offer|offers?\s+(?:just\s+)?for\s+you|special\s+offer",
    r"apply\s+now|shop\s+now|buy\s+now|order\s+now|explore\s+now|click\s+here\s+to\s+(?:avail|shop|buy)",
    r"refer\s+(?:&|and)\s+earn|invite\s+friends",
]

DEFINITIVE = r"(?:has\s+been|is|was)\s+(?:debited|credited)|debited\s+(?:from|by)|credited\s+(?:to|with)|(?:purchase|spent?)\s+(?:of|at|worth|using|on)\b"

AMOUNT_VALUE = r"(?:₹|(?:rs|inr)\.?\s?)\s*([\d,]+(?:\.\d{1,2})?)"
BALANCE = r"(?:avl|available|avail\.?|net|total|closing|opening)\s*(?:bal(?:ance)?|limit)|bal(?:ance)?\s*(?:is|:|-)|limit\s*(?:is|:|-)|reward|points|outstanding"

REFUND = r"\brefund(?:ed)?\b|\breversal\b|\breversed\b"
DEBIT = [
    r"(?:has\s+been|is|was|stands?)\s+debited",
    r"debited\s+(?:from|by|for|with)",
    r"you\s+(?:have\s+)?(?:paid|sent)\b",
    r"(?:money|amount|payment)\s+sent",
    r"payment\s+(?:of|to|made)",
    r"(?:purchase|spent?)\s+(?:of|at|worth|using|on)",
    r"\bwithdrawn\b",
    r"successful(?:ly)?\s+(?:paid|sent|transferred)",
    r"(?:card|account|a\/c)[^.\n]{0,40}?has\s+been\s+used\s+(?:for|at|on)",
    r"\bdebit(?:ed)?\b(?!\s+card\b)",
    r"\b(?:sent|spent|paid)\s+(?:₹|rs\.?|inr)\s?[\d,]",
    r"(?:₹|rs\.?|inr)\s?[\d,]+(?:\.\d{1,2})?\s+without\s+otp\s*\/?\s*pin",
    r"\btxn\s*amt\s*[:.]?\s*(?:₹|rs\.?|inr)",
]
CREDIT = [
    r"(?:has\s+been|is|was|stands?)\s+credited",
    r"credited\s+(?:to|with|in|by)",
    r"you\s+(?:have\s+)?received\b",
    r"(?:money|amount|payment)\s+received",
    r"(?:refund|reversal)\s+(?:of|for|processed|credited)",
    r"deposited",
    r"\bcredit(?:ed)?\b(?!\s+(?:card|limit|score)\b)",
    r"\breceived\s+(?:₹|rs\.?|inr)\s?[\d,]",
]

VPA = r"\b([a-z0-9][a-z0-9._-]{1,60}@[a-z][a-z0-9]{1,20})\b"
EMAIL_PROVIDERS = ["gmail", "yahoo", "outlook", "hotmail", "rediffmail", "icloud", "live", "protonmail"]

CONNECT = r"\.?\s*(?:is|was)?\s*[:\-]?\s*"
REFERENCE = [
    r"UPI\s*(?:transaction\s*)?(?:ref(?:erence)?\b)?\s*(?:no\b|number\b|id\b)?" + CONNECT + r"(\d{9,18})",
    r"ref(?:erence)?\b\s*(?:no\b|number\b|id\b|#)?" + CONNECT + r"([A-Z0-9]{6,25})\b",
    r"(?:transaction|txn)\s*(?:id\b|no\b|number\b|ref(?:erence)?\b)\s*(?:no\b|number\b|id\b)?" + CONNECT + r"([A-Z0-9]{6,30})\b",
    r"(?:IMPS|NEFT|RTGS)\s*(?:ref\b)?\s*(?:no\b)?" + CONNECT + r"([A-Z0-9]{6,25})\b",
]

#: The last heeds case.
CARD = [
    r"(?i)(?:credit|debit)?\s*card\s*(?:no\.?|number)?\s*(?:ending|ending\s+in|ending\s+with)?\s*(?:in|with)?\s*[xX*]*(\d{4})\b",
    r"(?i)card\s+[xX*]{2,}\s*(\d{4})\b",
    r"\bXX(\d{4})\b",
]

#: (pattern, channel) after those that need a VPA or a card.
CHANNEL_WORDS = [
    (r"\bupi\b", "UPI"),
    (r"\bIMPS\b", "IMPS"),
    (r"\bNEFT\b", "NEFT"),
    (r"\bRTGS\b", "RTGS"),
    (r"\bATM\b|cash\s+withdrawal", "ATM"),
    (r"\bwallet\b", "Wallet"),
    (r"net\s?banking", "NetBanking"),
]

MERCHANT_STOP = r"(?i)\s+(?:on|at|via|using|vide|towards|with|for|ref|upi|dated|is|was|has)\b|[.,;\n\r(]|\z"
DISPLAY_SUFFIX = r"(?i)(?:\s+(?:pvt\.?|private|ltd\.?|limited|india|systems?|technolog(?:y|ies)|solutions?|services?))+\z"
NARRATION = r"(?i)UPI[/-](?:DR|CR|P2M|P2A)?[/-]?(\d{9,15})?[/-]([^/\n]{2,40})[/-]([A-Z]{3,6})?[/-]?([a-z0-9._-]+@[a-z0-9]+)?"

#: (pattern, source); the merchant is group 1.
MERCHANT = [
    (r"(?i)(?:Info|Remarks?|Narration|Description)\s*[:\-]\s*(?:UPI[/-][A-Z]{2}[/-]\d+[/-])?([^\n\r]{2,60})", "info-freetext"),
    (r"\bat\s+([A-Z0-9][\w &.'*@-]{1,50}?)(?=\s+on\s|\s+using\s|\s+via\s|\s+vide\s|[.,;\n/]|\z)", "pattern"),
    (r"(?i)\bFor\s+([A-Z0-9][\w &.'*-]{1,50}?)(?=\s+(?:Txn|Dt|Via)\b)", "pattern"),
    (r"(?i)(?:paid|sent|payment)\s+(?:of\s+(?:₹|rs\.?|inr)\s?[\d,.]+\s+)?to\s+(?!VPA\b)([^\n\r]{2,50}?)(?=\s+(?:on|at|via|using|for|is|was|has)\b|[.,;\n(/]|\z)", "pattern"),
    (r"(?i)(?:transferred?|remitted)\s+to\s+(?!VPA\b)([^\n\r]{2,50}?)(?=\s+(?:on|at|via|using)\b|[.,;\n(/]|\z)", "pattern"),
    (r"(?i)(?:received|credited)\s+from\s+(?!VPA\b)([^\n\r]{2,50}?)(?=\s+(?:on|at|via|using|to)\b|[.,;\n(/]|\z)", "pattern"),
    (r"(?i)\baccount\s+[Xx*]{2,}\d{2,8}\s+(?:from|to)\s+(?!VPA\b)([^\n\r]{2,50}?)(?=\s+(?:with|on|at|via|using)\b|[.,;\n(/]|\z)", "pattern"),
    (r"(?i)\btowards\s+(?!VPA\b)([^\n\r]{2,50}?)(?=\s+(?:on|at|via)\b|[.,;\n(/]|\z)", "pattern"),
    (r"(?i)\byour\s+([^\n\r]{1,40}?)\s+bill\b", "pattern"),
]

SOURCE_CONFIDENCE = {"narration": 0.9, "vpa-name": 0.85, "pattern": 0.7, "upi-id": 0.6, "info-freetext": 0.45}

DATE = r"(?i)\bon\s+(\d{1,2})[-/ ]([a-z]{3,9}|\d{1,2})[-/ ](\d{2,4})(?:[\s,]+(?:at\s+)?(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(am|pm)?)?"
ISO_DATE = r"(?i)\bon\s+(\d{4})-(\d{1,2})-(\d{1,2})[:\s](\d{1,2}):(\d{2})(?::(\d{2}))?"
TIME = r"(?i)\bat\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(am|pm)?\b"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

#: (id, bank, channel hint, sender pattern, domains to query), in order of precedence.
PROVIDERS = [
    ("hdfc", "HDFC Bank", None, r"hdfcbank\.(net|com|bank\.in)", ["hdfcbank.net", "hdfcbank.com", "hdfcbank.bank.in"]),
    ("icici", "ICICI Bank", None, r"icicibank\.com", ["icicibank.com"]),
    ("axis", "Axis Bank", None, r"axisbank\.com", ["axisbank.com"]),
    ("sbi", "SBI", None, r"sbi\.co\.in|onlinesbi\.com|sbicard\.com", ["sbi.co.in", "onlinesbi.com", "sbicard.com"]),
    ("kotak", "Kotak", None, r"kotak\.com", ["kotak.com"]),
    ("idfc", "IDFC FIRST", None, r"idfcfirstbank\.com", ["idfcfirstbank.com"]),
    ("indusind", "IndusInd", None, r"indusind\.com", ["indusind.com"]),
    ("federal", "Federal Bank", None, r"federalbank\.co\.in", ["federalbank.co.in"]),
    ("au", "AU Bank", None, r"aubank\.in", ["aubank.in"]),
    ("yesbank", "Yes Bank", None, r"yesbank\.in", ["yesbank.in"]),
    ("pnb", "PNB", None, r"pnbindia\.in", ["pnbindia.in"]),
    ("bob", "Bank of Baroda", None, r"bankofbaroda\.(co\.in|in)", ["bankofbaroda.co.in", "bankofbaroda.in"]),
    ("canara", "Canara Bank", None, r"canarabank\.com", ["canarabank.com"]),
    ("unionbank", "Union Bank", None, r"unionbankofindia\.co\.in", ["unionbankofindia.co.in"]),
    ("amex", "American Express", "Card", r"americanexpress\.com|aexp\.com", ["americanexpress.com"]),
    ("phonepe", None, "UPI", r"phonepe\.com", ["phonepe.com"]),
    ("gpay", None, "UPI", r"payments-noreply@google\.com|googlepay", ["payments-noreply@google.com"]),
    ("paytm", None, "Wallet", r"paytm\.com|paytmbank\.com", ["paytm.com", "paytmbank.com"]),
    ("bhim", None, "UPI", r"npci\.org\.in|bhimupi", ["npci.org.in"]),
    ("cred", None, None, r"cred\.club", ["cred.club"]),
    ("amazonpay", None, "Wallet", r"amazonpay|payments.*amazon\.(in|com)|amazon\.(in|com)", ["payments@amazon.in", "payments@amazon.com"]),
]

#: Words that say nothing about which merchant it is.
NOISE_WORDS = r"\b(?:pvt|private|ltd|limited|india|ind|systems?|payments?|pay|technologies|technology|tech|solutions?|services?|retail|online|internet|ecommerce|e-commerce)\b"

ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&#8377;": "₹", "&#x20b9;": "₹", "&rupee;": "₹"}

#: Column names of bank statements.
HEADERS = {
    "date": r"(?i)\b(txn|transaction|value)?\s*date\b",
    "narration": r"(?i)narration|description|particulars|remarks|details",
    "debit": r"(?i)debit|withdrawal",
    "credit": r"(?i)credit|deposit",
    "amount": r"(?i)^amount\z|transaction\s*amount",
    "crDr": r"(?i)^(cr\/dr|dr\/cr|type)\z",
    "ref": r"(?i)ref(erence)?\s*(no\.?|number)?|cheque\s*no|utr",
}
VPA_SEGMENT = r"(?i)^[a-z0-9][a-z0-9._]{1,60}@[a-z][a-z0-9]{1,20}\z"

#: Characters of a message that are looked at.
SCAN = 6000

#: Words (lower case) of which a text must hold one for the pattern to match, whatever the case: looking for words costs far less
#: than a pattern, and most patterns' words aren't there. A pattern that isn't named is always tried.
NEEDS = dict(
    zip(
        [p for p, _ in HARD_NEGATIVE],
        [
            ("otp", "time", "verification code", "security code"),
            ("statement",),
            ("due", "bill"),
            ("reminder", "overdue", "last"),
            ("will", "due", "upcoming", "scheduled"),
            ("reward",),
            ("limit",),
            ("request",),
            ("failed", "declined", "unsuccessful", "could"),
            ("failed", "declined", "unsuccessful"),
            ("mandate", "autopay"),
            ("newsletter", "webinar", "invit"),
            ("convert",),
        ],
        strict=True,
    )
)
NEEDS |= dict(
    zip(
        STRONG_POSITIVE,
        [("debited", "credited"), ("debited", "credited"), ("paid", "sent", "received"), ("sent", "received", "transferred"), ("payment",), ("successful",), ("withdrawn",), ("purchase", "spen"), ("refund", "reversal"), ("transaction",), ("txn",), ("deposited",), ("sent", "spent", "paid", "received"), ("otp",), ("txn",)],
        strict=True,
    )
)
NEEDS |= dict(zip(SOFT_NEGATIVE, [("off", "cashback", "discount", "reward", "bonus"), ("off", "cashback", "discount"), ("offer",), ("now", "click"), ("earn", "friends")], strict=True))
NEEDS |= {DEFINITIVE: ("debited", "credited", "purchase", "spen"), REFUND: ("refund", "revers")}
NEEDS |= dict(zip(DEBIT, [("debited",), ("debited",), ("paid", "sent"), ("sent",), ("payment",), ("purchase", "spen"), ("withdrawn",), ("successful",), ("used",), ("debit",), ("sent", "spent", "paid"), ("otp",), ("txn",)], strict=True))
NEEDS |= dict(zip(CREDIT, [("credited",), ("credited",), ("received",), ("received",), ("refund", "reversal"), ("deposited",), ("credit",), ("received",)], strict=True))
NEEDS |= dict(zip(REFERENCE, [("upi",), ("ref",), ("transaction", "txn"), ("imps", "neft", "rtgs")], strict=True))
NEEDS |= dict(zip(CARD, [("card",), ("card",), ("xx",)], strict=True))
NEEDS |= dict(zip([p for p, _ in MERCHANT], [("info", "remark", "narration", "description"), (), ("txn", "dt", "via"), ("paid", "sent", "payment"), ("transfer", "remitted"), ("received", "credited"), ("account",), ("towards",), ("bill",)], strict=True))
NEEDS |= dict(zip([p for p, _ in CHANNEL_WORDS], [("upi",), ("imps",), ("neft",), ("rtgs",), ("atm", "cash"), ("wallet",), ("banking",)], strict=True))
