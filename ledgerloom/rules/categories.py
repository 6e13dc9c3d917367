"""Fixed values of categorization: default categories, brands, generic words and display names of known merchants."""

DEFAULT_CATEGORIES = [
    ("Food", "#ff9500"),
    ("Groceries", "#34c759"),
    ("Shopping", "#af52de"),
    ("Transport", "#5ac8fa"),
    ("Travel", "#007aff"),
    ("Entertainment", "#ff2d55"),
    ("Bills", "#ff3b30"),
    ("Fuel", "#a2845e"),
    ("Healthcare", "#30d158"),
    ("Investment", "#64d2ff"),
    ("Salary", "#32d74b"),
    ("Subscriptions", "#bf5af2"),
    ("Utilities", "#ffd60a"),
    ("Insurance", "#0a84ff"),
    ("Rent", "#ff9f0a"),
    ("Transfer", "#8e8e93"),
    ("Education", "#5e5ce6"),
]

#: (word or words, category, text that rules the brand out)
BRANDS = [
    ("swiggy", "Food", None),
    ("zomato", "Food", None),
    ("dominos", "Food", None),
    ("domino s", "Food", None),
    ("mcdonald", "Food", None),
    ("kfc", "Food", None),
    ("pizza hut", "Food", None),
    ("burger king", "Food", None),
    ("eatclub", "Food", None),
    ("starbucks", "Food", None),
    ("blinkit", "Groceries", None),
    ("zepto", "Groceries", None),
    ("bigbasket", "Groceries", None),
    ("instamart", "Groceries", None),
    ("dmart", "Groceries", None),
    ("jiomart", "Groceries", None),
    ("reliance fresh", "Groceries", None),
    ("more supermarket", "Groceries", None),
    ("amazon", "Shopping", "amazonpay"),
    ("flipkart", "Shopping", None),
    ("myntra", "Shopping", None),
    ("ajio", "Shopping", None),
    ("meesho", "Shopping", None),
    ("nykaa", "Shopping", None),
    ("tata cliq", "Shopping", None),
    ("decathlon", "Shopping", None),
    ("croma", "Shopping", None),
    ("ikea", "Shopping", None),
    ("uber", "Transport", None),
    ("ola", "Transport", None),
    ("rapido", "Transport", None),
    ("blusmart", "Transport", None),
    ("metro", "Transport", None),
    ("fastag", "Transport", None),
    ("irctc", "Travel", None),
    ("redbus", "Travel", None),
    ("makemytrip", "Travel", None),
    ("goibibo", "Travel", None),
    ("cleartrip", "Travel", None),
    ("ixigo", "Travel", None),
    ("indigo", "Travel", None),
    ("air india", "Travel", None),
    ("vistara", "Travel", None),
    ("oyo", "Travel", None),
    ("airbnb", "Travel", None),
    ("bookmyshow", "Entertainment", None),
    ("pvr", "Entertainment", None),
    ("inox", "Entertainment", None),
    ("steam", "Entertainment", None),
    ("netflix", "Subscriptions", None),
    ("spotify", "Subscriptions", None),
    ("hotstar", "Subscriptions", None),
    ("prime video", "Subscriptions", None),
    ("youtube premium", "Subscriptions", None),
    ("youtube", "Subscriptions", None),
    ("apple.com/bill", "Subscriptions", None),
    ("apple services", "Subscriptions", None),
    ("apple media services", "Subscriptions", None),
    ("google one", "Subscriptions", None),
    ("jio", "Utilities", None),
    ("airtel", "Utilities", None),
    ("vi recharge", "Utilities", None),
    ("bsnl", "Utilities", None),
    ("tata power", "Utilities", None),
    ("adani electricity", "Utilities", None),
    ("bescom", "Utilities", None),
    ("mahadiscom", "Utilities", None),
    ("electricity", "Utilities", None),
    ("broadband", "Utilities", None),
    ("cred club", "Bills", None),
    ("hpcl", "Fuel", None),
    ("iocl", "Fuel", None),
    ("bpcl", "Fuel", None),
    ("indian oil", "Fuel", None),
    ("indianoil", "Fuel", None),
    ("bharat petroleum", "Fuel", None),
    ("hindustan petroleum", "Fuel", None),
    ("shell", "Fuel", None),
    ("petrol", "Fuel", None),
    ("apollo", "Healthcare", None),
    ("pharmeasy", "Healthcare", None),
    ("1mg", "Healthcare", None),
    ("netmeds", "Healthcare", None),
    ("practo", "Healthcare", None),
    ("pharmacy", "Healthcare", None),
    ("zerodha", "Investment", None),
    ("groww", "Investment", None),
    ("upstox", "Investment", None),
    ("kuvera", "Investment", None),
    ("indian clearing corp", "Investment", None),
    ("bse limited", "Investment", None),
    ("nsdl", "Investment", None),
    ("mutual fund", "Investment", None),
    ("lic of india", "Insurance", None),
    ("policybazaar", "Insurance", None),
    ("hdfc ergo", "Insurance", None),
    ("star health", "Insurance", None),
    ("acko", "Insurance", None),
    ("insurance", "Insurance", None),
]

GENERIC = [
    ("pizza", "Food", None),
    ("biryani", "Food", None),
    ("cafe", "Food", None),
    ("coffee", "Food", None),
    ("restaurant", "Food", None),
    ("dhaba", "Food", None),
    ("kitchen", "Food", None),
    ("bakery", "Food", None),
    ("sweets", "Food", None),
    ("chai", "Food", None),
    ("juice", "Food", None),
    ("eatery", "Food", None),
    ("tiffin", "Food", None),
    ("dosa", "Food", None),
    ("idli", "Food", None),
    ("momos", "Food", None),
    ("shawarma", "Food", None),
    ("food", "Food", None),
    ("kirana", "Groceries", None),
    ("mart", "Groceries", None),
    ("supermarket", "Groceries", None),
    ("grocery", "Groceries", None),
    ("provision", "Groceries", None),
    ("fresh", "Groceries", None),
    ("cab", "Transport", None),
    ("taxi", "Transport", None),
    ("parking", "Transport", None),
    ("toll", "Transport", None),
    ("rickshaw", "Transport", None),
    ("fuel", "Fuel", None),
    ("petroleum", "Fuel", None),
    ("filling station", "Fuel", None),
    ("hospital", "Healthcare", None),
    ("healthcare", "Healthcare", None),
    ("health", "Healthcare", None),
    ("clinic", "Healthcare", None),
    ("diagnostic", "Healthcare", None),
    ("lab", "Healthcare", None),
    ("medical", "Healthcare", None),
    ("chemist", "Healthcare", None),
    ("dental", "Healthcare", None),
    ("physio", "Healthcare", None),
    ("gym", "Healthcare", None),
    ("fitness", "Healthcare", None),
    ("yoga", "Healthcare", None),
    ("airlines", "Travel", None),
    ("resort", "Travel", None),
    ("travels", "Travel", None),
    ("tours", "Travel", None),
    ("lodge", "Travel", None),
    ("hotel", "Travel", None),
    ("recharge", "Utilities", None),
    ("dth", "Utilities", None),
    ("gas", "Utilities", None),
    ("water bill", "Utilities", None),
    ("school", "Education", None),
    ("college", "Education", None),
    ("academy", "Education", None),
    ("institute", "Education", None),
    ("coaching", "Education", None),
    ("tuition", "Education", None),
    ("classes", "Education", None),
    ("premium", "Insurance", None),
    ("policy", "Insurance", None),
    ("sip", "Investment", None),
    ("securities", "Investment", None),
    ("broking", "Investment", None),
    ("demat", "Investment", None),
    ("rent", "Rent", None),
    ("cinema", "Entertainment", None),
    ("movies", "Entertainment", None),
    ("gaming", "Entertainment", None),
    ("club", "Entertainment", None),
]

KNOWN_MERCHANTS = {
    "swiggy": "Swiggy",
    "zomato": "Zomato",
    "dominos": "Domino's",
    "mcdonald": "McDonald's",
    "kfc": "KFC",
    "starbucks": "Starbucks",
    "blinkit": "Blinkit",
    "zepto": "Zepto",
    "bigbasket": "BigBasket",
    "instamart": "Swiggy Instamart",
    "dmart": "DMart",
    "jiomart": "JioMart",
    "amazon": "Amazon",
    "flipkart": "Flipkart",
    "myntra": "Myntra",
    "ajio": "Ajio",
    "meesho": "Meesho",
    "nykaa": "Nykaa",
    "decathlon": "Decathlon",
    "croma": "Croma",
    "ikea": "IKEA",
    "uber": "Uber",
    "ola": "Ola",
    "rapido": "Rapido",
    "blusmart": "BluSmart",
    "irctc": "IRCTC",
    "redbus": "redBus",
    "makemytrip": "MakeMyTrip",
    "goibibo": "Goibibo",
    "cleartrip": "Cleartrip",
    "ixigo": "ixigo",
    "indigo": "IndiGo",
    "vistara": "Vistara",
    "oyo": "OYO",
    "airbnb": "Airbnb",
    "bookmyshow": "BookMyShow",
    "netflix": "Netflix",
    "spotify": "Spotify",
    "hotstar": "Disney+ Hotstar",
    "zerodha": "Zerodha",
    "groww": "Groww",
    "upstox": "Upstox",
    "apollo": "Apollo Pharmacy",
    "pharmeasy": "PharmEasy",
    "netmeds": "Netmeds",
    "practo": "Practo",
}
