"""Word lists, keyword weights and lookup tables.

Results depend on these values exactly, so they are stated plainly and in
natural order. Nothing here is logic.
"""

# --- money ---------------------------------------------------------------
CURRENCY_WORDS = {
    "₹": "INR", "rs": "INR", "inr": "INR", "rupee": "INR", "rupees": "INR",
    "$": "USD", "usd": "USD", "dollar": "USD", "dollars": "USD",
    "€": "EUR", "eur": "EUR", "euro": "EUR", "euros": "EUR",
    "£": "GBP", "gbp": "GBP", "pound": "GBP", "pounds": "GBP",
}
CURRENCY_SYMBOLS = {"INR": "₹", "USD": "$", "EUR": "€", "GBP": "£"}
# (marker, currency, is_symbol)
PRICE_MARKERS = [
    ("₹", "INR", True), ("Rs.", "INR", False), ("Rs", "INR", False), ("INR", "INR", False),
    ("$", "USD", True), ("USD", "USD", False), ("€", "EUR", True), ("EUR", "EUR", False),
    ("£", "GBP", True), ("GBP", "GBP", False),
]
PRICE_REJECT_WORDS = (
    "otp|verification|verify|code|order|booking|transaction|txn|upi|ref|reference|receipt|bill|"
    "invoice|account|aadhaar|pan|pin|password|id|no|number|qty|quantity|items?|kg|km|cm|mm|gb|mb|%"
)
PHONE_REJECT_WORDS = (
    "order|booking|transaction|txn|upi|ref|reference|receipt|bill|invoice|account|aadhaar|pan|pin|id|no"
)
CODE_REJECT_WORDS = (
    "order|booking|transaction|txn|upi|ref|reference|receipt|bill|invoice|account|aadhaar|pan|pin|card|ifsc"
)
# (cue pattern, reach in characters)
CODE_CUES = [
    (r"\b(?:otp|o\.?t\.?p\.?)\b", 40),
    (r"\bone[\s\-]?time[\s\-]?password\b", 40),
    (r"\bverification[\s\-]?code\b", 40),
    (r"\bsecurity[\s\-]?code\b", 40),
    (r"\bsecurity[\s\-]?pin\b", 40),
    (r"\bauth(?:entication)?[\s\-]?code\b", 40),
    (r"\bverif(?:y|ied|ication)\b", 24),
    (r"\bconfirm\b", 24),
    (r"\bcode\b", 20),
    (r"\buse\b", 16),
    (r"\benter\b", 16),
]

# --- links ---------------------------------------------------------------
TLDS = [
    "com", "in", "org", "net", "io", "ai", "co", "gov", "edu", "dev", "app", "xyz", "info", "biz",
    "me", "us", "uk", "de", "fr", "jp", "au", "ca", "ru", "br", "it", "es", "nl", "se", "ch", "tech",
    "store", "online", "site", "blog", "cloud", "tv", "cc", "ly", "sh", "gg", "link", "news", "media",
    "live", "studio", "pro", "shop", "sale", "deals", "kart", "pay", "bank", "health", "plus",
]
SECOND_LEVEL = ["co", "com", "org", "net", "gov", "edu"]

# --- dates ---------------------------------------------------------------
MONTH_NAMES = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]

# --- receipts ------------------------------------------------------------
MERCHANT_WORDS = [
    "store", "shop", "mart", "market", "supermarket", "mall", "bazaar", "bakery", "restaurant", "cafe",
    "hotel", "hospital", "clinic", "pharmacy", "medical", "fuel", "petrol", "gas", "station", "uber",
    "ola", "rapido", "swiggy", "zomato", "blinkit", "bigbasket", "grofers", "dunzo", "amazon",
    "flipkart", "myntra", "nykaa", "jiomart", "reliance", "dmart", "more", "spencer", "reliance fresh",
    "reliance smart", "big bazaar", "vishal mega", "easyday", "nilgiris", "food world", "apna bazaar",
]
EXPENSE_CATEGORIES = [
    ("uber", "Transport"), ("ola", "Transport"), ("rapido", "Transport"),
    ("swiggy", "Food"), ("zomato", "Food"), ("blinkit", "Groceries"),
    ("bigbasket", "Groceries"), ("grofers", "Groceries"), ("dunzo", "Groceries"),
    ("amazon", "Shopping"), ("flipkart", "Shopping"), ("myntra", "Shopping"), ("nykaa", "Shopping"),
    ("uber eats", "Food"),
    ("hospital", "Healthcare"), ("clinic", "Healthcare"), ("apollo", "Healthcare"), ("fortis", "Healthcare"),
    ("indigo", "Travel"), ("air india", "Travel"), ("vistara", "Travel"), ("spicejet", "Travel"),
    ("goair", "Travel"), ("irctc", "Travel"), ("makemytrip", "Travel"), ("goibibo", "Travel"),
    ("yatra", "Travel"),
    ("pvr", "Entertainment"), ("inox", "Entertainment"), ("cinepolis", "Entertainment"),
]

# --- catalogue -----------------------------------------------------------
CAPTURE_FOLDERS = [
    "/screenshot", "/screenshots", "/screenshot_", "/screenshots_",
    "/screen shots", "/screen captures", "/screen recordings", "/capture",
]
CAPTURE_PREFIXES = ["screenshot", "screen shot", "screencap", "screen_shot", "ss_", "scr_"]
CAPTURE_SUFFIXES = ["screenshot", "screen shot", "screencap", "screen_shot", "capture"]
CAPTURE_EXCLUSIONS = [
    "/screenrecord", "/screen recorder", "/screen_recorder",
    "/screensavers", "/screen saver", "/wallpaper", "/wallpapers",
]
CAPTURE_EXTENSIONS = ["png", "jpg", "jpeg", "webp"]

# --- search words --------------------------------------------------------
LEADING_FILLER = """
find finds search searches show shows showme locate spot get got open view give tell remember recall
retrieve display list browse pull check look see saw seen can could would will please pls hey ok okay
do does did i me my we us you your where wherever which what that this those these the a an of in on
at to for with and or any some there it its was were is are be been have has had having containing
contains contain includes include including last past previous recent recently screenshot screenshots
image images pic pics photo photos shot shots snap snaps capture captures cost costing costs priced
price prices buy bought paid pay worth sold
""".split()
TRAILING_FILLER = LEADING_FILLER + "thanks thankyou thank now again exactly only".split()
INNER_STOP = """
a an the of in on at to for with and or is are was were be been am i me my we us you your it its that
this these those there have has had do did does can could would will please where which what whose
when then saw see seen if so as by from about into than up down but containing contains contain
includes include including last past previous recent recently screenshot screenshots image images pic
pics photo photos shot shots snap snaps capture captures find finds search searches show shows showme
locate spot remember recall retrieve tell display browse cost costing costs priced buy bought paid pay
worth sold
""".split()
TOP_WORD_STOP = """
the and for with from this that have your screenshot screenshots image photo https http www com
""".split()
GROUP_WORD_STOP = "screenshot image photo with from this that".split()
REQUEST_VERBS = """
find finds search searches locate spot get open view show shows showme where which what remember
recall retrieve tell give pull display list
""".split()

# --- colours -------------------------------------------------------------
COLORS = [
    ("red", 200, 40, 40), ("orange", 230, 130, 20), ("yellow", 230, 210, 60), ("green", 50, 170, 80),
    ("blue", 50, 120, 220), ("purple", 130, 70, 190), ("pink", 230, 130, 180), ("brown", 140, 100, 60),
    ("black", 20, 20, 20), ("white", 240, 240, 240), ("gray", 140, 140, 140),
]
COLOR_WORDS = {
    **{c[0]: c[0] for c in COLORS},
    "grey": "gray", "violet": "purple", "cyan": "blue", "teal": "green", "maroon": "red", "beige": "brown",
    "dark": "dark", "light": "light",
}

# --- concepts ------------------------------------------------------------
CONCEPTS = {
    "travel": "flight hotel train ticket booking reservation boarding pnr departure arrival itinerary trip",
    "flight": "airline boarding departure arrival pnr gate seat airways",
    "hotel": "reservation checkin checkout room stay booking",
    "shopping": "order cart delivery price offer discount deal buy purchase store product",
    "deal": "offer discount sale price deal coupon cashback",
    "phone": "smartphone mobile handset device",
    "smartphone": "phone mobile handset",
    "laptop": "computer notebook macbook",
    "receipt": "invoice bill payment paid total receipt",
    "food": "restaurant order delivery zomato swiggy meal dining menu",
    "finance": "bank account balance transaction upi payment statement",
    "bank": "account balance statement transaction ifsc",
    "tax": "gst income return filing tds invoice ca",
    "education": "course study exam class lecture tutorial notes coaching",
    "work": "meeting project office report deadline presentation email",
    "health": "doctor hospital appointment prescription report clinic medicine",
    "entertainment": "movie show ticket booking concert series",
    "message": "chat conversation whatsapp sms message",
    "social": "post profile follower like comment share",
    "document": "certificate id passport license form application",
    "technology": "app software update device gadget",
}

# --- category rules: (category, keyword weights, hosts, host weight, price weight, code weight) ----
CATEGORY_RULES = [
    ("FLIGHTS", {"boarding pass": 2.0, "pnr": 2.0, "departure": 1.0, "arrival": 1.0, "flight": 1.0, "airline": 1.0, "gate": 0.5, "seat": 0.5},
     ["indigo", "airindia", "spicejet", "makemytrip", "goibibo", "yatra", "easemytrip"], 1.0, 0.0, 0.0),
    ("TRAVEL", {"booking confirmation": 2.0, "itinerary": 2.0, "checkin": 1.0, "hotel": 1.0, "reservation": 1.0, "trip": 1.0, "travel": 1.0},
     ["makemytrip", "goibibo", "booking.com", "airbnb", "oyorooms", "irctc"], 1.0, 0.0, 0.0),
    ("HOTELS", {"checkin": 1.5, "checkout": 1.5, "hotel": 1.0, "room booking": 2.0, "stay": 0.5},
     ["booking.com", "airbnb", "oyorooms", "makemytrip"], 1.0, 0.0, 0.0),
    ("TRAIN", {"pnr": 1.0, "irctc": 2.0, "train": 1.0, "coach": 1.0, "berth": 1.5, "railway": 1.0}, [], 0.0, 0.0, 0.0),
    ("SHOPPING", {"add to cart": 2.0, "buy now": 2.0, "order": 0.5, "delivery": 0.5, "discount": 1.0, "offer": 0.5, "deal": 0.5, "cart": 1.0, "checkout": 1.0, "cashback": 1.0},
     ["amazon", "flipkart", "myntra", "meesho", "ajio", "nykaa"], 1.5, 0.5, 0.0),
    ("RECEIPTS", {"invoice": 2.0, "receipt": 2.0, "total": 0.5, "paid": 0.5, "payment successful": 1.5, "order id": 1.0, "gstin": 1.5}, [], 0.0, 1.0, 0.0),
    ("FINANCE", {"balance": 1.0, "statement": 1.0, "transaction": 0.5, "account": 0.5, "upi": 0.5, "transfer": 0.5, "investment": 1.0, "mutual fund": 1.5},
     ["hdfcbank", "icicibank", "sbi", "axisbank", "kotak", "paytm", "phonepe", "groww", "zerodha"], 1.5, 0.0, 0.0),
    ("BANKING", {"otp": 1.0, "one time password": 1.5, "account": 0.5, "ifsc": 1.5, "debit card": 1.5, "credit card": 1.5, "netbanking": 1.5}, [], 0.0, 0.0, 1.0),
    ("TAX", {"gst": 1.5, "income tax": 2.0, "tds": 1.5, "tax": 1.0, "return filing": 2.0, "form 16": 2.0, "pan": 0.5, "ca ": 0.5},
     ["incometax.gov", "gst.gov", "cleartax"], 1.5, 0.0, 0.0),
    ("FOOD", {"restaurant": 1.0, "zomato": 2.0, "swiggy": 2.0, "delivery": 0.5, "menu": 0.5, "order food": 1.5}, ["zomato", "swiggy"], 1.5, 0.0, 0.0),
    ("WORK", {"meeting": 1.0, "project": 0.5, "deadline": 1.0, "presentation": 1.0, "report": 0.5, "standup": 1.5, "jira": 1.5, "slack": 1.0},
     ["slack", "teams", "zoom", "meet.google"], 1.0, 0.0, 0.0),
    ("EDUCATION", {"course": 1.0, "lecture": 1.5, "exam": 1.0, "tutorial": 1.0, "coaching": 1.5, "udemy": 1.5, "coursera": 1.5, "syllabus": 1.5},
     ["udemy", "coursera", "unacademy", "khanacademy"], 1.5, 0.0, 0.0),
    ("HEALTH", {"appointment": 1.0, "prescription": 2.0, "doctor": 1.0, "hospital": 1.0, "report": 0.5, "diagnosis": 1.5, "medicine": 1.0, "practo": 1.5}, [], 0.0, 0.0, 0.0),
    ("TECHNOLOGY", {"pixel": 0.5, "iphone": 0.5, "android": 0.5, "github": 1.5, "update available": 1.0, "software": 0.5, "ram": 0.5, "storage": 0.3},
     ["github", "stackoverflow", "play.google"], 1.5, 0.0, 0.0),
    ("SOCIAL", {"follower": 1.5, "instagram": 1.5, "post": 0.3, "like": 0.3, "story": 0.5, "tweet": 1.5, "facebook": 1.0},
     ["instagram", "facebook", "twitter", "x.com", "linkedin", "reddit"], 1.5, 0.0, 0.0),
    ("MESSAGES", {"whatsapp": 1.5, "telegram": 1.5, "chat": 0.5, "typing": 1.0, "online": 0.3, "message": 0.3}, ["whatsapp", "telegram"], 1.0, 0.0, 0.0),
    ("ENTERTAINMENT", {"movie": 1.0, "bookmyshow": 2.0, "concert": 1.0, "netflix": 1.5, "series": 0.5, "showtime": 1.5},
     ["bookmyshow", "netflix", "primevideo", "hotstar"], 1.5, 0.0, 0.0),
    ("DOCUMENTS", {"aadhaar": 2.0, "passport": 2.0, "license": 1.0, "certificate": 1.0, "pan card": 2.0, "voter": 1.5}, [], 0.0, 0.0, 0.0),
    ("TICKETS", {"ticket": 1.0, "entry pass": 2.0, "qr code": 0.5, "admit card": 2.0, "booking": 0.5}, [], 0.0, 0.0, 0.0),
]
CATEGORY_LABELS = {
    "SHOPPING": "Shopping", "RECEIPTS": "Receipts", "TRAVEL": "Travel", "FLIGHTS": "Flights", "HOTELS": "Hotels",
    "TRAIN": "Train", "FINANCE": "Finance", "BANKING": "Banking", "WORK": "Work", "EDUCATION": "Education",
    "TAX": "CA / Tax", "TECHNOLOGY": "Technology", "SOCIAL": "Social", "MESSAGES": "Messages",
    "ENTERTAINMENT": "Entertainment", "FOOD": "Food", "HEALTH": "Health", "DOCUMENTS": "Documents",
    "TICKETS": "Tickets", "OTHER": "Other",
}

# --- capture type rules: (type, keyword weights, hosts, host weight, price, code, layouts) --------
TYPE_RULES = [
    ("BANKING", {"otp": 1.0, "one time password": 1.5, "account": 0.4, "ifsc": 1.5, "upi": 0.5, "netbanking": 1.5, "debit card": 1.2, "credit card": 1.2, "balance": 0.8, "transaction": 0.4}, [], 0.0, 0.0, 1.0, {}),
    ("RECEIPT", {"invoice": 1.5, "receipt": 1.5, "gstin": 1.2, "total": 0.4, "paid": 0.4, "order id": 0.8}, [], 0.0, 0.6, 0.0, {"RECEIPT_LIKE": 1.2}),
    ("TICKET", {"boarding pass": 2.0, "pnr": 1.5, "departure": 0.8, "ticket": 0.6, "seat": 0.4, "gate": 0.4, "booking confirmation": 1.2}, ["bookmyshow", "irctc", "makemytrip"], 1.0, 0.0, 0.0, {}),
    ("PRODUCT_LISTING", {"add to cart": 1.8, "buy now": 1.8, "checkout": 0.8, "discount": 0.6, "in stock": 1.0, "free delivery": 1.0, "ratings": 0.8, "reviews": 0.5}, ["amazon", "flipkart", "myntra"], 1.2, 0.5, 0.0, {}),
    ("CHAT", {"typing": 1.2, "online": 0.3, "delivered": 0.5, "seen": 0.3, "message": 0.3, "reply": 0.4}, [], 0.0, 0.0, 0.0, {"CHAT_BUBBLES": 1.5}),
    ("DOCUMENT", {"aadhaar": 1.8, "passport": 1.8, "certificate": 1.0, "license": 0.8, "pan card": 1.8, "form 16": 1.5}, [], 0.0, 0.0, 0.0, {"TABLE": 0.5}),
    ("MAP", {"directions": 1.2, "km away": 1.0, "navigate": 1.0, "traffic": 0.6, "distance": 0.4, "eta": 0.8}, ["maps", "uber", "ola"], 1.0, 0.0, 0.0, {}),
    ("SOCIAL_MEDIA", {"followers": 1.2, "following": 0.8, "likes": 0.4, "comments": 0.4, "share": 0.3, "story": 0.4, "reels": 1.0}, ["instagram", "facebook", "twitter", "x.com", "reddit"], 1.2, 0.0, 0.0, {}),
    ("WEBPAGE", {"cookies": 1.0, "privacy policy": 1.0, "subscribe": 0.5, "newsletter": 0.8, "search": 0.2, "menu": 0.2}, [], 0.0, 0.0, 0.0, {}),
]
UI_MARKERS = [
    "settings", "search", "home", "back", "cancel", "done", "save",
    "notifications", "profile", "logout", "menu", "share", "edit",
]

# --- graph ---------------------------------------------------------------
CHROME_WORDS = """
search settings home back next more done save edit share copy paste delete cancel close open menu login
logout sign account profile update upgrade install uninstall download upload post posts page pages view
views data info help support about privacy terms cookie cookies high low medium new old yes no ok on off
add follow following followers like likes comment comments protection tracker trackers history recent
star stars court case report review reviews score scores
""".split()
PRODUCT_NOUNS = """
phone phones smartphone smartphones mobile handset laptop laptops notebook tablet tablets watch watches
earbuds headphones headphone earphone speaker speakers charger cable case cover screen guard glass stand
monitor television tv camera dslr lens printer router keyboard mouse console controller gpu ssd ram drive
shirt tshirt jeans dress saree kurta shoes sneakers sandals bag handbag wallet ring bracelet perfume book
books pen furniture sofa bed mattress bike bicycle car tyre tires helmet scooter subscription plan
recharge offer deal coupon voucher
""".split()

# --- organisation --------------------------------------------------------
CONFIRMATION_WORDS = [
    "booking confirmed", "confirmation", "order confirmed", "ticket confirmed",
    "reservation confirmed", "payment successful", "booking successful",
]
CHECKOUT_WORDS = ["checkout", "place order", "pay now", "proceed to pay"]
PAYMENT_WORDS = ["payment", "paid", "transaction", "upi", "card"]
TRAVEL_WORDS = ["flight", "hotel", "itinerary", "boarding pass", "pnr"]
RESEARCH_WORDS = ["review", "compare", "vs", "specifications", "price"]
IMPORTANT_STRONG = [
    "booking confirmed", "ticket", "order id", "invoice", "receipt", "pnr",
    "confirmation", "payment successful", "tracking",
]
IMPORTANT_WEAK = ["price", "offer", "discount", "booking", "reservation"]
TEMPORARY_WORDS = [
    "otp", "one time password", "verification code", "error", "expired", "session timeout", "try again",
]

# --- questions -----------------------------------------------------------
TIMELINE_WORDS = ["before", "after", "around", "earlier", "timeline", "when did", "sequence"]
PRICE_WORDS = ["price", "cost", "deal", "cheap", "cheapest", "lowest", "highest", "expensive"]
COMPARISON_WORDS = ["compare", "changed", "difference", "different", "without", "missing", "vs", "versus"]
CHANGE_WORDS = ["changed", "change", "different", "missing", "disappeared", "appeared"]
SUMMARIZE_WORDS = ["summarize", "summary", "main topics", "overview"]
COUNT_WORDS = ["how many", "count", "number of"]
LIST_WORDS = ["show me", "list", "all of", "everything"]
RELATIONSHIP_WORDS = ["what websites", "which sites", "where did", "sold by", "from which", "linked to"]
RECALL_WORDS = ["i remember", "remember", "blue header", "red button", "white background", "large"]
EXPLAIN_WORDS = ["why", "explain"]
ENTITY_WORDS = ["about", "related to", "everything on", "saved about", "collection"]
PREVIOUS_WORDS = ["it", "that", "this", "the one", "which", "when did i see", "show me that", "the lowest", "the cheapest"]
QUESTION_COLORS = ["blue", "red", "green", "white", "black", "yellow", "purple", "orange", "grey", "gray", "pink"]
QUESTION_STOP = """
the a an is are was were what which when where how did do does for in on at to of and or my me i you your
it that this with from by show find get have has had there any all some under below above over about around
before after price screenshot screenshots saved see saw seen
""".split()

# --- query prices --------------------------------------------------------
AT_MOST_WORDS = [
    "no more than", "not more than", "lesser than", "less than", "up to", "at most", "cheaper than",
    "below", "under", "within", "maximum of", "max of", "maximum", "max", "upto",
]
AT_LEAST_WORDS = [
    "no less than", "not less than", "greater than", "more than", "at least", "starting from",
    "starting at", "above", "over", "minimum of", "min of", "minimum", "min",
]
APPROXIMATE_WORDS = [
    "approximately", "approximatly", "approx", "around", "roughly", "nearly", "about", "close to",
    "near", "circa", "somewhere near",
]
PRICE_TRIGGER_WORDS = [
    "price", "prices", "cost", "costs", "costing", "costed", "priced", "pricing", "worth", "paying",
    "paid", "pay", "budget", "amount", "for", "at", "of", "mrp", "rate", "total", "billed", "bill",
    "sell", "sold", "only",
]
PRICE_IDENTIFIER_WORDS = [
    "id", "ids", "no", "nos", "num", "number", "order", "invoice", "receipt", "ref", "refs", "reference",
    "txn", "transaction", "upi", "booking", "aadhaar", "pan", "pin", "account", "otp", "code", "voucher",
    "coupon", "tracking", "awb", "rn", "imei", "isbn", "sku",
]
PRICE_TOLERANCE = 0.05

# --- privacy -------------------------------------------------------------
EMAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
PHONE = r"\b[+]?[\d\s()-]{7,15}\b"
CARD = r"\b(?:\d[ -]*?){13,19}\b"
PAN = r"\b[A-Z]{5}\d{4}[A-Z]\b"
NATIONAL_ID = r"\b\d{4}[ -]?\d{4}[ -]?\d{4}\b"
UPI = r"\b\w+@[\w.-]*(?:upi|apl|paytm|okaxis|ybl|sbi|okicici|oksbi|hdfcbank|icici)\b"
SHORT_CODE = r"\b\d{4,8}\b"
CODE_LABELLED = r"(?i)\b(?:otp|otp\s+code|verification\s+code|auth\s+code|2fa|two-factor|authenticator)[:\s]*(\d{4,8})\b"
SIX_DIGITS = r"\b\d{6}\b"
PASSWORD = r"(?i)\b(?:password|pwd|pass|pin|cvv|cvc)[:\s]*\S{4,20}"
ACCOUNT_NUMBER = r"\b\d{9,18}\b"
IFSC = r"\b[A-Z]{4}0[A-Z0-9]{6}\b"
TRANSACTION_ID = r"(?i)\b(?:txn|transaction|ref|reference|id)[:\s#]*\S{6,20}"
COMMUNICATION_WORDS = ["whatsapp", "telegram", "signal", "sms", "chat", "message", "conversation"]
KIND_PATTERNS = [
    ("OTP", r"(?i)\b(?:otp|one[\s-]?time|verification\s+code|2fa|mfa)\b"),
    ("BANKING", r"(?i)\b(?:bank|account\s+(?:number|no)|ifsc|netbanking|debit\s+card|credit\s+card|cvv|balance|statement)\b"),
    ("PAYMENT", r"(?i)\b(?:upi|payment\s+successful|transaction\s+(?:id|successful)|paid\s+₹|wallet)\b"),
    ("IDENTITY", r"(?i)\b(?:aadhaar|passport|pan\s+card|driving\s+licen[sc]e|voter\s+id|date\s+of\s+birth)\b"),
    ("PASSWORD", r"(?i)\b(?:password|passcode|passwd|pwd)\b[\s:]*\S"),
    ("PRIVATE_CHAT", r"(?i)\b(?:whatsapp|telegram)\b.{0,80}\b(?:love|secret|private|personal)\b"),
]
HISTORY_CODE_CONTEXT = r"(?i)\b(?:otp|o\.t\.p|one[\s-]?time|verification|verify|security|login|auth|2fa|mfa)\b"
LEAK = r"(?i)\b(otp|password|pin|cvv|aadhaar|pan)\s*[:#-]?\s*\S"
EMAIL_LOOSE = r"[a-zA-Z0-9._%+-]+\s*@\s*[a-zA-Z0-9.-]+\s*\.\s*[a-zA-Z]{2,}"
STREET = r"\d{1,5}\s+[A-Za-z][A-Za-z .-]{3,40}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Nagar|Colony|Layout|Marg|Chowk)"
ORDER_CODE = r"(?i:order|booking|pnr|confirmation|reservation|transaction|awb|tracking)[\s:#.\-]*([A-Z0-9]{6,20})\b"

# --- patterns that results depend on. Fixed values. -------------------------
URL_TAIL = r"""[^\s<>{}|\\^`"\[\]]"""
HOST_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
URL = (
    rf"(?i)(?:https?://{URL_TAIL}+|www\.{URL_TAIL}+"
    rf"|(?<![\w@])(?:{HOST_LABEL}\.)+(?:{'|'.join(TLDS)})(?::\d{{1,5}})?(?:/{URL_TAIL}*)?)"
)
PRICE_NUMBER = r"\d[\d,]*(?:\.\d{1,2})?"
PHONE_PATTERNS = [
    r"\+91[\s\-]*[6-9]\d{4}[\s\-]*\d{5}",
    r"\+91[6-9]\d{9}",
    r"(?<!\d)91[\s\-]?[6-9]\d{4}[\s\-]?\d{5}(?!\d)",
    r"(?<!\d)0?[6-9]\d{4}[\s\-]?\d{5}(?!\d)",
]
#: What every phone pattern above holds.
PHONE_CORE = r"[6-9]\d{4}[\s\-]*\d{5}"
MONTH_ALT = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
    "|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec"
)
DATE_SEPARATOR = r"\s*([/.\-])\s*"
DATE_YMD = rf"\b(\d{{4}}){DATE_SEPARATOR}(\d{{1,2}})\2\s*(\d{{1,2}})\b"
DATE_COMPACT = r"\b(\d{4})(\d{2})(\d{2})\b"
DATE_DMY = rf"\b(\d{{1,2}}){DATE_SEPARATOR}(\d{{1,2}})\2\s*(\d{{2,4}})\b"
DATE_DAY_NAME = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?[\s\-]+({MONTH_ALT})\.?[\s\-]+(\d{{2,4}})\b"
DATE_NAME_DAY = rf"(?i)\b({MONTH_ALT})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?[\s,\-]+(\d{{2,4}})\b"
DATE_SHORT_NUMBER = rf"(?<![\d/.\-])(\d{{1,2}}){DATE_SEPARATOR}(\d{{1,2}})(?![\d/.\-])"
DATE_SHORT_DAY = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?[\s\-]+({MONTH_ALT})\.?\b"
DATE_SHORT_NAME = rf"(?i)\b({MONTH_ALT})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?\b"
RECEIPT_NUMBER = r"[\d,]+\.?\d*"

# --- patterns of query texts. Fixed values. ---------------------------------
QUERY_MONTH = "(?:" + "|".join(sorted([*MONTH_NAMES, *[m[:3] for m in MONTH_NAMES], "sept"], key=len, reverse=True)) + ")"
QUERY_TODAY = r"(?i)\b(?:today|tonight|just now)\b"
QUERY_YESTERDAY = r"(?i)\byesterday\b"
QUERY_THIS_WEEK = r"(?i)\b(?:this|current)\s+week\b"
QUERY_LAST_WEEK = r"(?i)\b(?:last|previous|past)\s+week\b"
QUERY_THIS_MONTH = r"(?i)\b(?:this|current)\s+month\b"
QUERY_LAST_MONTH = r"(?i)\b(?:last|previous|past)\s+month\b"
QUERY_THIS_YEAR = r"(?i)\b(?:this|current)\s+year\b"
QUERY_LAST_YEAR = r"(?i)\b(?:last|previous|past)\s+year\b"
QUERY_LAST_N = r"(?i)\b(?:last|past|previous)\s+(\d{1,3})\s+(day|week|month|year)s?\b"
QUERY_ISO = r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b"
QUERY_SLASH = r"\b(\d{1,2})/(\d{1,2})/(\d{2,4})\b"
QUERY_BEFORE = r"(?i)\b(?:before|prior to|earlier than|until|till|up to)\s+"
QUERY_AFTER = r"(?i)\b(?:after|since)\s+"
QUERY_MONTH_YEAR = rf"({QUERY_MONTH})\b(?:\s+(\d{{4}}))?"
QUERY_YEAR = r"((?:19|20)\d{2})\b"
QUERY_DAY_NAME = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({QUERY_MONTH})\b(?:\s+(\d{{4}}))?"
QUERY_NAME_DAY = rf"(?i)\b({QUERY_MONTH})\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s*(\d{{4}})?\b"
QUERY_IN_MONTH = rf"(?i)\b(?:(?:in|from|during|of)\s+)?({QUERY_MONTH})\b(?:\s+(\d{{4}}))?"
QUERY_IN_YEAR = r"(?i)\b(?:in|from|during|of)\s*((?:19|20)\d{2})\b"
QUERY_HOST = r"(?i)\b(?:https?://)?(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,24}(?::\d{1,5})?(?:/[^\s]*)?"
QUERY_CODE = (r"(?i)\b(?:otp|o\.t\.p|one[\s-]?time(?:\s+(?:password|code|pin|otp))?|verification\s+code|verify\s+code|security\s+code|login\s+code|auth\s+code|"
              r"2fa\s+code|mfa\s+code|captcha|pin)\b[\s:#.\-]*(\d{4,8})\b")
QUERY_SYMBOLS = "₹$€£"
QUERY_BETWEEN = (rf"(?i)\bbetween\s+(?:([{QUERY_SYMBOLS}])\s?)?(\d[\d,]*(?:\.\d{{1,2}})?)\s*(?:and|to|-|–|—)\s*"
                 rf"(?:([{QUERY_SYMBOLS}])\s?)?(\d[\d,]*(?:\.\d{{1,2}})?)")
QUERY_AMOUNT = r"\d{1,3}(?:[,\s]\d{2,3})+(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?"
QUERY_TYPE_PATTERNS = [
    ("DUPLICATES", r"(?i)\b(?:near[\s-]?)?duplicates?\b|\bidentical\s+(?:screenshots?|images?|copies)\b"),
    ("OTPS", r"(?i)\b(?:otp|o\.t\.p)s?\b|\bone[\s-]?time\s+(?:passwords?|codes?|pins?)\b|\b(?:verification|verify|security|login|auth)\s+codes?\b"),
    ("URLS", r"(?i)\b(?:with|containing|has|have|including|shows?)\s+(?:a\s+|an\s+|any\s+)?(?:urls?|links?|websites?|web\s+pages?)\b|\burls?\b|\blinks?\b|\bwebsites?\b"),
    ("PRICES", r"(?i)\bwith\s+(?:a\s+)?prices?\b|\bcontaining\s+(?:a\s+)?prices?\b|\bprice\s+lists?\b"),
    ("PHONES", r"(?i)\bwith\s+(?:a\s+)?(?:phone|contact|mobile)\s*(?:numbers?)?\b|\bcontaining\s+(?:a\s+)?phone\s*numbers?\b|\bphone\s+numbers?\b|\bcontacts?\b"),
    ("DATES", r"(?i)\bwith\s+(?:a\s+)?dates?\b|\bcontaining\s+(?:a\s+)?dates?\b|\bdate\s+range\b"),
]
QUERY_LONG = r"(?i)\b(?:long|tall|stitched|full[\s-]?page|scrolling)\s+(?:screenshots?|images?|pics?|captures?|shots?)\b"
QUESTION_DOMAIN = r"[a-z0-9-]+[.][a-z]{2,}"
QUESTION_NUMBER = r"\s*₹?\s*([\d,]+(?:\.\d+)?)\s*(k?)"
QUESTION_AT_MOST = r"(?:under|below|less than|up to|cheaper than|at most)" + QUESTION_NUMBER
QUESTION_AT_LEAST = r"(?:above|over|more than|greater than|from|at least)" + QUESTION_NUMBER
#: Phrases of a period and what it spans, in order of precedence: days back to its start, days back to its end, months back to its start.
QUESTION_PERIODS = [
    ("today", 0, 0, 0), ("yesterday", 1, 1, 0), ("this week", 7, 0, 0), ("last week", 7, 0, 0), ("this month", 30, 0, 0),
    ("last month", 0, 0, 1), ("recently", 14, 0, 0), ("a few days ago", 14, 0, 0), ("a few weeks ago", 30, 0, 0),
]

# Layout thresholds on a screen of 1000 by 1000 units. Fixed values.
LAYOUT = {
    "chat_width": (60, 620), "chat_height": (8, 120), "chat_boxes": 4, "chat_rows": 4, "chat_per_row": 2, "chat_turns": 3, "middle": 500,
    "table_per_row": 3, "table_rows": 2, "table_edge": 30, "receipt_boxes": 5, "receipt_width": (60, 560), "receipt_left": (300, 700),
    "form_boxes": 6, "form_rows": 5, "form_width": 620, "form_edge": 60, "article_boxes": 6, "article_width": 700, "article_height": (10, 60), "least_boxes": 3,
}
