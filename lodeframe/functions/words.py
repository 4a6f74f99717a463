"""Word lists, symbols and patterns that results depend on."""

# Words read as true and as false.
TRUE_WORDS = (
    "true", "yes", "y", "1", "t", "on", "active", "enabled", "checked", "pass", "ok", "correct", "positive",
)
FALSE_WORDS = (
    "false", "no", "n", "0", "f", "off", "inactive", "disabled", "unchecked", "fail", "wrong", "negative",
)

# Texts that stand for a missing value.
PSEUDO_NULLS = (
    "n/a", "na", "nan", "null", "none", "--", "-", ".", "..", "missing", "undefined", "not available", "not applicable",
    "no data", "empty", "#n/a", "#ref!", "#value!", "#null!", "?", "unknown", "tbd", "tba", "nil",
)

# Money.
CURRENCY_SYMBOLS = "$€£¥₹₽₩₪₫¢₴₦"
CURRENCY = (
    r"^\s*[$€£¥₹₽₩₪₫¢₴₦]?\s*[\-+]?\s*[\d,]+\.?\d*\s*[KkMmBbTt]?\s*$"
    r"|^\s*\([\d,]+\.?\d*\)\s*$"
    r"|^\s*[\-+]?\s*[\d,]+\.?\d*\s*[$€£¥₹₽₩₪₫¢₴₦]\s*$"
    r"|^\s*[\-+]?\s*[\d,]+\.?\d*\s*%\s*$"
)
SUFFIXES = {"K": 1e3, "M": 1e6, "B": 1e9, "T": 1e12}

# Structured texts.
URL = r"(?i)^https?://\S+$"
EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
IP = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"

# Markup and emoji.
HTML_TAG = r"<[^>]+>"
MARKDOWN = r"[*_~`#\[\]()!]"
URL_INSIDE = r"https?://\S+"
EMOJI = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}"
    r"\x{1FA70}-\x{1FAFF}\x{2702}-\x{27B0}\x{FE00}-\x{FE0F}\x{1F1E0}-\x{1F1FF}]+"
)

# Contractions.
CONTRACTIONS = {
    "don't": "do not", "doesn't": "does not", "didn't": "did not", "won't": "will not", "wouldn't": "would not",
    "couldn't": "could not", "shouldn't": "should not", "can't": "cannot", "isn't": "is not", "aren't": "are not",
    "wasn't": "was not", "weren't": "were not", "hasn't": "has not", "haven't": "have not", "hadn't": "had not",
    "mustn't": "must not", "shan't": "shall not", "needn't": "need not", "i'm": "i am", "you're": "you are",
    "he's": "he is", "she's": "she is", "it's": "it is", "we're": "we are", "they're": "they are", "i've": "i have",
    "you've": "you have", "we've": "we have", "they've": "they have", "i'll": "i will", "you'll": "you will",
    "he'll": "he will", "she'll": "she will", "we'll": "we will", "they'll": "they will", "i'd": "i would",
    "you'd": "you would", "he'd": "he would", "she'd": "she would", "we'd": "we would", "they'd": "they would",
    "let's": "let us", "that's": "that is", "who's": "who is", "what's": "what is", "here's": "here is",
    "there's": "there is", "where's": "where is", "how's": "how is",
}

# Formats tried for dates, in order.
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd",
    "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "yyyyMMdd",
)

# Pairs that stand for yes and no, and which of them means yes.
BOOLEAN_PAIRS = (
    ("yes", "no"), ("y", "n"), ("true", "false"), ("t", "f"), ("1", "0"), ("on", "off"), ("active", "inactive"),
    ("enabled", "disabled"), ("m", "f"), ("male", "female"), ("pass", "fail"), ("positive", "negative"),
)
POSITIVE = ("yes", "y", "true", "t", "1", "on", "active", "enabled", "pass", "positive", "male")

# Ordered scales.
ORDINALS = (
    ("low", "medium", "high"),
    ("small", "medium", "large"),
    ("bronze", "silver", "gold", "platinum"),
    ("poor", "fair", "good", "very good", "excellent"),
    ("none", "mild", "moderate", "severe"),
    ("beginner", "intermediate", "advanced", "expert"),
    ("very low", "low", "medium", "high", "very high"),
    ("freshman", "sophomore", "junior", "senior"),
    ("xs", "s", "m", "l", "xl", "xxl"),
)

# Patterns of semantic types.
SEMANTIC = {
    "email": r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$",
    "url": r"(?i)^https?://[^\s]+$|^www\.[^\s]+$",
    "ip": r"^(\d{1,3}\.){3}\d{1,3}$|^([0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}$",
    "phone": r"^[\+]?[0-9\s\-\(\)\.]{7,20}$",
    "currency": r"^[\$€£¥₹₽][\s]?[\d,]+\.?\d*$|^[\d,]+\.?\d*[\s]?[\$€£¥₹₽]$",
    "percentage": r"^[\-+]?\d+\.?\d*\s*%$",
    "hash": r"^[0-9a-fA-F]{32,128}$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "geo": r"^[\-+]?\d+\.?\d*[,\s]+[\-+]?\d+\.?\d*$",
    "binary": r"^[01]{11,}$",
}

# Personal data inside texts, and column names that hold names of people.
PERSONAL = {
    "email": r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "phone": r"(?:\+?\d{1,3}[\s\-]?)?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{4}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d{4}[\s\-]?){3}\d{4}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "us_zip": r"\b\d{5}(?:-\d{4})?\b",
}
NAME_COLUMNS = (
    "name", "first_name", "last_name", "full_name", "firstname", "lastname", "fname", "lname", "author", "user", "username",
    "customer_name",
)

# Scripts by their characters.
SCRIPTS = {
    "English": r"[a-zA-Z]",
    "Chinese": r"[\x{4e00}-\x{9fff}]",
    "Japanese": r"[\x{3040}-\x{309f}\x{30a0}-\x{30ff}]",
    "Korean": r"[\x{ac00}-\x{d7af}]",
    "Arabic": r"[\x{0600}-\x{06ff}]",
    "Cyrillic": r"[\x{0400}-\x{04ff}]",
    "Devanagari": r"[\x{0900}-\x{097f}]",
    "Thai": r"[\x{0e00}-\x{0e7f}]",
    "Latin Extended": r"[\x{00c0}-\x{024f}]",
}

# What texts may mention, and how often it must occur to count.
ENTITIES = {
    "dates": (r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s+\d{1,2},?\s*\d{4}|\b\d{1,2}/\d{1,2}/\d{2,4}\b", 5),
    "currency_amounts": (r"[\$€£¥₹]\s?\d+(?:[,\.]\d+)*", 3),
    "possible_locations_or_names": (r"\b[A-Z][a-z]+(?:\s[A-Z][a-z]+)+\b", 10),
    "emails": (PERSONAL["email"], 2),
    "phone_numbers": (PERSONAL["phone"], 2),
}
MARKUP = {"html": r"<[a-zA-Z][^>]*>", "markdown": r"(\*\*|__|#+\s|```|\[.*\]\(.*\)|!\[)"}

# What a text must hold to fit the pattern of that name; short patterns that fail at the first character.
NEEDED = {
    "html": "<", "email": "@", "emails": "@", "phone": r"\d{3}[\s\-]?\d{4}", "phone_numbers": r"\d{3}[\s\-]?\d{4}", "dates": r"\d{4}|\d/\d", "currency_amounts": r"[\$€£¥₹]",
    "ssn": r"\d{3}-\d{2}-\d{4}", "credit_card": r"\d{4}[\s\-]?\d{4}", "ip_address": r"\d\.\d", "us_zip": r"\d{5}", "markdown": r"\*\*|__|#\s|```|\]\(|!\[",
}

# Formats of dates in texts.
DATE_SHAPES = (
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "ISO 8601"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", "YYYY-MM-DD HH:MM:SS"),
    (r"^\d{4}-\d{2}-\d{2}", "YYYY-MM-DD"),
    (r"^\d{2}/\d{2}/\d{4}", "MM/DD/YYYY or DD/MM/YYYY"),
    (r"^\d{2}-\d{2}-\d{4}", "MM-DD-YYYY or DD-MM-YYYY"),
    (r"^\d{2}\.\d{2}\.\d{4}", "DD.MM.YYYY"),
    (r"^\d{4}/\d{2}/\d{2}", "YYYY/MM/DD"),
    (r"^\w+ \d{1,2}, \d{4}", "Month DD, YYYY"),
    (r"^\d{1,2} \w+ \d{4}", "DD Month YYYY"),
)

# Number formatting found in texts.
NUMBER_FORMATS = {
    "currency symbols": r"[\$€£¥₹₽]",
    "thousand separators": r"\d{1,3}(?:,\d{3})+",
    "percentage signs": r"%",
}

# Names that suggest a target, weakly or strongly, or rule it out.
TARGET_STRONG = (
    "target", "label", "outcome", "result", "prediction", "predicted", "class", "y", "dependent", "response", "output",
    "score", "grade", "rating", "rank", "diagnosis", "disease", "mortality", "readmission", "severity", "positive",
    "negative", "malignant", "benign", "survival", "default", "bankrupt", "risk", "fraud", "anomaly", "return", "profit",
    "loss", "credit", "churn", "purchase", "conversion", "revenue", "demand", "satisfaction", "sentiment", "recommend",
    "attrition", "turnover", "performance", "promotion", "hired", "fired", "left", "resigned", "failure", "defect",
    "quality", "downtime", "rul", "exam_score", "final_score", "test_score", "passed", "failed", "survived", "event",
    "censored",
)
TARGET_WEAK = (
    "is_", "has_", "was_", "will_", "price", "salary", "amount", "total", "count", "status", "approved", "accepted",
    "rejected", "flag", "forecast", "predicted", "expected", "estimated", "click", "engagement", "nps", "ltv", "value",
)
TARGET_NEVER = (
    "id", "index", "idx", "key", "pk", "name", "first_name", "last_name", "username", "date", "time", "timestamp",
    "created", "updated", "modified", "url", "uri", "link", "path", "email", "phone", "address", "city", "state", "zip",
    "country", "description", "comment", "note", "text", "body", "file", "image", "photo", "avatar",
)
