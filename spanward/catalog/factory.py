"""Constants of labelled-text production."""

# Domain pools.
TRAINING_DOMAINS = [
    "formal business email",
    "Slack/Teams messaging chat",
    "customer support ticket description",
    "legal contract clause",
    "medical intake form notes",
    "call center audio transcript",
    "internal corporate memo",
    "HR employee incident report",
    "database migration query log",
    "online bank statement comment",
    "software system trace log",
    "e-commerce shipping invoice",
    "job application cover letter",
    "insurance claim description",
    "financial audit report footnote",
    "product review forum post",
    "API request payload JSON log",
    "academic research survey response",
    "government tax filing notes",
    "real estate lease agreement text",
]
HELD_OUT_DOMAINS = [
    "insurance claim description",
    "legal contract clause",
    "medical intake form notes",
    "call center audio transcript",
    "internal corporate memo",
    "financial audit report footnote",
    "product review forum post",
    "academic research survey response",
    "government tax filing notes",
    "real estate lease agreement text",
    "database migration query log",
    "software system trace log",
]

# Ratios, sizes and markers.
NEUTRAL_LABEL = "NEUTRAL"
NEUTRAL_SHARE = 0.10
HARD_NEGATIVE_SHARE = 0.12
BATCH_SIZE = 15
NEAR_DUPLICATE_RATIO = 0.85
LEAKAGE_JACCARD = 0.5
PLACEHOLDER = "[PII]"
SAMPLE_STYLE = "Clean / Standard Sentence"
UNKNOWN_DOMAIN = "Unknown"
GENERATION_TRIES = 10
PERTURB_STEPS = 30
PERTURB_REPLACEMENTS = "ABCXYZ987"
PERTURB_INSERTS = "-/_*#"
PERTURB_LETTERS = "JKL"
EMPTIED_VALUE = "distractor_value"
API_KEY_PREFIX = "sk-live-"

# Label names that share one kind of made-up value.
VALUE_KINDS = {
    "name": ["person", "name", "patient", "client", "user", "owner"],
    "email": ["email", "email address"],
    "phone": ["phone", "phone number", "mobile", "contact"],
    "address": ["address", "location", "street", "city"],
    "password": ["password", "passcode", "pwd", "pin"],
    "card": ["credit card", "credit card number", "cc", "card"],
    "bank": ["bank account", "bank account number", "iban", "bban"],
    "ssn": ["ssn", "social security number"],
    "api_key": ["api key", "apikey", "secret"],
}

# Dictionaries for made-up names, places and domains.
FIRST_NAMES = "Alice Bruno Carla Dmitri Elena Farid Grace Hugo Ines Jonas Karim Lena Mateo Nadia Oscar Priya".split()
LAST_NAMES = "Abbott Berger Castillo Dawson Eriksen Fischer Gupta Haddad Ibarra Jensen Keller Larsen Moreau Novak".split()
STREETS = "Oak Maple Cedar Lake Hill River Park Sunset Willow Spring".split()
CITIES = "Ashford Brookfield Clayton Dunmore Easton Fairview Granville Hartley".split()
MAIL_DOMAINS = ["example.com", "example.org", "example.net", "mail.example.com"]
