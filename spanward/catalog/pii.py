"""Personal-data catalogue."""

# The ten labels with their patterns, in catalogue order.
PATTERNS = {
    "person": r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b",
    "email address": r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b",
    "phone number": r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "address": r"\b\d+\s+[A-Za-z0-9\s,.]+ St(?:reet)?|Ave(?:nue)?|Rd|Road\b",
    "credit card number": r"\b(?:\d[ -]*?){13,16}\b",
    "social security number": r"\b\d{3}-\d{2}-\d{4}\b",
    "passport number": r"\b[A-Z0-9]{6,9}\b",
    "bank account number": r"\b\d{9,18}\b",
    "password": r"\b[a-zA-Z0-9!@#$%^&*()_+]{8,20}\b",
    "api key": r"\b[a-zA-Z0-9_-]{16,40}\b",
}

# Default domain text per label.
DATA_FORMATS = {
    "person": "HR records / employee lists",
    "email address": "Tech/Support communications",
    "phone number": "Customer contact logs",
    "address": "Legal contracts / shipping invoices",
    "credit card number": "Banking invoices / payment summaries",
    "social security number": "HR tax documentation",
    "passport number": "Travel booking itineraries",
    "bank account number": "Banking transactions",
    "password": "Access logs / credentials",
    "api key": "Tech/Support API logs",
}

# Policy defaults.
DEFAULT_LABELS = [
    "credit card number",
    "social security number",
    "passport number",
    "bank account number",
    "password",
    "api key",
    "person",
    "email address",
    "phone number",
    "address",
]
DEFAULT_ACTION = "MASK"
DEFAULT_THRESHOLD = 0.4
SUPPRESSED_RESPONSE = "[Response suppressed: model output contained blocked PII]"
BLOCK_REASON_PREFIX = "PII policy violation: request blocked due to detected "

# Generic phrases for rewritten spans.
REWRITE_PHRASES = {
    "person": "the user",
    "phone number": "a contact number",
    "address": "their address",
}

# Canonical label by the first fragment found in the upper-cased raw label.
CANONICAL_RULES = [
    (("FIRSTNAME", "LASTNAME", "SURNAME", "NAME", "PER"), "person"),
    (("EMAIL",), "email address"),
    (("PHONE", "TELEPHONE", "MOBILE"), "phone number"),
    (("CARD", "ACCOUNTNUMBER"), "credit card number"),
    (("SSN", "SOCIALSECURITY"), "social security number"),
    (("PASSPORT",), "passport number"),
    (("BANK", "IBAN"), "bank account number"),
    (("ADDRESS", "STREET", "CITY", "ZIP", "LOC"), "address"),
    (("PASSWORD",), "password"),
    (("KEY", "SECRET"), "api key"),
]
FIRST_CUSTOM_LABEL_ID = 111

# The default profile holds all labels; leaving one out is the caller's choice.
DETECTION_LABELS = list(PATTERNS)
