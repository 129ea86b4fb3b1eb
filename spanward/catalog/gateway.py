"""Endpoint catalogue and request-analysis vocabulary."""

# Fixed values: (cluster, model, rpm, tpm, tpr, cost per million tokens, tier) in configuration order.
ENDPOINTS = [
    ("primary-cluster", "groq/llama-3.1-8b-instant", 30, 100000, 131072, 0.05, "medium"),
    ("primary-cluster", "cerebras/llama3.1-8b", 30, 200000, 8192, 0.01, "low"),
    ("primary-cluster", "groq/llama-3.3-70b-versatile", 30, 100000, 131072, 0.70, "high"),
    ("backup-cluster", "together_ai/meta-llama/Meta-Llama-3.1-8B-Instruct-Turbo", 50, 150000, 131072, 0.20, "medium"),
    ("backup-cluster", "together_ai/meta-llama/Llama-3.3-70B-Instruct-Turbo", 50, 150000, 131072, 0.90, "high"),
    ("backup-cluster", "groq/llama-3.1-8b-instant", 1000, 100000, 131072, 0.05, "low"),
]
FALLBACKS = {"primary-cluster": ["backup-cluster"]}
BACKUP_CLUSTER = "backup-cluster"

# Endpoint defaults and the price thresholds of the tiers.
DEFAULT_RPM = 1000
DEFAULT_TPM = 100000
DEFAULT_TPR = 8192
DEFAULT_COST = 0.1
HIGH_TIER_COST = 0.50
MEDIUM_TIER_COST = 0.04
CATALOGUE_TPM = 50000
CATALOGUE_COST = 0.05
DEFAULT_CREDIT_LIMIT = 9999.0
DEFAULT_MAX_TOKENS = 1000
USAGE_WINDOW_SECONDS = 60
USAGE_EXPIRY_SECONDS = 65
LATEST_EVENTS = 50

# Complexity vocabulary and limits.
HIGH_KEYWORDS = [
    "code", "python", "javascript", "c++", "rust", "java", "html", "css", "sql", "git",
    "algorithm", "function", "refactor", "debug", "optimize", "regex", "database",
    "proof", "theorem", "math", "calculus", "derive", "solve", "equation",
    "analyze", "evaluate", "architecture", "design pattern", "system design",
    "compare and contrast", "step by step", "reasoning", "logical deduction",
]
MEDIUM_KEYWORDS = [
    "summar", "summary", "report", "translation", "translate", "synopsis", "outline", "draft",
    "rewrite", "rephrase", "format", "extract", "list", "bullet points", "email",
    "explain", "what is", "how does",
]
CODE_MARKERS = ["```", "def ", "import "]
CODE_MARKER_WEIGHT = 3
BRACES_OVER = 2
HIGH_CONTEXT = 8192
KEYWORD_CONTEXT = 2048
MEDIUM_CONTEXT = 1024
LONG_MESSAGE = 500
MESSAGE_OVERHEAD = 4
REQUEST_OVERHEAD = 2
CHARS_PER_TOKEN = 4
TIER_NUMBER = {"low": 1, "medium": 2, "high": 3}
UNKNOWN_TIER = 2
TIER_CLASH_PENALTY = 5.0

# Screening follows the cleaning of all messages, so its events come behind theirs.
SAFETY_POSITION = 1 << 40
