"""Name lists, patterns and limits the operators take as defaults.

Every operator accepts these as parameters, so another API ecosystem is a
change of data and not of code.
"""

# --- fixed values: whitespace as ECMAScript understands it -------------------
# Java's and RE2's \s are ASCII only, so the Unicode members are spelled out.
WS = "[\\s\\x0b   -     　﻿]"

# --- fixed values: names that decide a literal's position --------------------
MODEL_NAME_PATTERN = "(?i)model"
DEPLOYMENT_NAMES = ("deployment", "deploymentName", "deployment_name")
TS_FACTORIES = (
    "google",
    "openai",
    "anthropic",
    "createOpenAI",
    "createAnthropic",
    "createGoogleGenerativeAI",
    "getGenerativeModel",
    "generativeModel",
    "languageModel",
    "chat",
)
PY_FACTORIES = (
    "GenerativeModel",
    "ChatOpenAI",
    "ChatAnthropic",
    "ChatGoogleGenerativeAI",
    "init_chat_model",
)
TRANSPARENT_CASTS = ("string", "const")

# --- fixed values: model classes, tested in this order -----------------------
MODEL_CLASSES = (
    ("moderation", "moderation"),
    ("embedding", "embedding|(^|-)embed(-|$)"),
    ("tts", "(^|-)tts(-|$)|text-to-speech"),
    ("audio", "whisper|transcribe|(^|-)audio(-|$)|speech-to-text"),
    ("image", "dall-e|dalle|imagen|stable-diffusion|sdxl|gpt-image|(^|-)image(-|$)"),
)
DEFAULT_CLASS = "chat"
OUT_OF_CLASS = ("moderation", "image", "audio", "tts")

# --- fixed values: review reasons in reporting order -------------------------
# The last two are reserved: they have a rank but no operator emits them.
REVIEW_REASONS = (
    "replacement_unverified",
    "platform_blocked",
    "usage_unverified",
    "type_cast_masked",
    "dynamic_model_value",
    "insufficient_dataflow",
)
TIERS = ("A", "B", "C")

# --- fixed values: registry vocabulary ---------------------------------------
RECORD_KINDS = ("model_id", "param_rename", "param_removal")
LIFECYCLES = ("retired", "deprecated")
VERIFICATION_STATUSES = ("verified", "quarantined", "unverified", "unverifiable")
REVIEW_STATES = ("quarantined", "unverified", "unverifiable", "unstamped", "withheld")
SWITCHES = ("officialSourceConfirmed", "replacementConfirmed", "autoApplyAllowed")
PROPOSERS = ("llm-research", "human", "discovery")
CAVEAT_MARKERS = (
    "do not auto-apply",
    "unverified",
    "status unknown",
    "itself deprecated",
    "not the currently-recommended",
    "stale",
)
CONTENT_HASH_PATTERN = "^sha256:[0-9a-f]{64}$"
EXCERPT_MAX_CHARS = 240
REGISTRY_STALE_DAYS = 30

# --- fixed values: deprecation-page reading ----------------------------------
MODEL_HEADER = r"(?i)\bmodel\b"
REPLACEMENT_HEADER = r"(?i)\b(?:replacement|substitute)\b"
DATE_HEADER = r"(?i)\b(?:shutdown|retirement|deactivation|sunset)\b"
PRICE_HEADER = r"(?i)\bprice\b"
MODEL_ID_SHAPE = r"^[a-z][a-z0-9]*(?:[.-][a-z0-9]+)+$"
PROVIDER_ID_PATTERNS = {
    "openai": "^(?:gpt|o[1-9]|chatgpt|codex|text-|code-|davinci-|babbage-|curie-|ada-|whisper-|tts-|dall-e|omni-)",
    "anthropic": "^claude-",
    "google": "^(?:gemini|palm|imagen|text-bison|chat-bison)",
}
FIRST_PARTY = ("anthropic", "openai", "google")
MONTHS = (
    "jan", "feb", "mar", "apr", "may", "jun",
    "jul", "aug", "sep", "oct", "nov", "dec",
)
# U+2010..U+2015 and U+2212
UNICODE_DASHES = "[‐-―−]"

# Officially recommended successors, per provider.
OFFICIAL_RECOMMENDATIONS = {
    "anthropic": {
        "claude-opus-4-1-20250805": "claude-opus-4-8",
        "claude-opus-4-20250514": "claude-opus-4-8",
        "claude-opus-4-5-20251101": "claude-opus-4-8",
        "claude-sonnet-4-20250514": "claude-sonnet-4-6",
        "claude-3-haiku-20240307": "claude-haiku-4-5-20251001",
        "claude-3-5-haiku-20241022": "claude-haiku-4-5-20251001",
        "claude-3-7-sonnet-20250219": "claude-sonnet-4-6",
        "claude-3-5-sonnet-20240620": "claude-sonnet-4-6",
        "claude-3-5-sonnet-20241022": "claude-sonnet-4-6",
        "claude-3-opus-20240229": "claude-opus-4-8",
        "claude-3-sonnet-20240229": "claude-sonnet-4-6",
    },
    "openai": {
        "gpt-4-0613": "gpt-5.6-sol",
        "o1-preview": "o3",
        "o1-mini": "o4-mini",
        "gpt-4-32k": "gpt-4o",
        "gpt-3.5-turbo-0613": "gpt-3.5-turbo",
        "text-moderation-007": "omni-moderation",
        "gpt-3.5-turbo-instruct": "gpt-5.6-terra",
    },
    "google": {},
}

# --- fixed values: source-tree scope -----------------------------------------
TS_EXTENSIONS = r"\.(ts|tsx|mts|cts)$"
TS_EXCLUDED_DIRS = ("node_modules", ".git", "dist", "build", "out", ".next", "coverage")
PY_EXCLUDED_DIRS = (
    ".git", "node_modules", ".venv", "venv", "site-packages",
    "__pycache__", ".tox", ".mypy_cache", ".pytest_cache",
)
TS_TEST_PATTERNS = (
    r"\.(test|spec|vitest|e2e)\.[mc]?[jt]sx?$",
    r"(^|/)(__tests__|__mocks__|__fixtures__|tests?|test-helpers?|test-utils|testing|mocks?|fixtures?|e2e)/",
    r"(^|/)mock[-.][^/]*$|[-.]mocks?\.[mc]?[jt]sx?$",
)
PY_TEST_PATTERNS = (
    r"(^|/)test_[^/]*\.py$",
    r"_test\.py$",
    r"(^|/)conftest\.py$",
    r"(^|/)tests?/",
)
CATALOG_BASENAME = "(?i)prices|models|constant|limits|llm-list|masks"
CATALOG_DISTINCT_IDS = 10
ANNOTATION_LINES = 5
ANNOTATIONS = ("model-catalog", "ignore-file")

# --- fixed values: spec diff, logs, gates ------------------------------------
CHANGE_KINDS = ("field_rename", "field_removed", "type_change", "enum_value_change")
LOG_MAX_CHARS = 8000
GATES = ("typecheck", "tests", "eval")
GATE_REQUIRED = {"typecheck": True, "tests": False, "eval": True}
SNAPSHOT_MAX_BYTES = 1024 * 1024
SNAPSHOT_WINDOW_BYTES = 64 * 1024
SNAPSHOT_HEAD_SHARE = 0.5
SNAPSHOT_MARKER_RESERVE = 1024
MIN_ANCHOR_TOKEN = 6
