"""Schemas, the label domain and the rule tables.

The values under "FIXED VALUES" must equal the reference's for identical
results; they are stated plainly and in their natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES -- label domain (ordered; id = position)
# ---------------------------------------------------------------------------
SEVERITY_ORDER = ["medium", "high", "critical"]
SEVERITY_TO_ID = {label: i for i, label in enumerate(SEVERITY_ORDER)}
NUM_CLASSES = len(SEVERITY_ORDER)

# Score levels produced by the rule scorer (superset of the label domain).
SCORE_LEVELS = ["critical", "high", "medium", "low", "info"]

REQUIRED_COLUMNS = [
    "type", "value", "severity", "source", "description", "tags",
    "firstSeen", "lastSeen", "observedCount", "raw",
]
OPTIONAL_COLUMNS = ["confidence", "fingerprint"]

INDICATOR_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("tags", T.StringType()),
    T.StructField("firstSeen", T.StringType()),
    T.StructField("lastSeen", T.StringType()),
    T.StructField("observedCount", T.StringType()),
    T.StructField("raw", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("fingerprint", T.StringType()),
])

PHISHING_SCHEMA = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("host", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("target", T.StringType()),
])

# 19 numeric + 5 categorical model features.
FEATURE_COLUMNS_NUMERIC = [
    "desc_len", "tag_count", "value_len", "age_days", "recency_days",
    "observedCount_num", "log_observedCount", "is_hash_like", "is_url",
    "is_domain", "is_ip", "domain_depth", "url_path_depth", "is_in_ip_txt",
    "is_in_spamhaus_cidr", "cidr_prefix_len", "cidr_base_match",
    "phish_domain_seen_count", "phish_domain_seen_flag",
]
FEATURE_COLUMNS_CATEGORICAL = ["type", "source", "tld", "url_scheme", "phish_target_mode"]

# Type groups used by the feature flags.
HASH_TYPES = ["sha256", "sha1", "md5"]
DOMAIN_TYPES = ["domain", "hostname"]
IP_TYPES = ["ipv4", "ipv6"]

# URL schemes whose last path segment carries ";params" (Python urllib).
PARAMS_SCHEMES = [
    "", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp",
    "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel",
]


# ---------------------------------------------------------------------------
# FIXED VALUES -- rule scorer tables
# ---------------------------------------------------------------------------
PY_SOURCE_SCORES = {
    "urlhaus": 90,
    "threatfox": 90,
    "otx": 85,
    "emergingthreats": 85,
    "spamhaus": 90,
    "ciarmy": 80,
    "phishtank": 75,
    "phishstats": 75,
    "bazaar": 70,
    "malshare": 75,
    "dshield_openioc": 60,
    "dshield_threatfeeds": 60,
    "bazaar_yara": 65,
}
JS_SOURCE_SCORES = {
    "urlhaus": 90,
    "threatfox": 90,
    "otx": 85,
    "emergingthreats": 85,
    "spamhaus": 90,
    "ciarmy": 80,
    "phishtank": 75,
    "phishstats": 75,
    "bazaar": 70,
    "malshare": 75,
    "misp": 80,
    "ipsum": 78,
    "c2intel": 78,
    "yaraforge": 80,
    "nvd": 88,
    "dshield_openioc": 60,
    "dshield_threatfeeds": 60,
    "bazaar_yara": 65,
}
DEFAULT_SOURCE_SCORE = 50

PY_TYPE_SCORES = {
    "hash": 80,
    "ip": 60,
    "domain": 65,
    "url": 75,
    "email": 60,
    "file": 80,
}
JS_TYPE_SCORES = {
    "hash": 80,
    "ip": 60,
    "domain": 65,
    "url": 75,
    "cve": 82,
    "email": 60,
    "file": 80,
}
DEFAULT_TYPE_SCORE = 50

CRITICAL_KEYWORDS = [
    "ransomware", "apt", "advanced persistent", "zero-day", "exploit",
    "backdoor", "trojan", "rat", "remote access", "c2", "command and control",
    "cryptominer", "miner", "botnet", "ddos",
]
HIGH_KEYWORDS = [
    "malware", "phishing", "phish", "scam", "fraud", "stealer",
    "banking", "credential", "keylogger", "spyware", "adware",
]
MEDIUM_KEYWORDS = ["suspicious", "potentially unwanted", "pua", "pup", "unwanted"]

KEYWORDS = {"critical": CRITICAL_KEYWORDS, "high": HIGH_KEYWORDS, "medium": MEDIUM_KEYWORDS}

# Keyword tier points, score-level thresholds, observation buckets.
KEYWORD_POINTS = {"critical": 20, "high": 10, "medium": 5}
LEVEL_THRESHOLDS = [(85, "critical"), (70, "high"), (50, "medium"), (30, "low")]
OBSERVATION_BUCKETS = [(100, "very-high"), (10, "high"), (2, "multi")]


@dataclass(frozen=True)
class RuleSet:
    """One parameterisation of the rule scorer (J1-J5 and J7 share the code).

    ``keywords``: ``(tier, points, words)``, the first tier that has a word in the text counts.
    ``levels`` and ``buckets``: ``(least value, name)``, highest first.
    ``rounding``: ``half_even`` (Python) or ``half_up`` (JavaScript).
    ``zero_confidence_is_absent``: JavaScript treats 0 like a missing value.
    """

    name: str
    source_scores: dict = field(default_factory=dict)
    type_scores: dict = field(default_factory=dict)
    obs_cap: float = 10.0
    obs_factor: float = 2.0
    rounding: str = "half_even"
    zero_confidence_is_absent: bool = False
    default_source: int = DEFAULT_SOURCE_SCORE
    default_type: int = DEFAULT_TYPE_SCORE
    keywords: tuple = tuple((tier, KEYWORD_POINTS[tier], tuple(words)) for tier, words in KEYWORDS.items())
    levels: tuple = tuple(LEVEL_THRESHOLDS)
    lowest_level: str = "info"
    buckets: tuple = tuple(OBSERVATION_BUCKETS)


PY_RULES = RuleSet("py", PY_SOURCE_SCORES, PY_TYPE_SCORES, 10.0, 2.0, "half_even", False)
JS_RULES = RuleSet("js", JS_SOURCE_SCORES, JS_TYPE_SCORES, 15.0, 4.0, "half_up", True)
