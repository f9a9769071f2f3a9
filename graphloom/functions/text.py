"""Text functions as native expressions: routing, normalisation, sanitising, injection scores."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the question classes, in order of precedence.
COMPLEXITY = [
    ("aggregate", r"most critical|top \d|count|how many|ranking|rank\b|highest|transitive.*count|by.*count"),
    ("multi_hop", r"blast radius|downstream|upstream|depends on|dependency chain|cascade|if.*fails|impact|indirect|transitive(?!.*count)"),
    ("single_hop", r"produce[sd]?( to)?|consume[sd]?( from)?|calls?\b|deployed in|connects? to|communicates? with"),
]
# Patterns of the template intents, in order of precedence.
INTENTS = [
    ("blast_radius", r"blast\s*radius|downstream.*fail|impact.*fail|fail.*impact"),
    ("dependency_count", r"dependency\s*count|most\s*critical|most\s*depended|ranked\s*by.*dep"),
    ("service_neighbors", r"(?:what|who)\s+does\s+\S+\s+call|neighbors?\s+of|connected\s+to|calls?\s+from"),
    ("topic_consumers", r"consum(?:e|es|ers?|ing)\s+(?:from|the)|subscribers?\s+(?:of|to|for)"),
    ("topic_producers", r"produc(?:e|es|ers?|ing)\s+(?:to|on|the)|publish(?:es|ers?|ing)\s+(?:to|on|the)"),
    ("service_deployments", r"deploy(?:ed|ments?)\s+(?:of|for|hosting)|(?:where|how)\s+is\s+\S+\s+deployed|k8s.*(?:pods?|replicas?)\s+(?:of|for)|\bdeployed\b"),
    ("namespace_services", r"services?\s+(?:in|within|deployed\s+in)\s+(?:the\s+)?(?:namespace|ns)|namespace\s+\S+\s+services?"),
    ("service_databases", r"databas(?:e|es)\s+(?:used|accessed|of|for)\s+|(?:reads?|writes?)\s+(?:to|from)\s+(?:which|what)\s+databas"),
    ("cross_team_dependencies", r"cross[\s-]?team\s+dep|inter[\s-]?team\s+call|calls?\s+across\s+teams?"),
]
# Phrases of filler, in order, and synonyms, in order.
FILLERS = ["can you tell me", "could you tell me", "please show me", "please tell me", "show me", "tell me", "i want to know", "i would like to know", "can you", "could you", "please"]
SYNONYMS = [(r"\bwhich\b", "what"), (r"\bwhat are the\b", "what"), (r"(?<!-)\bcalls\b(?!-)", "call"), (r"(?<!-)\bservices\b(?!-)", "service"), (r"(?<!-)\bdepends\b(?!-)", "depend")]
# Secrets that are blanked out, in order.
SECRETS = [
    (r"sk-[A-Za-z0-9]{20,}", "[REDACTED_SECRET]"),
    (r"AKIA[A-Z0-9]{16}", "[REDACTED_SECRET]"),
    (r"ghp_[A-Za-z0-9]{36,}", "[REDACTED_SECRET]"),
    (r"ghs_[A-Za-z0-9]{36,}", "[REDACTED_SECRET]"),
    (r"-----BEGIN[A-Z ]*PRIVATE KEY-----[\s\S]*?-----END[A-Z ]*PRIVATE KEY-----", "[REDACTED_SECRET]"),
    (r"-----BEGIN[A-Z ]*KEY-----[\s\S]*?-----END[A-Z ]*KEY-----", "[REDACTED_SECRET]"),
    (r"""['"](?:sk-|AKIA|ghp_|ghs_)[A-Za-z0-9+/=]{16,}['"]""", '"[REDACTED_SECRET]"'),
]
# Instructions that are blanked out, in order.
INSTRUCTIONS = [
    (r"(?i)ignore\s+(all\s+)?previous\s+(instructions?|rules?)", "[REDACTED]"),
    (r"(?i)ignore\s+(all\s+)?prior\s+(instructions?|rules?)", "[REDACTED]"),
    (r"(?i)ignore\s+(all\s+)?above\s+(instructions?|rules?)", "[REDACTED]"),
    (r"(?i)disregard\s+(all\s+)?previous\s+instructions?", "[REDACTED]"),
    (r"(?i)system\s*prompt\s*:", "[REDACTED]:"),
    (r"(?im)^you\s+are\s+(an?\s+)?", "[REDACTED] "),
    (r"(?i)forget\s+(all\s+)?(your\s+)?instructions?", "[REDACTED]"),
    (r"(?i)new\s+instructions?\s*:", "[REDACTED]:"),
    (r"(?i)override\s+(system|safety|security)\s+", "[REDACTED] "),
    (r"(?i)act\s+as\s+(if\s+)?you\s+(are|were)\s+", "[REDACTED] "),
    (r"(?i)pretend\s+(that\s+)?you\s+(are|were)\s+", "[REDACTED] "),
]
# Rules of the injection score with their weights.
RULES = [
    ("instruction_override", 0.4, r"(?i)ignore\s+(all\s+)?(previous|above|prior)\s+(instructions?|rules?|prompts?)"),
    ("instruction_override", 0.4, r"(?i)disregard\s+(all\s+)?(previous|above|prior)?\s*instructions?"),
    ("instruction_override", 0.4, r"(?i)forget\s+(all\s+)?(your\s+)?instructions?"),
    ("instruction_override", 0.4, r"(?i)new\s+instructions?\s*:"),
    ("role_play", 0.35, r"(?i)you\s+are\s+now\b"),
    ("role_play", 0.35, r"(?i)act\s+as\s+(if\s+)?you\s+(are|were)\s+"),
    ("role_play", 0.35, r"(?i)pretend\s+(that\s+)?you\s+(are|were)\s+"),
    ("system_mimicry", 0.35, r"(?im)^\s*SYSTEM\s*:"),
    ("system_mimicry", 0.35, r"(?i)\[SYSTEM\]"),
    ("system_mimicry", 0.35, r"(?im)^#{1,3}\s+System\s*(Message)?\s*$"),
    ("system_mimicry", 0.4, r"<\|im_start\|>"),
    ("system_mimicry", 0.4, r"<\|im_end\|>"),
    ("system_mimicry", 0.35, r"\[/?INST\]"),
    ("system_mimicry", 0.4, r"<{2}/?SYS>{2}"),
    ("encoding_obfuscation", 0.35, r"[A-Za-z0-9+/]{40,}={0,2}"),
    ("encoding_obfuscation", 0.35, r"(\\x[0-9a-fA-F]{2}){4,}"),
    ("encoding_obfuscation", 0.35, r"(\\u[0-9a-fA-F]{4}){4,}"),
    ("delimiter_escape", 0.4, r"(?i)<\s*/?\s*(?:graph_context|user_query|system|assistant)\s*>"),
    ("delimiter_escape", 0.4, r"(?i)GRAPHCTX_[A-Za-z0-9]+(?:_[A-Za-z0-9]+)*"),
]
# Phrases that ask for structure, or for text.
STRUCTURAL = ["connected to", "depends on", "dependency", "upstream", "downstream", "calls", "produces", "consumes", "deployed in", "topology", "path between", "hop", "traversal", "relationship", "blast radius", "failure propagation", "backpressure"]
TEXTUAL = ["describe", "explain", "what does", "summary", "overview", "purpose", "role of", "tell me about"]


def classify(query: Column) -> Column:
    out = F.lit("entity_lookup")
    for name, pattern in reversed(COMPLEXITY):
        out = F.when(query.rlike("(?i)" + pattern), name).otherwise(out)
    return F.coalesce(out, F.lit("entity_lookup"))


def route(complexity: Column) -> Column:
    return F.when(complexity == "entity_lookup", "vector").when(complexity == "single_hop", "single_hop").when(complexity == "multi_hop", "cypher").otherwise("hybrid")


def intent(query: Column) -> Column:
    """The first matching template intent, else null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(INTENTS):
        out = F.when(query.rlike("(?i)" + pattern), name).otherwise(out)
    return out


def fusion_weights(query: Column) -> tuple[Column, Column]:
    """(text, structural) weights from phrase counts; null without any phrase."""
    low = F.lower(query)
    count = lambda phrases: sum((F.contains(low, F.lit(p)).cast("int") for p in phrases), F.lit(0))
    s, t = count(STRUCTURAL), count(TEXTUAL)
    return F.when(s + t > 0, 1 - s / (s + t)), F.when(s + t > 0, s / (s + t))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))


def normalize_query(query: Column) -> Column:
    out = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(query, F.lit("")), r"^\s+|\s+$", "")), r"[?!.,;:]+$", "")
    for phrase in FILLERS:
        out = F.regexp_replace(out, rf"\b{phrase}\b", "")
    for pattern, by in SYNONYMS:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def redact_secrets(text: Column) -> Column:
    for pattern, by in SECRETS:
        text = F.regexp_replace(text, pattern, by)
    return text


def sanitize_query(text: Column, limit: int = 4000) -> Column:
    """Control characters, length, boundary tags, secrets, instructions, then markup, in this order."""
    out = F.substring(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), 1, limit)
    out = F.regexp_replace(out, r"(?i)<\s*/?\s*(?:graph_context|user_query|system|assistant)\s*>", "")
    return strip_instructions(redact_secrets(out))


def strip_instructions(text: Column) -> Column:
    for pattern, by in INSTRUCTIONS:
        text = F.regexp_replace(text, pattern, by)
    return text


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def cdata_escape(text: Column) -> Column:
    return F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>"))


def rule_score(text: Column) -> Column:
    """The sum of the weights of the rules that match."""
    return sum((F.when(text.rlike(p), F.lit(w)).otherwise(F.lit(0.0)) for _, w, p in RULES), F.lit(0.0))


def rule_hits(text: Column) -> Column:
    """The categories that match, sorted, each once."""
    return F.array_sort(F.array_distinct(F.filter(F.array(*(F.when(text.rlike(p), F.lit(c)) for c, _, p in RULES)), lambda x: x.isNotNull())))


def entropy(text: str) -> float:
    """Structural entropy in 0..1: 0 under three tokens or 4.5 bits."""
    if len(text.split()) < 3:
        return 0.0
    chars = Counter(c for c in text if not c.isspace())
    total = sum(chars.values())
    if total < 2:
        return 0.0
    bits = -sum(n / total * math.log2(n / total) for n in chars.values())
    return 0.0 if bits < 4.5 else min(1.0, bits / math.log2(total))


def _entropies(text: pd.Series) -> pd.Series:
    return text.fillna("").map(entropy)


def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def entropy_column(text: Column) -> Column:
    return F.pandas_udf(_entropies, "double")(text)


def nfkc(text: Column) -> Column:
    return F.pandas_udf(_nfkc, "string")(text)


def injection_score(text: Column) -> Column:
    """Rules plus 0.3 of the entropy, at most 1; above 0.3 is flagged."""
    return F.least(F.lit(1.0), rule_score(text) + 0.3 * entropy_column(text))
