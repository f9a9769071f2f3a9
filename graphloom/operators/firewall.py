"""Guards of text and of queries: content rules, signed delimiters, complexity and scope checks."""

from __future__ import annotations

import hashlib
import hmac
import re
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.text import nfkc
from graphloom.operators.governance import _code

# Rules of the content firewall, in order: category, what stands in for a match, pattern.
CONTENT_RULES = [
    ("instruction_override", "[BLOCKED]", r"(?i)ignore\s+(all\s+)?(previous|above|prior)\s+(instructions?|rules?|prompts?)"),
    ("instruction_override", "[BLOCKED]", r"(?i)disregard\s+(all\s+)?(previous|above|prior)?\s*instructions?"),
    ("instruction_override", "[BLOCKED]", r"(?i)you\s+are\s+now\b"),
    ("instruction_override", "[BLOCKED]", r"(?i)new\s+instructions?\s*:"),
    ("instruction_override", "[BLOCKED]", r"(?i)forget\s+(all\s+)?(your\s+)?instructions?"),
    ("system_prompt_marker", "", r"<\|im_start\|>"),
    ("system_prompt_marker", "", r"<\|im_end\|>"),
    ("system_prompt_marker", "", r"\[/?INST\]"),
    ("system_prompt_marker", "", r"<{2}/?SYS>{2}"),
    ("system_prompt_marker", "[BLOCKED]", r"(?im)^\s*system\s*:(?=[ \t]+[^ \t\n]+[ \t]+[^ \t\n]+[ \t]+[^ \t\n])"),
    ("system_prompt_marker", "[BLOCKED]", r"(?im)^#{1,3}\s+System\s*$"),
    ("role_injection", "[BLOCKED]", r"(?im)^\s*assistant\s*:(?=[ \t]+[^ \t\n]+[ \t]+[^ \t\n]+[ \t]+[^ \t\n])"),
    ("role_injection", "[BLOCKED]", r"(?im)^\s*user\s*:(?=[ \t]+[^ \t\n]+[ \t]+[^ \t\n]+[ \t]+[^ \t\n])"),
    ("role_injection", "[BLOCKED]", r"(?im)^\s*Human\s*:(?=[ \t]+[^ \t\n]+[ \t]+[^ \t\n]+[ \t]+[^ \t\n])"),
    ("role_injection", "[BLOCKED]", r"(?im)^\s*AI\s*:(?=[ \t]+[^ \t\n]+[ \t]+[^ \t\n]+[ \t]+[^ \t\n])"),
    ("tag_injection", "", r"(?i)<\s*/?\s*(?:graph_context|user_query|system|assistant)\s*>"),
]
# Letters of other scripts that look like Latin ones, and what they look like.
LOOKALIKES = ("аАеЕіІоОрРсСуУхХъѕЅјЈһԁԐαΑεΕοΟıꓸ", "aAeEiIoOpPcCyYxXbsSjJhdqaAeEoOiH")
SCAN_BYTES = 100_000


def plain_letters(text: Column) -> Column:
    return F.translate(nfkc(text), *LOOKALIKES)


def threats(text: Column) -> Column:
    """The categories whose rules match the normalised text, sorted, each once; null for null, and beyond SCAN_BYTES (see too_long)."""
    plain = plain_letters(text)
    hits = F.array(*(F.when(plain.rlike(_unix(p)), F.lit(c)) for c, _, p in CONTENT_RULES))
    found = F.array_sort(F.array_distinct(F.filter(hits, lambda x: x.isNotNull())))
    return F.when(text.isNotNull() & ~too_long(text), found)


def too_long(text: Column) -> Column:
    return F.octet_length(plain_letters(text)) > SCAN_BYTES


def blocked(text: Column) -> Column:
    """The text with each match replaced, rule by rule, as it stands."""
    for _, by, pattern in CONTENT_RULES:
        text = F.regexp_replace(text, _unix(pattern), by)
    return text


def _unix(pattern: str) -> str:
    """Only line feeds end a line."""
    return pattern.replace("(?im)", "(?imd)")


def signature(message: Column, key: bytes) -> Column:
    """Hex HMAC-SHA256 under a key of at most a block, as two native digests."""
    block = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def delimiter(nonce: Column, key: bytes) -> Column:
    return F.concat(F.lit("GRAPHCTX_"), nonce, F.lit("_"), F.substring(signature(nonce, key), 1, 16))


def is_delimiter(text: Column, key: bytes) -> Column:
    """Whether a delimiter was made with this key."""
    parts = F.split(text, "_", 3)
    whole = (F.size(parts) == 3) & (F.try_element_at(parts, F.lit(1)) == "GRAPHCTX")
    signed = F.substring(signature(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), key), 1, 16)
    return F.coalesce(whole & (F.try_element_at(parts, F.lit(3)) == signed), F.lit(False))


class Requests:
    """Signed requests with a window of time and nonces that pass once; a retired key still verifies."""

    def __init__(self, key: bytes, previous: bytes | None = None, window: float = 300.0, clock=time.time) -> None:
        self.keys, self.window, self.clock = [k for k in (key, previous) if k], window, clock
        self.seen: dict[str, float] = {}

    def sign(self, body: str, nonce: str, at: float) -> str:
        return hmac.new(self.keys[0], f"{at}\n{nonce}\n{body}".encode(), hashlib.sha256).hexdigest()

    def verify(self, body: str, nonce: str, at: float, signed: str) -> bool:
        now = self.clock()
        self.seen = {n: t for n, t in self.seen.items() if now - t <= self.window}
        if abs(now - at) > self.window or nonce in self.seen:
            return False
        own = (hmac.new(k, f"{at}\n{nonce}\n{body}".encode(), hashlib.sha256).hexdigest() for k in self.keys)
        ok = any(hmac.compare_digest(x, signed) for x in own)
        if ok:
            self.seen[nonce] = now
        return ok


def check_complexity(text: str, labels: set[str], rels: set[str], matches: int = 5, optional: int = 3) -> None:
    """Raises for labels or relationship types outside the ontology and for too many clauses."""
    code = _code(text)
    for name in re.findall(r"\(\s*\w*\s*:\s*(\w+)", code):
        if name not in labels:
            raise ValueError(f"label {name} is unknown")
    for names in re.findall(r"\[\s*\w*\s*:\s*([\w|:]+)", code):
        for name in re.split(r"[|:]+", names):
            if name not in rels:
                raise ValueError(f"relationship {name} is unknown")
    n = len(re.findall(r"(?i)\boptional\s+match\b", code))
    if n > optional or len(re.findall(r"(?i)\bmatch\b", code)) - n > matches:
        raise ValueError("too many clauses")


def capped(text: str, most: int = 1000) -> str:
    """The query with its last limit at most `most` (added if absent); rows must not be multiplied after a limit."""
    code = _code(text)
    if re.search(r"(?is)\blimit\b.*\bunwind\b", code):
        raise ValueError("rows are unwound after a limit")
    found = list(re.finditer(r"(?i)\blimit\s+(\d+)", code))
    if not found:
        return f"{text.rstrip().rstrip(';')} LIMIT {most}"
    return text if int(found[-1][1]) <= most else re.sub(r"(?i)(\blimit\s+)\d+(?!.*\blimit\s+\d)", rf"\g<1>{most}", text, flags=re.S)


def tenant_scoped(text: str) -> str:
    """The query with the tenant and access predicates on every node variable of every match; raises for nodes without a variable."""
    code = _code(text)
    if len(code) != len(text):  # strings and comments were blanked to one space each
        text = code
    out, at = [], 0
    for m in re.finditer(r"(?is)\bmatch\b(.*?)(?=\b(?:optional|match|where|return|with|order|unwind|call)\b|$)(\bwhere\b)?", text):
        if re.search(r"\(\s*[:){]", m[1]):
            raise ValueError("a node without a variable can't be scoped")
        names = list(dict.fromkeys(re.findall(r"\(\s*(\w+)", m[1])))
        rule = " AND ".join(f"{v}.tenant_id = $tenant_id AND ($is_admin OR any(l IN {v}.namespace_acl WHERE l IN $acl_labels))" for v in names)
        out += [text[at : m.start()], text[m.start() : m.start() + 5], m[1].rstrip(), f" WHERE {rule} ", "AND" if m[2] else ""]
        at = m.end()
    return "".join(out) + text[at:]


def unscoped(queries: dict[str, str]) -> list[str]:
    """Names of queries that match nodes without naming the tenant."""
    return sorted(k for k, q in queries.items() if re.search(r"(?i)\bmatch\b", _code(q)) and "tenant_id" not in q)
