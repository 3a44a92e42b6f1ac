"""Policies, replacements and restoration."""

from __future__ import annotations

import hashlib
import hmac
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POLICIES = ("pseudonymize", "redact", "hash", "allow", "block")
HASH_CHARS = 12


def policy_of(kind: Column, policies: dict[str, str], default: str = "pseudonymize") -> Column:
    """Per-kind override, else the default; literal placeholders are always pseudonymized."""
    for p in (default, *policies.values()):
        if p not in POLICIES:
            raise ValueError(f"unknown policy {p!r}")
    chosen = F.when(kind == "LITERAL", F.lit("pseudonymize"))
    for k, p in policies.items():
        chosen = chosen.when(kind == k, F.lit(p))
    return chosen.otherwise(F.lit(default))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 of a binary column, from sha2 and the two key pads."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def hash_token(kind: Column, value: Column, key: bytes) -> Column:
    digest = hmac_sha256(key, F.encode(F.concat(kind, F.lit("\0"), value), "utf-8"))
    return F.concat(F.lit("["), kind, F.lit(":"), F.substring(digest, 1, HASH_CHARS), F.lit("]"))


def masked(value: Column) -> Column:
    """White space as spaces; up to four characters all hidden, else the first and last two shown."""
    flat = F.regexp_replace(value, r"\s", " ")
    n = F.char_length(flat)
    return F.when(n <= 4, F.repeat(F.lit("•"), n)).otherwise(F.concat(F.left(flat, F.lit(2)), F.repeat(F.lit("•"), F.least(F.lit(6), n - 4)), F.right(flat, F.lit(2))))


@dataclass
class Session:
    """Placeholders of one session, over any number of texts: equal values of a kind share one, numbers used literally are skipped."""

    key: bytes
    policies: dict[str, str] = field(default_factory=dict)
    default: str = "pseudonymize"
    tokens: dict[str, str] = field(default_factory=dict)
    _of_value: dict[tuple[str, str], str] = field(default_factory=dict)
    _next: dict[str, int] = field(default_factory=dict)
    _literal: set[str] = field(default_factory=set)

    def policy(self, kind: str) -> str:
        return "pseudonymize" if kind == "LITERAL" else self.policies.get(kind, self.default)

    def _placeholder(self, kind: str, value: str) -> str:
        token = self._of_value.get((kind, value))
        if token is None:
            n = self._next.get(kind, 0)
            while True:
                n += 1
                token = f"[{kind}_{n}]"
                if token not in self._literal and token not in self.tokens:
                    break
            self._next[kind] = n
            self._of_value[kind, value] = token
            self.tokens[token] = value
        return token

    def replacement(self, kind: str, value: str) -> str | None:
        """Text put in place of a span, none where it stays."""
        policy = self.policy(kind)
        if policy == "pseudonymize":
            return self._placeholder(kind, value)
        if policy == "redact":
            return f"[{kind}_REDACTED]"
        if policy == "hash":
            return f"[{kind}:{hmac.new(self.key, f'{kind}\0{value}'.encode(), hashlib.sha256).hexdigest()[:HASH_CHARS]}]"
        return None

    def blocked(self, spans: list[tuple]) -> dict[str, int]:
        """Findings per kind that must not leave."""
        return dict(Counter(s[2] for s in spans if self.policy(s[2]) == "block"))

    def redact(self, text: str, spans: list[tuple]) -> str:
        """The text with its disjoint spans (start, end, kind, ...), in order, replaced."""
        self._literal.update(text[s[0] : s[1]] for s in spans if s[2] == "LITERAL")
        parts, at = [], 0
        for start, end, kind, *_ in spans:
            new = self.replacement(kind, text[start:end])
            parts += [text[at:start], text[start:end] if new is None else new]
            at = end
        parts.append(text[at:])
        return "".join(parts)

    def restore(self, text: str) -> str:
        return _KNOWN.sub(lambda m: self.tokens.get(m[0], m[0]), text)


def redacted(df: DataFrame, key: bytes, policies: dict[str, str] | None = None, default: str = "pseudonymize", text: str = "text") -> DataFrame:
    """Adds ``redacted``, ``tokens`` (placeholder to value), ``blocked`` and ``blocked_counts`` to rows with ``spans``.

    Each text is a session of its own; the cost is linear in the text and its findings.
    A blocked text gives a null ``redacted``; nothing is raised inside a job.
    """
    policies = policies or {}
    policy_of(F.lit(""), policies, default)  # raises on unknown policies

    @F.arrow_udf("struct<redacted:string,tokens:map<string,string>,counts:map<string,long>>")
    def rewrite(texts: pa.Array, found: pa.Array) -> pa.Array:
        out, tokens, counts = [], [], []
        for value, spans in zip(texts, found):
            value, session = value.as_py(), Session(key, policies, default)
            listed = [(s["start"], s["end"], s["kind"]) for s in spans.as_py() or ()]
            stopped = session.blocked(listed)
            out.append(None if value is None or stopped else session.redact(value, listed))
            tokens.append(list(session.tokens.items()))
            counts.append(list(stopped.items()))
        pairs = pa.map_(pa.string(), pa.string())
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(tokens, pairs), pa.array(counts, pa.map_(pa.string(), pa.int64()))], names=["redacted", "tokens", "counts"])

    df = df.withColumn("_r", rewrite(F.col(text).cast("string"), F.col("spans")))
    return df.withColumns({"redacted": F.col("_r.redacted"), "tokens": F.col("_r.tokens"), "blocked": F.size("_r.counts") > 0, "blocked_counts": F.col("_r.counts")}).drop("_r")


PLACEHOLDER = r"\[[A-Z][A-Z0-9_]{0,60}_[0-9]{1,9}\]"
_KNOWN = re.compile(PLACEHOLDER)


def _restored(texts: pa.Array, tokens: pa.Array) -> pa.Array:
    out = []
    for text, known in zip(texts, tokens):
        text, known = text.as_py(), dict(known.as_py() or ())
        out.append(None if text is None else _KNOWN.sub(lambda m: known.get(m[0], m[0]), text))
    return pa.array(out, pa.string())


def restored(text: Column, tokens: Column) -> Column:
    """Known placeholders replaced by their values in one pass; unknown ones stay."""
    return F.arrow_udf(_restored, "string")(text, tokens)


def session_numbers(findings: DataFrame, session: str, order: list[str]) -> DataFrame:
    """Ordinal of each value in its session and kind by first appearance: rows ``session, kind, value, ordinal``."""
    first = findings.groupBy(session, "kind", "value").agg(F.min(F.struct(*order)).alias("first"))
    return first.withColumn("ordinal", F.row_number().over(Window.partitionBy(session, "kind").orderBy("first"))).drop("first")
