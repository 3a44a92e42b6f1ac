"""Texts that tell a model about placeholders, and the chat bodies that carry them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds named in a briefing.
MOST_KINDS = 10


def kinds_by_policy(findings: DataFrame, key: str) -> DataFrame:
    """``key, pseudonymized, redacted, hashed``: sorted distinct kinds of each handling (rows ``key, kind, policy``)."""
    sets = [F.array_sort(F.collect_set(F.when(F.col("policy") == p, F.col("kind")))).alias(n) for p, n in (("pseudonymize", "pseudonymized"), ("redact", "redacted"), ("hash", "hashed"))]
    return findings.groupBy(key).agg(*sets)


def text(pseudonymized: Column, redacted: Column, hashed: Column) -> Column:
    """The explanation for the kinds present, null if there are none."""

    def part(kinds: Column, before: str, after: str) -> Column:
        named = F.array_join(F.slice(kinds, F.lit(1), F.lit(MOST_KINDS)), ", ")
        return F.when(F.size(kinds) > 0, F.concat(F.lit(before), named, F.lit(after)))

    parts = [
        part(pseudonymized, "Placeholders in square brackets stand for personal data (", "). Keep each exactly as written; equal placeholders mean the same value."),
        part(redacted, "Some values were removed (", ") and cannot be recovered."),
        part(hashed, "Some values are shown as stable hashes (", ")."),
    ]
    joined = F.concat_ws(" ", *parts)
    return F.when(joined != "", joined)


def attached(df: DataFrame, body: str, briefing: str, out: str = "briefed") -> DataFrame:
    """The chat body with the briefing: after the leading system messages, or appended to ``system`` where the body has that field."""

    def one(raw: str | None, extra: str | None) -> str | None:
        if raw is None or not extra:
            return raw
        try:
            value = json.loads(raw)
        except ValueError:
            return None
        if "system" in value:
            value["system"] = f"{value['system']}\n\n{extra}" if isinstance(value["system"], str) else [*value["system"], {"type": "text", "text": extra}]
        else:
            messages = value.get("messages", [])
            at = next((i for i, m in enumerate(messages) if m.get("role") not in ("system", "developer")), len(messages))
            value["messages"] = [*messages[:at], {"role": "system", "content": extra}, *messages[at:]]
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))

    return df.withColumn(out, F.udf(one, "string")(F.col(body), F.col(briefing)))
