"""Scan copies, briefings and attachment tallies."""

import json

from pyspark.sql import functions as F

from umbra.operators import audit, briefing


def test_briefing(spark):
    found = spark.createDataFrame([(1, "EMAIL", "pseudonymize"), (1, "IBAN", "redact"), (1, "EMAIL", "pseudonymize"), (2, "IPV4", "allow")], "id int, kind string, policy string")
    rows = briefing.kinds_by_policy(found, "id").withColumn("text", briefing.text(F.col("pseudonymized"), F.col("redacted"), F.col("hashed")))
    texts = {r.id: r.text for r in rows.collect()}
    assert "(EMAIL)" in texts[1] and "(IBAN)" in texts[1] and texts[2] is None
    bodies = spark.createDataFrame([('{"messages":[{"role":"system","content":"s"},{"role":"user","content":"u"}]}', "B"), ('{"system":"s","messages":[]}', "B"), ("{}", None)], "body string, b string")
    out = [r.briefed for r in briefing.attached(bodies, "body", "b").collect()]
    assert [m["content"] for m in json.loads(out[0])["messages"]] == ["s", "B", "u"] and json.loads(out[1])["system"] == "s\n\nB" and out[2] == "{}"


def test_attachments(spark):
    schema = f"upstream string, mode string, {audit.RECORD[audit.RECORD.index('attachments') : audit.RECORD.index(', dropped')]}"
    a = {"format": "pdf", "bytes": 10, "outcome": "extracted", "extractor": "x"}
    rows = audit.attachments(spark.createDataFrame([("h", "warn", [a, {**a, "outcome": "blocked", "extractor": None}]), (None, "warn", [a])], schema)).collect()
    assert [(r.format, r["count"], r.bytes, r.outcomes, r.extractors, r.unredacted) for r in rows] == [("pdf", 3, 30, {"blocked": 1, "extracted": 2}, ["x"], 1)]
