"""Detectors, resolution, redaction and restoration on small texts."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from umbra.operators import detect, engine, redact
from umbra.operators.resolve import resolved

KEY = b"key"


RESOLVE = [
    ([(0, 5, "A", "a", 1), (5, 10, "B", "b", 1)], [(0, 5), (5, 10)]),
    ([(0, 10, "A", "a", 1), (2, 4, "B", "b", 99)], [(0, 10)]),
    ([(0, 5, "A", "a", 1), (3, 8, "B", "b", 2)], [(3, 8)]),
    ([(0, 5, "A", "a", 1), (3, 8, "B", "b", 1)], [(0, 5)]),
    ([(0, 20, "A", "a", 1), (0, 8, "B", "b", 5), (9, 20, "C", "c", 5)], [(0, 20)]),
]


@pytest.mark.parametrize("given_spans, want", RESOLVE)
def test_resolve(spark, given_spans, want):
    rows = [(s, e, k, "x" * (e - s), d, p) for s, e, k, d, p in given_spans]
    df = spark.createDataFrame([(rows,)], f"spans array<{detect.SPAN}>")
    assert [(s.start, s.end) for s in df.select(resolved(F.col("spans")).alias("s")).first().s] == want


def test_redact_numbers_and_literals(spark):
    texts = ["a@x.de and a@x.de", "a@x.de DE89370400440532013000 b@x.de", "[EMAIL_1] and c@x.de", None, "nothing here"]
    df = engine.found_in(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"))
    rows = redact.redacted(df, KEY).withColumn("back", redact.restored(F.col("redacted"), F.col("tokens"))).orderBy("id").collect()
    assert rows[0].redacted == "[EMAIL_1] and [EMAIL_1]"
    assert rows[1].redacted == "[EMAIL_1] [IBAN_1] [EMAIL_2]"
    assert rows[2].redacted == "[LITERAL_1] and [EMAIL_2]"
    assert [r.back for r in rows] == texts


def test_policies(spark):
    df = engine.found_in(spark.createDataFrame([("a@x.de at 10.0.0.1",)], "text string"))
    out = redact.redacted(df, KEY, {"EMAIL": "redact", "IPV4": "allow"}).first()
    assert out.redacted == "[EMAIL_REDACTED] at 10.0.0.1" and not out.blocked
    blocked = redact.redacted(df, KEY, {"EMAIL": "block"}).first()
    assert blocked.blocked and blocked.redacted is None
    with pytest.raises(ValueError):
        redact.policy_of(F.lit("x"), {"A": "nonsense"})


def test_hmac(spark):
    import hashlib
    import hmac

    got = spark.range(1).select(redact.hmac_sha256(KEY, F.encode(F.lit("é value"), "utf-8")).alias("h")).first().h
    assert got == hmac.new(KEY, "é value".encode(), hashlib.sha256).hexdigest()


@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["a@x.de", "10.0.0.1", "[EMAIL_2]", "b@y.org", " ", "x", "😀", "DE89370400440532013000", "\n"]), max_size=12), min_size=5, max_size=60))
def test_round_trip(spark, texts):
    texts = [" ".join(parts) for parts in texts]
    df = engine.found_in(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"))
    rows = redact.redacted(df, KEY).select("id", redact.restored(F.col("redacted"), F.col("tokens")).alias("back"), "spans").orderBy("id").collect()
    assert [r.back for r in rows] == texts
    for r in rows:
        assert all(a.end <= b.start for a, b in zip(r.spans, r.spans[1:]))


def test_dense_text(spark):
    """Thousands of findings in one text, found, resolved, redacted and restored."""
    import time

    took = {}
    for n in (1_000, 8_000, 64_000):
        text = " ".join(f"user{i}@example{i % 97}.com" for i in range(n))
        began = time.process_time()
        spans = engine.found(text, engine.Options())
        session = redact.Session(KEY)
        out = session.redact(text, spans)
        took[n] = time.process_time() - began
        assert len(spans) == n and session.restore(out) == text and out.startswith("[EMAIL_1] [EMAIL_2]")
    assert took[64_000] < 24 * took[8_000] and took[8_000] < 24 * took[1_000] and took[64_000] < 30
    df = spark.createDataFrame([(" ".join(f"user{i}@example.com" for i in range(8_000)),)], "text string")
    row = redact.redacted(engine.found_in(df), KEY).withColumn("back", redact.restored(F.col("redacted"), F.col("tokens")) == F.col("text")).select(F.size("tokens").alias("n"), "back").first()
    assert (row.n, row.back) == (8_000, True)


def test_null_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "10.0.0.1")], "id int, text string")
    assert [r.redacted for r in redact.redacted(engine.found_in(df), KEY).orderBy("id").collect()] == [None, "", "[IPV4_1]"]
