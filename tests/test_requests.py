"""Chat bodies, attachments, event streams and payload helpers."""

import base64
import json
import random

from pyspark.sql import functions as F

from umbra.operators import engine, requests
from umbra.operators.structured import CHAT_RULES
from umbra.sources import documents
from umbra.streaming import sse


def body(*texts):
    return json.dumps({"model": "a@x.de", "messages": [{"role": "user", "content": t} for t in texts]})


def test_bodies(spark):
    rows = [(1, body("mail a@x.de", "again a@x.de and b@x.de [EMAIL_3] c@x.de")), (2, "{not json"), (3, None), (4, "[1]"), (5, body("10.0.0.1"))]
    df = requests.redacted_bodies(spark.createDataFrame(rows, "id int, body string"), "body", CHAT_RULES, b"k", {"IPV4": "block"}, options=engine.Options())
    out = {r.id: r for r in df.withColumn("back", requests.restored_body(F.col("redacted_body"), F.col("tokens"))).collect()}
    first = json.loads(out[1].redacted_body)
    assert [m["content"] for m in first["messages"]] == ["mail [EMAIL_1]", "again [EMAIL_1] and [EMAIL_2] [LITERAL_1] [EMAIL_4]"] and first["model"] == "a@x.de"
    assert json.loads(out[1].back) == json.loads(rows[0][1]) and out[1].findings == {"EMAIL": 4, "LITERAL": 1}
    assert out[2].redacted_body is None and out[2].error and out[3].redacted_body is None and out[4].error == "not an object"
    assert out[5].redacted_body is None and out[5].blocked_counts == {"IPV4": 1}


def test_controls(spark):
    assert requests.set_path({"a": {"b": 1}}, "a.c.d", 2) == {"a": {"b": 1, "c": {"d": 2}}} and requests.set_path({"a": 1}, "a.b", 2) == {"a": 1} and requests.set_path([1], "a", 2) == [1]
    df = spark.createDataFrame([('{"x":1}', ["store-off", "no-training"]), (None, []), ("{", ["store-off"])], "body string, wanted array<string>")
    out = [r.c for r in df.select(requests.with_controls(F.col("body"), {"store-off": ("store", False)}, F.col("wanted")).alias("c")).collect()]
    assert [c.body for c in out] == ['{"x":1,"store":false}', None, None] and out[0].applied == ["store-off"] and out[0].manual == ["no-training"]


def test_attachments(spark):
    text = base64.b64encode(b"hello").decode()
    parts = [
        {"type": "document", "title": "t", "source": {"type": "base64", "media_type": "text/plain", "data": text}}, {"type": "document", "source": {"type": "text", "data": "é"}},
        {"type": "document", "source": {"type": "content", "content": ["a", {"text": "b"}]}}, {"type": "image", "source": {"type": "url", "url": "http://x"}},
        {"type": "file", "file": {"filename": "f.txt", "file_data": f"data:text/plain;base64,{text}"}}, {"type": "file", "file": {"file_id": "x"}},
        {"type": "image_url", "image_url": {"url": "data:image/svg+xml,%3Csvg/%3E"}}, {"type": "input_audio", "input_audio": {}}, {"type": "text", "text": "no"},
    ]
    raw = json.dumps({"tools": [parts[0]], "messages": [{"role": "user", "content": parts}]})
    sites = spark.createDataFrame([(raw,), ("{",), (None,)], "body string").select(requests.attachment_sites(F.col("body")).alias("s")).collect()
    assert sites[1].s is None and sites[2].s is None
    found = sites[0].s
    assert [s.path[-1] for s in found] == [str(i) for i in range(8)] and [s.unresolvable is None for s in found] == [True, True, True, False, True, False, True, False]
    assert [requests.payload_bytes(s.data, 100) for s in found if s.data] == [b"hello", "é".encode(), b"a\nb", b"hello", b"<svg/>"]
    assert requests.payload_bytes("!!", 10) is None and requests.payload_bytes(text, 4) is None
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate((5, 11, 6, 7))], "r int, i int, n int")
    assert [x.refused for x in requests.budgeted(rows, "r", "i", "n", 10, 22, 3).orderBy("i").collect()] == [None, "attachment too large", None, "too many attachments"]


def test_events_at_every_cut():
    tokens = {"[EMAIL_1]": "a@x.de", "[NAME_2]": "Bo"}
    deltas = ["hi [EM", "AIL_1] and [NA", "ME_2", "] [", "x"]
    stream = "".join(f"event: content_block_delta\ndata: {json.dumps({'type': 'content_block_delta', 'index': 0, 'delta': {'text': d}, 'note': '[EMAIL_1]'})}\r\n\r\n" for d in deltas)
    stream += 'data: {"type":"content_block_stop","index":0}\n\n: keep\n\ndata: [DONE]\n\n'

    def texts(out):
        values = [json.loads(x[6:]) for x in out.split("\n") if x.startswith("data: {")]
        return "".join(v["delta"]["text"] for v in values if "delta" in v), {v["note"] for v in values if "note" in v}

    rng = random.Random(1)
    cuts = [[], *([i] for i in range(len(stream))), *(sorted(rng.sample(range(len(stream)), 5)) for _ in range(60))]
    for cut in cuts:
        one, at = sse.SseRehydrator(tokens, sse.MESSAGE_DELTAS), 0
        out = ""
        for end in [*cut, len(stream)]:
            out += one.push(stream[at:end])
            at = end
        out += one.flush()
        assert texts(out) == ("hi a@x.de and Bo [x", {"a@x.de"}) and out.rstrip().endswith("[DONE]") and ": keep" in out


def test_event_frames(spark):
    rows = [(1, i, c) for i, c in enumerate(['data: {"choices":[{"delta":{"content":"[EMA"}}]}\n', '\ndata: {"choices":[{"delta":{"content":"IL_1]"}}]}\n\n', "data: [DONE]\n\n"])]
    df = sse.restored_events(spark.createDataFrame(rows, "k int, i int, c string"), "k", ["i"], "c", {"[EMAIL_1]": "a@x.de"}, sse.CHAT_DELTAS)
    assert "a@x.de" in "".join(r.out for r in df.orderBy("i").collect())


def test_payloads(spark):
    pdf = b"%PDF-1.7\n1 0 obj<</Type/Pages/Count 3/Kids[]>>endobj 2 0 obj<</Type/Page/Font>>endobj"
    assert documents.pdf_probe(pdf) == {"version": "1.7", "pages": 3, "encrypted": False, "has_text": True} and documents.pdf_probe(b"x") is None
    long = documents.extract(b"x" * 300_000, "text")
    assert long["truncated"] and len(long["text"]) == documents.MAX_CHARS and len(documents.extract(b"x" * 300_000, "text", None)["text"]) == 300_000
    rows = spark.createDataFrame([(" Text/HTML; charset=x",), ("bad",), ("a/" + "b" * 130,), (None,)], "t string").select(documents.media_type(F.col("t")).alias("m")).collect()
    assert [r.m for r in rows] == ["text/html", None, None, None]
