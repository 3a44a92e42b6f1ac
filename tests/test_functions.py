"""Check digits, string scalars and operators on known values."""

import pytest
from pyspark.sql import functions as F

from umbra.functions import checks
from umbra.functions import text as t
from umbra.operators import audit, dictionary, metrics, probe, redact, residency, structured
from umbra.sources import documents as extract
from umbra.streaming import rehydrate, sse

VALID = {
    "luhn": ["4111111111111111", "79927398713"],
    "card": ["4111111111111111", "378282246310005", "5555555555554444", "6011111111111117"],
    "iban": ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606"],
    "tax_id": ["86095742719", "47036892816"],
    "kvnr": ["A123456780"],
    "aba": ["011000015", "021000021"],
    "imei": ["490154203237518"],
    "ipv4": ["0.0.0.0", "255.255.255.255"],
    "uuid_rfc": ["123e4567-e89b-42d3-a456-426614174000"],
    "vat_de": ["DE136695976"],
    "mrz_td3": ["L898902C36UTO7408122F1204159ZE184226B<<<<<10"],
    "bank_method_00": ["9290701", "539290858"],
}
INVALID = {
    "luhn": ["4111111111111112", "", "x"],
    "card": ["4111111111111112", "9999999999999995"],
    "iban": ["DE89370400440532013001", "DE8937040044053201300", "ZZ89370400440532013000"],
    "tax_id": ["86095742718", "06095742719", "11111111111"],
    "kvnr": ["A123456781", "1123456780"],
    "aba": ["000000000", "011000016"],
    "imei": ["490154203237519"],
    "ipv4": ["256.1.1.1", "01.1.1.1", "1.1.1"],
    "uuid_rfc": ["123e4567-e89b-92d3-a456-426614174000"],
    "vat_de": ["DE136695975"],
    "mrz_td3": ["L898902C37UTO7408122F1204159ZE184226B<<<<<10"],
    "bank_method_00": ["9290702"],
}


@pytest.mark.parametrize("name", sorted(VALID))
def test_check_digits(spark, name):
    rows = [(v, True) for v in VALID[name]] + [(v, False) for v in INVALID[name]] + [(None, False)]
    for r in spark.createDataFrame(rows, "v string, want boolean").select("v", "want", getattr(checks, name)(F.col("v")).alias("got")).collect():
        assert r.got == r.want, r.v


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, redact.masked(F.lit("ab c"))) == "••••"
    assert one(spark, redact.masked(F.lit("hello\tworld"))) == "he••••••ld"
    assert one(spark, t.camel_split(F.lit("myNameIs"))) == "my Name Is"
    assert one(spark, t.kind_name(F.lit(" order-id 2"))) == "ORDER_ID_2" and one(spark, t.kind_name(F.lit("1x"))) is None
    assert one(spark, t.percent_decoded(F.lit("a%40b+c"))) == "a@b+c" and one(spark, t.percent_decoded(F.lit("a%4"))) is None
    assert one(spark, t.base64_text(F.lit("aGVsbG8gd29ybGQgYWdhaW4="))) == "hello world again" and one(spark, t.base64_text(F.lit("short"))) is None
    assert one(spark, t.entities_decoded(F.lit("a &amp; b &lt;"))) == "a & b <"
    assert one(spark, t.fold_confusables(F.lit("Маx"))) == "Max"
    assert one(spark, t.without_invisible(F.lit("a​b  \n\n\n\nc "))) == "ab\n\nc"
    assert one(spark, t.fold_for_compare(F.lit("Übér-Maß 1"))) == "ubermass1"
    assert one(spark, t.quality_reason(F.lit("short"), F.lit(None).cast("int"))) == "too few characters"
    assert one(spark, t.quality_reason(F.lit("a b c " * 40), F.lit(None).cast("int"))) == "fragmented"
    assert one(spark, t.quality_reason(F.lit("enough words to be a readable document"), F.lit(1))) is None


def test_usage(spark):
    assert one(spark, metrics.usage_tokens(F.lit('{"usage":{"total_tokens":9,"prompt_tokens":1}}'))) == 9
    assert one(spark, metrics.usage_tokens(F.lit('{"message":{"usage":{"input_tokens":4,"output_tokens":3}}}'))) == 7
    assert one(spark, metrics.usage_tokens(F.lit("{}"))) is None


def test_chain(spark):
    rows = spark.createDataFrame([(1, i, f'{{"n":{i}') for i in range(8)], "trail int, n int, body string")
    built = audit.chained(rows, "trail", "n")
    whole = audit.verified(built, "trail", "n").orderBy("n").collect()
    assert whole[0].prev == audit.GENESIS and all(r.linked and not r.altered for r in whole)
    cut = {r.n: r.break_reason for r in audit.verified(built.where("n <> 3"), "trail", "n").collect()}
    assert cut == {0: None, 1: None, 2: None, 4: "unlinked", 5: None, 6: None, 7: None}
    changed = built.withColumn("line", F.when(F.col("n") == 2, F.replace("line", F.lit('"n":2'), F.lit('"n":9'))).otherwise(F.col("line")))
    assert {r.n: r.break_reason for r in audit.verified(changed, "trail", "n").collect()}[2] == "altered"


def test_parsed_lines(spark):
    rows = audit.parsed(spark.createDataFrame([('{"ts":"t","status":200,"findings":{"EMAIL":2}}',), ("not json",), ("",), ("[1]",)], "value string")).collect()
    assert [r.malformed for r in rows] == [None, "not JSON", "blank line", "not an object"] and rows[0].record.findings == {"EMAIL": 2}


def test_path_rules():
    import re

    for rule, path, want in [("a.*", "a.b", True), ("a.*", "a", False), ("a.*", "a.b.c", False), ("a.**", "a", True), ("a.**", "a.b.c", True), ("**", "x.y", True), ("a.*.c", "a.b.c", True)]:
        assert bool(re.match(structured.rule_pattern(rule), path)) == want


def test_structured(spark):
    df = spark.createDataFrame([(1, '{"messages":[{"content":"hi","n":3}],"model":"hi"}'), (2, "broken"), (3, None)], "id int, body string")
    out = {r.id: r.rewritten for r in structured.rewritten(df, "body", structured.CHAT_RULES, str.upper).collect()}
    assert out == {1: '{"messages":[{"content":"HI","n":3}],"model":"hi"}', 2: None, 3: None}


@pytest.mark.parametrize("text", ["see [EMAIL_1] and [X", "[[EMAIL_1]]", "plain [EMAIL_2] [no_1] [EMAIL_1", ""])
def test_every_split(text):
    tokens = {"[EMAIL_1]": "a@x.de"}
    for a in range(len(text) + 1):
        for b in range(a, len(text) + 1):
            stream = rehydrate.Rehydrator(tokens)
            assert stream.push(text[:a]) + stream.push(text[a:b]) + stream.push(text[b:]) + stream.flush() == rehydrate.substitute(text, tokens)


def test_stream_over_batches(spark, tmp_path):
    """Held tails are carried from one micro-batch to the next and over a restart."""
    source, schema = tmp_path / "in", "conv string, n int, chunk string, done boolean"
    batches = [[("a", 0, "hi [EMA", False), ("b", 0, "x", False)], [("a", 1, "IL_1] you", False)], [("b", 1, " [EMAIL", False), ("b", 2, "_9", True), ("a", 2, " end", True)]]
    out: dict[str, str] = {}

    def collect(df, _):
        for r in df.collect():
            out[r.conv] = out.get(r.conv, "") + r.out

    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        stream = rehydrate.restored_stream(spark.readStream.schema(schema).json(str(source)), "conv", "n", "chunk", "done", {"[EMAIL_1]": "a@x.de"})
        query = stream.writeStream.foreachBatch(collect).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(60)
    assert out == {"a": "hi a@x.de you end", "b": "x [EMAIL_9"}


def test_events(spark):
    df = spark.createDataFrame([(1, 'event: a\ndata: x\r\n\r\n: c\n\ndata: 1\ndata: 2\n\ndata: [DONE]\n\n')], "id int, body string")
    assert [(r.name, r.data, r.done) for r in sse.events(df, "body", ["id"]).orderBy("position").collect()] == [("a", "x", False), ("", "1\n2", False), ("", "[DONE]", True)]


def test_dictionary(spark):
    df = spark.createDataFrame([(1, "Anna Schmidt met anna schmidt; Annas Schmidtt"), (2, None)], "id int, text string")
    terms = spark.createDataFrame([("Anna Schmidt",), ("Schmidt",)], "term string")
    assert {(r.id, r.term, r.n) for r in dictionary.hits(df, "id", "text", terms).collect()} == {(1, "Anna Schmidt", 2), (1, "Schmidt", 2)}
    near = spark.createDataFrame([(1, "Schmdit Schmitt Smith Schmidt")], "id int, text string")
    assert {r.token for r in dictionary.near_hits(near, "id", "text", terms).where("term = 'Schmidt'").collect()} == {"schmdit", "schmitt", "schmidt"}


def test_fuzzy_runs(spark):
    """Terms of two words, swapped and with an initial; words too far apart and edited initials do not match."""
    texts = {1: "in Saudi Arabja now", 2: "arabia, saudi", 3: "s. Arabia", 4: "Arabia S", 5: "s arabja", 6: "saudi ---- arabia", 7: "Republic of  Northern Upper Galia", 8: None, 9: "sarabia", 10: "unrelated words"}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    terms = spark.createDataFrame([("SAUDI ARABIA",), ("Republic of Northern Upper Galla",)], "term string")
    got = {(r.id, r.token, r.n) for r in dictionary.near_hits(df, "id", "text", terms, longest=5).collect()}
    assert got == {(1, "saudi arabja", 1), (2, "arabia saudi", 1), (3, "s arabia", 1), (4, "arabia s", 1), (7, "republic of northern upper galia", 1)}


def test_hidden_identifiers(spark, sf_dir):
    """Every window of every document, long or of unknown length; closing gaps shows the shredded address only."""
    from umbra.plans import catalogue

    long = "word " * 600
    shredded = long + "E-M ail : a nna .sc hmi dt@ nor dli cht.d e"
    df = spark.createDataFrame([(1, shredded), (2, long + "anna@nordlicht.de"), (3, long), (4, None), (5, "a\u2800b\n\n c")], "id int, text string")
    rows = probe.probed(df, "id", "text").collect()
    texts = {r.id: r.text for r in df.collect()}
    for i, text in texts.items():
        assert sorted(r.position for r in rows if r.id == i) == list(range(0, max(len(text or ""), 1), 120))
    assert {r.id for r in rows if r.n_closed > r.n_open} == {1} and sum(r.n_open for r in rows if r.id == 2) > 0
    assert [(r.n_chars, r.closed_chars) for r in rows if r.id == 5] == [(7, 4)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = catalogue.QUERIES["hidden_identifiers"](spark, sf_dir).select("doc_id", "position").collect()
    assert sorted(map(tuple, got)) == sorted((d.doc_id, at) for d in docs for at in range(0, max(len(d.text or ""), 1), 120))


def test_endpoints(spark):
    df = spark.createDataFrame([("api.openai.com",), ("a.b.openai.azure.com",), ("openai.azure.com",), ("nowhere.example",), (None,)], "host string")
    assert [r.endpoint_id for r in residency.with_endpoint(df, "host").collect()] == ["openai.api", "azure.openai", None, None, None]


def test_admission(spark):
    df = spark.createDataFrame([("t", i, ms) for i, ms in enumerate([0, 10, 20, 59_999, 60_000, 60_005])], "tenant string, n int, ms long")
    assert [r.admitted for r in metrics.admitted(df, "tenant", "ms", "n", 2).orderBy("n").collect()] == [True, True, False, False, True, False]


def test_extractors(spark):
    import io
    import zipfile

    package = io.BytesIO()
    with zipfile.ZipFile(package, "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:t>Hello &amp; bye</w:t></w:p><w:p><w:t>two</w:t></w:p></w:document>")
    mail = b"From: a@x.de\r\nSubject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nbody text"
    rows = [(1, b"<html><body><p>one</p><p>two &amp; three</p><script>x</script>"), (2, rb"{\rtf1{\fonttbl x}Hello \b bold\b0\par \'e9 " + b"\\u8364" + b"?}"), (3, mail), (4, package.getvalue()), (5, b"%PDF-1.7"), (6, "plain é".encode("cp1252")), (7, b""), (8, None)]
    out = {r.id: (r.format, r.extracted.text) for r in extract.extracted(spark.createDataFrame(rows, "id int, content binary")).collect()}
    assert out[1] == ("html", "one\n\ntwo & three") and out[2] == ("rtf", "Hello bold\né €")
    assert out[3] == ("eml", "From: a@x.de\nSubject: Grüße\n\nbody text") and out[4] == ("zip", "Hello & bye\ntwo")
    assert out[5] == ("pdf", None) and out[7] == ("empty", None) and out[8][1] is None


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_text("x")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "b.txt").write_text("y")
    assert [r.path.rsplit("/", 1)[1] for r in extract.files(spark, str(tmp_path)).collect()] == ["a.txt"]
