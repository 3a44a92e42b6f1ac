"""Queries on string scalars, the quality gate, dictionaries and structured text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import text as t
from umbra.operators import dictionary, probe, structured
from umbra.sources import documents as extract
from umbra.streaming import rehydrate, sse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def base64_shaped_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/]{16,}={0,2}"), F.lit(0)).alias("runs")).where(F.size("runs") > 0)
    return rows.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.aggregate("runs", F.lit(0), lambda a, r: a + F.length(r)).cast("bigint").alias("n_chars"))


ORACLES["base64_shaped_runs"] = """
with r as (select doc_id, regexp_extract_all(text, '[A-Za-z0-9+/]{16,}={0,2}') as runs from documents)
select doc_id, len(runs)::bigint as n_runs, list_sum(list_transform(runs, lambda x: length(x)))::bigint as n_chars from r where len(runs) > 0
"""


@query
def base64_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names encoded and found again; keys divisible by three are broken and stay null."""
    coded = F.base64(F.encode(F.concat(F.lit("part "), "p_name"), "utf-8"))
    coded = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x"), coded)).otherwise(coded)
    return table(spark, sf_dir, "part").select("p_partkey", t.base64_text(F.replace(coded, F.lit("\r\n"), F.lit(""))).alias("decoded"))


ORACLES["base64_decoded"] = "select p_partkey, case when p_partkey % 3 <> 0 and length(base64(encode('part ' || p_name))) >= 16 then 'part ' || p_name end as decoded from part"


@query
def percent_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", t.percent_decoded(F.url_encode(F.concat("p_name", F.lit(" é+")))).alias("decoded")).select("p_partkey", F.replace("decoded", F.lit("+"), F.lit(" ")).alias("decoded"))


ORACLES["percent_decode"] = "select p_partkey, replace(url_decode(replace(url_encode(p_name || ' é+'), '%20', ' ')), '+', ' ') as decoded from part"


@query
def html_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "html", t.entities_decoded(F.col("html")).alias("d"))
    return rows.select("page_id", F.regexp_count("html", F.lit("&[a-z]+;")).cast("bigint").alias("n_named"), F.char_length("d").cast("bigint").alias("n_chars"), F.sha2("d", 256).alias("decoded_sha256"))


_DECODE_SQL = "html"
for _name, _value in t.ENTITIES.items():
    _DECODE_SQL = f"replace({_DECODE_SQL}, '&{_name};', '{_value.replace(chr(39), chr(39) * 2)}')"
ORACLES["html_entities"] = f"""
select page_id, len(regexp_extract_all(html, '&[a-z]+;'))::bigint as n_named, length({_DECODE_SQL})::bigint as n_chars, sha256({_DECODE_SQL}) as decoded_sha256 from pages
"""


@query
def camel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", t.camel_split(F.concat(F.lit("the"), "c_name")).alias("split"), t.kind_name(F.concat(F.lit(" "), "c_name", F.lit(" no.1 "))).alias("kind"))


ORACLES["camel_split"] = """
select c_custkey, regexp_replace('the' || c_name, '(\\p{Ll})(\\p{Lu})', '\\1 \\2', 'g') as split,
  upper(trim(regexp_replace(' ' || c_name || ' no.1 ', '[^A-Za-z0-9]+', '_', 'g'), '_')) as kind from customer
"""


@query
def confusables_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.translate("c_name", "aeo", "аео")
    return table(spark, sf_dir, "customer").select("c_custkey", (mixed != F.col("c_name")).alias("was_mixed"), t.fold_confusables(mixed).alias("folded"))


ORACLES["confusables_folded"] = "select c_custkey, regexp_matches(c_name, '[aeo]') as was_mixed, c_name as folded from customer"


@query
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, (F.col("n_chars") / 5).cast("int") + 1).alias("pages"))
    return rows.select("doc_id", F.coalesce(t.quality_reason(F.col("text"), F.col("pages")), F.lit("ok")).alias("verdict"))


ORACLES["quality_gate"] = r"""
with d as (select doc_id, text, case when doc_id % 2 = 0 then (floor(n_chars / 5))::int + 1 end as pages from documents),
c as (select *, length(text) as total, length(regexp_replace(text, '[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]', '', 'g')) as solid,
  length(text) - length(replace(text, chr(65533), '')) as replaced, length(text) - length(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')) as control,
  list_transform(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{024F}\x{0370}-\x{03FF}\x{0400}-\x{04FF}]+'), lambda x: length(x)) as runs from d)
select doc_id, case when solid < 16 then 'too few characters' when pages is not null and solid / pages < 8 then 'too few characters per page' when replaced / total > 0.1 then 'replacement characters'
  when control / total > 0.3 then 'control characters' when len(runs) >= 40 and len(list_filter(runs, lambda x: x <= 2)) / len(runs) > 0.6 then 'fragmented' else 'ok' end as verdict from c
"""


@query
def probe_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows of 240 characters, 120 apart, of all documents, with their address signs."""
    rows = probe.windows(table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text")
    return rows.select("doc_id", "position", F.char_length(F.regexp_replace("open", "[ \t]", "")).alias("closed_chars"), F.regexp_count("open", F.lit("@")).alias("signs"))


ORACLES["probe_windows"] = r"""
with w as (select doc_id, unnest(range(0, greatest(length(text), 1)::int, 120))::int as position, text from documents where text is not null)
select doc_id, position, length(regexp_replace(substr(text, position + 1, 240), '[ \t]', '', 'g'))::int as closed_chars, len(regexp_extract_all(substr(text, position + 1, 240), '@'))::int as signs from w
"""


@query
def hidden_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows of all documents with the findings before and after closing their gaps."""
    return probe.probed(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def dictionary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark items as terms in the documents."""
    terms = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[^\\p{L}\\p{N}]+")).alias("term")).where(F.length("term") >= 10).select(F.lower("term").alias("term")).distinct()
    found = dictionary.hits(table(spark, sf_dir, "documents"), "doc_id", "text", terms, longest=1)
    return found.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


ORACLES["dictionary_hits"] = r"""
with terms as (select distinct lower(term) as term from (select unnest(regexp_split_to_array(text, '[^\p{L}\p{N}]+')) as term from benchmark) where length(term) >= 10),
words as (select doc_id, lower(unnest(regexp_split_to_array(text, '[^\p{L}\p{N}]+'))) as term from documents)
select term, count(*)::bigint as n, count(distinct doc_id) as n_docs from words join terms using (term) group by term
"""


@query
def fuzzy_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation names misspelt by one edit, found again by blocking; ``fuzzy_document_hits`` reads documents."""
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("term"))
    wrong = F.array(F.col("n_name"), F.concat(F.substring("n_name", 1, 2), F.lit("x"), F.substring("n_name", 3, 40)), F.concat(F.substring("n_name", 1, 2), F.substring("n_name", 4, 40)), F.concat(F.substring("n_name", 2, 1), F.substring("n_name", 1, 1), F.substring("n_name", 3, 40)), F.reverse("n_name"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(wrong, " . ").alias("text"))
    return dictionary.near_hits(rows, "n_nationkey", "text", names).select("n_nationkey", F.lower("term").alias("term"), "token", "n")


ORACLES["fuzzy_hits"] = r"""
with t as (select n_nationkey, n_name from nation), w as (
  select n_nationkey, lower(unnest(regexp_split_to_array(array_to_string([n_name, substr(n_name, 1, 2) || 'x' || substr(n_name, 3), substr(n_name, 1, 2) || substr(n_name, 4), substr(n_name, 2, 1) || substr(n_name, 1, 1) || substr(n_name, 3), reverse(n_name)], ' . '), '[^\p{L}\p{N}]+'))) as token from t),
c as (select n_nationkey, token, count(*) as n from w where length(token) >= 5 group by all),
terms as (select distinct lower(n_name) as term, regexp_replace(lower(n_name), '[^\p{L}\p{N}]', '', 'g') as folded from nation)
select n_nationkey, term, token, n from c join terms on length(folded) >= 6 and damerau_levenshtein(token, folded) <= 1 and (left(token, 1) = left(folded, 1) or right(token, 1) = right(folded, 1))
"""


@query
def fuzzy_document_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nations and parts in the documents, in runs of up to five words and with one edit."""
    names = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("term")).union(table(spark, sf_dir, "part").select(F.lower("p_name"))).distinct()
    found = dictionary.near_hits(table(spark, sf_dir, "documents"), "doc_id", "text", names, longest=5)
    return found.groupBy("term", "token").agg(F.sum("n").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of chat requests by the path rules that select them."""
    body = F.expr("""'{"model":"m","messages":[{"role":"' || role || '","content":"' || regexp_replace(text, '[\\\\\\\\"\\n]', ' ') || '"},{"role":"user","content":[{"type":"text","text":"t' || turn || '"}]}],"metadata":{"user_id":"u"}}'""")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("body"))
    found = structured.strings(rows, "body", ["conv_id", "turn"])
    chosen = found.where(structured.selected(F.col("path"), structured.CHAT_RULES))
    return chosen.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.char_length("value")).alias("n_chars"))


ORACLES["path_rules"] = r"""
with b as (select regexp_replace(text, '[\\"\n]', ' ', 'g') as c, 't' || turn as x from conversations)
select 'messages.0.content' as path, count(*) as n, sum(length(c))::bigint as n_chars from b union all select 'messages.1.content.0.text', count(*), sum(length(x))::bigint from b
"""


@query
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of whole pages with attribute text and line structure."""
    rows = extract.html_text(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html")
    return rows.select("page_id", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query
def html_link_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)).alias("host"), F.regexp_count("html", F.lit("<a ")).alias("links"))
    return rows.groupBy("host").agg(F.count("*").alias("pages"), F.sum("links").alias("links"))


ORACLES["html_link_hosts"] = "select lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) as host, count(*) as pages, sum(len(regexp_extract_all(html, '<a ')))::bigint as links from pages group by 1"


@query
def format_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats told from the first bytes of derived payloads."""
    head = F.expr("case p_partkey % 6 when 0 then '%PDF-1.7 x' when 1 then '{\\\\rtf1 x}' when 2 then '<!DOCTYPE html><p>x' when 3 then 'From: a@x.de\\nSubject: x\\n\\nx' when 4 then 'GIF89a' else p_name end")
    return table(spark, sf_dir, "part").select(extract.sniffed(F.encode(head, "utf-8")).alias("format")).groupBy("format").agg(F.count("*").alias("n"))


ORACLES["format_sniff"] = "select case p_partkey % 6 when 0 then 'pdf' when 1 then 'rtf' when 2 then 'html' when 3 then 'eml' when 4 then 'gif' else 'text' end as format, count(*) as n from part group by 1"


@query
def stream_rehydrate_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with placeholders cut at any point, put together per conversation and restored."""
    cut_in_two = F.posexplode(F.array(F.lit("see [EMA"), F.lit("IL_1] now"))).alias("part", "chunk")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", cut_in_two)
    return rehydrate.restored_chunks(rows, "conv_id", ["turn", "part"], "chunk", {"[EMAIL_1]": "a@x.de"}).groupBy("conv_id").agg(F.sum(F.char_length("out")).alias("n_chars"), F.max(F.contains("out", F.lit("[EMAIL_1]"))).alias("left_over"))


ORACLES["stream_rehydrate_batch"] = "select conv_id, sum(length('see a@x.de now'))::bigint as n_chars, false as left_over from conversations group by conv_id"


@query
def sse_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event streams of a conversation split into events and their data."""
    stream = F.concat(F.lit("event: message\ndata: {\"n\":"), F.col("turn").cast("string"), F.lit("}\r\n\r\n: note\n\ndata: one\ndata: two\n\ndata: [DONE]\n\n"))
    events = sse.events(table(spark, sf_dir, "conversations").select("conv_id", "turn", stream.alias("body")), "body", ["conv_id", "turn"])
    return events.groupBy("name", "done").agg(F.count("*").alias("n"), F.sum(F.char_length("data")).alias("n_chars"))


ORACLES["sse_parse"] = """
select 'message' as name, false as done, count(*) as n, sum(length('{"n":' || turn || '}'))::bigint as n_chars from conversations
union all select '', false, count(*), (count(*) * 7)::bigint from conversations union all select '', true, count(*), (count(*) * 6)::bigint from conversations
"""
