"""Queries on requests: recipients, policies, budgets, sessions, tenants and the rows of reports."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import accounts
from umbra.operators import audit, metrics, requests, residency
from umbra.plans.governance import DUCK_RECORDS, records, trail
from umbra.sources import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def trail_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.spans(records(spark, sf_dir), "trail", "event_id")


ORACLES["trail_spans"] = f"select trail, count(*) as records, arg_min(ts, event_id) as first_ts, arg_max(ts, event_id) as last_ts from ({DUCK_RECORDS}) group by trail"


@query
def request_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).select("tenant", "event_id", "outcome", F.explode("findings").alias("kind", "n"), "policies")
    return audit.handled(rows.withColumn("policy", F.try_element_at("policies", F.col("kind"))), "tenant", "event_id")


ORACLES["request_policies"] = f"""
with f as (select tenant, event_id, outcome, unnest([{{'k': 'EMAIL', 'n': n_email, 'p': 'pseudonymize'}}, {{'k': 'IBAN', 'n': n_iban, 'p': 'redact'}}, {{'k': 'IPV4', 'n': n_ipv4, 'p': 'allow'}}]) as x from ({DUCK_RECORDS}))
select tenant, x.k as kind, arg_max(case when outcome = 'blocked' then 'block' else x.p end, event_id) as policy from f where x.n > 0 group by all
"""


@query
def recipient_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipients with the legal basis that the allow list declares for them."""
    allowed = spark.createDataFrame([("openai", "api.openai.com", "contract"), ("mistral", "api.mistral.ai", "consent"), ("mistral", "api.mistral.ai", "contract")], "endpoint string, host string, basis string")
    found = audit.recipients(records(spark, sf_dir)).withColumn("endpoint", F.when(F.col("host") == "localhost", "").otherwise(F.col("endpoint")))
    return audit.legal_basis(found, allowed).select("host", "requests", "basis")


ORACLES["recipient_basis"] = f"""
select upstream as host, count(*) as requests, case upstream when 'api.openai.com' then 'contract' when 'api.mistral.ai' then 'ambiguous' else 'undeclared' end as basis
from ({DUCK_RECORDS}) where upstream is not null group by upstream
"""


@query
def recipient_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.ranked(audit.recipients(records(spark, sf_dir)), "requests", "host").select("host", "requests", "place")


ORACLES["recipient_order"] = f"select upstream as host, count(*) as requests, (row_number() over (order by count(*) desc, upstream))::int as place from ({DUCK_RECORDS}) where upstream is not null group by upstream"


@query
def anchors_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of every hundredth record, one in three of them made up, that their trail does not have."""
    rows = trail(spark, sf_dir).select("trail", "event_id", "hash")
    anchors = rows.where("event_id % 100 = 0").withColumn("hash", F.when(F.col("event_id") % 3 == 0, F.sha2(F.col("event_id").cast("string"), 256)).otherwise(F.col("hash")))
    return audit.missing_anchors(anchors, rows.select("trail", "hash"), "trail").groupBy("trail").agg(F.count("*").alias("missing"))


ORACLES["anchors_missing"] = f"select trail, count(*) as missing from ({DUCK_RECORDS}) where event_id % 100 = 0 and event_id % 3 = 0 group by trail"


@query
def attachment_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments of a user as one request: running bytes against the limits of files and requests."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", (F.col("event_id") * 7919 % 1000).alias("bytes"))
    out = requests.budgeted(rows, "user_id", "event_id", "bytes", 900, 2500, 8)
    return out.groupBy(F.coalesce("refused", F.lit("ok")).alias("verdict")).agg(F.count("*").alias("n"), F.sum("running_bytes").alias("running"))


ORACLES["attachment_budget"] = """
with r as (select user_id, event_id, event_id * 7919 % 1000 as bytes from events),
w as (select *, sum(bytes) over o as running, row_number() over o as nth from r window o as (partition by user_id order by event_id rows unbounded preceding))
select case when nth > 8 then 'too many attachments' when bytes > 900 then 'attachment too large' when running > 2500 then 'attachments too large together' else 'ok' end as verdict, count(*) as n, sum(running)::bigint as running from w group by 1
"""


@query
def sessions_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trial sessions of each tenant that still live at the last event."""
    rows = records(spark, sf_dir).select("tenant", "event_id", "at_ms")
    now = rows.agg(F.max("at_ms").alias("now_ms"))
    return metrics.latest_sessions(rows.join(F.broadcast(now)), "tenant", "at_ms", "event_id", F.col("now_ms"), ttl_ms=86_400_000).select("tenant", "event_id")


ORACLES["sessions_kept"] = f"""
with r as ({DUCK_RECORDS}) select tenant, event_id from r where (select max(at_ms) from r) - at_ms < 86400000 qualify row_number() over (partition by tenant order by at_ms desc, event_id desc) <= 16
"""


@query
def warnings_throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).where("status >= 400")
    return metrics.throttled(rows, "status", "at_ms", "event_id").groupBy("status").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


ORACLES["warnings_throttled"] = f"""
with w as (select * from ({DUCK_RECORDS}) where status >= 400 qualify row_number() over (partition by status, floor(at_ms / 60000.0) order by at_ms, event_id) = 1)
select status, count(*) as n, sum(event_id)::bigint as ids from w group by status
"""


@query
def tenant_authentication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by the tenant whose stored key hash theirs has."""
    keys = spark.createDataFrame([(f"tenant{i}", f"key-{i}") for i in range(4)], "tenant_id string, key string").select("tenant_id", metrics.key_hash(F.col("key")).alias("key_hash"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("key-"), (F.col("user_id") % 6).cast("string")).alias("key"))
    return metrics.authenticated(rows, "key", keys).groupBy(F.coalesce("tenant_id", F.lit("none")).alias("tenant")).agg(F.count("*").alias("n"))


ORACLES["tenant_authentication"] = "select case when user_id % 6 < 4 then 'tenant' || (user_id % 6) else 'none' end as tenant, count(*) as n from events group by 1"


@query
def severity_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.expr("case when status >= 500 then 'fail' when status >= 400 then 'warn' when mode in ('warn', 'allow') then 'note' else 'ok' end")
    return metrics.tally(records(spark, sf_dir).select("tenant", severity.alias("severity")), "tenant")


ORACLES["severity_tally"] = f"""
with s as (select tenant, case when status >= 500 then 'fail' when status >= 400 then 'warn' when mode in ('warn', 'allow') then 'note' else 'ok' end as severity from ({DUCK_RECORDS}))
select tenant, count(*) filter (where severity = 'ok') as ok, count(*) filter (where severity = 'note') as note, count(*) filter (where severity = 'warn') as warn, count(*) filter (where severity = 'fail') as fail from s group by tenant
"""


@query
def upstream_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upstreams of each tenant that the allow list does not cover."""
    routes = records(spark, sf_dir).where("upstream is not null").select("tenant", F.concat(F.lit("https://"), "upstream", F.lit("/v1/chat")).alias("url")).distinct()
    return residency.refusals(residency.verdicts(routes, [("https://api.mistral.ai", None, "contract"), ("https://localhost", "LOCAL", "own")]), "tenant")


ORACLES["upstream_refusals"] = f"""
with u as (select distinct tenant, upstream from ({DUCK_RECORDS}) where upstream is not null)
select tenant, count(*) as upstreams, count(*) filter (where upstream not in ('api.mistral.ai', 'localhost')) as refused from u group by tenant
"""


@query
def data_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls that a request field can set, and those left to people, by provider."""
    rows = residency.endpoints(spark).select("endpoint_id", F.split("controls", ",").alias("wanted")).distinct()
    rows = rows.withColumn("c", residency.controls_split(F.col("wanted"), ("store-off",)))
    return rows.select("endpoint_id", F.array_join("c.applied", ",").alias("applied"), F.array_join("c.manual", ",").alias("manual"))


ORACLES["data_controls"] = "select * from (values " + ", ".join(
    f"('{e}', '{','.join(x for x in c.split(',') if x == 'store-off')}', '{','.join(x for x in c.split(',') if x != 'store-off')}')" for e, c in sorted({(e, c) for e, _, _, c in residency.ENDPOINTS})
) + ") t(endpoint_id, applied, manual)"


@query
def endpoints_offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residency.proxyable(spark)


ORACLES["endpoints_offered"] = "with e as (select * from (values " + ", ".join(f"('{e}', '{j}')" for e, _, j, _ in residency.ENDPOINTS) + """) t(endpoint_id, j)),
g as (select endpoint_id, count(*) as hosts, any_value(j) in ('US', 'UNKNOWN') as leaves_eea from e group by endpoint_id)
select endpoint_id, hosts, leaves_eea, (row_number() over (order by leaves_eea, endpoint_id))::int as place from g"""


@query
def text_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the original, the redacted text or nothing leaves."""
    mode = F.when(F.col("outcome") == "blocked", "block").otherwise(F.coalesce("mode", F.lit("sanitize")))
    return records(spark, sf_dir).select(F.coalesce(residency.outgoing(mode, F.lit("original"), F.lit("redacted")), F.lit("nothing")).alias("sent")).groupBy("sent").agg(F.count("*").alias("n"))


ORACLES["text_sent"] = f"select case when outcome = 'blocked' then 'nothing' when mode in ('warn', 'allow') then 'original' else 'redacted' end as sent, count(*) as n from ({DUCK_RECORDS}) group by 1"


@query
def media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared media types in their plain form."""
    declared = F.expr("case p_partkey % 4 when 0 then ' Text/HTML; charset=utf-8' when 1 then 'APPLICATION/x-tar' when 2 then 'application/PDF' else 'no type' end")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.coalesce(documents.media_type(declared), F.lit("none")).alias("media_type")).groupBy("media_type").agg(F.count("*").alias("n"))


ORACLES["media_types"] = "select case p_partkey % 4 when 0 then 'text/html' when 1 then 'application/x-tar' when 2 then 'application/pdf' else 'none' end as media_type, count(*) as n from part group by 1"


@query
def escaped_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with bars, angles and control characters, fit for a table's cell."""
    text = F.expr("p_name || '|' || chr(7) || '<b>'")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", audit.cell(text).alias("cell"))


ORACLES["escaped_cells"] = r"select p_partkey, replace(replace(p_name, '_', '\_'), '*', '\*') || '\|\u0007\<b\>' as cell from part"

_WEIGHTS = {"03": [2, 1], "05": [7, 3, 1], "18": [3, 9, 7, 1], "20": [2, 3, 4, 5, 6, 7, 8, 9, 3], "43": [1, 2, 3, 4, 5, 6, 7, 8, 9], "40": [2, 4, 8, 5, 10, 9, 7, 3, 6]}


@query
def account_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account numbers derived from order keys that fit each of six methods."""

    def fits(numbers: pa.Array, methods: pa.Array) -> pa.Array:
        return pa.array([accounts.valid(n.as_py(), "10000000", m.as_py()) for n, m in zip(numbers, methods)], pa.bool_())

    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") * 7919 % 9999999 + 1000000).cast("string").alias("account"), F.explode(F.array(*[F.lit(m) for m in _WEIGHTS])).alias("method"))
    return rows.where(F.arrow_udf(fits, "boolean")("account", "method")).groupBy("method").agg(F.count("*").alias("n"), F.sum(F.col("account").cast("bigint")).alias("total"))


def _method_sql(method: str, weights: list[int]) -> str:
    total = " + ".join(f"(account[{9 - i}]::int * {weights[i % len(weights)]})" for i in range(9))
    digit = "case when s % 11 < 2 then 0 else 11 - s % 11 end" if method in ("20", "40") else "(10 - s % 10) % 10"
    return f"select '{method}' as method, account from (select account, {total} as s from a) where {digit} = account[10]::int"


ORACLES["account_methods"] = (
    "with a as (select lpad((o_orderkey * 7919 % 9999999 + 1000000)::varchar, 10, '0') as account from orders), f as ("
    + " union all ".join(_method_sql(m, w) for m, w in _WEIGHTS.items())
    + ") select method, count(*) as n, sum(account::bigint)::bigint as total from f group by method"
)
