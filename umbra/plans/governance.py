"""Queries on audit trails, residency, metrics and quotas over a trail derived from ``events``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.operators import audit, metrics, residency

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# one request per event, by the same arithmetic in both engines
_COLUMNS = """event_id, user_id % 64 as trail, {ts} as ts, {ms} as at_ms, 'r' || event_id as id, 'tenant' || (user_id % 5) as tenant,
  case event_id % 3 when 0 then 'openai.chat.completions' when 1 then 'anthropic.messages' else 'scan' end as route,
  case when event_id % 17 = 0 then 'blocked' when event_id % 23 = 0 then 'failed' else 'forwarded' end as outcome,
  cast(case when event_id % 17 = 0 then 403 when event_id % 23 = 0 then 502 else 200 end as int) as status,
  event_id * 7919 % 130000 as latency_ms,
  case when event_id % 17 = 0 then null when event_id % 4 = 0 then 'api.openai.com' when event_id % 4 = 1 then 'api.mistral.ai' when event_id % 4 = 2 then 'eu1.openai.azure.com' else 'localhost' end as upstream,
  event_id * 31 % 997 as tokens,
  event_id % 3 as n_email, case when event_id % 7 = 0 then 2 else 0 end as n_iban, event_id % 2 as n_ipv4,
  case when event_id % 17 = 0 then null when event_id % 5 = 0 then 'warn' when event_id % 11 = 0 then 'allow' else 'sanitize' end as mode,
  case when event_id % 97 = 0 then event_id % 4 else 0 end as dropped"""
# the SQL's epoch_ms rounds to the nearest millisecond, halves away from 1970; times without a zone are the same in every session zone
_MICROS = "if(typeof(ts) = 'timestamp_ntz', (ts - timestamp_ntz'1970-01-01') div interval '0.000001' second, unix_micros(cast(ts as timestamp)))"
SPARK_RECORDS = "select " + _COLUMNS.format(ts="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")", ms=f"({_MICROS} + if({_MICROS} < 0, -500, 500)) div 1000")
DUCK_RECORDS = "select " + _COLUMNS.format(ts="strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')", ms="epoch_ms(ts)") + " from events"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(SPARK_RECORDS + " from {events}", events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    found = F.map_filter(F.create_map(F.lit("EMAIL"), F.col("n_email"), F.lit("IBAN"), F.col("n_iban").cast("bigint"), F.lit("IPV4"), F.col("n_ipv4")), lambda k, v: v > 0)
    policies = F.create_map(F.lit("EMAIL"), F.lit("pseudonymize"), F.lit("IBAN"), F.lit("redact"), F.lit("IPV4"), F.lit("allow"))
    rows = rows.withColumn("findings", found).withColumn("policies", policies)
    return residency.with_endpoint(rows, "upstream").withColumnsRenamed({"endpoint_id": "endpoint", "endpoint_jurisdiction": "jurisdiction"}).drop("controls")


def _endpoint_sql(host: str) -> str:
    exact = " ".join(f"when lower({host}) = '{p}' then '{e}'" for e, p, _, _ in residency.ENDPOINTS if not p.startswith("*"))
    suffix = " ".join(f"when ends_with(lower({host}), '{p[1:]}') then '{e}'" for e, p, _, _ in sorted(residency.ENDPOINTS, key=lambda x: -len(x[1])) if p.startswith("*"))
    return f"case {exact} {suffix} end"


_WHERE_SQL = "case {e} " + " ".join(f"when '{e}' then '{j}'" for e, j in {e: j for e, _, j, _ in residency.ENDPOINTS}.items()) + " else 'UNKNOWN' end"

# the open JSON of a record, without the closing brace
_BODY = (
    "'{{\"ts\":\"' || ts || '\",\"id\":\"' || id || '\",\"tenant\":\"' || tenant || '\",\"route\":\"' || route || '\",\"outcome\":\"' || outcome || '\",\"status\":' || cast(status as {string}) || "
    "',\"latencyMs\":' || cast(latency_ms as {string}) || ',\"stream\":false,\"upstream\":' || coalesce('\"' || upstream || '\"', 'null') || ',\"tokens\":' || cast(tokens as {string}) || "
    "',\"findings\":{{\"EMAIL\":' || cast(n_email as {string}) || '}},\"policies\":{{\"EMAIL\":\"pseudonymize\"}},\"residency\":null,\"attachments\":[]'"
)


def trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(SPARK_RECORDS + " from {events}", events=spark.read.parquet(f"{sf_dir}/events.parquet")).select("trail", "event_id", F.expr(_BODY.format(string="string")).alias("body"))
    return audit.chained(rows, "trail", "event_id")


_TRAIL_SQL = f"""bodies as (select trail, event_id, {_BODY.format(string='varchar')} as body, row_number() over (partition by trail order by event_id) as n from ({DUCK_RECORDS})),
chain as (
  select trail, event_id, n, body, '{audit.GENESIS}' as prev, sha256(body || ',"prev":"{audit.GENESIS}"}}') as hash from bodies where n = 1
  union all
  select b.trail, b.event_id, b.n, b.body, c.hash, sha256(b.body || ',"prev":"' || c.hash || '"}}') from chain c join bodies b on b.trail = c.trail and b.n = c.n + 1
)"""


@query
def audit_trail_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trail(spark, sf_dir).select("trail", "event_id", "prev", "hash")


ORACLES["audit_trail_build"] = f"with recursive {_TRAIL_SQL} select trail, event_id, prev, hash from chain"


@query
def audit_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.verified(trail(spark, sf_dir), "trail", "event_id")
    return rows.groupBy("trail").agg(F.count("*").alias("records"), F.count("break_reason").alias("breaks"), F.max_by("hash", "event_id").alias("head"))


ORACLES["audit_verify"] = f"with recursive {_TRAIL_SQL} select trail, count(*) as records, 0::bigint as breaks, arg_max(hash, n) as head from chain group by trail"


def tampered(rows: DataFrame) -> DataFrame:
    """Every 37th record removed, every 41st changed, every 53rd stored with a wrong predecessor (its hash made to fit)."""
    e = F.col("event_id")
    rows = rows.where(e % 37 != 0)
    changed = F.when(e % 41 == 0, F.replace("line", F.lit('"status":200'), F.lit('"status":201'))).otherwise(F.col("line"))
    prev = F.when((e % 53 == 0) & (e % 41 != 0), F.sha2(e.cast("string"), 256)).otherwise(F.col("prev"))
    open_line = F.concat("body", F.lit(',"prev":"'), prev, F.lit('"'))
    fit = F.sha2(F.concat(open_line, F.lit("}")), 256)
    moved = (e % 53 == 0) & (e % 41 != 0)
    return rows.select(
        "trail", "event_id", prev.alias("prev"), F.when(moved, fit).otherwise(F.col("hash")).alias("hash"), F.when(moved, F.concat(open_line, F.lit(',"hash":"'), fit, F.lit('"}'))).otherwise(changed).alias("line")
    )


@query
def audit_verify_tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.verified(tampered(trail(spark, sf_dir)), "trail", "event_id")
    return audit.first_breaks(rows, "trail", "event_id").select("trail", "event_id", "break_reason", "break_no")


# the recurrence itself, row by row
ORACLES["audit_verify_tampered"] = f"""
with recursive {_TRAIL_SQL}, kept as (
  select trail, event_id, body, (event_id % 53 = 0 and event_id % 41 <> 0) as moved, hash as own,
    case when event_id % 53 = 0 and event_id % 41 <> 0 then sha256(event_id::varchar) else prev end as prev,
    event_id % 41 = 0 and contains(body, '"status":200') as altered from chain where event_id % 37 <> 0
), stored as (
  select *, case when moved then sha256(body || ',"prev":"' || prev || '"}}') else own end as hash, row_number() over (partition by trail order by event_id) as n from kept
), walk as (
  select trail, n, prev = '{audit.GENESIS}' as linked, case when prev = '{audit.GENESIS}' then null else '{audit.GENESIS}' end as bridge, hash as previous from stored where n = 1
  union all
  select s.trail, s.n, s.prev = w.previous or coalesce(s.prev = w.bridge, false), case when s.prev = w.previous or coalesce(s.prev = w.bridge, false) then null else w.previous end, s.hash
  from walk w join stored s on s.trail = w.trail and s.n = w.n + 1
), found as (
  select s.trail, event_id, case when altered then 'altered' when not linked then 'unlinked' end as break_reason from stored s join walk w on s.trail = w.trail and s.n = w.n
)
select trail, event_id, break_reason, (row_number() over (partition by trail order by event_id))::int as break_no from found where break_reason is not null
qualify row_number() over (partition by trail order by event_id) <= {audit.REPORTED}
"""


@query
def report_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.volumes(records(spark, sf_dir))


ORACLES["report_volumes"] = f"""
with r as ({DUCK_RECORDS}) select 'total' as measure, 'all' as key, count(*) as requests, sum(tokens)::bigint as tokens from r
union all select 'outcome', outcome, count(*), sum(tokens)::bigint from r group by outcome union all select 'route', route, count(*), sum(tokens)::bigint from r group by route
union all select 'enforcement', coalesce(mode, 'n/a'), count(*), sum(tokens)::bigint from r group by 2
"""


@query
def report_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.categories(records(spark, sf_dir))


ORACLES["report_categories"] = f"""
with r as ({DUCK_RECORDS}), k as (
  select 'EMAIL' as kind, n_email as n, 'pseudonymize' as policy, * from r where n_email > 0 union all select 'IBAN', n_iban, 'redact', * from r where n_iban > 0 union all select 'IPV4', n_ipv4, 'allow', * from r where n_ipv4 > 0
), h as (select *, upstream is not null and coalesce(mode, 'n/a') in ('warn', 'allow') as raw from k)
select kind, sum(n)::bigint as findings, count(*) as requests, sum(case when raw or (upstream is not null and policy = 'allow') then n else 0 end)::bigint as unredacted,
  array_to_string(list_sort(list(distinct case when raw then 'sent unredacted (residency ' || mode || ')' else policy end)), '; ') as handlings from h group by kind
"""


@query
def report_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.recipients(records(spark, sf_dir))


ORACLES["report_recipients"] = f"""
with r as (select *, {_endpoint_sql('upstream')} as e from ({DUCK_RECORDS}) where upstream is not null)
select upstream as host, coalesce(e, '') as endpoint, {_WHERE_SQL.format(e='e')} as jurisdiction, count(*) as requests, sum(tokens)::bigint as tokens from r group by 1, 2, 3
"""


@query
def report_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.tenants(records(spark, sf_dir))


ORACLES["report_tenants"] = f"select tenant, count(*) as requests, sum(tokens)::bigint as tokens from ({DUCK_RECORDS}) group by tenant"
PERIOD = ("2024-01-10", "2024-01-20")


@query
def report_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.losses(records(spark, sf_dir), "trail", "event_id", *PERIOD)


ORACLES["report_loss"] = f"""
with r as (select *, left(coalesce(lag(ts) over (partition by trail order by event_id), ''), 10) as low, left(ts, 10) as high from ({DUCK_RECORDS}))
select case when high < '{PERIOD[0]}' or low > '{PERIOD[1]}' then 'outside' when low >= '{PERIOD[0]}' and high <= '{PERIOD[1]}' then 'inside' else 'straddling' end as placed,
  count(*) as windows, sum(dropped)::bigint as dropped from r where dropped > 0 group by 1
"""


@query
def jurisdiction_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by status of the place they went to."""
    rows = residency.with_jurisdiction(records(spark, sf_dir).where("upstream is not null"), "jurisdiction")
    return rows.groupBy("jurisdiction", "jurisdiction_name", "jurisdiction_status", "leaves_eea").agg(F.count("*").alias("requests"))


ORACLES["jurisdiction_transfer"] = f"""
with r as (select {_WHERE_SQL.format(e='(' + _endpoint_sql('upstream') + ')')} as jurisdiction from ({DUCK_RECORDS}) where upstream is not null)
select jurisdiction, case jurisdiction when 'FR' then 'France' when 'DE' then 'Germany' when 'US' then 'United States' when 'LOCAL' then 'Your own infrastructure' else 'Undeclared' end as jurisdiction_name,
  case jurisdiction when 'FR' then 'eea' when 'DE' then 'eea' when 'US' then 'third-country' when 'LOCAL' then 'local' else 'unknown' end as jurisdiction_status, jurisdiction not in ('FR', 'DE', 'LOCAL') as leaves_eea, count(*) as requests from r group by 1
"""

_HOSTS = "case n_nationkey % 6 when 0 then 'api.openai.com' when 1 then 'x.y.openai.azure.com' when 2 then 'a.endpoints.ai.cloud.ovh.net' when 3 then 'LOCALHOST' when 4 then 'example.org' else 'api.scaleway.ai' end"


@query
def endpoint_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.expr(_HOSTS).alias("host"))
    return residency.with_endpoint(rows, "host").select("n_nationkey", "host", F.coalesce("endpoint_id", F.lit("none")).alias("endpoint"), F.col("endpoint_jurisdiction").alias("jurisdiction"))


ORACLES["endpoint_match"] = f"""
with h as (select n_nationkey, {_HOSTS} as host from nation), e as (select *, {_endpoint_sql('host')} as id from h)
select n_nationkey, host, coalesce(id, 'none') as endpoint, {_WHERE_SQL.format(e='id')} as jurisdiction from e
"""
ALLOW = [("https://api.scaleway.ai", None, "contract"), ("https://api.openai.com/v1", "US", "standard clauses"), ("https://example.org", "DE", "contract")]


@query
def residency_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.expr(f"'https://' || lower({_HOSTS}) || case when n_nationkey % 2 = 0 then '/v1/chat' else '/v2' end").alias("url"))
    return residency.verdicts(rows, ALLOW, mode="block").select("n_nationkey", "url", "permitted", "rule", "jurisdiction")


ORACLES["residency_verdicts"] = f"""
with u as (select n_nationkey, lower({_HOSTS}) as host, 'https://' || lower({_HOSTS}) || case when n_nationkey % 2 = 0 then '/v1/chat' else '/v2' end as url from nation),
v as (select *, {_endpoint_sql('host')} as e, case when starts_with(url, 'https://api.scaleway.ai/') then 0 when starts_with(url, 'https://api.openai.com/v1/') then 1 when starts_with(url, 'https://example.org/') then 2 end as i from u)
select n_nationkey, url, i is not null and e is not null as permitted, case when i is null then 'residency.allow' else 'residency.allow[' || i || ']' end as rule,
  coalesce(case i when 1 then 'US' when 2 then 'DE' end, {_WHERE_SQL.format(e='e')}) as jurisdiction from v
"""
ROUTES, KINDS = {"scan": "warn"}, {"IPV4": "allow", "IBAN": "block"}


@query
def enforcement_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).select("event_id", "route", F.explode_outer("findings").alias("kind", "n"))
    return residency.enforcement(rows, "event_id", "sanitize", ROUTES, KINDS).groupBy("mode", "rule").agg(F.count("*").alias("requests"))


ORACLES["enforcement_mode"] = f"""
with r as ({DUCK_RECORDS}), k as (
  select event_id, route, 'EMAIL' as kind from r where n_email > 0 union all select event_id, route, 'IBAN' from r where n_iban > 0 union all select event_id, route, 'IPV4' from r where n_ipv4 > 0
  union all select event_id, route, null from r where n_email = 0 and n_iban = 0 and n_ipv4 = 0
), d as (select event_id, kind, case kind when 'IPV4' then 'allow' when 'IBAN' then 'block' else case route when 'scan' then 'warn' else 'sanitize' end end as mode,
  case when kind in ('IPV4', 'IBAN') then 'residency.categories.' || kind when route = 'scan' then 'residency.routes.scan' else 'residency.mode' end as rule, coalesce(kind not in ('IPV4', 'IBAN'), true) as general from k),
w as (select * from d qualify row_number() over (partition by event_id order by list_position(['allow', 'warn', 'sanitize', 'block'], mode) desc, general, kind) = 1)
select mode, rule, count(*) as requests from w group by 1, 2
"""


@query
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency_histogram(records(spark, sf_dir), "route").select("route", "le", "n", "sum_ms", "total")


_BOUNDS = ", ".join(f"('{b}', {b})" for b in metrics.BUCKETS) + ", ('+Inf', 1e18)"
ORACLES["latency_histogram"] = f"""
with r as ({DUCK_RECORDS}) select route, le, count(*) filter (where latency_ms / 1000.0 <= bound) as n, sum(latency_ms)::bigint as sum_ms, count(*) as total
from r, (values {_BOUNDS}) b(le, bound) group by route, le
"""


@query
def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.exposition(metrics.counters(records(spark, sf_dir), "route", "status"), "requests_total", "requests", "route", "status")


ORACLES["request_metrics"] = f"""select 'requests_total{{route="' || route || '",status="' || status || '"}} ' || count(*) as line from ({DUCK_RECORDS}) group by route, status"""


@query
def quota_rpm_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.demand(records(spark, sf_dir).select("event_id", "tenant", "at_ms"), "tenant", "at_ms").select("event_id", "tenant", "in_window")


ORACLES["quota_rpm_demand"] = f"select event_id, tenant, count(*) over (partition by tenant order by at_ms range between 59999 preceding and current row) as in_window from ({DUCK_RECORDS})"


@query
def quota_tokens_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.day_tokens(records(spark, sf_dir), "tenant", "at_ms", "event_id").select("event_id", "tenant", F.col("used_before").cast("bigint").alias("used_before"))


ORACLES["quota_tokens_day"] = f"""
select event_id, tenant, coalesce(sum(tokens) over (partition by tenant, at_ms // 86400000 order by at_ms, event_id rows between unbounded preceding and 1 preceding), 0)::bigint as used_before from ({DUCK_RECORDS})
"""


@query
def quota_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).select("event_id", "tenant", "at_ms")
    return metrics.admitted(rows, "tenant", "at_ms", "event_id", 3, 3_600_000).select("event_id", "tenant", "admitted", "retry_after")


@query
def usage_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr("""case event_id % 4 when 0 then '{"usage":{"total_tokens":' || event_id || '}}' when 1 then '{"usage":{"prompt_tokens":' || event_id || ',"completion_tokens":7}}'
      when 2 then '{"message":{"usage":{"input_tokens":' || event_id || ',"output_tokens":5}}}' else '{"id":1}' end""")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.coalesce(metrics.usage_tokens(body), F.lit(-1)).alias("tokens"))


ORACLES["usage_extraction"] = "select event_id, case event_id % 4 when 0 then event_id when 1 then event_id + 7 when 2 then event_id + 5 else -1 end::bigint as tokens from events"
