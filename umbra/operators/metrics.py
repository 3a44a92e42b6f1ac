"""Request metrics, latency histograms, quotas and token usage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: histogram bounds in seconds
BUCKETS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0]
WINDOW_MS = 60_000


def counters(records: DataFrame, *labels: str) -> DataFrame:
    return records.groupBy(*labels).agg(F.count("*").alias("requests"))


def latency_histogram(records: DataFrame, *labels: str) -> DataFrame:
    """Cumulative counts per bound (``le``), with sum and count of the label set."""
    seconds = F.col("latency_ms") / 1000
    sums = [F.count_if(seconds <= b).alias(f"b{i}") for i, b in enumerate(BUCKETS)]
    wide = records.groupBy(*labels).agg(*sums, F.count("*").alias("total"), F.sum("latency_ms").alias("sum_ms"))
    bounds = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BUCKETS)], F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("n")))
    return wide.select(*labels, F.explode(bounds).alias("x"), "sum_ms", "total").select(*labels, "x.le", "x.n", "sum_ms", "total")


def exposition(counts: DataFrame, name: str, value: str, *labels: str) -> DataFrame:
    """Lines of the Prometheus text format."""

    def escaped(c: str) -> Column:
        return F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))

    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), escaped(c), F.lit('"')) for c in labels])
    return counts.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))


def demand(requests: DataFrame, tenant: str, at_ms: str, window_ms: int = WINDOW_MS) -> DataFrame:
    """Requests of the tenant in the window that ends with each request, itself included."""
    by = Window.partitionBy(tenant).orderBy(at_ms).rangeBetween(-(window_ms - 1), 0)
    return requests.withColumn("in_window", F.count("*").over(by))


def day_tokens(requests: DataFrame, tenant: str, at_ms: str, order: str) -> DataFrame:
    """Tokens that the tenant used earlier on the same UTC day."""
    by = Window.partitionBy(tenant, F.floor(F.col(at_ms) / 86_400_000)).orderBy(at_ms, order).rowsBetween(Window.unboundedPreceding, -1)
    return requests.withColumn("used_before", F.coalesce(F.sum("tokens").over(by), F.lit(0)))


def admitted(requests: DataFrame, tenant: str, at_ms: str, order: str, limit: int, window_ms: int = WINDOW_MS) -> DataFrame:
    """Sliding-window admission: a request is rejected while ``limit`` admitted ones lie in its window; rejected ones do not count.

    Whether one is admitted depends on all before it, so a tenant is one ordered task.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([at_ms, order])
        stamps: list[int] = []
        low, ok, retry = 0, [], []
        for t in rows[at_ms].tolist():
            while low < len(stamps) and t - stamps[low] >= window_ms:
                low += 1
            free = len(stamps) - low < limit
            ok.append(free)
            retry.append(0 if free else -(-(stamps[low] + window_ms - t) // 1000))
            if free:
                stamps.append(t)
        return rows.assign(admitted=ok, retry_after=retry)

    return requests.groupBy(tenant).applyInPandas(fold, f"{fields}, admitted boolean, retry_after bigint")


def usage_tokens(body: Column) -> Column:
    """Tokens of a JSON reply: the total if given, else the sum of prompt, completion, input and output; null without usage."""

    def number(path: str) -> Column:
        return F.get_json_object(body, path).try_cast("bigint")

    totals = [number(f"$.{at}usage.total_tokens") for at in ("", "message.")]
    parts = [number(f"$.{at}usage.{k}_tokens") for at in ("", "message.") for k in ("prompt", "completion", "input", "output")]
    summed = F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0))))
    return F.coalesce(*totals, summed)


def latest_sessions(sessions: DataFrame, owner: str, at_ms: str, order: str, now_ms: Column, most: int = 16, ttl_ms: int = 1_800_000) -> DataFrame:
    """The sessions of an owner that live: used within the time to live, the latest ``most`` of them."""
    live = sessions.where(now_ms - F.col(at_ms) < ttl_ms)
    by = Window.partitionBy(owner).orderBy(F.desc(at_ms), F.desc(order))
    return live.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= most).drop("_r")


def throttled(warnings: DataFrame, kind: str, at_ms: str, order: str, every_ms: int = 60_000) -> DataFrame:
    """The first warning of a kind in each interval."""
    by = Window.partitionBy(kind, F.floor(F.col(at_ms) / every_ms)).orderBy(at_ms, order)
    return warnings.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def key_hash(key: Column) -> Column:
    """What is stored of a tenant's key."""
    return F.sha2(key, 256)


def authenticated(requests: DataFrame, key: str, tenants: DataFrame) -> DataFrame:
    """Adds ``tenant_id`` (null: no tenant has the key) from rows ``tenant_id, key_hash``."""
    return requests.join(F.broadcast(tenants.withColumnRenamed("key_hash", "_h")), key_hash(F.col(key)) == F.col("_h"), "left").drop("_h")


def tally(checks: DataFrame, *keys: str) -> DataFrame:
    """Checks per severity, a column each."""
    return checks.groupBy(*keys).pivot("severity", ["ok", "note", "warn", "fail"]).count().fillna(0)
