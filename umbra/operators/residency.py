"""Where data goes: jurisdictions, endpoints, verdicts and enforcement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: states of the EEA, and of Article 45 adequacy decisions
EEA = {
    "AT": "Austria", "BE": "Belgium", "BG": "Bulgaria", "HR": "Croatia", "CY": "Cyprus", "CZ": "Czechia", "DK": "Denmark", "EE": "Estonia", "FI": "Finland",
    "FR": "France", "DE": "Germany", "GR": "Greece", "HU": "Hungary", "IE": "Ireland", "IT": "Italy", "LV": "Latvia", "LT": "Lithuania", "LU": "Luxembourg",
    "MT": "Malta", "NL": "Netherlands", "PL": "Poland", "PT": "Portugal", "RO": "Romania", "SK": "Slovakia", "SI": "Slovenia", "ES": "Spain", "SE": "Sweden",
    "IS": "Iceland", "LI": "Liechtenstein", "NO": "Norway",
}
ADEQUATE = {
    "AD": "Andorra", "AR": "Argentina", "CA": "Canada", "CH": "Switzerland", "FO": "Faroe Islands", "GB": "United Kingdom", "GG": "Guernsey", "IL": "Israel",
    "IM": "Isle of Man", "JE": "Jersey", "JP": "Japan", "KR": "Republic of Korea", "NZ": "New Zealand", "UY": "Uruguay",
}
OTHER = {"US": ("United States", "third-country"), "LOCAL": ("Your own infrastructure", "local"), "UNKNOWN": ("Undeclared", "unknown")}
# fixed values: public hosts of model providers (host or *.suffix) with their jurisdiction; the ids are ours
ENDPOINTS = [
    ("openai", "api.openai.com", "US", "no-training,store-off"),
    ("anthropic", "api.anthropic.com", "US", "no-training,zero-retention"),
    ("google-gemini", "generativelanguage.googleapis.com", "US", "no-training"),
    ("azure", "*.openai.azure.com", "UNKNOWN", "no-training,zero-retention"),
    ("azure", "*.cognitiveservices.azure.com", "UNKNOWN", "no-training,zero-retention"),
    ("bedrock-frankfurt", "bedrock-runtime.eu-central-1.amazonaws.com", "DE", "no-training"),
    ("bedrock-ireland", "bedrock-runtime.eu-west-1.amazonaws.com", "IE", "no-training"),
    ("bedrock-paris", "bedrock-runtime.eu-west-3.amazonaws.com", "FR", "no-training"),
    ("bedrock-stockholm", "bedrock-runtime.eu-north-1.amazonaws.com", "SE", "no-training"),
    ("mistral", "api.mistral.ai", "FR", "no-training"),
    ("aleph-alpha", "api.aleph-alpha.com", "DE", "no-training"),
    ("ionos", "inference.de-txl.ionos.com", "DE", "no-training"),
    ("ionos", "openai.inference.de-txl.ionos.com", "DE", "no-training"),
    ("ovhcloud", "*.endpoints.kepler.ai.cloud.ovh.net", "FR", "no-training"),
    ("ovhcloud", "*.endpoints.ai.cloud.ovh.net", "FR", "no-training"),
    ("scaleway", "api.scaleway.ai", "FR", "no-training"),
    ("on-premises", "localhost", "LOCAL", "no-training,zero-retention"),
    ("on-premises", "127.0.0.1", "LOCAL", "no-training,zero-retention"),
    ("on-premises", "[::1]", "LOCAL", "no-training,zero-retention"),
    ("on-premises", "host.docker.internal", "LOCAL", "no-training,zero-retention"),
]
STRICTNESS = ["allow", "warn", "sanitize", "block"]


def jurisdictions(spark: SparkSession) -> DataFrame:
    rows = [(c, n, "eea") for c, n in EEA.items()] + [(c, n, "adequate") for c, n in ADEQUATE.items()] + [(c, n, s) for c, (n, s) in OTHER.items()]
    return spark.createDataFrame(rows, "code string, name string, status string")


def endpoints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENDPOINTS, "endpoint_id string, pattern string, jurisdiction string, controls string")


def with_jurisdiction(df: DataFrame, code: str) -> DataFrame:
    """Adds ``jurisdiction_name``, ``jurisdiction_status`` and ``leaves_eea``; an unlisted code is UNKNOWN."""
    dim = jurisdictions(df.sparkSession).select(F.col("code").alias("_code"), F.col("name").alias("jurisdiction_name"), F.col("status").alias("jurisdiction_status"))
    out = df.join(F.broadcast(dim), F.upper(F.col(code)) == F.col("_code"), "left").drop("_code")
    out = out.withColumn("jurisdiction_status", F.coalesce("jurisdiction_status", F.lit("unknown"))).withColumn("jurisdiction_name", F.coalesce("jurisdiction_name", F.lit("Undeclared")))
    return out.withColumn("leaves_eea", ~F.col("jurisdiction_status").isin("eea", "local"))


def with_endpoint(df: DataFrame, host: str) -> DataFrame:
    """Adds the most specific endpoint of a host: an exact name before any suffix, a longer suffix before a shorter.

    A host's suffixes are generated from its labels and looked up, longest first, in the
    fixed table of endpoints, which is a literal map: no join.
    """
    lowered = F.lower(F.col(host))
    labels = F.split(lowered, r"\.")
    suffixes = F.transform(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))), lambda i: F.concat(F.lit("*."), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    keyed = df.withColumn("_forms", F.concat(F.array(lowered), F.when(F.size(labels) > 1, suffixes).otherwise(F.array().cast("array<string>"))))
    table = F.map_from_entries(F.array(*[F.struct(F.lit(p), F.struct(F.lit(e).alias("endpoint_id"), F.lit(j).alias("jurisdiction"), F.lit(c).alias("controls"))) for e, p, j, c in ENDPOINTS]))
    match = F.get(F.filter(F.transform(F.col("_forms"), lambda f: F.try_element_at(table, f)), lambda m: m.isNotNull()), 0)
    return keyed.withColumn("_m", match).withColumns({"endpoint_id": F.col("_m.endpoint_id"), "endpoint_jurisdiction": F.coalesce("_m.jurisdiction", F.lit("UNKNOWN")), "controls": F.coalesce("_m.controls", F.lit(""))}).drop("_forms", "_m")


def verdicts(routes: DataFrame, allow: list[tuple[str, str | None, str]], mode: str = "sanitize", require_controls: bool = False) -> DataFrame:
    """Whether each route's ``url`` may be used: ``permitted``, ``rule``, ``jurisdiction``.

    ``allow``: (endpoint URL prefix, declared jurisdiction, legal basis); the first that
    covers a URL decides.  An empty list permits everything and says so.
    """
    url = F.col("url")
    rows = with_endpoint(routes.withColumn("host", F.lower(F.try_parse_url(url, F.lit("HOST")))), "host")
    index, declared = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i in range(len(allow) - 1, -1, -1):
        prefix, where, _ = allow[i]
        covers = (url == prefix) | F.startswith(url, F.lit(prefix.rstrip("/") + "/"))
        index, declared = F.when(covers, F.lit(i)).otherwise(index), F.when(covers, F.lit(where)).otherwise(declared)
    rows = rows.withColumn("_i", index).withColumn("jurisdiction", F.coalesce(declared, "endpoint_jurisdiction"))
    lacking = F.lit(require_controls or mode == "block") & (F.col("controls") == "")
    permitted = F.lit(True) if not allow else F.col("_i").isNotNull() & ~lacking
    rule = F.lit("residency.allow (empty)") if not allow else F.when(F.col("_i").isNull(), "residency.allow").otherwise(F.concat(F.lit("residency.allow["), F.col("_i").cast("string"), F.lit("]")))
    return rows.withColumn("permitted", permitted).withColumn("rule", rule).drop("_i", "endpoint_jurisdiction")


def enforcement(requests: DataFrame, key: str, mode: str, routes: dict[str, str], categories: dict[str, str]) -> DataFrame:
    """Strictest applicable mode of each request (rows ``key, route, kind``; kind null: no finding): ``key, mode, rule``."""

    def table(entries: dict[str, str]) -> Column:
        return F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(v)) for k, v in entries.items()])) if entries else F.create_map().cast("map<string,string>")

    by_route, by_kind = F.try_element_at(table(routes), F.col("route")), F.try_element_at(table(categories), F.col("kind"))
    rows = requests.select(key, "kind", F.coalesce(by_kind, by_route, F.lit(mode)).alias("mode"), F.when(by_kind.isNotNull(), F.concat(F.lit("residency.categories."), "kind")).when(by_route.isNotNull(), F.concat(F.lit("residency.routes."), "route")).otherwise("residency.mode").alias("rule"), by_kind.isNull().alias("general"))
    strict = F.array_position(F.array(*[F.lit(m) for m in STRICTNESS]), F.col("mode"))
    best = Window.partitionBy(key).orderBy(strict.desc(), "general", "kind")
    return rows.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(key, "mode", "rule")


def proxyable(spark: SparkSession) -> DataFrame:
    """Endpoints with their place in the list shown to people: those inside the EEA first, by id."""
    rows = with_jurisdiction(endpoints(spark).groupBy("endpoint_id", "jurisdiction").agg(F.count("*").alias("hosts")), "jurisdiction")
    return rows.select("endpoint_id", "hosts", "leaves_eea", F.row_number().over(Window.orderBy("leaves_eea", "endpoint_id")).alias("place"))


def refusals(judged: DataFrame, *keys: str) -> DataFrame:
    """Per key the number of upstreams and of those that are not permitted; a service may start only where none is."""
    return judged.groupBy(*keys).agg(F.count("*").alias("upstreams"), F.count_if(~F.col("permitted")).alias("refused"))


def controls_split(wanted: Column, settable: tuple[str, ...]) -> Column:
    """``applied`` and ``manual``: the controls that a request field can set, and those left to people."""
    known = F.array(*[F.lit(c) for c in settable])
    return F.struct(F.filter(wanted, lambda c: F.array_contains(known, c)).alias("applied"), F.filter(wanted, lambda c: ~F.array_contains(known, c)).alias("manual"))


def outgoing(mode: Column, original: Column, redacted: Column) -> Column:
    """What leaves: the original where the mode only warns or allows, nothing where it blocks, else the redacted text."""
    return F.when(mode == "block", F.lit(None).cast("string")).when(mode.isin("warn", "allow"), original).otherwise(redacted)
