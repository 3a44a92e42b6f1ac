"""Secret scans with multipart credential linking (DataFrame functions only).

Base kinds are reported wherever they match.  Weak parts (an identifier, a key or an
endpoint that is no evidence alone) are reported only where complementary parts
co-occur within a scope: an identifier near any secret, a key near any identifier or
endpoint, an endpoint near both a secret and an identifier.  Two parts share a scope if
they start at most ``SCOPE`` code points apart in one document.  Weak spans that
overlap a base span are dropped.

The interval join of parts is a range window per document: parts are counted by role
in the range around each start, so no pairs are formed however dense a text is.

Offsets are code points, end exclusive; the lengths of matches and of the gaps between
them give the starts.  Only texts with a match leave the scan, as rows of lengths.

Defined results: a null text is empty and has no spans; null doc_ids stay; rows that
agree in doc_id and text have the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPE = 240

#: Base kinds in the order of listing; group 2 of assign has 6 or more characters.
BASE = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
WEAK = {
    "ident": r"""(?i:client_?id|account_?id|access_?key_?id|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""",
    "key": r"""(?i:pass|pwd|pass_?phrase|private_?key|access_?key|auth|credentials?|signature)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""",
    "host": r"""(?:(?i:https?|wss?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://|(?i:endpoint|host|server)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9._~:/?@&+,;=%-]{4,}""",
}
KINDS = [*BASE, *WEAK]


def _matches(text: Column, kind: str) -> Column:
    """Array of (ord, i, pre, len, ok) of a kind's matches."""
    pattern = (BASE | WEAK)[kind]
    re = F.lit(pattern)
    found = F.regexp_extract_all(text, re, F.lit(0))
    ok = F.transform(F.regexp_extract_all(text, re, F.lit(2)), lambda g: F.char_length(g) >= 6) if kind == "assign" else F.transform(found, lambda m: F.lit(True))
    zipped = F.arrays_zip(
        F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda g: F.char_length(g)).alias("pre"),
        F.transform(found, lambda m: F.char_length(m)).alias("len"),
        ok.alias("ok"),
    )
    rows = F.transform(zipped, lambda z, i: F.struct(F.lit(KINDS.index(kind)).alias("ord"), i.alias("i"), z["pre"].alias("pre"), z["len"].alias("len"), z["ok"].alias("ok")))
    return F.when(F.rlike(text, re), rows).otherwise(F.array().cast("array<struct<ord:int,i:int,pre:int,len:int,ok:boolean>>"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["ord"]), s["start"], s["end"])), ",")


def spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id, text_key, ord, start, end`` of all reported spans; ord numbers KINDS."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.flatten(F.array(*[_matches(text, k) for k in KINDS])).alias("m"))
    rows = rows.where(F.size("m") > 0).dropDuplicates(["doc_id", "text_key"])
    rows = rows.select("doc_id", "text_key", F.explode("m").alias("m")).select("doc_id", "text_key", "m.*")
    kind = Window.partitionBy("doc_id", "text_key", "ord").orderBy("i")
    upto, before = kind.rowsBetween(Window.unboundedPreceding, 0), kind.rowsBetween(Window.unboundedPreceding, -1)
    start = F.sum("pre").over(upto) + F.coalesce(F.sum("len").over(before), F.lit(0))
    rows = rows.withColumn("start", start).where("ok").select("doc_id", "text_key", "ord", "start", (F.col("start") + F.col("len")).alias("end"))
    text_rows = Window.partitionBy("doc_id", "text_key").orderBy("start")
    near = text_rows.rangeBetween(-scope, scope)
    base = F.col("ord") < len(BASE)

    def has(*kinds: str) -> Column:
        return F.max(F.col("ord").isin([KINDS.index(k) for k in kinds])).over(near)

    secret, ident, host = has("assign", "hex", "key"), has("access", "ident"), has("host")
    linked = F.when(base, True).when(F.col("ord") == KINDS.index("ident"), secret).when(F.col("ord") == KINDS.index("key"), ident | host).otherwise(secret & ident)
    earlier = F.max(F.when(base, F.col("end"))).over(text_rows.rangeBetween(Window.unboundedPreceding, 0))
    later = F.min(F.when(base, F.col("start"))).over(text_rows.rangeBetween(0, Window.unboundedFollowing))
    clear = base | ((F.coalesce(earlier, F.lit(0)) <= F.col("start")) & (F.coalesce(later, F.col("end")) >= F.col("end")))
    return rows.select("doc_id", "text_key", "ord", "start", "end", (linked & clear).alias("kept")).where("kept").drop("kept")


def report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``, and ``n_linked``, the number of weak spans."""
    each = F.array_sort(F.collect_list(F.struct("start", "ord", "end")))
    base = F.array_sort(F.collect_list(F.when(F.col("ord") < len(BASE), F.struct("start", "ord", "end"))))
    counts = [F.count_if(F.col("ord") == i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    found = spans(docs, scope).groupBy("doc_id", "text_key").agg(*counts, F.count_if(F.col("ord") >= len(BASE)).alias("n_linked"), _listed(base).alias("base"), _listed(each).alias("spans"))
    found = found.withColumnsRenamed({"doc_id": "_d", "text_key": "_k"})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k")), "left")
    zero = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in [*BASE, "linked"]]
    return out.select("doc_id", *zero[:-1], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero[-1])


def _sql_string(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_EACH = " union all ".join(
    f"select doc_id, {i} as ord, unnest(range(len(regexp_extract_all(t, {_sql_string(p)}))))::int as i, "
    f"unnest([length(g) for g in regexp_split_to_array(t, {_sql_string(p)})[:-2]]) as pre, "
    f"unnest([length(m) for m in regexp_extract_all(t, {_sql_string(p)})]) as len, "
    + (f"unnest([length(m) >= 6 for m in regexp_extract_all(t, {_sql_string(p)}, 2)])" if k == "assign" else f"unnest([true for m in regexp_extract_all(t, {_sql_string(p)})])")
    + f" as ok from texts where regexp_matches(t, {_sql_string(p)})"
    for i, (k, p) in enumerate((BASE | WEAK).items())
)
_NAMES = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
ORACLE = f"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
matches as ({_EACH}),
placed as (
  select doc_id, ord, len, ok, (sum(pre) over w + coalesce(sum(len) over (partition by doc_id, ord order by i rows between unbounded preceding and 1 preceding), 0))::bigint as s
  from matches window w as (partition by doc_id, ord order by i rows unbounded preceding)
), parts as (select doc_id, ord, s, s + len as e from placed where ok),
seen as (
  select *, bool_or(ord in (0, 2, 4)) over near as secret, bool_or(ord in (1, 3)) over near as ident, bool_or(ord = 5) over near as host,
    max(case when ord < 3 then e end) over (partition by doc_id order by s range between unbounded preceding and current row) as earlier,
    min(case when ord < 3 then s end) over (partition by doc_id order by s range between current row and unbounded following) as later
  from parts window near as (partition by doc_id order by s range between {SCOPE} preceding and {SCOPE} following)
), kept as (
  select doc_id, ord, s, {_NAMES}[ord + 1] || ':' || s || ':' || e as span from seen
  where ord < 3 or (case ord when 3 then secret when 4 then ident or host else secret and ident end and coalesce(earlier, 0) <= s and coalesce(later, e) >= e)
), per as (
  select doc_id, count(*) filter (where ord = 0) as n0, count(*) filter (where ord = 1) as n1, count(*) filter (where ord = 2) as n2, count(*) filter (where ord > 2) as n3,
    coalesce(string_agg(span, ',' order by s, ord) filter (where ord < 3), '') as base, string_agg(span, ',' order by s, ord) as spans
  from kept group by doc_id
)
select t.doc_id, coalesce(n0, 0)::bigint as n_assign, coalesce(n1, 0)::bigint as n_access, coalesce(n2, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n3, 0)::bigint as n_linked
from texts t left join per p on t.doc_id = p.doc_id
"""
