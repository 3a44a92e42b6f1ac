"""Mixing sources to target weights (DataFrame functions only).

A document's size is its number of words ``[^\\x20\\x09-\\x0D]+``.  Sources, by code point
and null last, weigh ``WEIGHTS`` in turn and share ``SHARE`` times all words; a target
stops at ``MOST`` times its source's words and the excess goes to the others by weight
until none is above.  A source's repetition rate is target / words; each document comes
floor(rate) times, and once more by a Bernoulli draw with the fraction as probability.
Draws are hashes of doc_id and a seed; of ``SEEDS`` seeds each source takes the one
whose total lands nearest its target, so small sources come near theirs too.

Defined results: null or blank texts have size 0 and no influence; a source of size 0
has target 0 and takes nothing; a null source is a source; rows with one doc_id draw
alike; null doc_ids draw as one id.

Scale: one aggregation with map-side combine gives the sources' sizes; their ranks come
from a range-partitioned sort with one offset a partition, never one task; resharing
needs one aggregated row a round.  The table of sources is broadcast only if its row
count allows; else the join is a shuffle join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.llm.textio import cut, packed

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEEDS = 16
#: Sources up to this count are broadcast (under 200 bytes each, but for their names).
BROADCAST_SOURCES = 50_000

#: Fixed value: the word pattern.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """Uniform in [0, 1), a function of doc_id and the seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source_key, source_size, target`` from rows ``source, size``."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    n = max(1, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(per.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("offset") + F.col("in_part")) % len(weights) + 1).cast("int"))
    weighed = ranged.withColumn("in_part", rank).join(offsets, "part").select(_key(F.col("source")).alias("source_key"), "source_size", weight.alias("weight"))
    weighed = cut(weighed)
    total, weight_sum = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    level, stopped = 0.0, None
    while total:
        above = F.col("weight") * F.lit(level) > most * F.col("source_size")
        now = tuple(weighed.where(above).agg(F.coalesce(F.sum(most * F.col("source_size")), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first())
        if now == stopped:
            break
        stopped = now
        level = (share * total - now[0]) / (weight_sum - now[1])
    target = F.least(F.col("weight") * F.lit(level), (most * F.col("source_size")).cast("double"))
    return weighed.select("source_key", "source_size", target.alias("target"))


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources ``source_key, source_size, target, rate, seed`` and sized rows ``doc_id, source_key, size``."""
    sizes = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size")))
    per = targets(sizes).withColumn("rate", F.coalesce(F.least(F.try_divide("target", "source_size"), F.lit(float(MOST))), F.lit(0.0)))
    per = cut(per)
    sized = sizes.select("doc_id", _key(F.col("source")).alias("source_key"), "size")
    part = F.col("rate") - F.floor("rate")
    extra = [F.sum(F.when(draw(F.col("doc_id"), k) < part, F.col("size")).otherwise(0)).alias(f"x{k}") for k in range(SEEDS)]
    tried = with_sources(sized, per).groupBy("source_key").agg(*extra)
    best = F.array_min(F.array(*[F.struct(F.abs(F.floor("rate") * F.col("source_size") + F.col(f"x{k}") - F.col("target")).alias("off"), F.lit(k).alias("seed")) for k in range(SEEDS)]))
    return cut(per.join(tried, "source_key").withColumn("seed", best["seed"]).drop(*[f"x{k}" for k in range(SEEDS)])), sized


def with_sources(rows: DataFrame, per: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(per) if per.count() <= BROADCAST_SOURCES else per, "source_key")


def copies() -> Column:
    chance = F.element_at(F.array(*[draw(F.col("doc_id"), k) for k in range(SEEDS)]), F.col("seed") + 1)
    return (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")


def mixture(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id, size, source_size, target, taken``."""
    per, sized = plan(docs)
    return with_sources(sized, per).select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents as often as the mixture takes them; ``copy`` (with underscores if the table has that column) counts from 1."""
    per, _ = plan(docs)
    counter = "copy"
    while counter in docs.columns:
        counter += "_"
    rows = with_sources(packed(docs, _key(F.col("source")).alias("source_key")), per.select("source_key", "rate", "seed"))
    rows = rows.withColumn("times", copies()).where("times > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth")).select("row.*", F.col("nth").alias(counter))


_DRAWS = ", ".join(f"('0x' || substr(md5('{k}:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint / 4503599627370496.0" for k in range(SEEDS))
_OFFS = ", ".join(f"{{'off': abs(floor(rate) * source_size + coalesce(sum(size) filter (where d[{k + 1}] < rate - floor(rate)), 0) - target), 'seed': {k}}}" for k in range(SEEDS))
ORACLE = f"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size, [{_DRAWS}] as d from documents
), per as (
  select source, sum(size)::bigint as source_size from sized group by source
), weighed as (
  select *, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::bigint as weight from per
), prefixes as (
  select sum(2 * source_size) over w as c, sum(weight) over w as k from weighed
  window w as (order by 2.0 * source_size / weight, source nulls last rows unbounded preceding)
), whole as (
  select sum(source_size)::double as total, sum(weight) as k from weighed
), level as (
  select max(l) as level from (
    select 1.5 * total / k as l from whole
    union all select (1.5 * total - p.c) / (w.k - p.k) from prefixes p, whole w where w.k > p.k)
), goal as (
  select source, source_size, least(weight * level, (2 * source_size)::double) as target from weighed, level
), rated as (
  select *, case when source_size > 0 then least(target / source_size, 2.0) else 0.0 end as rate from goal
), seeded as (
  select r.source, source_size, target, rate, list_min([{_OFFS}]).seed as seed
  from sized s join rated r on s.source is not distinct from r.source group by r.source, source_size, target, rate
)
select doc_id, size, source_size, target,
  (size * (floor(rate) + case when d[seed + 1] < rate - floor(rate) then 1 else 0 end))::bigint as taken
from sized s join seeded r on s.source is not distinct from r.source
"""
