"""Links between the members of candidate buckets, found without all-pairs joins.

Buckets come as ``(bucket, id)`` rows.  Members are compared with their bucket's
least member first; that settles groups of copies of any size with one
comparison a member.  Only buckets whose members then still lie in more than one
component go on: their members from different components are compared unless a
cheap bound rules the link out, so no link between two members of a bucket is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.graph import components
from umbra.llm.textio import cut, drop

#: Bytes of the members' contents up to which they are broadcast to the pairs; beyond, both go by shuffle joins.
BROADCAST_BYTES = 4 << 20
#: Rows of components (16 bytes each) up to which they are broadcast; beyond, they go by shuffle joins.
BROADCAST_ROWS = 250_000


def link(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    profile: Callable[[DataFrame], DataFrame],
    compatible: Callable[[Column, Column], Column],
) -> tuple[DataFrame, DataFrame]:
    """Verified links ``(a, b)`` and components ``(id, component)``.

    ``members``: distinct ``(bucket, id)``, a cut that is deleted here.  ``verify`` takes
    distinct pairs ``(a, b)`` with ``a < b`` and returns those that hold.  ``profile`` gives
    ``(id, profile)`` for the ids of a table, and ``compatible`` tells from two profiles
    whether their link is possible at all.  Every pair that shares a bucket is verified, or
    already within one component, or incompatible; so the components are exact with respect
    to the buckets.

    Rounds: each member against the least of its buckets' leaders; then against those
    of its other leaders that lie in another component; last, all compatible
    cross-component pairs that share a bucket, each once.
    """
    sized = members.groupBy("bucket").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1")
    rest = cut(members.join(sized, "bucket").select("bucket", "id", "leader"), members)
    star = rest.where("id <> leader")
    first = star.groupBy(F.col("id").alias("b")).agg(F.min("leader").alias("a"))
    links = cut(verify(first.select("a", "b")))
    own = components(links)
    placed = _placed(star.select(F.col("leader").alias("a"), F.col("id").alias("b")), own, "a", "b")
    others = cut(placed.where("c_a <> c_b").select("a", "b").distinct())
    if not others.isEmpty():
        more = cut(verify(others))
        if not more.isEmpty():
            links, own = _joined(links, more, own)
    placed = _placed(rest.select("bucket", "id"), own, "id").withColumnRenamed("c_id", "component")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket")
    rest = cut(placed.join(mixed, "bucket"), rest, others)
    if rest.isEmpty():
        return links, own
    profiles = profile(cut(rest.select("id").distinct()))
    # each pair comes from the least bucket that its two members share, once
    buckets = rest.groupBy("id").agg(F.collect_set("bucket").alias("buckets"))
    rest = cut(rest.join(buckets, "id").join(profiles, "id"), rest)
    left, right = (rest.select("bucket", F.col("id").alias(i), F.col("component").alias(f"c{i}"), F.col("buckets").alias(f"b{i}"), F.col("profile").alias(f"p{i}")) for i in "ab")
    once = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (F.array_min(F.array_intersect("ba", "bb")) == left["bucket"]) & compatible(F.col("pa"), F.col("pb"))
    pairs = cut(left.join(right, (left["bucket"] == right["bucket"]) & once).select("a", "b"), rest)
    if pairs.isEmpty():
        return links, own
    more = cut(verify(pairs), pairs)
    return (links, own) if more.isEmpty() else _joined(links, more, own)


def _joined(links: DataFrame, more: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables of links, which share none, and their components."""
    links = cut(links.union(more), links, more)
    drop(own)
    return links, components(links)


def sides(table: DataFrame, column: str, small: bool) -> list[DataFrame]:
    """``column`` of ``table`` for both ends of a pair, as ``of_a`` and ``of_b``; broadcast if it is known to be small."""
    out = [table.select(F.col("id").alias(i), F.col(column).alias(f"of_{i}")) for i in "ab"]
    return [F.broadcast(x) for x in out] if small else out


def _placed(rows: DataFrame, own: DataFrame, *ids: str) -> DataFrame:
    """With the component of each id column as ``c_<column>``."""
    if own.count() <= BROADCAST_ROWS:
        own = F.broadcast(own)
    for i in ids:
        rows = rows.join(own.select(F.col("id").alias(i), F.col("component").alias(f"c_{i}")), i, "left").withColumn(f"c_{i}", F.coalesce(f"c_{i}", i))
    return rows
