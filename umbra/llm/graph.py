"""Connected components of a link table.

Links are contracted in the workers first: a worker replaces its links by the stars of
their components, which keeps what is reachable and drops what repeats.  A table that
then has at most ``LOCAL_LINKS`` links (16 bytes each, a bound that does not grow with
the input) is finished by one task.  Larger ones go through large-star and small-star
rounds, contracted in the workers each time, until they settle or come under the bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.textio import cut, drop

LOCAL_LINKS = 1_000_000
#: Links that a worker contracts at once.
_HELD = 1 << 18


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id of the links, and the least id that it reaches."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(x):
        x, y = root[x], root[y]
        open_ = x != y
        x, y = x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    return ids, ids[root]


def _stars(everything: bool):
    """Links as (u, v) to stars (u, least), in pieces or all at once; then with the least itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def contracted() -> pa.RecordBatch:
            u, v = np.concatenate(held, axis=1) if held else np.zeros((2, 0), np.int64)
            ids, least = least_reachable(u, v)
            keep = slice(None) if everything else ids != least
            return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(least[keep])], names=["u", "v"])

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v")]))
            size += batch.num_rows
            if size >= _HELD and not everything:
                yield contracted()
                held, size = [], 0
        if held:
            yield contracted()

    return run


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _contracted(edges: DataFrame, *superseded: DataFrame) -> DataFrame:
    return cut(edges.mapInArrow(_stars(False), "u long, v long"), *superseded)


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 50, local_links: int = LOCAL_LINKS) -> DataFrame:
    """``(id, component)`` for every id in ``links``; component: the least id reachable.

    Large-star and small-star steps are each a min-aggregation with map-side combine and
    one equi-join; no neighbourhood is ever gathered into one row or task.  Rows with a
    null end and self-links are ignored.  The lineage is cut after every round.
    """
    edges = _contracted(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))))
    before = None
    for _ in range(most_rounds):
        n = edges.count()
        if n <= local_links:
            return cut(edges.coalesce(1).mapInArrow(_stars(True), "u long, v long").select(F.col("u").alias("id"), F.col("v").alias("component")), edges)
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct(), edges)
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct(), large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links did not settle in {most_rounds} rounds")
    both = edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")))
    out = cut(both.groupBy("id").agg(F.min("component").alias("component")))
    drop(edges)
    return out
