"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

Documents are sets of distinct five-word shingles (A-Z lower-cased, words
``[^\\x20\\x09-\\x0D]+``); a text of one to four words is one shingle.  The sketch is
the "fast similarity sketching" of Dahlgaard, Knudsen and Thorup: in round i every
shingle is thrown into a random bin with the value (i, hash); a bin keeps its least
value; after the first t rounds each further round throws all shingles into one
fixed bin, so every bin fills for every non-empty set.  Bands of five coordinates
propose pairs, the sketches drop those far below the threshold, and full sets confirm
the rest.

Recall: a pair at exactly the threshold 0.75 shares a given band with probability
about 0.75**5, so all 48 bands miss it with probability about 2e-6 (5e-9 at 0.8).
The sketch filter asks for 144 of the 240 coordinates, over five standard deviations
below the 180 expected at the threshold.

Defined results: null or empty texts and texts without words have an empty set and
link with nothing; rows without doc_id are never linked (component_id null, kept);
several rows of one doc_id form one node of the link graph and each stays a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbra.llm import linkage
from umbra.llm.textio import chunks, cut, drop, packed, unpacked, utf8
from umbra.llm.wordhash import U, gram_starts, grams, mix, stream, word_hashes

SHINGLE = 5
BANDS, ROWS = 48, 5
THRESHOLD = (75, 100)
#: Parts of the hash space in a document's profile.
PARTS = 64
#: Up to so many doc_ids (8 bytes each) are broadcast to fetch texts; more go by a shuffle join.
BROADCAST_IDS = 1_000_000


def shingle_sets(batch: pa.RecordBatch, n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row's text."""
    words, ranges, _ = word_hashes(*utf8(batch.column("text")), lower=True)
    runs = grams(words, n)
    out = []
    for lo, hi in zip(ranges[:-1].tolist(), ranges[1:].tolist(), strict=True):
        if hi - lo >= n:
            out.append(np.unique(runs[lo : hi - n + 1]))
        elif hi > lo:
            out.append(grams(words[lo:hi], hi - lo, seed=100 + hi - lo))
        else:
            out.append(np.zeros(0, U))
    return out


def sketch(sets: list[np.ndarray], bins: int = BANDS * ROWS, seed: int = 7) -> np.ndarray:
    """A row of ``bins`` values for each set; rows of empty sets stay at the maximum."""
    unset = U(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), bins), unset, U)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return out
    flat = out.reshape(-1)
    items = np.concatenate(sets)
    rows = np.repeat(np.arange(len(sets)), sizes)
    keys = stream(seed, 2 * bins)
    for i in range(bins):
        if not len(items):
            return out
        h = mix(items ^ keys[i])
        at = rows * bins + ((h >> U(40)) * U(bins) >> U(24)).astype(np.int64)
        np.minimum.at(flat, at, (U(i) << U(48)) | (mix(h) >> U(16)))
        open_rows = (out == unset).any(axis=1)
        stay = open_rows[rows]
        items, rows = items[stay], rows[stay]
    for j in range(bins):  # every set reaches the bins that are still open
        need = (out[:, j] == unset)[rows]
        if need.any():
            h = mix(mix(items[need] ^ keys[bins + j])) >> U(16)
            np.minimum.at(flat, rows[need] * bins + j, (U(bins + j) << U(48)) | h)
    return out


def band_keys(sketches: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = sketches.reshape(len(sketches), bands, rows)
    with np.errstate(over="ignore"):
        total = stream(31, bands)[None, :].repeat(len(sketches), 0)
        for r, c in enumerate(stream(32, rows) | U(1)):
            total = mix(total + parts[:, :, r] * c)
    return total.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        sets = shingle_sets(batch)
        sizes = np.array([len(s) for s in sets], np.int64)
        with np.errstate(over="ignore"):
            sums = np.array([[mix(s ^ U(k)).sum(dtype=U) if len(s) else 0 for k in (3, 5)] for s in sets], U).view(np.int64)
        keys = band_keys(sketch(sets)).reshape(-1)
        offsets = np.arange(len(sets) + 1, dtype=np.int32) * BANDS
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))],
            names=["doc_id", "n_shingles", "s1", "s2", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        sets = shingle_sets(batch)
        low = [row.tobytes() for row in sketch(sets).astype(np.uint8)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(low, pa.binary())], names=["id", "set", "low"]
        )


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch.column("set").to_pylist()]
        if sets:
            ids = np.repeat(batch.column("id").to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets))], names=["id", "shingle"])


@F.pandas_udf(T.BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    """At least three in five coordinates agree in their low byte."""
    if not len(a):
        return pd.Series([], dtype=bool)
    x, y = (np.frombuffer(b"".join(v), np.uint8).reshape(len(v), -1) for v in (a, b))
    return pd.Series((x == y).sum(axis=1) * 5 >= x.shape[1] * 3)


@F.pandas_udf(T.BooleanType())
def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    up, down = THRESHOLD
    out = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if min(len(x), len(y)) * down < max(len(x), len(y)) * up:
            continue
        x, y = np.frombuffer(x, U), np.frombuffer(y, U)
        if len(y) > len(x):
            x, y = y, x
        at = np.searchsorted(x, y)
        at[at == len(x)] = 0
        both = int((x[at] == y).sum())
        out[i] = down * both >= up * (len(x) + len(y) - both)
    return pd.Series(out)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, s1, s2, bands``; s1 and s2 identify the full set."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _signatures, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"
    )


def near_duplicates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per row ``doc_id, n_shingles, component_id, kept``; and the links between representatives of different sets ``(a, b)``.

    Equal sets are one class, represented by its least doc_id, before any bucket
    is formed; so a group of copies costs one aggregation row, whatever its size.
    """
    sig = cut(signatures(docs))
    some = sig.where("doc_id is not null and n_shingles > 0")
    key = ["s1", "s2", "n_shingles"]
    classes = cut(some.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    banded = some.select(F.explode("bands").alias("bucket"), "doc_id", "s1")
    # only buckets with different sets go on, and of each set its representative
    shared = banded.groupBy("bucket").agg(F.min("s1").alias("x"), F.max("s1").alias("y")).where("x < y").select("bucket")
    members = banded.join(shared, "bucket").select("bucket", F.col("doc_id").alias("id")).distinct()
    members = cut(members.join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"))
    ids = cut(members.select(F.col("id").alias("doc_id")).distinct())
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(wanted, "doc_id", "left_semi")
    sets = cut(texts.mapInArrow(_sets, "id long, set binary, low binary"), ids)
    # a doc_id on several rows keeps each set once; with several sets it has no size of its own
    repeated = cut(sets.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    several = repeated
    if not repeated.isEmpty():
        few = F.broadcast(repeated) if repeated.count() <= BROADCAST_IDS else repeated
        once = cut(sets.join(few, "id", "left_semi").dropDuplicates(["id", "set"]))
        several = cut(once.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
        sets = cut(sets.join(few, "id", "left_anti").unionByName(once), sets, once)

    small = (sets.agg(F.sum(F.octet_length("set") + F.octet_length("low") + 64)).first()[0] or 0) <= linkage.BROADCAST_BYTES

    def verify(pairs: DataFrame) -> DataFrame:
        for udf, column in ((_near, "low"), (_similar, "set")):
            a, b = linkage.sides(sets, column, small)
            pairs = pairs.join(a, "a").join(b, "b").where(udf("of_a", "of_b")).select("a", "b")
        return pairs if several is repeated and repeated.isEmpty() else pairs.distinct()

    def profile(ids: DataFrame) -> DataFrame:
        """Set size, and per part of the hash space how many shingles the document shares with any other of these documents."""
        own = cut(sets.join(ids, "id", "left_semi").mapInArrow(_shingles, "id long, shingle long"))
        part = F.pmod("shingle", F.lit(PARTS)).cast("int").alias("part")
        alone = own.groupBy("shingle").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").groupBy("id", part).agg(F.count("*").alias("alone"))
        each = own.groupBy("id", part).agg(F.count("*").alias("n")).join(alone, ["id", "part"], "left")
        whole = each.groupBy("id").agg(F.sum("n").alias("size"), F.map_from_entries(F.collect_list(F.struct("part", (F.col("n") - F.coalesce("alone", F.lit(0))).cast("int")))).alias("shared"))
        filled = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.coalesce(F.try_element_at("shared", i), F.lit(0)))
        whole = whole.join(several.select("id", F.lit(True).alias("several")), "id", "left")
        return whole.select("id", F.struct("size", filled.alias("shared"), F.coalesce("several", F.lit(False)).alias("several")).alias("profile"))

    def compatible(a: Column, b: Column) -> Column:
        """The sets could have enough in common: no part has more than the poorer document shares there.  A doc_id with several sets always could."""
        up, down = THRESHOLD
        most = F.aggregate(F.zip_with(a["shared"], b["shared"], lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
        bounded = (F.least(a["size"], b["size"]) * down >= F.greatest(a["size"], b["size"]) * up) & (most * (up + down) >= (a["size"] + b["size"]) * up)
        return a["several"] | b["several"] | bounded

    links, found = linkage.link(members, verify, profile, compatible)
    drop(sets)
    # a document alone with its set is its own representative, so only classes of several rows are joined; of the large ones,
    # which adaptive execution can split, each has one row here
    linked = found.withColumnRenamed("id", "rep")
    placed = cut(classes.join(linked, "rep", "left").where("n > 1 or component is not null").select(*key, F.coalesce("component", "rep").alias("component")), classes)
    # several classes can hold one doc_id (repeated rows), so every doc_id goes with all its classes
    ids = some.join(placed, key).groupBy("doc_id").agg(F.min("component").alias("component_id"))
    out = sig.select("doc_id", "n_shingles").join(ids, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), links


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay when one row of each group remains, columns as given."""
    found, _ = near_duplicates(docs)
    gone = found.where("not kept").select("doc_id").distinct()
    return unpacked(packed(docs).join(gone, "doc_id", "left_anti"))
