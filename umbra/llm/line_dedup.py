"""Line dedup by a segment-partition edit join.

Lines (\\n-split, with at least one word) are equal or near: within one insertion,
deletion or substitution of a code point for every ``EDIT_EVERY`` code points of the
shorter line, at most ``EDITS``.  So the number of edits follows the length (under
``EDIT_EVERY`` code points none, and equal lines only).  For k edits a line is cut into
k + 1 even segments; by the pigeonhole principle a near line holds one of them unchanged,
at a position that the two lengths bound.  Index keys hash (k, line length, segment
number, segment); a line probes the keys of its own length and of the k lengths below
with the substrings that the multi-match-aware window allows, which covers its own
index keys too.  Lines that share a key are compared by banded bit-parallel edit
distance.  Linked lines form classes (connected components); of each class the line
with the least (doc_id, line number) stays.

Scale: lines are identified by hashes of 128 bits; the link table uses the first 64 as
node, and a line that shares these but not the others with a linked line is not part of
its class.  Only lines that share a key with a different line are fetched as text.  Pairs
that only one key brings together must have close counts of characters before they are
compared.  Repeated lines are dropped from the probes within a worker's
chunk, equal lines aggregate with map-side combine, and joins are equi-joins that
adaptive execution can split.

Defined results: null texts have no lines; blank lines stay; rows without doc_id keep
all lines and count for none; rows that share a doc_id are one document.
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
from umbra.llm.textio import chunks, cut, drop, packed, utf8
from umbra.llm.wordhash import U, mix, powers, stream

EDITS = 2
EDIT_EVERY = 12
#: Classes of code points that the profile of a line counts.
PROFILE = 32
#: Up to so many shared buckets or line ids (8 bytes each) are sent to the workers of the next pass; more go by a shuffle join.
SENT_KEYS = 1_000_000
#: Fixed value: a character of a word.
WORD = r"[^\x20\x09-\x0D]"
_P = U(0xC2B2AE3D27D4EB4F)
_P_INV = U(pow(int(_P), -1, 1 << 64))
_R = U(0x94D049BB133111EB)
_R_INV = U(pow(int(_R), -1, 1 << 64))


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most k: bit-parallel over the 2k + 1 diagonals of the band."""
    if abs(len(a) - len(b)) > k:
        return False
    if a == b:
        return True
    lo, most = 0, min(len(a), len(b))
    step = most
    while step:  # common prefix by halving slices
        while lo + step <= most and a[lo : lo + step] == b[lo : lo + step]:
            lo += step
        step >>= 1
    a, b = a[lo:], b[lo:]
    hi, most = 0, min(len(a), len(b))
    step = most
    while step:
        while hi + step <= most and a[len(a) - hi - step : len(a) - hi] == b[len(b) - hi - step : len(b) - hi]:
            hi += step
        step >>= 1
    a, b = a[: len(a) - hi], b[: len(b) - hi]
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n == 0:
        return m <= k
    # column j (of b) keeps rows j-k .. j+k of a as bits 0 .. 2k; rows outside a never match
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << (i + k))
    width = 2 * k + 1
    full = (1 << width) - 1
    # bit i stands for row j - k + i; rows up to 0 start with distance 0 differences
    vp = (full << k) & full
    vn = 0
    score = k  # at the lowest diagonal of the band, row j + k
    for j in range(m):
        match = (where.get(b[j], 0) >> j) & full
        d0 = (((match & vp) + vp) ^ vp) | match | vn
        hp = vn | ~(d0 | vp)
        hn = d0 & vp
        down = d0 >> 1
        vp = (hn | ~(down | hp)) & full
        vn = (down & hp) & full
        if not (d0 >> (2 * k)) & 1:
            score += 1
            if score > k + 2 * k:
                return False
    # from row m + k of the last column up to row n
    for i in range(m + k - n):
        bit = 1 << (2 * k - 1 - i)
        score += bool(vn & bit) - bool(vp & bit)
    return score <= k


class Lines:
    """Lines with a word of a chunk of texts, as ranges of code points with prefix hashes."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = utf8(batch.column("text"))
        self.raw = data.tobytes()
        points = np.frombuffer(self.raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80) if len(data) != len(points) else np.arange(len(data))
        self.byte_at = np.append(lead, len(data))
        ends = np.searchsorted(lead, offsets)  # of texts, in code points
        breaks = np.flatnonzero(points == 10)
        first = np.union1d(ends[:-1], breaks + 1)
        first = first[first < len(points)]
        last = np.append(first[1:], len(points))
        last = last - (points[last - 1] == 10)
        text = np.searchsorted(ends, first, side="right") - 1
        solid = np.zeros(len(points) + 1, np.int64)
        np.cumsum(~((points == 32) | ((points >= 9) & (points <= 13))), out=solid[1:])
        number = np.arange(len(first)) - np.searchsorted(first, ends[:-1])[text]
        has = solid[last] > solid[first]
        self.first, self.last, self.text, self.number = first[has], last[has], text[has], number[has]
        self.points = points
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(points) + 1, U)
            np.cumsum((points.astype(U) + U(1)) * powers(_P, len(points)), out=self.sums[1:])
            self.inverse = powers(_P_INV, len(points) + 1)
            size = (self.last - self.first).astype(U)
            body = (self.sums[self.last] - self.sums[self.first]) * self.inverse[self.first]
            self.id = mix(body + size * U(0x9E3779B97F4A7C15)).view(np.int64)
            other = np.zeros(len(points) + 1, U)
            np.cumsum(mix(points.astype(U)) * powers(_R, len(points)), out=other[1:])
            self.id2 = mix((other[self.last] - other[self.first]) * powers(_R_INV, len(points) + 1)[self.first]).view(np.int64)

    def line(self, i: int) -> str:
        return self.raw[self.byte_at[self.first[i]] : self.byte_at[self.last[i]]].decode("utf-8")

    def keys(self, edits: int, every: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket keys of the chunk's different lines, and the id of each key's line."""
        _, once = np.unique(self.id, return_index=True)
        size = (self.last - self.first)[once]
        out, of = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for k in range(1, edits + 1):
            # the shorter line of a pair with k edits has k * every code points or more, and under (k + 1) * every unless k is the most
            mine = once[(size >= k * every) & ((k == edits) | (size < (k + 1) * every + k))]
            self._keys(mine, k, (k + 1) * every if k < edits else None, out, of)
        return np.concatenate(out).view(np.int64), np.concatenate(of)

    def _keys(self, lines: np.ndarray, edits: int, below: int | None, out: list[np.ndarray], of: list[np.ndarray]) -> None:
        base, ids = self.first[lines], self.id[lines]
        size = self.last[lines] - base
        parts = edits + 1
        salt = stream(41 + 10 * edits, parts)
        with np.errstate(over="ignore"):
            for shorter in range(edits + 1):
                target = size - shorter
                small, large = target // parts, target % parts
                fits = target < (1 << 62 if below is None else below)
                for i in range(parts):
                    length = small + (i >= parts - large)
                    start = i * small + np.maximum(0, i - (parts - large))
                    for move in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1):
                        at = start + move
                        ok = fits & (length > 0) & (at >= 0) & (at + length <= size)
                        s = (base + at)[ok]
                        body = (self.sums[s + length[ok]] - self.sums[s]) * self.inverse[s]
                        out.append(mix(mix(body + salt[i]) + target[ok].astype(U)))
                        of.append(ids[ok])

    def profile(self, i: int) -> np.ndarray:
        """How often code points of each class modulo PROFILE occur in line i."""
        return np.bincount(self.points[self.first[i] : self.last[i]] % PROFILE, minlength=PROFILE)


def _held(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def _probes(edits: int, every: int, wanted: np.ndarray | None = None):
    """Rows (bucket, id); wanted: sorted buckets, others stay in the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            keys, ids = Lines(batch).keys(edits, every)
            if wanted is not None:
                ok = _held(wanted, keys)
                keys, ids = keys[ok], ids[ok]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids)], names=["bucket", "id"])

    return run


_TEXT = pa.struct([("id", pa.int64()), ("id2", pa.int64()), ("line", pa.string()), ("profile", pa.list_(pa.int32()))])


def _read(wanted: np.ndarray | None, every: int):
    """A row per document: number, id and id2 of its lines, and the wanted lines' texts and profiles (None: of all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            own = Lines(batch)
            edges = np.searchsorted(own.text, np.arange(batch.num_rows + 1)).astype(np.int32)
            long = own.last - own.first >= every
            take = np.flatnonzero(long & _held(wanted, own.id) if wanted is not None else long)
            texts = pa.array([{"id": int(own.id[i]), "id2": int(own.id2[i]), "line": own.line(i), "profile": own.profile(i).tolist()} for i in take], _TEXT)
            lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x)) for x in (own.number.astype(np.int32), own.id, own.id2)]
            text_edges = np.searchsorted(own.text[take], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists, pa.ListArray.from_arrays(pa.array(text_edges), texts)], names=["doc_id", "number", "id", "id2", "texts"])

    return run


READ_SCHEMA = "doc_id long, number array<int>, id array<long>, id2 array<long>, texts array<struct<id:long,id2:long,line:string,profile:array<int>>>"


def _sorted_longs(rows: DataFrame, most: int) -> np.ndarray | None:
    """The values of a one-column table in order if there are at most ``most``; else None."""
    if rows.count() > most:
        return None
    return np.sort(np.array([r[0] for r in rows.toLocalIterator()], np.int64))


def classes(docs: DataFrame, edits: int = EDITS, every: int = EDIT_EVERY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines read (a row per document), links ``(a, b)`` between near lines' ids, components ``(id, id2, component)``."""
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "bucket long, id long"
    probes = named.mapInArrow(_probes(edits, every), schema)
    shared = cut(probes.groupBy("bucket").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x < y").select("bucket"))
    buckets = _sorted_longs(shared, SENT_KEYS)
    probes = named.mapInArrow(_probes(edits, every, buckets), schema)
    members = cut((probes if buckets is not None else probes.join(shared, "bucket")).distinct(), shared)
    ids = cut(members.select("id").distinct())
    wanted = _sorted_longs(ids, SENT_KEYS)
    read = cut(named.mapInArrow(_read(wanted, every), READ_SCHEMA))
    texts = read.select(F.explode("texts").alias("t")).select("t.*")
    texts = texts if wanted is not None else texts.join(ids, "id", "left_semi")
    texts = cut(texts.groupBy("id").agg(F.min_by(F.struct("id2", "line", "profile"), "id2").alias("t")).select("id", "t.*"), ids)

    @F.pandas_udf(T.BooleanType())
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within(x, y, min(edits, min(len(x), len(y)) // every)) for x, y in zip(a, b, strict=True)], dtype=bool)

    small = (texts.agg(F.sum(F.octet_length("line") + 64)).first()[0] or 0) <= linkage.BROADCAST_BYTES

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = linkage.sides(texts, "line", small)
        return pairs.join(a, "a").join(b, "b").where(near("of_a", "of_b")).select("a", "b")

    def compatible(a: Column, b: Column) -> Column:
        off = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda t, x: t + x)
        return off <= 2 * edits  # an edit changes at most two counts by one

    links, found = linkage.link(members, verify, lambda ids: texts.join(ids, "id", "left_semi").select("id", "profile"), compatible)
    found = cut(found.join(texts.select("id", "id2"), "id").select("id", "id2", "component"), texts)
    return read, links, found


def repeats(docs: DataFrame, edits: int = EDITS, every: int = EDIT_EVERY) -> tuple[DataFrame, DataFrame]:
    """``doc_id, line_no, class_id, first_doc, first_line`` of each line that an earlier line of its class precedes; lines read."""
    read, links, found = classes(docs, edits, every)
    drop(links)
    read = cut(read.drop("texts"), read)
    rows = read.select("doc_id", F.explode(F.arrays_zip("number", "id", "id2")).alias("l")).select("doc_id", F.col("l.number").alias("line_no"), "l.id", "l.id2")
    equal = rows.groupBy("id", "id2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"))
    equal = equal.join(found, ["id", "id2"], "left").where("n > 1 or component is not null").select("id", "id2", F.coalesce("component", "id").alias("class_id"), F.col("component").isNotNull().alias("linked"), "first")
    equal = cut(equal, found)
    heads = equal.where("linked").groupBy("class_id").agg(F.min("first").alias("head"))
    heads = cut(equal.join(heads.withColumn("linked", F.lit(True)), ["class_id", "linked"], "left").select("id", "id2", "class_id", F.coalesce("head", "first").alias("head")), equal)
    out = rows.join(heads, ["id", "id2"]).where("struct(doc_id, line_no) <> head")
    return out.select("doc_id", "line_no", "class_id", F.col("head.doc_id").alias("first_doc"), F.col("head.line_no").alias("first_line")), read


def _split(text: Column) -> Column:
    return F.split(text.cast("string"), "\n", -1)


def _removed(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("_removed")).withColumnRenamed("doc_id", "_removed_id")


def line_report(docs: DataFrame, **options: int) -> DataFrame:
    """Per row ``doc_id, n_lines, n_removed, removed_lines``; the last lists line numbers from 0, comma-joined."""
    found, read = repeats(docs, **options)
    own = read.select("doc_id", F.size("id").cast("long").alias("n_lines"))
    own = own.union(docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.size(F.filter(_split(F.coalesce("text", F.lit(""))), lambda x: F.rlike(x, F.lit(WORD)))).cast("long")))
    out = own.join(_removed(found), F.col("doc_id") == F.col("_removed_id"), "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("_removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("_removed", ","), F.lit("")).alias("removed_lines"))


def without_repeats(docs: DataFrame, **options: int) -> DataFrame:
    """The documents without repeated lines, columns as given (``n_chars`` follows the text).

    Documents of which only blank lines would be left are dropped.
    """
    removed = _removed(repeats(docs, **options)[0]).withColumnsRenamed({"_removed_id": "doc_id", "_removed": "removed"})
    out = packed(docs, F.col("text").cast("string").alias("text")).join(removed, "doc_id", "left")
    split = _split(F.col("text"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("removed")), lambda i: F.get(split, i))
    out = out.withColumn("text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    out = out.where(F.col("removed").isNull() | F.rlike("text", F.lit(WORD)))
    fresh = {"text": F.col("text"), "n_chars": F.when(F.col("removed").isNull(), F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(None)).otherwise(F.char_length("text").cast("long"))}
    return out.select(*[(fresh.get(c, F.col("row")[c])).alias(c) for c in docs.columns])
