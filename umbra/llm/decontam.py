"""Benchmark decontamination by spaced seeds, verified on the tokens.

Tokens are runs of ASCII letters and digits and of non-ASCII characters, A-Z
lower-cased.  A seed is a window of ``SPAN`` tokens of which a fixed mask ignores some
positions.  Three masks ignore a third each (every third position), six ignore a half
each (two of every four), so a window with any two substituted tokens, or with several
in one third, still gives an equal hash.  Hashes of benchmark items and documents are
joined; equal ones propose a diagonal (document, item, shift).  On it the tokens of
both are compared one by one: a document is contaminated by an item if the diagonal has
a stretch in which at least ``min(SPAN, 80 % of the item)`` tokens (of items under ``EXACT``
tokens all) are equal and make up
80 % of it, whatever lies before and behind it.

Items of 8 to 12 tokens have masked windows of their own length; these let pass as many
substituted tokens as 80 % allows.  Shorter items count where a document holds all their
tokens in a row.  Documents are padded by ``PAD`` tokens, so items cut short at their ends are seen.
An overlap is missed if every window in it has three or more substitutions that no mask
covers.

Scale: a document's seeds leave the scan only if a two-hash Bloom filter of the
benchmark's seeds lets them pass.  The filter has a fixed size (8 MB) whatever the
benchmark's; with a huge benchmark it lets more through and the join,
an ordinary equi-join, does the work.

Defined results: null texts have no tokens; items with the same text are all reported;
rows without doc_id are not reported by contaminated() and are kept by keep_clean().
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm import bitfilter
from umbra.llm.textio import chunks, cut, packed, unpacked, utf8
from umbra.llm.wordhash import U, byte_table, gram_starts, grams, word_hashes

SPAN = 13
#: Items under so many tokens must stand in a document token for token.
EXACT = 8
PAD = 2


def _masks(n: int) -> list[list[int]]:
    """Kept positions of each mask of a window of n tokens."""
    if n < EXACT:
        return [list(range(n))]
    thirds = [[i for i in range(n) if i % 3 != j] for j in range(3)]
    halves = [[i for i in range(n) if i % 4 in kept] for kept in combinations(range(4), 2)]
    return thirds if n < 10 else halves if n < SPAN else thirds + halves


MASKS = {n: _masks(n) for n in range(1, SPAN + 1)}
#: 80 % as a fraction.
PROVEN = (4, 5)
#: Up to so many seeds are broadcast; a larger benchmark goes by shuffle joins.
BROADCAST_SEEDS = 200_000

_GAP = np.zeros(256, bool)
_GAP[:128] = True
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = False
_TAB = byte_table(lower=True, space=_GAP)


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    words, ranges, _ = word_hashes(*utf8(batch.column("text")), tab=_TAB, space=_GAP)
    return words, ranges


def _seeds(words: np.ndarray, ranges: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length of the window, positions, hashes)."""
    for n in lengths:
        at = np.flatnonzero(gram_starts(ranges, n))
        for j, mask in enumerate(MASKS[n]):
            yield n, at, grams(words, n, seed=100 * n + j, keep=mask)[at]


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        ids = batch.column("item_id").cast(pa.int64())
        words, ranges = _tokens(batch)
        sizes = np.diff(ranges)
        for n, at, hashes in _seeds(words, ranges, list(MASKS)):
            item = np.searchsorted(ranges, at, side="right") - 1
            fits = np.minimum(sizes[item], SPAN) == n
            item, at, hashes = item[fits], at[fits], hashes[fits]
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), ids.take(pa.array(item)), pa.array((at - ranges[item]).astype(np.int32)), pa.array(np.full(len(at), n, np.int32))],
                    names=["seed", "item_id", "item_at", "span"],
                )


def _item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        words, ranges = _tokens(batch)
        tokens = [words[lo:hi].tobytes() for lo, hi in zip(ranges[:-1], ranges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("item_id").cast(pa.int64()), pa.array(tokens, pa.binary())], names=["item_id", "item"])


def _document_seeds(words_set: np.ndarray, lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            ids = batch.column("doc_id").cast(pa.int64())
            words, ranges = _tokens(batch)
            text = np.repeat(np.arange(batch.num_rows), np.diff(ranges))
            wide = ranges + 2 * PAD * np.arange(len(ranges))
            padded = np.zeros(int(wide[-1]), U)
            padded[np.arange(len(words)) + PAD * (2 * text + 1)] = words
            seeds, places = [np.zeros(0, U)], [np.zeros(0, np.int64)]
            for _, at, hashes in _seeds(padded, wide, lengths):
                hit = bitfilter.held(words_set, hashes)
                seeds.append(hashes[hit])
                places.append(at[hit])
            seed, at = np.concatenate(seeds), np.concatenate(places)
            if len(at):
                doc = np.searchsorted(wide, at, side="right") - 1
                order = np.argsort(doc, kind="stable")
                seed, at, doc = seed[order], at[order], doc[order]
                docs, first = np.unique(doc, return_index=True)
                offsets = pa.array(np.append(first, len(doc)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(docs)),
                        pa.array([words[ranges[d] : ranges[d + 1]].tobytes() for d in docs], pa.binary()),
                        pa.ListArray.from_arrays(offsets, pa.array(seed.view(np.int64))),
                        pa.ListArray.from_arrays(offsets, pa.array((at - wide[doc] - PAD).astype(np.int32))),
                    ],
                    names=["doc_id", "doc", "seeds", "ats"],
                )

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The longest stretch of each diagonal, where it is long enough."""
    up, down = PROVEN
    for batch in batches:
        keep, out = [], []
        columns = (batch.column(c).to_pylist() for c in ("doc", "item", "doc_from", "item_tokens"))
        for i, (doc, item, doc_from, tokens) in enumerate(zip(*columns, strict=True)):
            at = np.flatnonzero(np.frombuffer(doc, U) == np.frombuffer(item, U))
            least = tokens if tokens < EXACT else min(SPAN, -(-up * tokens // down))
            if len(at) < least:
                continue
            first, last = _stretch(at)
            if last - first + 1 >= least:
                keep.append(i)
                out.append((doc_from + at[first], at[last] - at[first] + 1, last - first + 1))
        start, n_tokens, n_proven = np.array(out, np.int64).reshape(-1, 3).T
        ids = [batch.column(c).take(pa.array(keep, pa.int64())) for c in ("doc_id", "item_id")]
        yield pa.RecordBatch.from_arrays([*ids, pa.array(start.astype(np.int32)), pa.array(n_tokens), pa.array(n_proven)], names=["doc_id", "item_id", "start", "n_tokens", "n_proven"])


def _stretch(at: np.ndarray) -> tuple[int, int]:
    """First and last index of the longest stretch of sorted positions that fill 80 % of it; of several the longest in tokens, then the first."""
    up, down = PROVEN
    # positions a to b fill enough if down * (b - a + 1) >= up * (at[b] - at[a] + 1)
    level = down * np.arange(len(at)) - up * at.astype(np.int64)
    first = np.searchsorted(-np.minimum.accumulate(level), -(level + down - up))
    last = np.arange(len(at))
    best = np.lexsort((first, at[first] - at[last], first - last))[0]
    return int(first[best]), int(best)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, start, n_tokens, n_proven``: a row for each document and item, with its longest overlap (in tokens of the document); n_proven of its tokens are equal."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null").dropDuplicates()
    seeds = cut(items.mapInArrow(_item_seeds, "seed long, item_id long, item_at int, span int"))
    words_set = bitfilter.collected(seeds.select("seed"))
    lengths = sorted(r["span"] for r in seeds.select("span").distinct().collect())
    small = F.broadcast if seeds.count() <= BROADCAST_SEEDS else lambda df: df
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    # documents with a hit, with their tokens; rows of one doc_id can meet each other's diagonals, which are verified like any
    found = cut(rows.mapInArrow(_document_seeds(words_set, lengths), "doc_id long, doc binary, seeds array<long>, ats array<int>"))
    hits = found.select("doc_id", F.explode(F.arrays_zip("seeds", "ats")).alias("h")).select("doc_id", F.col("h.seeds").alias("seed"), F.col("h.ats").alias("at"))
    diagonals = hits.join(small(seeds), "seed").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    pairs = diagonals.join(small(items.mapInArrow(_item_tokens, "item_id long, item binary")), "item_id").join(found.select("doc_id", "doc"), "doc_id")
    doc_from, item_from = F.greatest("shift", F.lit(0)), F.greatest(-F.col("shift"), F.lit(0))
    both = F.least(F.octet_length("doc") - 8 * doc_from, F.octet_length("item") - 8 * item_from)
    overlaps = pairs.select(
        "doc_id", "item_id", doc_from.alias("doc_from"), (F.octet_length("item") / 8).cast("int").alias("item_tokens"),
        F.substring("doc", 8 * doc_from + 1, both).alias("doc"), F.substring("item", 8 * item_from + 1, both).alias("item"),
    )
    runs = overlaps.mapInArrow(_verified, "doc_id long, item_id long, start int, n_tokens long, n_proven long")
    best = runs.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_proven", "n_tokens", (-F.col("start")).alias("before"))).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.before")).alias("start"), "b.n_tokens", "b.n_proven")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item contaminates, columns as given."""
    bad = contaminated(docs, benchmark).select("doc_id").distinct()
    return unpacked(packed(docs).join(bad, "doc_id", "left_anti"))
