"""Substring dedup by relative Lempel-Ziv factors.

A document is factored against the documents of smaller doc_id.  The reference is
indexed by blocks with content-defined borders: every window of ``WINDOW``
consecutive words picks the word run of length ``ANCHOR`` with the least hash as its
anchor, and the consecutive windows that pick the same anchor position form a block
(12 words and one per window, 21 words at most).  Equal windows pick equal anchors, so
every repeat of ``WINDOW`` words lies within blocks of one anchor.

1. Anchors that several documents hold are found, with whether their blocks differ.
2. Blocks of anchors with different blocks form the reference: each different block is
   stored once, with its words and the least doc_id that holds it.  Where an anchor has
   one block only, every later holder copies it whole.
3. Every stored block is factored: a match is grown from the anchor to both sides, word
   by word, against the anchor's leading block (that of the least document).  A factor of
   ``WINDOW`` words or more is a duplicate span.
4. At factor boundaries, that is in what a factor leaves of a block, the remaining
   windows are looked up among those that the factors of all other reference blocks of
   the anchor left, so no block is compared with all others of a hot anchor.
5. A document's copied blocks and windows are put together by the greedy parse: from the
   left, the factor that reaches furthest.

Lookups are by 128 hashed bits (anchor and content).  The result equals the removal of
every word under a ``WINDOW``-word window that starts in a smaller document too.

Scale: anchors aggregate with map-side combine (first in the workers, then as a partial
aggregation); only blocks that pass a Bloom filter of fixed size (of the shared anchors,
of those with different blocks) leave the workers after that.  Lookups are equi-joins
with one row a key on one side, which adaptive execution can split, and lists are per
document.  The text is shuffled once, by doc_id, for the removal.  Lineage is cut between
the steps, and files that nothing reads any more are deleted.

Defined results: a null or blank text has no words; texts under ``WINDOW`` words keep
all; rows without doc_id are neither removed from nor a source; rows that share a
doc_id are one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm import bitfilter
from umbra.llm.textio import chunks, cut, drop, utf8
from umbra.llm.wordhash import U, grams, mix, powers, stream, word_hashes

WINDOW = 13
ANCHOR = 5
#: Bytes of text whose index rows are combined in a worker before they leave it.
COMBINE_BYTES = 1 << 25
_Q = U(0xA0761D6478BD642F)
_Q_INV = U(pow(int(_Q), -1, 1 << 64))


class Blocks:
    """Blocks of a chunk of texts: word ranges, anchors, content hashes."""

    def __init__(self, batch: pa.RecordBatch, window: int, anchor: int):
        self.words, self.ranges, _ = word_hashes(*utf8(batch.column("text")))
        n = len(self.words)
        lo, hi = self.ranges[:-1], self.ranges[1:]
        counts = np.maximum(hi - lo - window + 1, 0)
        total = int(counts.sum())
        rows = np.repeat(np.arange(len(lo)), counts)
        starts = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo, counts)
        self.window, self.starts = window, starts
        if not total:
            self.first = self.last = self.doc = self.at = np.zeros(0, np.int64)
            self.anchor = self.content = np.zeros(0, U)
            return
        g = grams(self.words, anchor)
        width = window - anchor + 1
        least, at = g.copy(), np.arange(len(g))
        step = 1
        spans = [1]
        while step * 2 <= width:  # least of each 2**i neighbours, the leftmost of equals
            least, at = self._pair(least, at, step)
            step *= 2
            spans.append(step)
        if step < width:
            least, at = self._pair(least, at, width - step)
        chosen = at[starts]
        new = np.ones(total, bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (rows[1:] != rows[:-1])
        self.heads = np.flatnonzero(new)
        tails = np.append(self.heads[1:], total) - 1
        self.first, self.last = starts[self.heads], starts[tails] + window  # words [first, last)
        self.doc = rows[self.heads]
        self.at = chosen[self.heads]
        self.anchor = g[self.at]
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, U)
            np.cumsum(self.words * powers(_Q, n), out=self.sums[1:])
        self.content = self.hashed(self.first, self.last)

    @staticmethod
    def _pair(least: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = least[: len(least) - step], least[step:]
        right = b < a
        return np.where(right, b, a), np.where(right, at[step:], at[: len(at) - step])

    def texts(self, which: np.ndarray, width: int, anchor: int) -> np.ndarray:
        """Word hashes of blocks, a row each, aligned at the anchor; 0 where the block has no word."""
        at = self.at[which, None] + np.arange(-width, anchor + width)
        inside = (at >= self.first[which, None]) & (at < self.last[which, None])
        return np.where(inside, self.words[np.where(inside, at, 0)], U(0))

    def hashed(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[last] - self.sums[first]) * powers(_Q_INV, len(self.words) + 1)[first] + (last - first).astype(U) * U(0x9E3779B97F4A7C15))


def _anchor_rows(window: int, anchor: int):
    """Rows (anchor, block, lo, hi): least and greatest doc_id of each block in a stretch of input."""

    def combined(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        a, c, d = (np.concatenate([h[i] for h in held]) for i in range(3))
        order = np.lexsort((d, c, a))
        a, c, d = a[order], c[order], d[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        at = np.flatnonzero(new)
        out = [a[at].view(np.int64), c[at].view(np.int64), d[at], d[np.append(at[1:], len(d)) - 1] if len(d) else d]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["anchor", "block", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chunks(batches):
            ids = _ids(batch)
            blocks = Blocks(batch, window, anchor)
            held.append([blocks.anchor, blocks.content, ids[blocks.doc]])
            size += batch.nbytes
            if size >= COMBINE_BYTES:
                yield combined(held)
                held, size = [], 0
        if held:
            yield combined(held)

    return run


def _document_rows(window: int, anchor: int, wanted: np.ndarray):
    """Rows (anchor, block, doc_id) of the blocks whose anchor passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            blocks = Blocks(batch, window, anchor)
            at = bitfilter.held(wanted, blocks.anchor)
            rows = np.unique(np.stack([blocks.anchor[at].view(np.int64), blocks.content[at].view(np.int64), _ids(batch)[blocks.doc[at]]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=["anchor", "block", "doc_id"])

    return run


def _reference_rows(window: int, anchor: int, wanted: np.ndarray):
    """Rows (anchor, block, doc_id, words) of the different blocks of a stretch of input whose anchor passes the filter."""
    width = window - anchor

    def combined(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        a, c, d, w = (np.concatenate([h[i] for h in held]) for i in range(4))
        order = np.lexsort((d, c, a))
        new = np.ones(len(a), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (c[order][1:] != c[order][:-1])
        at = order[new]
        words = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * (anchor + 2 * width)), len(at), [None, pa.py_buffer(np.ascontiguousarray(w[at]).tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(a[at].view(np.int64)), pa.array(c[at].view(np.int64)), pa.array(d[at]), words.cast(pa.binary())], names=["anchor", "block", "doc_id", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chunks(batches):
            blocks = Blocks(batch, window, anchor)
            at = bitfilter.held(wanted, blocks.anchor)
            held.append([blocks.anchor[at], blocks.content[at], _ids(batch)[blocks.doc[at]], blocks.texts(at, width, anchor)])
            size += batch.nbytes
            if size >= COMBINE_BYTES:
                yield combined(held)
                held, size = [], 0
        if held:
            yield combined(held)

    return run


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)


def _grown(window: int, anchor: int):
    """Of each reference block the windows (from, to) that the factor against its leader covers, and the hashes of the others."""
    width = window - anchor
    coefficients = stream(77, window) | U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            own, lead = (np.frombuffer(b"".join(batch.column(c).to_pylist()), U).reshape(n, anchor + 2 * width) for c in ("words", "lead_words"))
            there = own != 0
            same = there & (own == lead)
            # from the anchor to both sides, as far as the words agree
            left = np.cumprod(same[:, :width][:, ::-1], axis=1).sum(axis=1)
            right = np.cumprod(same[:, width + anchor :], axis=1).sum(axis=1)
            first = there.argmax(axis=1)  # windows start here and up to ``count`` further on
            count = there.sum(axis=1) - window + 1
            start, stop = np.maximum(width - left - first, 0), right - first + 1
            long = left + right + anchor >= window
            start, stop = np.where(long, start, 0), np.where(long, np.minimum(stop, count), 0)
            index = np.arange(width + 1)
            rest = (index < count[:, None]) & ~((index >= start[:, None]) & (index < stop[:, None]))
            rest &= (batch.column("is_lead").to_numpy(zero_copy_only=False) == 0)[:, None]
            row, nth = np.nonzero(rest)
            hashes = np.zeros(len(row), U)
            with np.errstate(over="ignore"):
                for j in range(window):
                    hashes += own[row, first[row] + nth + j] * coefficients[j]
            edges = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("anchor", "block", "doc_id", "lead_doc")), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)),
                 pa.ListArray.from_arrays(edges, pa.array(nth.astype(np.int32))), pa.ListArray.from_arrays(edges, pa.array(mix(hashes).view(np.int64)))],
                names=["anchor", "block", "doc_id", "lead_doc", "from", "to", "nth", "win"],
            )

    return run


GROWN = "anchor long, block long, doc_id long, lead_doc long, `from` int, `to` int, nth array<int>, win array<long>"


def _lists(column: pa.Array) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return [v.values.to_numpy(zero_copy_only=False) if v.is_valid else np.zeros(0, np.int64) for v in column]


def _parsed(first: np.ndarray, last: np.ndarray, source: np.ndarray, window: int) -> list[dict[str, int]]:
    """The greedy parse of copied windows [first, last) with their sources: from the left, the factor that reaches furthest.

    Neighbouring stretches with one source grow together first.
    """
    grown: list[list[int]] = []
    order = np.lexsort((first, source))
    for s, a, b in zip(source[order].tolist(), first[order].tolist(), last[order].tolist(), strict=True):
        if grown and grown[-1][2] == s and a <= grown[-1][1]:
            grown[-1][1] = max(grown[-1][1], b)
        else:
            grown.append([a, b, s])
    grown.sort()
    out, at, i = [], -1, 0
    while i < len(grown):
        start = max(at, grown[i][0])
        best = grown[i]
        while i < len(grown) and grown[i][0] <= start:
            if grown[i][1] > best[1]:
                best = grown[i]
            i += 1
        if best[1] > start:
            out.append({"start": start, "words": best[1] + window - 1 - start, "source": best[2]})
            at = best[1]
    return out


def _removals(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            blocks = Blocks(batch, window, anchor)
            data, offsets = utf8(batch.column("text"))
            copied = [_lists(batch.column(c)) for c in ("block", "source", "from", "to")]
            bounds = np.searchsorted(blocks.doc, np.arange(batch.num_rows + 1))
            content = blocks.content.view(np.int64)
            n_words, n_removed, shas, kept_texts, factors = [], [], [], [], []
            raw = data.tobytes()
            for i in range(batch.num_rows):
                lo, hi = int(blocks.ranges[i]), int(blocks.ranges[i + 1])
                words = raw[offsets[i] : offsets[i + 1]].split()
                parsed, gone = [], np.zeros(hi - lo, bool)
                key, source, start, stop = (c[i] for c in copied)
                if len(key):
                    own = content[bounds[i] : bounds[i + 1]]
                    order = np.argsort(own, kind="stable")
                    a, b = (np.searchsorted(own[order], key, side=x) for x in ("left", "right"))
                    which = np.repeat(np.arange(len(key)), b - a)
                    block = order[np.arange(len(which)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)] + bounds[i]
                    first = blocks.first[block] - lo + start[which]
                    last = np.minimum(blocks.first[block] - lo + stop[which], blocks.last[block] - lo - window + 1)
                    parsed = _parsed(first, last, source[which], window)
                    for f in parsed:
                        gone[f["start"] : f["start"] + f["words"]] = True
                kept = b" ".join(compress(words, (~gone).tolist()) if parsed else words)
                n_words.append(hi - lo)
                n_removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode("utf-8", "replace"))
                factors.append(parsed)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas), pa.array(kept_texts), pa.array(factors, pa.list_(_FACTOR))],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "factors"],
            )

    return run


_FACTOR = pa.struct([("start", pa.int32()), ("words", pa.int32()), ("source", pa.int64())])


def factored(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per row ``doc_id, n_words, n_removed, kept_sha256, kept_text, factors``.

    ``factors``: the parse's copied stretches, ``(start, words, source)`` in words, each of
    ``window`` words or more; ``source``: a smaller doc_id that holds every window of it.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    copied = copied_blocks(docs.where("doc_id is not null"), window, anchor)
    item = F.struct("block", "source", "from", "to")
    lists = copied.groupBy("doc_id").agg(F.collect_list(item).alias("c"))
    joined = docs.join(lists, "doc_id", "left").select("doc_id", "text", *[F.col(f"c.{x}").alias(x) for x in ("block", "source", "from", "to")])
    return joined.mapInArrow(_removals(window, anchor), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, factors array<struct<start:int,words:int,source:long>>")


def copied_blocks(named: DataFrame, window: int, anchor: int) -> DataFrame:
    """``doc_id, block, source, from, to``: the windows [from, to) of a document's blocks that a smaller document, the source, has too."""
    whole = F.lit(window - anchor + 1)
    index = named.mapInArrow(_anchor_rows(window, anchor), "anchor long, block long, lo long, hi long")
    index = index.groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("block").alias("b0"), F.max("block").alias("b1"))
    shared = cut(index.where("lo < hi").select("anchor", "lo", (F.col("b0") < F.col("b1")).alias("varied")))
    wanted = bitfilter.collected(shared.select("anchor"))
    rows = named.mapInArrow(_document_rows(window, anchor, wanted), "anchor long, block long, doc_id long")
    hits = cut(rows.join(shared, "anchor").where("varied or doc_id > lo").select("doc_id", "anchor", "block", "lo", "varied"))

    # the reference: different blocks of anchors with several; others of the filter's have no smaller holder and do no harm
    varied = bitfilter.collected(shared.where("varied").select("anchor"))
    reference = named.mapInArrow(_reference_rows(window, anchor, varied), "anchor long, block long, doc_id long, words binary")
    reference = reference.join(shared.where("varied").select("anchor"), "anchor", "left_semi").groupBy("anchor", "block").agg(F.min(F.struct("doc_id", "words")).alias("r"))
    reference = cut(reference.select("anchor", "block", "r.doc_id", "r.words"), shared)
    lead = cut(reference.groupBy("anchor").agg(F.min(F.struct("doc_id", "block", "words")).alias("l")))
    pairs = reference.join(lead, "anchor").select("anchor", "block", "doc_id", "words", F.col("l.doc_id").alias("lead_doc"), F.col("l.words").alias("lead_words"), (F.col("l.block") == F.col("block")).cast("int").alias("is_lead"))
    grown = cut(pairs.mapInArrow(_grown(window, anchor), GROWN), reference, lead)

    # what the factors left: the least document of each window, of those left at the same anchor
    left = grown.select("anchor", "block", "doc_id", F.explode(F.arrays_zip("nth", "win")).alias("w")).select("anchor", "block", "doc_id", "w.nth", "w.win")
    source = cut(left.groupBy("anchor", "win").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").drop("last"))
    single = left.join(source, ["anchor", "win"]).where("source < doc_id").select("doc_id", "block", "source", F.col("nth").alias("from"), (F.col("nth") + 1).alias("to"))
    factor = grown.where("lead_doc < doc_id and `to` > `from`").select("doc_id", "block", F.col("lead_doc").alias("source"), "from", "to")
    later = hits.where("varied").join(grown.select("anchor", "block", F.col("doc_id").alias("source")), ["anchor", "block"]).where("source < doc_id")
    plain = hits.where("not varied").select("doc_id", "block", F.col("lo").alias("source"))
    out = plain.union(later.select("doc_id", "block", "source")).select("doc_id", "block", "source", F.lit(0).alias("from"), whole.alias("to"))
    out = cut(out.union(factor).union(single), hits, grown)
    drop(source)
    return out
