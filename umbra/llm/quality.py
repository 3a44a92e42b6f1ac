"""Quality rules with cross-document line frequency.

Base rules work on one text.  The method then hashes normalised lines (A-Z
lower-cased, digits alike, white space collapsed), counts the distinct documents of a
host (``source``) that hold each line, takes lines above the limit out, and rejects
documents that keep too small a part of their words.

A line is above the limit in a host if more than ``max(MIN_DOCS, MAX_SHARE * the
host's distinct documents)`` of the host's distinct documents (by doc_id) hold it.  The
holder with the least doc_id keeps the line, so the original of a widely copied text is
not emptied; of a group of copies larger than the limit the others are depleted.

Defined results: a null or blank text has no words and fails the base rules; a null
source is a host of its own; rows without doc_id count as one document; rows that agree
in doc_id, source and text share a verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.textio import chunks, cut, packed, utf8
from umbra.llm.wordhash import SPACE, U, byte_table, gram_starts, grams, mix, powers, stream, word_hashes

MIN_WORDS = 50
MIN_DOCS = 20
MAX_SHARE = 0.05
MIN_LEFT = 0.3
#: Lines above the limit that are broadcast, and bytes of verdicts; beyond, both go by shuffle joins.
BROADCAST_LINES = 100_000
BROADCAST_BYTES = 8 << 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LINE = stream(17, 256) | U(1)
_LINE[10] = 0
_NORMAL = byte_table(lower=True, digits=False)
_Q = U(0x9FB21C651E98DF25)
_Q_INV = U(pow(int(_Q), -1, 1 << 64))
_P = U(0xD6E8FEB86659FD93)
_P_INV = U(pow(int(_P), -1, 1 << 64))
SCHEMA = "doc_id long, source string, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line:long,words:int,no:int>>"


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(keys: np.ndarray) -> np.ndarray:
    """True where the key occurs at least twice."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(keys), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.empty(len(keys), bool)
    out[order] = twice
    return out


def _later(keys: np.ndarray) -> np.ndarray:
    """True where the key has occurred before."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = ordered[1:] == ordered[:-1]
    return out


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        data, offsets = utf8(batch.column("text"))
        n = batch.num_rows
        words, ranges, starts = word_hashes(data, offsets)
        plain, _, _ = word_hashes(data, offsets, tab=_NORMAL)
        solid = ~SPACE[data]
        word_chars = _per_text(solid & ((data & 0xC0) != 0x80), offsets)
        symbols = _per_text(_SYMBOL[data], offsets)
        text_of_word = np.repeat(np.arange(n), np.diff(ranges))
        with np.errstate(over="ignore"):
            three = grams(words, 3)
            fits = gram_starts(ranges, 3)
            at = np.flatnonzero(fits)
            twice = np.zeros(len(words) + 3, bool)
            twice[at] = _repeats(three[at] + mix(text_of_word[at].astype(U)))
            covered = twice[: len(words)].copy()
            covered[1:] |= twice[: len(words)][:-1]
            covered[2:] |= twice[: len(words)][:-2]
            repeat_words = _per_text(covered, ranges)
            # lines: from each text's start and from after each \n inside it
            after = np.flatnonzero(data == 10) + 1
            heads = np.union1d(offsets[:-1][offsets[:-1] < offsets[1:]], after[~np.isin(after, offsets)])
            line_text = np.searchsorted(offsets, heads, side="right") - 1
            number = np.arange(len(heads)) - np.searchsorted(heads, offsets[:-1])[line_text]
            bounds = np.append(heads, len(data))
            first_word = np.searchsorted(starts, bounds)
            n_line = np.diff(first_word)
            raw = np.zeros(0, U)
            if len(heads):
                raw = _line_hashes(data, heads)
            sums = np.zeros(len(plain) + 1, U)
            np.cumsum(plain * powers(_Q, len(plain)), out=sums[1:])
            normal = mix((sums[first_word[1:]] - sums[first_word[:-1]]) * powers(_Q_INV, len(plain) + 1)[first_word[:-1]])
            has = n_line > 0
            raw, normal, n_line, line_text, number = raw[has], normal[has], n_line[has], line_text[has], number[has]
            dup = _later(raw + mix(line_text.astype(U)))
        counts = np.bincount(line_text, minlength=n)
        dups = np.bincount(line_text, weights=dup, minlength=n).astype(np.int64)
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)),
            pa.StructArray.from_arrays([pa.array(normal.view(np.int64)), pa.array(n_line.astype(np.int32)), pa.array(number.astype(np.int32))], names=["line", "words", "no"]),
        )
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "source", "text_key")), *(pa.array(x.astype(np.int64)) for x in (np.diff(ranges), word_chars, symbols, dups, repeat_words)), lists],
            names=["doc_id", "source", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
        )


def _line_hashes(data: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Hash of each line's bytes, \\n left out."""
    if len(data) <= 1 << 21:
        return mix(np.add.reduceat(_LINE[data] * powers(_P, len(data)), heads) * powers(_P_INV, len(data))[heads])
    ends = np.append(heads[1:], len(data))
    out = np.empty(len(heads), U)
    for i, (a, b) in enumerate(zip(heads.tolist(), ends.tolist(), strict=True)):
        total, at = U(0), a
        while at < b:  # a long line goes in pieces
            step = min(1 << 20, b - at)
            part = (_LINE[data[at : at + step]] * powers(_P, step)).sum(dtype=U)
            shift = U(pow(int(_P), at - a, 1 << 64))
            total += part * shift
            at += step
        out[i] = total
    return mix(out)


def judged(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_boilerplate_words, source, text_key, above``.

    ``above``: numbers of the lines above the limit, from 0; null if there are none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    stats = cut(rows.mapInArrow(_stats, SCHEMA))
    host = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("host")
    hosts = stats.select(host, "doc_id").distinct().groupBy("host").agg(F.greatest(F.lit(float(min_docs)), max_share * F.count("*")).alias("limit"))
    lines = stats.select(host, "doc_id", "text_key", F.explode("lines").alias("l")).select("host", "doc_id", "text_key", "l.line", "l.words", "l.no")
    held = lines.select("host", "line", "doc_id").distinct()
    counts = held.groupBy("host", "line").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first")).where(f"docs > {min_docs}")
    above = cut(counts.join(hosts, "host").where("docs > limit").select("host", "line", "first"))
    if above.count() <= BROADCAST_LINES:
        above = F.broadcast(above)
    gone = lines.join(above, ["host", "line"]).where("not (doc_id <=> first)").dropDuplicates(["host", "doc_id", "text_key", "no"])
    gone = gone.groupBy("host", "doc_id", "text_key").agg(F.sum("words").alias("gone"), F.collect_list("no").alias("above"))
    gone = gone.select(F.col("host").alias("h"), F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "gone", "above")
    out = stats.drop("lines").withColumn("host", host)
    out = out.join(gone, out["host"].eqNullSafe(gone["h"]) & out["doc_id"].eqNullSafe(gone["d"]) & (out["text_key"] == gone["k"]), "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (left >= min_left * F.col("n_words"))).alias("kept"),
        F.coalesce("gone", F.lit(0)).cast("long").alias("n_boilerplate_words"), "source", "text_key", "above",
    )


def verdicts(docs: DataFrame, **limits: float) -> DataFrame:
    """``judged`` without the line numbers."""
    return judged(docs, **limits).drop("above")


def keep_good(docs: DataFrame, **limits: float) -> DataFrame:
    """The documents that pass, without their lines above the limits, columns as given (``n_chars`` follows the text)."""
    odd = judged(docs, **limits).where("not kept or above is not null").select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.col("source").alias("s"), "kept", "above")
    odd = cut(odd.dropDuplicates(["d", "k", "s"]))
    size = odd.agg(F.sum(64 + F.coalesce(F.octet_length("s"), F.lit(0)) + 4 * F.greatest(F.size("above"), F.lit(0)))).first()[0] or 0
    odd = F.broadcast(odd) if size <= BROADCAST_BYTES else odd
    text = F.col("text").cast("string")
    rows = packed(docs, text.alias("text"), F.xxhash64(text).alias("text_key"), F.col("source").cast("string").alias("source"))
    out = rows.join(odd, rows["doc_id"].eqNullSafe(odd["d"]) & (rows["text_key"] == odd["k"]) & rows["source"].eqNullSafe(odd["s"]), "left").where("kept is null or kept")
    split = F.split("text", "\n", -1)
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("above")), lambda i: F.get(split, i))
    fresh = {"text": F.when(F.col("above").isNull(), F.col("row")["text"]).otherwise(F.array_join(left, "\n"))}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(F.col("above").isNull(), F.col("row")["n_chars"]).otherwise(F.char_length(fresh["text"]).cast("long"))
    return out.select(*[fresh.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
