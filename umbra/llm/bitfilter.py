"""A two-hash Bloom filter of fixed size, built by an aggregation and sent to the workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.wordhash import U, mix

#: 2**26 bits are 8 MB, whatever goes in; with more keys the filter lets more through and the joins behind it do the work.
FILTER_BITS = 26


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = h.astype(U)
    return (h >> U(64 - FILTER_BITS)).astype(np.int64), (mix(h) >> U(64 - FILTER_BITS)).astype(np.int64)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bit = np.unique(np.concatenate(_bits(batch.column("key").to_numpy(zero_copy_only=False).view(U))))
        yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array(np.left_shift(U(1), (bit & 63).astype(U)).view(np.int64))], names=["word", "bit"])


def collected(keys: DataFrame) -> np.ndarray:
    """The filter of a table's one long column; at most 2**20 rows of 64 bits come to the driver."""
    out = np.zeros(1 << (FILTER_BITS - 6), U)
    words = keys.toDF("key").mapInArrow(_words, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    for row in words.toLocalIterator():
        out[row["word"]] = U(row["bits"] & 0xFFFFFFFFFFFFFFFF)
    return out


def held(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Positions of the hashes that the filter lets through."""
    first = (hashes >> U(64 - FILTER_BITS)).astype(np.int64)
    hit = np.flatnonzero((words[first >> 6] >> (first & 63).astype(U)) & U(1))
    second = _bits(hashes[hit])[1]
    return hit[(words[second >> 6] >> (second & 63).astype(U)) & U(1) > 0]
