"""Shared input helpers: tables, Arrow text buffers and byte-bounded chunks."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised pass works on; bounds a worker's memory.
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Shuffle files of a step go when its execution ends, instead of when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _checkpoint_folder(spark: SparkSession) -> None:
    """The cluster names the folder in ``spark.checkpoint.dir``; a local session without one gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="umbra-")
    context.setCheckpointDir(folder)


def cut(df: DataFrame, *superseded: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the checkpoint folder and go on from there.

    The shuffle files of the step are dropped at its end.  ``superseded``: earlier cuts
    that nothing reads from here on; their files are deleted.
    """
    spark = df.sparkSession
    _checkpoint_folder(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        out = df.select("*").checkpoint(eager=True)  # a plan of its own, so that the setting holds for it
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    drop(*superseded)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of cuts that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if path.isDefined():
            at = context._jvm.org.apache.hadoop.fs.Path(path.get())
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """The rows as one column ``row``, with ``doc_id`` as a long and more columns beside it; no name of the table can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *more)


def unpacked(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.select("row.*", *more)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values and the offset of each (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, count=column.offset + n + 1)[column.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _return_memory() -> None:
    """Give free memory back: a worker stays alive, idle, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of text; a longer single text is its own slice."""
    try:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
            at = 0
            while at < n:
                end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
                end = min(max(end, at + 1), n)
                yield batch.slice(at, end - at)
                at = end
    finally:
        _return_memory()
