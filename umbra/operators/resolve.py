"""Overlap resolution of spans that are already a column."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from umbra.operators import engine
from umbra.operators.detect import SPAN


def _resolved(spans: pa.Array) -> pa.Array:
    out = []
    for row in spans:
        if not row.is_valid:
            out.append(None)
            continue
        by = {(s["start"], s["end"], s["kind"], s["detector"], s["priority"]): s for s in row.as_py()}
        out.append([by[s] for s in engine.resolve(by)])
    return pa.array(out, spans.type)


def resolved(spans: Column) -> Column:
    """Greedy choice: longest first, then priority, start, detector and kind; a suppressed span suppresses nothing.  In order of start."""
    return F.arrow_udf(_resolved, f"array<{SPAN}>")(spans)
