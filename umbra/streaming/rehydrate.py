"""Restoring placeholders in streams whose chunks may cut them anywhere."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LONGEST = 72
PLACEHOLDER = re.compile(r"\[[A-Z][A-Z0-9_]{0,60}_[0-9]{1,9}\]")
_PREFIX = re.compile(r"\[(?:[A-Z][A-Z0-9_]*)?\Z")


def hold_from(text: str) -> int:
    """Where the tail begins that may still become a placeholder; the length if there is none."""
    at = text.rfind("[")
    return at if at >= 0 and len(text) - at < LONGEST and _PREFIX.match(text, at) else len(text)


def substitute(text: str, tokens: dict[str, str]) -> str:
    return PLACEHOLDER.sub(lambda m: tokens.get(m[0], m[0]), text)


class Rehydrator:
    """Push chunks, get restored text; what may be the start of a placeholder is held back."""

    def __init__(self, tokens: dict[str, str], held: str = ""):
        self.tokens, self.held = tokens, held

    def push(self, chunk: str) -> str:
        text = self.held + chunk
        at = hold_from(text)
        self.held = text[at:]
        return substitute(text[:at], self.tokens)

    def flush(self) -> str:
        text, self.held = self.held, ""
        return substitute(text, self.tokens)


def restored_chunks(df: DataFrame, key: str, order: list[str], chunk: str, tokens: dict[str, str]) -> DataFrame:
    """Batch form: each stream's chunks in order, with ``out``, the text that leaves at that chunk (the last flushes)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        stream = Rehydrator(tokens)
        out = [stream.push(c or "") for c in rows[chunk]]
        if out:
            out[-1] += stream.flush()
        return rows.assign(out=out)

    return df.groupBy(key).applyInPandas(fold, f"{fields}, out string")


def restored_stream(df: DataFrame, key: str, order: str, chunk: str, done: str, tokens: dict[str, str], idle: str | None = None) -> DataFrame:
    """Streaming form: rows ``key, out`` per micro-batch; the held tail is keyed state, flushed by a ``done`` row or, if given, after ``idle`` without chunks (for triggers that keep running)."""
    kind = df.schema[key].dataType.simpleString()
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stream = Rehydrator(tokens, state.get[0] if state.exists else "")
        if state.hasTimedOut:
            text = stream.flush()
        else:
            rows = pd.concat(list(batches)).sort_values(order)
            text = "".join(stream.push(c or "") + (stream.flush() if end else "") for c, end in zip(rows[chunk], rows[done]))
        if stream.held:
            state.update((stream.held,))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()
        if text:
            yield pd.DataFrame({key: [group[0]], "out": [text]})

    return df.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, out string", "held string", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)
