"""Server-sent events in text columns."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from umbra.operators.requests import dumped, mapped, selector
from umbra.streaming.rehydrate import Rehydrator, substitute

# fixed values: string fields of streamed replies that carry text
CHAT_DELTAS = ("choices.*.delta.content", "choices.*.delta.refusal", "choices.*.delta.tool_calls.*.function.arguments", "choices.*.text")
MESSAGE_DELTAS = ("delta.text", "delta.partial_json", "content_block.text")


def events(df: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """``keys, position, name, data, done`` of each event with data; lines end in CR, LF or both, blocks at a blank line."""
    text = F.regexp_replace(body, "\r\n|\r", "\n")
    blocks = df.select(*keys, F.posexplode(F.split(text, "\n\n+")).alias("position", "block"))
    lines = F.split("block", "\n")
    data = F.transform(F.filter(lines, lambda x: F.rlike(x, F.lit("^data:"))), lambda x: F.regexp_replace(x, "^data: ?", ""))
    name = F.regexp_replace(F.coalesce(F.get(F.filter(lines, lambda x: F.rlike(x, F.lit("^event:"))), 0), F.lit("")), "^event: ?", "")
    out = blocks.select(*keys, "position", name.alias("name"), data.alias("parts")).where(F.size("parts") > 0)
    return out.select(*keys, "position", "name", F.array_join("parts", "\n").alias("data")).withColumn("done", F.col("data") == "[DONE]")


_BLOCK_END = re.compile(r"(?:\r\n|\r(?!\n)|\n)(?:\r\n|\r(?!\Z)|\n)")


class SseRehydrator:
    """Restores placeholders in a stream of events whose text deltas may cut them anywhere.

    Each delta path, with the event's index, is a stream of its own; a stop event, the end
    mark or the end of input releases what is held back, in an event like the last one.
    Strings outside the delta paths are restored at once.
    """

    def __init__(self, tokens: dict[str, str], rules: tuple[str, ...], pending: str = "", held: dict[str, tuple[str, str, str]] | None = None):
        self.tokens, self.delta, self.pending = tokens, selector(rules), pending
        #: stream to (held text, event name, JSON of its last event)
        self.held = dict(held or {})

    def push(self, chunk: str) -> str:
        self.pending += chunk
        out = []
        while m := _BLOCK_END.search(self.pending):
            block, self.pending = self.pending[: m.start()], self.pending[m.end() :]
            out.append(self._event(block))
        return "".join(out)

    def flush(self) -> str:
        rest, self.pending = self.pending, ""
        return self._release(lambda _: True) + (self._event(rest) if rest.strip() else "")

    def _event(self, block: str) -> str:
        lines = re.split(r"\r\n|\r|\n", block)
        data = "\n".join(re.sub("^data: ?", "", x) for x in lines if x.startswith("data:"))
        name = next((re.sub("^event: ?", "", x) for x in lines if x.startswith("event:")), "")
        if not any(x.startswith("data:") for x in lines):
            return block + "\n\n"
        if data.strip() == "[DONE]":
            return self._release(lambda _: True) + self._written(name, data)
        try:
            value = json.loads(data)
        except ValueError:
            return self._written(name, substitute(data, self.tokens))
        index = value.get("index") if isinstance(value, dict) else None
        kind = value.get("type") if isinstance(value, dict) else None
        before = ""
        if isinstance(kind, str) and kind.endswith("_stop"):
            before = self._release((lambda k: k.endswith(f"#{index}")) if isinstance(index, int) else lambda _: True)

        def change(text: str, path: tuple[str, ...]) -> str:
            if not self.delta(path):
                return substitute(text, self.tokens)
            key = ".".join(path) + (f"#{index}" if isinstance(index, int) else "")
            stream = Rehydrator(self.tokens, self.held.get(key, ("",))[0])
            out = stream.push(text)
            self.held[key] = (stream.held, name, data)
            return out

        return before + self._written(name, dumped(mapped(value, change)))

    def _release(self, chosen: Callable[[str], bool]) -> str:
        out = []
        for key in [k for k in self.held if chosen(k)]:
            tail, name, data = self.held.pop(key)
            if tail:
                own = key.rsplit("#", 1)[0]
                swap = lambda text, path: substitute(tail, self.tokens) if ".".join(path) == own else "" if self.delta(path) else substitute(text, self.tokens)
                out.append(self._written(name, dumped(mapped(json.loads(data), swap))))
        return "".join(out)

    @staticmethod
    def _written(name: str, data: str) -> str:
        return (f"event: {name}\n" if name else "") + "".join(f"data: {x}\n" for x in data.split("\n")) + "\n"


def restored_events(df: DataFrame, key: str, order: list[str], chunk: str, tokens: dict[str, str], rules: tuple[str, ...]) -> DataFrame:
    """Batch form: each stream's chunks in order, with ``out``, the events that leave at that chunk (the last flushes)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows, stream = rows.sort_values(order), SseRehydrator(tokens, rules)
        out = [stream.push(c or "") for c in rows[chunk]]
        if out:
            out[-1] += stream.flush()
        return rows.assign(out=out)

    return df.groupBy(key).applyInPandas(fold, f"{fields}, out string")


def restored_event_stream(df: DataFrame, key: str, order: str, chunk: str, done: str, tokens: dict[str, str], rules: tuple[str, ...]) -> DataFrame:
    """Streaming form: rows ``key, out`` per micro-batch; unfinished events and held tails are keyed state, flushed by a ``done`` row."""
    kind = df.schema[key].dataType.simpleString()

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, held = state.get if state.exists else ("", "{}")
        stream = SseRehydrator(tokens, rules, pending, {k: tuple(v) for k, v in json.loads(held).items()})
        rows = pd.concat(list(batches)).sort_values(order)
        text = "".join(stream.push(c or "") + (stream.flush() if end else "") for c, end in zip(rows[chunk], rows[done]))
        state.update((stream.pending, json.dumps(stream.held)))
        if text:
            yield pd.DataFrame({key: [group[0]], "out": [text]})

    return df.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, out string", "pending string, held string", "append", GroupStateTimeout.NoTimeout)
