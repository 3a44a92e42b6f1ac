"""JSON bodies as rows: strings with their paths, path rules, rewriting."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 32
# fixed values: the string fields of chat requests and messages
CHAT_RULES = (
    "messages.*.content", "messages.*.content.*.text", "messages.*.content.*.input_text", "messages.*.name", "messages.*.refusal",
    "messages.*.tool_calls.*.function.arguments", "messages.*.function_call.arguments", "tools.*.function.description", "tools.*.function.parameters.**",
    "functions.*.description", "functions.*.parameters.**",
)
MESSAGE_RULES = (
    "system", "system.*.text", "messages.*.content", "messages.*.content.*.text", "messages.*.content.*.source.content", "messages.*.content.*.source.content.*",
    "messages.*.content.*.source.content.*.text", "messages.*.content.*.content", "messages.*.content.*.content.*.text", "messages.*.content.*.input.**",
    "tools.*.description", "tools.*.input_schema.**", "metadata.user_id",
)


def rule_pattern(rule: str) -> str:
    """A rule as an anchored expression over a dotted path: ``*`` one segment, ``**`` any number."""
    out = ""
    for i, part in enumerate(rule.split(".")):
        if part == "**":
            out += r"(?:\.[^.]+)*" if i else r"(?:[^.]+(?:\.[^.]+)*)?"
        else:
            out += (r"\." if i else "") + (r"[^.]+" if part == "*" else re.escape(part))
    return f"^{out}$"


def selected(path: Column, rules: tuple[str, ...]) -> Column:
    return F.rlike(path, F.lit("|".join(rule_pattern(r) for r in rules)))


def _walk(value: object, path: tuple[str, ...] = ()) -> Iterator[tuple[str, str]]:
    if len(path) > MAX_DEPTH:
        raise ValueError(f"nested deeper than {MAX_DEPTH}")
    if isinstance(value, str):
        yield ".".join(path), value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from _walk(v, (*path, k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _walk(v, (*path, str(i)))


def strings(df: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """``keys, path, value`` of every string of a JSON column; malformed bodies and too deep ones have a null path."""
    schema = df.select(*keys).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, paths, values = [], [], []
            for i, text in enumerate(batch.column(body).to_pylist()):
                try:
                    found = list(_walk(json.loads(text))) if text is not None else []
                except ValueError:
                    found = [(None, None)]
                at += [i] * len(found)
                paths += [p for p, _ in found]
                values += [v for _, v in found]
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in keys), pa.array(paths, pa.string()), pa.array(values, pa.string())], names=[*keys, "path", "value"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return df.select(*keys, body).mapInArrow(run, f"{fields}, path string, value string")


def rewritten(df: DataFrame, body: str, rules: tuple[str, ...], change: Callable[[str], str], out: str = "rewritten") -> DataFrame:
    """The column's JSON with ``change`` applied to the strings that the rules select; malformed bodies give null."""
    chosen = re.compile("|".join(rule_pattern(r) for r in rules))

    def rebuild(value: object, path: tuple[str, ...] = ()) -> object:
        if len(path) > MAX_DEPTH:
            raise ValueError(f"nested deeper than {MAX_DEPTH}")
        if isinstance(value, str):
            return change(value) if chosen.match(".".join(path)) else value
        if isinstance(value, dict):
            return {k: rebuild(v, (*path, k)) for k, v in value.items()}
        if isinstance(value, list):
            return [rebuild(v, (*path, str(i))) for i, v in enumerate(value)]
        return value

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(rebuild(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    from pyspark.sql import types as T

    return df.withColumn(out, F.udf(one, T.StringType(), useArrow=True)(F.col(body)))
