"""Chat bodies end to end: redaction, restoration, data controls, attachments and their budgets."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.operators import engine
from umbra.operators.redact import _KNOWN, Session
from umbra.operators.structured import MAX_DEPTH, rule_pattern

Json = object


def mapped(value: Json, change: Callable[[str, tuple[str, ...]], str], path: tuple[str, ...] = ()) -> Json:
    """The value with every string changed; too deep ones raise."""
    if len(path) > MAX_DEPTH:
        raise ValueError(f"nested deeper than {MAX_DEPTH}")
    if isinstance(value, str):
        return change(value, path)
    if isinstance(value, dict):
        return {k: mapped(v, change, (*path, k)) for k, v in value.items()}
    if isinstance(value, list):
        return [mapped(v, change, (*path, str(i))) for i, v in enumerate(value)]
    return value


def selector(rules: tuple[str, ...]) -> Callable[[tuple[str, ...]], bool]:
    chosen = re.compile("|".join(rule_pattern(r) for r in rules))
    return lambda path: chosen.match(".".join(path)) is not None


def dumped(value: Json) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def redacted_bodies(df: DataFrame, body: str, rules: tuple[str, ...], key: bytes, policies: dict[str, str] | None = None, default: str = "pseudonymize", options: engine.Options | None = None) -> DataFrame:
    """Adds ``redacted_body, tokens, findings, blocked_counts, error``: a body is one session over the strings that the rules select.

    A malformed or too deep body, and one with blocked findings, gives no redacted body.
    """
    options, wanted = options or engine.Options(), selector(rules)

    def one(raw: str | None) -> dict:
        session, counts, blocked = Session(key, policies or {}, default), {}, {}

        def change(text: str, path: tuple[str, ...]) -> str:
            if not wanted(path):
                return text
            spans = engine.found(text, options)
            for s in spans:
                counts[s[2]] = counts.get(s[2], 0) + 1
            for kind, n in session.blocked(spans).items():
                blocked[kind] = blocked.get(kind, 0) + n
            return session.redact(text, spans)

        try:
            value = json.loads(raw) if raw is not None else None
            if raw is not None and not isinstance(value, dict):
                raise ValueError("not an object")
            out, error = None if raw is None else dumped(mapped(value, change)), None
        except ValueError as problem:
            out, error = None, str(problem)[:200]
        return {"redacted_body": None if blocked else out, "tokens": list(session.tokens.items()), "findings": list(counts.items()), "blocked_counts": list(blocked.items()), "error": error}

    counts = pa.map_(pa.string(), pa.int64())
    kind = pa.struct([("redacted_body", pa.string()), ("tokens", pa.map_(pa.string(), pa.string())), ("findings", counts), ("blocked_counts", counts), ("error", pa.string())])
    schema = "struct<redacted_body:string,tokens:map<string,string>,findings:map<string,long>,blocked_counts:map<string,long>,error:string>"
    run = F.arrow_udf(lambda bodies: pa.array([one(b.as_py()) for b in bodies], kind), schema)
    return df.withColumn("_r", run(F.col(body))).select(*[F.col(f"`{c}`") for c in df.columns], "_r.*")


def restored_body(body: Column, tokens: Column) -> Column:
    """Every string of a JSON body with its known placeholders replaced; malformed bodies are substituted as text."""

    def one(raw: str | None, known: dict[str, str]) -> str | None:
        if raw is None:
            return None

        def swap(text: str, _: tuple[str, ...] = ()) -> str:
            return _KNOWN.sub(lambda m: known.get(m[0], m[0]), text)

        try:
            return dumped(mapped(json.loads(raw), swap))
        except ValueError:
            return swap(raw)

    return F.arrow_udf(lambda bodies, maps: pa.array([one(b.as_py(), dict(m.as_py() or ())) for b, m in zip(bodies, maps)], pa.string()), "string")(body, tokens)


def set_path(value: Json, path: str, new: Json) -> Json:
    """``value`` with a dotted path set, objects made on the way; anything but an object on the way leaves it as it is."""
    head, _, rest = path.partition(".")
    if not isinstance(value, dict):
        return value
    if not rest:
        return {**value, head: new}
    below = value.get(head, {})
    return {**value, head: set_path(below, rest, new)} if isinstance(below, dict) else value


def with_controls(body: Column, controls: dict[str, tuple[str, Json]], wanted: Column) -> Column:
    """``body, applied, manual``: the wanted controls (array of names) that have a field are set, the others are left to people."""

    def one(raw: str | None, names: list[str]) -> dict:
        try:
            value = json.loads(raw) if raw is not None else None
        except ValueError:
            return {"body": None, "applied": [], "manual": names}
        applied = [n for n in names if n in controls]
        for n in applied:
            value = set_path(value, *controls[n])
        return {"body": None if raw is None else dumped(value), "applied": applied, "manual": [n for n in names if n not in controls]}

    kind = pa.struct([("body", pa.string()), ("applied", pa.list_(pa.string())), ("manual", pa.list_(pa.string()))])
    return F.arrow_udf(lambda bodies, names: pa.array([one(b.as_py(), n.as_py() or []) for b, n in zip(bodies, names)], kind), "struct<body:string,applied:array<string>,manual:array<string>>")(body, wanted)


_DATA_URL = re.compile(r"data:([^,;]*)((?:;[^,;]*)*),(.*)\Z", re.S | re.I)
_ROOTS = ("messages", "system", "input", "prompt")


def data_url(text: str) -> tuple[str | None, str] | None:
    """Media type and base64 payload of a data URL."""
    m = _DATA_URL.match(text)
    if m is None:
        return None
    payload = m[3] if ";base64" in m[2].lower() else base64.b64encode(unquote_to_bytes(m[3])).decode()
    return m[1].strip().lower() or None, payload


def payload_bytes(data: str, most: int) -> bytes | None:
    """Decoded base64, none if it is malformed or larger than ``most``."""
    data = re.sub(r"\s+", "", data)
    if len(data) * 3 // 4 > most + 2:
        return None
    try:
        out = base64.b64decode(data, validate=True)
    except (binascii.Error, ValueError):
        return None
    return out if len(out) <= most else None


def _site(part: dict) -> dict | None:
    """An attachment that a content part carries: data, media type, file name, or why it cannot be read."""

    def site(data: str | None = None, media: str | None = None, name: str | None = None, why: str | None = None) -> dict:
        return {"data": data, "media_type": media, "filename": name, "unresolvable": why}

    def text(value: Json) -> str:
        return base64.b64encode(str(value).encode()).decode()

    kind = part.get("type")
    if kind in ("document", "image") and isinstance(source := part.get("source"), dict):
        media, name = source.get("media_type"), part.get("title") or part.get("filename")
        if source.get("type") == "base64" and isinstance(source.get("data"), str):
            return site(source["data"], media, name)
        if source.get("type") == "text" and isinstance(source.get("data"), str):
            return site(text(source["data"]), media or "text/plain", name)
        if source.get("type") == "content" and isinstance(source.get("content"), list):
            lines = [b if isinstance(b, str) else b.get("text") for b in source["content"] if isinstance(b, (str, dict))]
            joined = "\n".join(x for x in lines if isinstance(x, str))
            return site(text(joined), media or "text/plain", name) if joined else None
        if source.get("type") in ("url", "file"):
            return site(None, media, name, "a remote address" if source["type"] == "url" else "a file that only the provider holds")
    elif kind in ("file", "input_file"):
        file = part["file"] if isinstance(part.get("file"), dict) else part
        if isinstance(file.get("file_data"), str):
            media, data = data_url(file["file_data"]) or (None, file["file_data"])
            return site(data, media, file.get("filename"))
        if isinstance(file.get("file_id"), str):
            return site(None, None, file.get("filename"), "a file that only the provider holds")
    elif kind in ("image_url", "input_image"):
        url = part.get("image_url")
        url = url.get("url") if isinstance(url, dict) else url
        if isinstance(url, str):
            found = data_url(url)
            return site(found[1], found[0]) if found else site(why="a remote address")
    elif kind == "input_audio" and isinstance(part.get("input_audio"), dict):
        return site(media="audio/basic", why="audio cannot be transcribed")
    return None


def sites_in(value: Json, path: tuple[str, ...] = ()) -> Iterator[dict]:
    if len(path) > MAX_DEPTH:
        raise ValueError(f"nested deeper than {MAX_DEPTH}")
    if isinstance(value, list):
        for i, v in enumerate(value):
            yield from sites_in(v, (*path, str(i)))
    elif isinstance(value, dict):
        if (found := _site(value)) is not None:
            yield {"path": list(path), **found}
            return
        for k, v in value.items():
            if path or k in _ROOTS:
                yield from sites_in(v, (*path, k))


SITE = "array<struct<path:array<string>,data:string,media_type:string,filename:string,unresolvable:string>>"


def attachment_sites(body: Column) -> Column:
    """Attachments of a chat body; malformed and too deep bodies give null."""

    def one(raw: str | None) -> list[dict] | None:
        try:
            return None if raw is None else list(sites_in(json.loads(raw)))
        except ValueError:
            return None

    kind = pa.list_(pa.struct([("path", pa.list_(pa.string())), *[(n, pa.string()) for n in ("data", "media_type", "filename", "unresolvable")]]))
    return F.arrow_udf(lambda bodies: pa.array([one(b.as_py()) for b in bodies], kind), SITE)(body)


#: Bytes of one attachment and of a request's attachments together, and their number.
FILE_BYTES, REQUEST_BYTES, MOST_FILES = 10 << 20, 32 << 20, 256


def budgeted(sites: DataFrame, request: str, order: str, size: str, file_bytes: int = FILE_BYTES, request_bytes: int = REQUEST_BYTES, most: int = MOST_FILES) -> DataFrame:
    """Adds ``running_bytes`` and ``refused`` (a reason or null): limits of a file, of a request's bytes so far and of its files."""
    by = Window.partitionBy(request).orderBy(order)
    rows = sites.withColumn("running_bytes", F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_nth", F.row_number().over(by))
    reason = F.when(F.col("_nth") > most, "too many attachments").when(F.col(size) > file_bytes, "attachment too large").when(F.col("running_bytes") > request_bytes, "attachments too large together")
    return rows.withColumn("refused", reason).drop("_nth")
