"""Personal data by bootstrapped contextual extraction.

Base kinds are found by their shapes and checks.  They seed the method: the words
around a base span induce lexical patterns (two words before, two words after, one on
each side), candidates are other tokens with digits or an address sign, and Spark
scores the bipartite graph of patterns and values in rounds:

* a pattern's confidence for a kind is the summed score of its values over the number
  of its values, and counts only from ``MIN_SUPPORT`` seed values and ``MIN_CONFIDENCE`` on;
* a value's score for a kind is 1 if it is a seed, else the chance that not all of its
  confident patterns are wrong (noisy or).

Candidates whose score reaches ``MIN_SCORE`` and whose form allows the kind are added
as ``ctx_<kind>``; base spans stay as they are.

Scale: one pass over the texts emits spans and contexts only (hashes); each round is
two equi-joins and two aggregations with map-side combine over that graph.

Offsets are code points, end exclusive.  Defined results: a null text is empty and has
no spans; null doc_ids stay; rows that agree in doc_id and text have the same result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.textio import chunks, cut

KINDS = ["email", "ip", "card", "phone"]
MIN_SUPPORT = 5
MIN_CONFIDENCE = 0.8
MIN_SCORE = 0.8
ROUNDS = 3

# fixed values: the base patterns
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_GAP = re.compile(r"[ \t\n\x0b\x0c\r]")
_SOLID = re.compile(r"[^ \t\n\x0b\x0c\r]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SPACE = frozenset(" \t\n\x0b\x0c\r")
_EDGE = ".,;:!?()[]{}<>|\"'=#*$%&"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    out.sort()
    return out


def _candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens with at least four digits, or an address sign, that touch no base span."""
    busy = sorted((s, e) for s, _, e in taken)
    at, b, low = 0, 0, 0
    while True:
        digit, sign = _DIGIT.search(text, at), text.find("@", at)
        if digit is None and sign < 0:
            return
        at = min(x for x in (digit.start() if digit else -1, sign) if x >= 0)
        start = at
        while start > low and text[start - 1] not in _SPACE:
            start -= 1
        gap = _GAP.search(text, at + 1)
        low = at = end = gap.start() if gap else len(text)
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        if end - start < 6:
            continue
        while b < len(busy) and busy[b][1] <= start:
            b += 1
        if b < len(busy) and busy[b][0] < end:
            continue
        token = text[start:end]
        if "@" in token or sum("0" <= c <= "9" for c in token) >= 4:
            yield start, end


def _word_before(text: str, at: int) -> tuple[str, int]:
    """The last word that ends at or before ``at``, without its edges, and where it starts; an empty word at the start of the text."""
    while at > 0:
        end = at
        while end > 0 and text[end - 1] in _SPACE:
            end -= 1
        at = end
        while at > 0 and text[at - 1] not in _SPACE:
            at -= 1
        if word := text[at:end].strip(_EDGE):
            return word.lower(), at
    return "", 0


def _word_after(text: str, at: int) -> tuple[str, int]:
    for m in _SOLID.finditer(text, at):
        if word := m[0].strip(_EDGE):
            return word.lower(), m.end()
    return "", len(text)


def _patterns(text: str, start: int, end: int) -> list[str]:
    near, at = _word_before(text, start)
    before = [w for w in (_word_before(text, at)[0] if near else "", near) if w]
    near, at = _word_after(text, end)
    after = [w for w in (near, _word_after(text, at)[0] if near else "") if w]
    out = []
    if len(before) == 2:
        out.append("<" + " ".join(before))
    if len(after) == 2:
        out.append(">" + " ".join(after))
    if before and after:
        out.append(f"{before[-1]}_{after[0]}")
    return out


def _allowed(token: str) -> int:
    """Bits of the kinds whose form the token could have."""
    n = sum("0" <= c <= "9" for c in token)
    other = [c for c in token if not "0" <= c <= "9"]
    bits = 1 if "@" in token or "(at)" in token.lower() else 0
    if other and set(other) <= {"."} and token.count(".") >= 3 or token.count(":") >= 2:
        bits |= 2
    if 12 <= n <= 19 and set(other) <= {"-"}:
        bits |= 4
    if 7 <= n <= 15 and set(other) <= set("-.()/+"):
        bits |= 8
    return bits


def _value(kind: int, token: str) -> str:
    return token.lower() if kind in (-1, 0) and "@" in token else _digits(token) if kind != 1 and not set(token) & {".", ":"} else token.lower()


_INSTANCE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("allowed", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])
SCHEMA = "doc_id long, text_key long, base array<struct<start:int,kind:int,end:int>>, instances array<struct<start:int,end:int,kind:int,allowed:int,value:string,patterns:array<string>>>"
_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        spans, instances = [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            own = [{"start": s, "end": e, "kind": k, "allowed": 1 << k, "value": _value(k, text[s:e]), "patterns": _patterns(text, s, e)} for s, k, e in base]
            for s, e in _candidates(text, base):
                if bits := _allowed(text[s:e]):
                    own.append({"start": s, "end": e, "kind": -1, "allowed": bits, "value": _value(-1, text[s:e]), "patterns": _patterns(text, s, e)})
            instances.append(own)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(spans, pa.list_(_SPAN)), pa.array(instances, pa.list_(_INSTANCE))], names=["doc_id", "text_key", "base", "instances"]
        )


def accepted_values(scanned: DataFrame, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_score: float = MIN_SCORE, rounds: int = ROUNDS) -> DataFrame:
    """``value, kind, score`` of the values that seeds and confident patterns vouch for."""
    seen = scanned.select(F.explode("instances").alias("i")).select("i.kind", "i.value", "i.allowed", F.explode("i.patterns").alias("pattern"))
    edges = cut(seen.groupBy("pattern", "value").agg(F.max("kind").alias("seed"), F.bit_or("allowed").alias("allowed")))
    seeds = edges.where("seed >= 0").select("value", F.col("seed").alias("kind")).distinct().withColumn("score", F.lit(1.0))
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("values"))
    support = edges.where("seed >= 0").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").alias("seeds")).where(F.col("seeds") >= min_support)
    # patterns without support never count, so only theirs go into the rounds
    useful = cut(support.join(sizes, "pattern"))
    edges = cut(edges.join(useful.select("pattern").distinct(), "pattern", "left_semi"))
    scores = seeds
    for _ in range(rounds):
        patterns = edges.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("total"))
        patterns = patterns.join(useful, ["pattern", "kind"]).select("pattern", "kind", (F.col("total") / F.col("values")).alias("confidence")).where(F.col("confidence") >= min_confidence)
        fits = F.expr("(allowed & shiftleft(1, kind)) <> 0")
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))
        found = edges.where("seed < 0").join(patterns, "pattern").where(fits).groupBy("value", "kind").agg((1 - doubt).alias("score"))
        scores = cut(seeds.union(found.join(seeds.select("value", "kind"), ["value", "kind"], "left_anti")))
    best = F.max_by(F.struct("kind", "score"), F.struct("score", -F.col("kind"))).alias("b")
    return scores.where(F.col("score") >= min_score).groupBy("value").agg(best).select("value", "b.kind", "b.score")


def _is_kind(i: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == i


def report(docs: DataFrame, **limits: float) -> DataFrame:
    """Per row ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    scanned = cut(rows.mapInArrow(_scan, SCHEMA))
    values = accepted_values(scanned, **limits)
    loose = scanned.dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", F.explode("instances").alias("i")).where("i.kind < 0")
    added = loose.select("doc_id", "text_key", "i.start", "i.end", "i.allowed", F.col("i.value").alias("value")).join(values, "value").where("(allowed & shiftleft(1, kind)) <> 0")
    added = added.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", (F.col("kind") + len(KINDS)).alias("kind"), "end")).alias("added"))
    added = added.withColumnsRenamed({"doc_id": "_d", "text_key": "_k"})
    out = scanned.join(added, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k")), "left")
    names = F.array(*[F.lit(k) for k in [*KINDS, *[f"ctx_{k}" for k in KINDS]]])

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    both = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    counts = [F.size(F.filter("base", _is_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(both).alias("spans"), F.greatest(F.coalesce(F.size("added"), F.lit(0)), F.lit(0)).cast("long").alias("n_context"))
