"""Token counts of whole texts by a public tokenizer file.

Arrow functions read batches of bounded bytes and return lengths only; ids never leave
the worker.  Long texts are split where the tokenizer's own word pattern must begin a
new piece: before a single space between two characters that are not white space.  A
piece gives the same tokens alone as in its text, so pieces are encoded once a batch
and their lengths are kept in a bounded table.  Texts with a space beside other white
space are encoded as a whole.

Special strings inside a text count as the library's default has them (one token);
begin, end and added special tokens are left out, nothing is truncated or padded.

Defined results: null is the empty text (0 bytes, 0 tokens); every row has a result,
equal or repeated rows too; null doc_ids stay null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.textio import chunks, utf8

LIMIT = 512
#: Entries and longest piece of the table of lengths in a worker.
TABLE_ENTRIES = 400_000
TABLE_CHARS = 48

_UNSAFE = re.compile(r"\s | \s")


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    if path.endswith(".json"):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def encoded_ids(path: str, texts: list[str]) -> list[list[int]]:
    if not texts:
        return []
    if path.endswith(".json"):
        return [e.ids for e in _tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]
    return _tokenizer(path).encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def _begins_with_space(path: str) -> np.ndarray:
    """By id: whether the token begins with the byte-level form of a space."""
    vocabulary = _tokenizer(path).get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
    return out


def splits_at_spaces(path: str) -> bool:
    """Whether the file's tokenizer begins a new piece at each safe boundary: byte-level, own pattern, no prefix space, no normaliser."""
    if not path.endswith(".json"):
        return False
    import json

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    before = whole.get("pre_tokenizer") or {}
    return whole.get("normalizer") is None and before.get("type") == "ByteLevel" and bool(before.get("use_regex")) and not before.get("add_prefix_space")


class Lengths:
    """Token lengths of texts, with a bounded table of pieces."""

    def __init__(self, path: str):
        self.path = path
        self.split = splits_at_spaces(path)
        self.known: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in encoded_ids(self.path, texts)]

    def pieces(self, words: list[str]) -> list[int]:
        """Lengths of " word" for words without spaces: encoded side by side, cut at the tokens that begin with a space."""
        joined, held, size = [], [], 0
        for w in words:
            held.append(" " + w)
            size += len(w) + 1
            if size > 1 << 15:
                joined.append("".join(held))
                held, size = [], 0
        if held:
            joined.append("".join(held))
        out: list[int] = []
        for ids in encoded_ids(self.path, joined):
            at = np.flatnonzero(_begins_with_space(self.path)[np.array(ids)])
            out += np.diff(np.append(at, len(ids))).tolist()
        return out

    def of(self, texts: list[str]) -> list[int]:
        if not self.split:
            return self.whole(texts)
        out = [0] * len(texts)
        rest, parts = [], {}
        for i, text in enumerate(texts):
            if _UNSAFE.search(text):
                rest.append(i)
            elif text:
                parts[i] = text.split(" ")
        for i, n in zip(rest, self.whole([texts[i] for i in rest]), strict=True):
            out[i] = n
        wanted: set[str] = set()
        for pieces in parts.values():
            wanted.update(pieces[1:])
        if len(self.known) + len(wanted) > TABLE_ENTRIES:
            self.known.clear()
        known = self.known
        new = [w for w in wanted if w not in known and w]
        fresh = dict(zip(new, self.pieces(new), strict=True))
        fresh[""] = self.whole([" "])[0]
        known.update((w, n) for w, n in fresh.items() if len(w) <= TABLE_CHARS)
        long = {w: n for w, n in fresh.items() if len(w) > TABLE_CHARS}
        length = (known | long if long else known).__getitem__
        firsts = self.whole([p[0] for p in parts.values()])
        for (i, pieces), first in zip(parts.items(), firsts, strict=True):
            out[i] = first + sum(map(length, pieces[1:]))
        return out


def counted(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per row ``doc_id, n_bytes, n_tokens, over_limit``; ``path``: the tokenizer's file, found on every worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(path)
        for batch in chunks(batches):
            _, offsets = utf8(batch.column("text"))
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = np.array(lengths.of(texts), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
