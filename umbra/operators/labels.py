"""Labels near a span: folded words that begin or end at a word's edge."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=50_000)
def folded(text: str) -> str:
    """NFKC, lower case, no marks, letters and digits only."""
    plain = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).lower())
    return "".join(c for c in plain if c.isalnum())


@lru_cache(maxsize=1000)
def _folded_labels(labels: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(folded(x) for x in labels))


def _holds(window: str, labels: tuple[str, ...]) -> bool:
    starts, ends, parts, at = set(), set(), [], 0
    for word in _WORD.findall(window):
        word = folded(word)
        starts.add(at)
        at += len(word)
        ends.add(at)
        parts.append(word)
    joined = "".join(parts)
    for label in _folded_labels(labels):
        i = joined.find(label)
        while i >= 0:
            if i in starts or i + len(label) in ends:
                return True
            i = joined.find(label, i + 1)
    return False


def near(text: str, start: int, end: int, labels: tuple[str, ...], window: int = 64, where: str = "either") -> bool:
    before = where != "after" and _holds(text[max(0, start - window) : start], labels)
    return before or where != "before" and _holds(text[end : end + window], labels)
