"""Near hits of a small dictionary in one pass over the texts: seeds of the spellings pick the runs that are compared."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: term, spelling, whether an edit is allowed
Form = tuple[str, str, bool]

_BEGINS, _ENDS = 1, 2
#: Entries of a worker's caches before they are emptied.
CACHED = 300_000
_OTHER = re.compile(r"[\W_]+")
_PLAIN = str.maketrans("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy") | {ord("ß"): "ss"}


def fold(word: str) -> str:
    """As ``functions.text.fold_for_compare``."""
    if word.isascii():
        return word.lower() if word.isalnum() else _OTHER.sub("", word.lower())
    return _OTHER.sub("", word.lower().translate(_PLAIN))


def within_one(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    i = 0
    while i < len(b) and a[i] == b[i]:
        i += 1
    if len(a) > len(b):
        return a[i + 1 :] == b[i:]
    return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]


class _Cache(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= CACHED:
            self.clear()
        self[key] = value = self.make(key)
        return value


class Finder:
    """Runs of up to ``longest`` words, at most ``max_gap`` characters apart, that are a spelling or one edit from it.

    Cut a spelling behind its character ``h``: an edit leaves all from ``h`` on alone, or all
    before ``h - 1``.  So a run that matches begins with the one piece or ends with the
    other.  A word that cannot begin or end such a run costs one look-up.
    """

    def __init__(self, forms: tuple[Form, ...], longest: int, max_gap: int):
        self.longest, self.pieces = longest, re.compile(rf"[^\W_]+|[\W_]{{{max_gap + 1},}}")
        self.exact: dict[str, list[str]] = {}
        self.heads: dict[tuple[int, str], list[tuple[str, str]]] = {}
        self.tails: dict[tuple[int, str], list[tuple[str, str]]] = {}
        #: Seeds of runs, whole words before a blank in them or behind it, first words of spellings without edits.
        self.head_seeds, self.tail_seeds, self.head_words, self.tail_words, self.firsts = set(), set(), set(), set(), set()
        for term, spelling, near in forms:
            self.exact.setdefault(spelling, []).append(term)
            if not near:
                self.firsts.add(spelling.split(" ")[0])
                continue
            n = len(spelling)
            h = (n + 1) // 2
            head, tail = spelling[: h - 1], spelling[h:]
            self.heads.setdefault((n, head), []).append((spelling, term))
            self.tails.setdefault((n, tail), []).append((spelling, term))
            self.head_seeds.add(head)
            self.tail_seeds.add(tail)
            self.head_words |= {head[: i + 1] for i, c in enumerate(head) if c == " "}
            self.tail_words |= {tail[i:] for i, c in enumerate(tail) if c == " "}
        lengths = [len(f[1]) for f in forms]
        self.least, self.most = min(lengths) - 1, max(lengths) + 1
        self.head_sizes, self.tail_sizes = sorted({len(s) for s in self.head_seeds}), sorted({len(s) for s in self.tail_seeds})
        self.folded, self.marks, self.terms = _Cache(fold), _Cache(self._mark), _Cache(self._terms)

    def _mark(self, piece: str) -> int:
        """Whether a run of interest can begin or end with the word; 0 for a wide gap."""
        word = fold(piece)
        if not word:
            return 0
        before, behind = " " + word, word + " "
        begins = word in self.firsts or behind in self.head_words or any(behind[:k] in self.head_seeds for k in self.head_sizes)
        ends = before in self.tail_words or any(before[-k:] in self.tail_seeds for k in self.tail_sizes)
        return _BEGINS * begins | _ENDS * ends

    def _terms(self, token: str) -> tuple[str, ...]:
        """The terms that have the token as a spelling or one edit from it."""
        out, size = set(self.exact.get(token, ())), len(token)
        for n in (size - 1, size, size + 1):
            h = (n + 1) // 2
            for spelling, term in (*self.heads.get((n, token[: h - 1]), ()), *self.tails.get((n, token[size - (n - h) :]), ())) if n > 2 else ():
                if term not in out and within_one(token, spelling):
                    out.add(term)
        return tuple(sorted(out))

    def _runs(self, pieces: list[str]) -> Iterator[str]:
        """Each run of interest once, its words folded, with single spaces between."""
        marks, folded = self.marks, self.folded
        for at in [i for i, p in enumerate(pieces) if marks[p]]:
            mark = marks[pieces[at]]
            for step in (1, -1):
                if not mark & (_BEGINS if step == 1 else _ENDS):
                    continue
                token, i = "", at
                for _ in range(self.longest):
                    if not 0 <= i < len(pieces) or not (word := folded[pieces[i]]):
                        break
                    token = (f"{token} {word}" if step == 1 else f"{word} {token}") if token else word
                    if len(token) > self.most:
                        break
                    if len(token) >= self.least and (step == 1 or not marks[pieces[i]] & _BEGINS):  # else found from its beginning
                        yield token
                    i += step

    def found(self, text: str | None) -> dict[str, int]:
        """Counts of the tokens that have terms."""
        out: dict[str, int] = {}
        if text:
            for token in self._runs(self.pieces.findall(text.lower() if text.isascii() else text)):
                if self.terms[token]:
                    out[token] = out.get(token, 0) + 1
        return out


@lru_cache(maxsize=1)
def finder(forms: tuple[Form, ...], longest: int, max_gap: int) -> Finder:
    return Finder(forms, longest, max_gap)


_HIT = pa.list_(pa.struct([("term", pa.string()), ("token", pa.string()), ("n", pa.int64())]))


def hits(df: DataFrame, key: str, text: str, forms: tuple[Form, ...], longest: int, max_gap: int) -> DataFrame:
    """``key, term, token, n`` of the forms; only what is found is shuffled."""

    @F.arrow_udf("array<struct<term:string,token:string,n:bigint>>")
    def scan(texts: pa.Array) -> pa.Array:
        f = finder(forms, longest, max_gap)
        return pa.array([[{"term": term, "token": token, "n": n} for token, n in f.found(one.as_py()).items() for term in f.terms[token]] for one in texts], _HIT)

    rows = df.select(key, scan(F.col(text)).alias("h")).where(F.size("h") > 0)
    return rows.select(key, F.explode("h").alias("h")).groupBy(key, "h.term", "h.token").agg(F.sum("h.n").alias("n"))
