"""Scan copies: a text as a reader sees it, each as a list of edits with offsets back to the original.

Profiles: invisible characters dropped and NFKC applied; look-alike letters folded;
marks taken off the letters of addresses; letters spaced out one by one closed;
lower-to-upper borders opened; digits that stand for letters folded; chains of digit
groups written with one separator or none; base64, percent and entity runs decoded.
"""

from __future__ import annotations

import base64
import binascii
import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from urllib.parse import unquote_to_bytes

from umbra.functions.text import CONFUSABLES

Edit = tuple[int, int, str]
#: Lengths of base64 runs that are tried.
BASE64_LEAST = 16


class Copy:
    """A text with edits (start, end, replacement) in order; an offset inside a replacement maps in proportion."""

    def __init__(self, text: str, edits: list[Edit], base: Copy | None = None):
        parts, at, grown = [], 0, 0
        self.from_, self.to, self.edits, self.base = [], [], edits, base
        for start, end, new in edits:
            parts += [text[at:start], new]
            self.from_.append(start + grown)
            grown += len(new) - (end - start)
            self.to.append(end + grown)
            at = end
        parts.append(text[at:])
        self.text = "".join(parts) if edits else text

    def back(self, at: int, end: bool = False) -> int:
        i = bisect_right(self.from_, at - end) - 1
        if i >= 0:
            start, stop, new = self.edits[i]
            if at >= self.to[i]:
                at += stop - self.to[i]
            else:
                whole = stop - start
                done = (at - self.from_[i]) * whole
                at = start + (-(-done // len(new)) if end else done // len(new))
        return self.base.back(at, end) if self.base else at


_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸\U000e0000-\U000e0fff]+")
_FOREIGN = re.compile(r"[^\x00-\x7f]+")
_ALIKE = re.compile(f"[{re.escape(''.join(CONFUSABLES))}]")
_DIGITS = re.compile("[0-9]+")
#: Characters on each side of digits in which a chain or a word with them lies.
MARGIN = 160
_SPACED = re.compile(r"(?<!\S)(?:\w ){3,}\w(?!\S)")
_CAMEL = re.compile(r"[a-zà-öø-ÿ][A-ZÀ-ÖØ-Þ]")
_TOKEN = re.compile(r"\S+")
_LEET_WORD = re.compile(r"(?<![\w@.])(?=\w*[0134578]\w*)(?=(?:\w*[^\W\d_]){3})\w+(?![\w@])")
# fixed values: digits that stand for letters; letters with a stroke
_LEET = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t"}
_STROKES = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ħ": "h", "ŧ": "t"}
_CHAIN = re.compile(r"(?<![\w.,])[A-Z]{0,4}[0-9][0-9A-Z]*(?:[   -  ./\\_:|‐-―-]{1,3}[0-9A-Z]+){1,24}(?!\w)", re.I)
_GROUPED_NUMBER = re.compile(r"[0-9]{1,3}(?:[., ][0-9]{3})+(?:[.,][0-9]{1,2})?\Z")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{14,}={0,2}(?![A-Za-z0-9+/_=-])")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]{2,8});")


def _unicode(text: str) -> Iterator[Edit]:
    for m in _FOREIGN.finditer(text):
        at = m.start()
        while at < m.end():
            end = at + 1
            if at == m.start() and at > 0 and unicodedata.combining(text[at]):
                at -= 1  # a mark belongs to the letter before it
            while end < len(text) and unicodedata.combining(text[end]):
                end += 1
            cluster = text[at:end]
            new = _INVISIBLE.sub("", unicodedata.normalize("NFKC", cluster))
            if new != cluster:
                yield at, end, new
            at = end


def _confusable(text: str) -> Iterator[Edit]:
    for m in _ALIKE.finditer(text):
        yield m.start(), m.end(), CONFUSABLES[m[0]]


def around_digits(text: str, margin: int) -> list[tuple[int, int]]:
    """The parts of a text around its digits."""
    out: list[list[int]] = []
    for m in _DIGITS.finditer(text):
        if out and m.start() - margin <= out[-1][1]:
            out[-1][1] = m.end() + margin
        else:
            out.append([m.start() - margin, m.end() + margin])
    return [(max(0, a), min(len(text), b)) for a, b in out]


def _unmarked(c: str) -> str:
    return _STROKES.get(c) or "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))


def _addresses(text: str) -> Iterator[Edit]:
    for m in _TOKEN.finditer(text) if "@" in text and not text.isascii() else ():
        if "@" not in m[0] or m[0].isascii():
            continue
        for i in range(m.start(), m.end()):
            if text[i] > "\x7f" and (new := _unmarked(text[i])) != text[i]:
                yield i, i + 1, new


def _spaced(text: str) -> Iterator[Edit]:
    for m in _SPACED.finditer(text):
        for i in range(m.start() + 1, m.end(), 2):
            yield i, i + 1, ""


def _camel(text: str) -> Iterator[Edit]:
    for m in _CAMEL.finditer(text):
        yield m.start() + 1, m.start() + 1, " "


def _leet(text: str) -> Iterator[Edit]:
    for m in (m for lo, hi in around_digits(text, MARGIN) for m in _LEET_WORD.finditer(text, lo, hi)):
        word = m[0]
        digits = sum(c.isdigit() for c in word)
        if digits and 2 * digits <= sum(c.isalpha() for c in word):
            lower = any(c.islower() for c in word)
            for i, c in enumerate(word):
                if c in _LEET:
                    yield m.start() + i, m.start() + i + 1, _LEET[c] if lower else _LEET[c].upper()


def _chains(close: bool) -> Callable[[str], Iterator[Edit]]:
    def edits(text: str) -> Iterator[Edit]:
        for m in (m for lo, hi in around_digits(text, MARGIN) for m in _CHAIN.finditer(text, lo, hi)):
            run = m[0]
            groups = re.findall(r"[0-9A-Za-z]+", run)
            size, digits = sum(map(len, groups)), sum(c.isdigit() for c in run)
            if size < 9 or digits < 6 or size < 2 * len(groups) and not close or _GROUPED_NUMBER.match(run):
                continue
            if close and (len(groups) < 4 or any(len(g) >= 4 for g in groups)):
                continue
            for x in re.finditer(r"[^0-9A-Z]+", run):
                new = re.sub(r"[^0-9A-Za-z]+", "" if close else " ", x[0]).upper()
                if new != x[0]:
                    yield m.start() + x.start(), m.start() + x.end(), new

    return edits


def _printable(data: bytes) -> str | None:
    try:
        out = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return out if out and all(c.isprintable() or c in "\t\r\n" for c in out) else None


def _base64(text: str) -> Iterator[Edit]:
    for m in _BASE64.finditer(text):
        run = m[0].translate({45: 43, 95: 47})
        if len(run) < BASE64_LEAST or len(run) % 4:
            continue
        try:
            data = base64.b64decode(run, validate=True)
        except binascii.Error:
            continue
        if base64.b64encode(data).decode() == run and (new := _printable(data)):
            yield m.start(), m.end(), new


def _percent(text: str) -> Iterator[Edit]:
    for m in _PERCENT.finditer(text) if "%" in text else ():
        if (new := _printable(unquote_to_bytes(m[0]))) is not None:
            yield m.start(), m.end(), new


def _entities(text: str) -> Iterator[Edit]:
    for m in _ENTITY.finditer(text) if "&" in text else ():
        if (new := html.unescape(m[0])) != m[0]:
            yield m.start(), m.end(), new


_PROFILES = [_confusable, _addresses, _spaced, _camel, _leet, _chains(False), _chains(True), _base64, _percent, _entities]


def copies(text: str) -> Iterator[Copy]:
    """The changed copies of a text, each content once."""
    plain = text.isascii() or unicodedata.is_normalized("NFKC", text) and not _INVISIBLE.search(text)
    edits = [] if plain else list(_unicode(text))
    base = Copy(text, edits)
    seen = {text}
    if base.text not in seen:
        seen.add(base.text)
        yield base
    for profile in _PROFILES:
        if found := list(profile(base.text)):
            copy = Copy(base.text, found, base)
            if copy.text not in seen:
                seen.add(copy.text)
                yield copy
