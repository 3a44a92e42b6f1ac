"""Leaf blocks of HTML pages: text with the path of its open elements."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

from umbra.llm.wordhash import mix

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
DROPPED = frozenset("script style template head svg iframe textarea select datalist".split())
#: Of these the content is not markup, so only their own end tag ends it.
RAW = frozenset("script style textarea iframe title".split())
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option label".split()
)
_CLOSES_P = BLOCK - {"button", "label", "option"}
_SELF_NEST = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}

_PAIRED = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[A-Za-z/!?][^>]*(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PIECE = re.compile(r"[a-z]+")


class Path:
    """An open block element with those around it: its tag, its depth, and the names of all of them as buckets."""

    __slots__ = ("depth", "row", "tag")

    def __init__(self, tag: str, depth: int, row: np.ndarray):
        self.tag, self.depth, self.row = tag, depth, row

    def inside(self, tag: str, names: list[str]) -> Path:
        """A child; every element has a row of its own size, however deep it lies."""
        row = self.row.copy()
        row[[bucket(n) for n in names]] = 1
        return Path(tag, self.depth + 1, row)


PATH_BUCKETS = 192


@lru_cache(maxsize=100_000)
def bucket(name: str) -> int:
    h = 1469598103934665603
    for byte in name.encode("utf-8", "replace"):
        h = (h ^ byte) * 1099511628211 % (1 << 64)
    return int(mix(h)) % PATH_BUCKETS


def _names(tag: str, attributes: str) -> list[str]:
    """The tag, and the words of its class, id and role marked with a dot."""
    if "=" not in attributes:
        return [tag]
    return [tag, *(f".{w}" for m in _NAMED.finditer(attributes) for w in _PIECE.findall((m[2] or m[3] or m[4] or "").lower()))]


class _Open:
    """The open elements, with the places of each tag, so that no end tag walks through all of them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, Path]] = []  # tag, path around it; a closed inline element leaves an empty tag
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.path = Path("", 0, np.zeros(PATH_BUCKETS, np.uint8))

    def push(self, tag: str, attributes: str) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        around = self.path
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
            self.path = around.inside(tag, _names(tag, attributes))
        self.stack.append((tag, around))

    def last(self, tags: Iterable[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def close_from(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, around = self.stack.pop()
            if tag:
                self.at[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
                self.path = around

    def end(self, tag: str) -> None:
        depth = self.last([tag])
        if depth < 0:
            return
        if tag in BLOCK or not self.blocks or self.blocks[-1] < depth:
            self.close_from(depth)
        else:
            self.at[tag].pop()
            self.stack[depth] = ("", self.stack[depth][1])


def blocks(page: str | None) -> list[tuple[Path, str, float]]:
    """(path, text, share of link text) of each block with text, in page order.

    ``br`` is white space inside a block.  An unfinished tag at the end is dropped; an
    end tag that closes nothing is ignored.
    """
    out: list[tuple[Path, str, float]] = []
    open_ = _Open()
    held: list[str] = []
    linked = 0
    path_at: Path | None = None
    endless: set[str] = set()

    def flush() -> None:
        nonlocal linked, path_at
        if held:
            text = "".join(held)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append((path_at or open_.path, text, min(1.0, linked / len(text))))
            held.clear()
        linked, path_at = 0, None

    page = page or ""
    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else n]
        if text and (path_at is not None or not text.isspace()):
            if path_at is None:
                path_at = open_.path
            held.append(text)
            if open_.at.get("a"):
                linked += len(text)
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:  # an end tag
            if tag in BLOCK:
                flush()
            open_.end(tag)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif held:
                held.append(" ")
            continue
        if tag in DROPPED or tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
                else:
                    endless.add(tag)
                    if tag in RAW:
                        at = n
            continue
        if tag in BLOCK:
            flush()
            if tag in _CLOSES_P and (depth := open_.last(["p"])) >= 0:
                open_.close_from(depth)
            if tag in _SELF_NEST:
                depth = open_.last(_PAIRED.get(tag, (tag,)))
                if depth > open_.last(_SELF_NEST[tag]):
                    open_.close_from(depth)
        open_.push(tag, m[3])
    flush()
    return out
