"""Main text of HTML pages by a recurrent block labeller.

A page is its sequence of leaf blocks.  Each block is a vector of its tag path (hashed
element names, class and id words, with depth), hashed words and a few measures; a
bidirectional LSTM in numpy reads the whole sequence, so a block's label depends on the
whole page, and a logistic unit labels each block as main text or not.

The model is trained here, on ``TRAIN_PAGES`` generated pages (a documented bound that
does not depend on the input) whose blocks are labelled by construction: articles in
several kinds of containers, and menus, headers, footers, sidebars, notices, adverts,
forms and reader comments around and inside them.  Training has a fixed seed and is done
by ``python -m umbra.llm.html_main``, which writes the weights beside this module; the
driver reads them and sends them to the workers.

Text of scripts, styles, templates, drawings, frames and form controls is never a block.  Character
references are decoded, white space inside a block becomes one space, blocks are joined
by one newline.

Defined results: null or empty html gives an empty text; pages without markup are one
block; malformed markup is read as far as it goes; every row has a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path as File

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.html_blocks import PATH_BUCKETS, Path, blocks, bucket
from umbra.llm.html_pages import page as training_page
from umbra.llm.textio import chunks, utf8
from umbra.llm.wordhash import U, mix, word_hashes

WORD_BUCKETS, MEASURES = 32, 6
INPUTS = PATH_BUCKETS + WORD_BUCKETS + MEASURES
HIDDEN = 16
TRAIN_PAGES = 800
HELD_OUT_PAGES = 200
EPOCHS = 10
#: Blocks labelled at once.
CELLS = 200_000


def vectors(found: list[tuple[Path, str, float]]) -> np.ndarray:
    """A row of INPUTS values for each block."""
    out = np.zeros((len(found), INPUTS), np.float32)
    if not found:
        return out
    for i, (path, text, linked) in enumerate(found):
        out[i, :PATH_BUCKETS] = path.row
        out[i, bucket("leaf " + path.tag)] = 1
        out[i, -MEASURES:-3] = min(path.depth / 8, 4), linked, min(np.log1p(len(text)) / 8, 2)
    words, ranges, _ = word_hashes(*utf8(pa.array([t for _, t, _ in found])), lower=True)
    count = np.diff(ranges)
    row = np.repeat(np.arange(len(found)), count)
    hashed = np.bincount(row * WORD_BUCKETS + (words % U(WORD_BUCKETS)).astype(np.int64), minlength=len(found) * WORD_BUCKETS)
    out[:, PATH_BUCKETS : PATH_BUCKETS + WORD_BUCKETS] = hashed.reshape(-1, WORD_BUCKETS) / np.maximum(count, 1)[:, None]
    out[:, -3] = np.minimum(np.log1p(count) / 6, 2)
    out[:, -2] = [t.endswith((".", "!", "?", ":")) for _, t, _ in found]
    out[:, -1] = 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, mask: np.ndarray, w: np.ndarray, r: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (steps, pages, HIDDEN) of one direction; masked steps carry the state on."""
    steps, pages = mask.shape
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    fed = x @ w
    out = np.empty((steps, pages, HIDDEN), np.float32)
    for t in range(steps):
        z = fed[t] + h @ r
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        new_c = f * c + i * g
        tc = np.tanh(new_c)
        if keep is not None:
            keep.append((h, c, i, f, o, g, tc))
        c = np.where(m, new_c, c)
        h = np.where(m, o * tc, h)
        out[t] = h
    return out


def _back(x: np.ndarray, mask: np.ndarray, r: np.ndarray, keep: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input and recurrent weights of one direction."""
    steps, pages = mask.shape
    dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    dz = np.zeros((steps, pages, 4 * HIDDEN), np.float32)
    dr = np.zeros_like(r)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, tc = keep[t]
        m = mask[t][:, None]
        dh = dh + grad[t]
        own_h, own_c = dh * m, dc * m
        own_c = own_c + own_h * o * (1 - tc * tc)
        z = np.concatenate([own_c * g * i * (1 - i), own_c * c * f * (1 - f), own_h * tc * o * (1 - o), own_c * i * (1 - g * g)], axis=1)
        dz[t] = z
        dr += h.T @ z
        dh = z @ r.T + dh * ~m
        dc = own_c * f + dc * ~m
    return np.einsum("tpi,tpz->iz", x, dz, optimize=True), dr


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), INPUTS), np.float32), np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


class Labeller:
    """A bidirectional LSTM over block vectors."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)

        def start(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.parts = {"w0": start(INPUTS, 4 * HIDDEN), "r0": start(HIDDEN, 4 * HIDDEN), "w1": start(INPUTS, 4 * HIDDEN), "r1": start(HIDDEN, 4 * HIDDEN), "v": start(2 * HIDDEN + INPUTS, 1)}
        for k in ("w0", "w1"):
            self.parts[k][-1, HIDDEN : 2 * HIDDEN] += 1  # the last input is 1: forget gates start open

    def _forward(self, x: np.ndarray, mask: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        p = self.parts
        ahead = _run(x, mask, p["w0"], p["r0"], keep and keep[0])
        back = _run(x[::-1], mask[::-1], p["w1"], p["r1"], keep and keep[1])[::-1]
        both = np.concatenate([ahead, back, x], axis=2)
        return both, _sigmoid(both @ p["v"])[:, :, 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over blocks."""
        keep: tuple[list, list] = ([], [])
        p = self.parts
        both, chance = self._forward(x, mask, keep)
        d = ((chance - label) * mask / mask.sum())[:, :, None].astype(np.float32)
        grad = {"v": np.einsum("tpi,tpo->io", both, d, optimize=True)}
        back = d @ p["v"].T
        grad["w0"], grad["r0"] = _back(x, mask, p["r0"], keep[0], back[:, :, :HIDDEN])
        grad["w1"], grad["r1"] = _back(x[::-1], mask[::-1], p["r1"], keep[1], back[::-1, :, HIDDEN : 2 * HIDDEN])
        return grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int, seed: int = 6, rate: float = 0.01, batch: int = 32) -> Labeller:
        rng = np.random.default_rng(seed)
        first, second, n = {k: 0.0 for k in self.parts}, {k: 0.0 for k in self.parts}, 0
        pages = sorted((p for p in pages if len(p[1])), key=lambda p: len(p[1]))
        groups = [pages[i : i + batch] for i in range(0, len(pages), batch)]
        for epoch in range(epochs):
            for k in rng.permutation(len(groups)):
                x, mask = _padded([p[0] for p in groups[k]])
                label = np.zeros(mask.shape, np.float32)
                for j, (_, y) in enumerate(groups[k]):
                    label[: len(y), j] = y
                n += 1
                for name, g in self.gradients(x, mask, label).items():
                    g = g + 1e-5 * self.parts[name]
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    step = (first[name] / (1 - 0.9**n)) / (np.sqrt(second[name] / (1 - 0.999**n)) + 1e-8)
                    self.parts[name] -= (rate * (1 - epoch / epochs) * step).astype(np.float32)
        return self

    def labels(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(pages[order[end]]) <= CELLS // 50:
                end += 1
            x, mask = _padded([pages[i] for i in order[at:end]])
            _, chance = self._forward(x, mask)
            for k, i in enumerate(order[at:end]):
                out[i] = chance[: len(pages[i]), k] > 0.5
            at = end
        return out


#: Marks words of main text in generated pages; a zero-width character, taken out before the vectors are made.
MARK = "​"


#: The weights that ``python -m umbra.llm.html_main`` trains and writes (about 130 KB).
WEIGHTS = File(__file__).with_name("labeller.npz")


def train() -> dict[str, np.ndarray]:
    return Labeller().fit(training_set(TRAIN_PAGES, 1), EPOCHS).parts


@lru_cache(maxsize=1)
def trained() -> dict[str, np.ndarray]:
    with np.load(WEIGHTS) as parts:
        return {k: parts[k] for k in parts.files}


def training_set(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        found = blocks(training_page(rng))
        label = np.array([MARK in text for _, text, _ in found], bool)
        out.append((vectors([(path, text.replace(MARK, ""), linked) for path, text, linked in found]), label))
    return out


def extracted(pages: DataFrame) -> DataFrame:
    """Per row ``page_id, url, text, n_chars``."""
    parts = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller()
        model.parts = parts
        for batch in chunks(batches, "html"):
            found = [blocks(h) for h in batch.column("html").to_pylist()]
            flat = vectors([b for f in found for b in f])
            ends = np.cumsum([len(f) for f in found])
            each = np.split(flat, ends[:-1]) if len(found) > 1 else [flat]
            texts = ["\n".join(t for (_, t, _), good in zip(f, label.tolist(), strict=True) if good) for f, label in zip(found, model.labels(each), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **train())
