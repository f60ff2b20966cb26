"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks. Each has a vector: the hashed words of its tag path (the tags around it with their class and id words), the hashed
words of its text and a few shares. A bidirectional LSTM, in numpy, reads the sequence both ways, so every block is judged by
the whole page, and says which blocks belong to the article. Their texts, joined by line ends in page order, are the result.

The labeller is trained on the driver on a bounded sample: ``SAMPLE`` pages, those with the smallest hashes of their ids. Their blocks are
labelled by structure: within ``article`` or ``main`` if the page has such an element, and not within an element whose tag or name says that it is something else. Of each
page variants are learned as well, in which the article and its blocks are marked up in other ways and blocks of menus, notices, forms, adverts, sidebars and reader comments are put in, with
the text of other blocks, so that pages of other makes are read, too. The model has a fixed size and goes to all tasks; every page is then read whole, pages side by side.

Defined cases: a NULL or empty page, or one without blocks, has empty text. Rows with one id are read each by itself. An empty
table gives no rows. Only the id, the address and the page are read.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import slices, table
from .html_blocks import Block, blocks_of

SAMPLE = 120
VARIANTS = 4
PATH, OWN, WORDS, SHARES = 96, 32, 32, 6
FEATURES = PATH + OWN + WORDS + SHARES
HIDDEN = 16
EPOCHS = 10
RATE = 0.01
SEED = 42
#: Blocks, with padding, that are read side by side.
SIDE_BY_SIDE = 50_000

# What an element is for, by its tag or a word of its class, id or role.
ARTICLE = {"article", "main"}
OTHER = set(
    "nav header footer aside form menu dialog "
    "ad ads advert advertisement banner sponsored promo cookie cookies consent notice alert popup modal newsletter subscribe signup login search "
    "comment comments disqus reply replies sidebar navbar navigation breadcrumb breadcrumbs pagination related recommended share social toolbar widget copyright".split()
)
ARTICLE_MARKUP = (
    (("article",),), (("main",),), (("div", "content"),), (("div", "post", "body"),), (("section", "entry", "content"),), (("div", "article", "body"),), (("main",), ("div", "text")),
    (("div", "main"),), (("div", "story"),),
)
#: How a block of an article may be marked up within it.
INNER_MARKUP = (
    (("p",),), (("h1",),), (("h2",),), (("h3",),), (("ul",), ("li",)), (("ol",), ("li",)), (("blockquote",), ("p",)), (("section",), ("p",)), (("div",), ("p",)), (("div",),),
    (("pre",),), (("table",), ("tbody",), ("tr",), ("td",)), (("dl",), ("dd",)),
)
OTHER_MARKUP = (
    (("nav",), ("ul",), ("li",), ("a",)), (("div", "menu"), ("ul",), ("li",), ("a",)), (("header",), ("div",)), (("header",), ("h1",)), (("footer",), ("p",)), (("div", "footer"),),
    (("aside",), ("p",)), (("aside",), ("ul",), ("li",), ("a",)), (("div", "sidebar"), ("p",)), (("div", "ad"),), (("div", "advert", "banner"),), (("div", "sponsored"), ("p",)),
    (("div", "cookie", "notice"), ("p",)), (("div", "consent"),), (("div", "notice"),), (("form",), ("p",)), (("form",), ("label",)), (("div", "newsletter"), ("form",)),
    (("section", "comments"), ("div", "comment"), ("p",)), (("div", "comments"), ("p",)), (("ol", "comment", "list"), ("li", "comment")), (("div", "related"), ("ul",), ("li",), ("a",)),
    (("section", "comments"), ("h3",)), (("aside",), ("h3",)), (("div", "related"), ("h3",)), (("footer",), ("div",)), (("div", "share"), ("a",)), (("div", "breadcrumb"), ("a",)),
)


def labels_of(blocks: Sequence[Block]) -> np.ndarray:
    """Which blocks are the article's, by structure."""
    is_other = [any(OTHER.intersection(e) and not ARTICLE.intersection(e) for e in b.path) for b in blocks]
    within = [any(e[0] in ARTICLE for e in b.path) for b in blocks]
    return np.array([not o and (w or not any(within)) for o, w in zip(is_other, within, strict=True)], bool)


def variant(blocks: Sequence[Block], labels: np.ndarray, texts: Sequence[str], draw: random.Random) -> tuple[list[Block], np.ndarray]:
    """The page with its article marked up in another way and other blocks put in before, after and at the end of it."""
    markup = draw.choice(ARTICLE_MARKUP)
    out: list[tuple[Block, bool]] = []
    for block, label in zip(blocks, labels.tolist(), strict=True):
        if label:
            inner = next((i for i, e in enumerate(block.path) if e[0] in ARTICLE), len(block.path) - 1)
            within = draw.choice(INNER_MARKUP) if draw.random() < 0.4 else block.path[inner + 1 :]
            block = Block((*block.path[:inner], *markup, *within), block.text, block.linked)
        out.append((block, label))
    first, last = (int(np.flatnonzero(labels)[i]) if labels.any() else 0 for i in (0, -1))
    for _ in range(draw.randrange(1, 5)):
        path = draw.choice(OTHER_MARKUP)
        # Comments and the like may stand within the article's own element.
        around = (("html",), ("body",), *(markup if draw.random() < 0.4 else ()))
        group = []
        for _ in range(draw.randrange(1, 5)):
            text = draw.choice(texts)
            group.append((Block((*around, *path), text, len(text) if path[-1][0] == "a" else 0), False))
        place = draw.choice((0, first, last + 1, len(out)))
        out[place:place] = group
        first, last = (first + len(group) if place <= first else first), (last + len(group) if place <= last else last)
    return [b for b, _ in out], np.array([label for _, label in out], bool)


def _bin(word: str, bins: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % bins


def features(blocks: Sequence[Block]) -> np.ndarray:
    """A row per block."""
    out = np.zeros((len(blocks), FEATURES), np.float32)
    paths: dict[tuple, np.ndarray] = {}
    for i, block in enumerate(blocks):
        known = paths.get(block.path)
        if known is None:
            known = np.zeros(PATH + OWN, np.float32)
            for element in block.path:
                for word in element:
                    known[_bin(f"path {word}", PATH)] = 1
            for depth, element in enumerate(block.path[-2:]):
                for word in element:
                    known[PATH + _bin(f"own {depth - len(block.path[-2:])} {word}", OWN)] = 1
            paths[block.path] = known
        out[i, : PATH + OWN] = known
        words = block.text.lower().split()
        hashed = np.bincount([zlib.crc32(w.encode("utf-8", "replace")) % WORDS for w in words], minlength=WORDS)
        out[i, PATH + OWN : PATH + OWN + WORDS] = np.sqrt(hashed / len(words))
        n = len(block.text)
        out[i, -SHARES:] = (np.log1p(n) / 8, block.linked / n, (i + 1) / len(blocks), block.text[-1] in ".!?", np.log1p(len(words)) / 6, len(block.path) / 10)
    return out


@dataclass
class Labeller:
    """Per direction: input weights, recurrent weights, biases; then the output's weights and bias."""

    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    biases: list[np.ndarray]
    output: np.ndarray
    bias: np.ndarray

    @classmethod
    def untrained(cls) -> Labeller:
        draw = np.random.default_rng(SEED)
        scale = lambda *shape: (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        start = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)  # remember at first
        return cls([scale(FEATURES, 4 * HIDDEN) for _ in "fb"], [scale(HIDDEN, 4 * HIDDEN) for _ in "fb"], [start.copy() for _ in "fb"], scale(2 * HIDDEN, 1), np.zeros(1, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recurrent, *self.biases, self.output, self.bias]

    def _read(self, x: np.ndarray, mask: np.ndarray, way: int, keep: list | None = None) -> np.ndarray:
        """The states of one direction for blocks (time, page, feature); padding passes the state on."""
        steps, pages, _ = x.shape
        given = x.reshape(-1, x.shape[2]) @ self.inputs[way]
        given = given.reshape(steps, pages, -1) + self.biases[way]
        state = cell = np.zeros((pages, HIDDEN), np.float32)
        out = np.empty((steps, pages, HIDDEN), np.float32)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            gates = given[t] + state @ self.recurrent[way]
            take, hold, show = (_sigmoid(gates[:, i * HIDDEN : (i + 1) * HIDDEN]) for i in range(3))
            new = np.tanh(gates[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            after = m * (hold * cell + take * new) + (1 - m) * cell
            shown = np.tanh(after)
            if keep is not None:
                keep.append((t, state, cell, take, hold, show, new, after, shown, m))
            state, cell = m * (show * shown) + (1 - m) * state, after
            out[t] = state
        return out

    def chances(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The chance of each block (time, page) to be the article's."""
        both = np.concatenate([self._read(x, mask, 0), self._read(x, mask, 1)], axis=2)
        return _sigmoid(both @ self.output + self.bias)[..., 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss, in the order of ``parameters``."""
        kept: list[list] = [[], []]
        both = np.concatenate([self._read(x, mask, way, kept[way]) for way in (0, 1)], axis=2)
        error = ((_sigmoid(both @ self.output + self.bias)[..., 0] - y) * mask / mask.sum()).astype(np.float32)
        d_output = np.einsum("tph,tp->h", both, error)[:, None]
        d_inputs, d_recurrent, d_biases = [], [], []
        for way in (0, 1):
            from_above = error[..., None] * self.output[way * HIDDEN : (way + 1) * HIDDEN, 0]
            d_gates_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            d_w = np.zeros_like(self.recurrent[way])
            d_state = d_cell = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, state, cell, take, hold, show, new, _after, shown, m in reversed(kept[way]):
                d_state = d_state + from_above[t]
                d_cell_now = d_cell + d_state * m * show * (1 - shown**2)
                inner = d_cell_now * m
                d_gates = np.concatenate(
                    [
                        inner * new * take * (1 - take),
                        inner * cell * hold * (1 - hold),
                        d_state * m * shown * show * (1 - show),
                        inner * take * (1 - new**2),
                    ],
                    axis=1,
                )
                d_gates_all[t] = d_gates
                d_w += state.T @ d_gates
                d_state = d_gates @ self.recurrent[way].T + d_state * (1 - m)
                d_cell = inner * hold + d_cell_now * (1 - m)
            flat = d_gates_all.reshape(-1, 4 * HIDDEN)
            d_inputs.append(x.reshape(-1, x.shape[2]).T @ flat)
            d_recurrent.append(d_w)
            d_biases.append(flat.sum(axis=0))
        return [*d_inputs, *d_recurrent, *d_biases, d_output, np.array([error.sum()], np.float32)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def side_by_side(pages: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of pages as (time, page, feature), and a mask of what is no padding."""
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), FEATURES), np.float32), np.zeros((steps, len(pages)), np.float32)
    for i, page in enumerate(pages):
        x[: len(page), i], mask[: len(page), i] = page, 1
    return x, mask


def train(pages: Sequence[tuple[list[Block], np.ndarray]], epochs: int = EPOCHS) -> Labeller:
    """A labeller trained on labelled pages and variants of them, always in the same way."""
    model, draw = Labeller.untrained(), random.Random(SEED)
    pages = [(b, y) for b, y in pages if b]
    texts = [b.text for blocks, _ in pages for b in blocks]
    every = list(pages)
    for blocks, labels in pages:
        every += [variant(blocks, labels, texts, draw) for _ in range(VARIANTS)]
    rows = [(features(blocks), labels.astype(np.float32)) for blocks, labels in every]
    parameters = model.parameters()
    mean, square = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    step = 0
    for epoch in range(epochs):
        draw.shuffle(rows)
        rows.sort(key=lambda r: len(r[0]) // 8)  # pages of like length together
        groups = [rows[i : i + 16] for i in range(0, len(rows), 16)]
        draw.shuffle(groups)
        for group in groups:
            x, mask = side_by_side([f for f, _ in group])
            y = np.zeros_like(mask)
            for i, (_, labels) in enumerate(group):
                y[: len(labels), i] = labels
            step += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            for p, g, m, s in zip(parameters, model.gradients(x, mask, y), mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def sample(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> list[tuple[list[Block], np.ndarray]]:
    """The labelled pages to learn from. The ids are chosen first, so that only chosen pages travel."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html")).where("id IS NOT NULL AND html IS NOT NULL")
    chosen = rows.select("id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).distinct().collect()
    wanted = rows.where(F.col("id").isin([r["id"] for r in chosen])).groupBy("id").agg(F.min("html").alias("html"))
    found = [blocks_of(r["html"]) for r in wanted.orderBy(F.xxhash64("id"), "id").collect()]
    return [(blocks, labels_of(blocks)) for blocks in found if blocks]


def label(pages: Sequence[list[Block]], model: Labeller) -> list[np.ndarray]:
    """Which blocks of each page are the article's."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    while order:
        # As many of the longest pages as fit side by side.
        group = [order.pop()]
        while order and (len(group) + 1) * len(pages[group[0]]) <= SIDE_BY_SIDE:
            group.append(order.pop())
        x, mask = side_by_side([features(pages[i]) for i in group])
        chances = model.chances(x, mask)
        for k, i in enumerate(group):
            out[i] = chances[: len(pages[i]), k] >= 0.5
    return out


def extract(pages: DataFrame, model: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, the article's ``text`` and its length in code points, ``n_chars``."""
    sent = pages.sparkSession.sparkContext.broadcast(model)
    frame = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows in slices(whole, "html"):
                found = [blocks_of(page) for page in rows["html"].to_pylist()]
                texts = ["\n".join(b.text for b, is_main in zip(blocks, chosen.tolist(), strict=True) if is_main) for blocks, chosen in zip(found, label(found, sent.value), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows["id"], rows["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"]
                )

    kinds = [frame.schema[c].dataType.simpleString() for c in ("id", "url")]
    schema = f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long"
    return frame.mapInArrow(run, schema).withColumnsRenamed({"id": id_col, "url": url_col})


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(sample(pages)))
