"""A quality classifier of supervised subword embeddings.

A document's features are its words, its pairs of consecutive words and the runs of ``NGRAMS`` code points within a blank, a word and a blank, each hashed to one of 2^``BITS`` places. Every place
has a learned vector of ``DIM`` numbers; a document is the average of its features' vectors, and a softmax over one linear output per class gives the
chances. Vectors and outputs are learned together by stochastic gradient descent in numpy.

Words are those between blanks, as written: capitals and signs are what tells noise from prose. A word like the one before it is read as a word of its own, "again", which
stands for repetition whatever is repeated.

Learning takes a bounded sample: of each class the documents that win one of ``SAMPLE`` slots by the hash of their id, and of each a stretch of ``SAMPLE_CHARS`` code points from a
place that the hash chooses. That is 8 MB of text for two classes, whatever the size of the input; more than ``MAX_CLASSES`` classes are refused. Documents
of the held-out fold are not learned from. Every whole text is scored.

The output is linear in the average, so scoring needs only each place's contribution to each class, a table of 2^``BITS`` x (classes - 1) numbers that is sent to all tasks.
A text is read in chunks of ``CHUNK`` code points of whole words; a longer word counts as several.

Defined cases: a NULL text, or one without a word, has score 0 for every class but the first: there is nothing in it that speaks for another. Without labels everything has score 0.
With one class, every text with a word has score 1 if it is the class asked for, else 0. Several labels for one id: the highest counts; NULL labels and ids do not. Of several rows with one id, the smallest stretch is
learned from; each is scored by its own text. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import slices, table
from .language import HELD_OUT, fold

BITS = 17
DIM = 16
NGRAMS = (3, 4)
SAMPLE = 2_000
SAMPLE_CHARS = 1_000
MAX_CLASSES = 16
CHUNK = 100_000
EPOCHS = 5
RATE = 20.0
SEED = 11

_BASE = np.uint32(0x01000193)
_SPREAD = np.uint32(0x9E3779B1)
_AGAIN = np.uint32(0xA6A1A6A1)


def _chunks(text: str) -> Iterator[list[str]]:
    """The words of a text, in lists of about ``CHUNK`` code points."""
    words = text.split()
    if len(text) <= CHUNK:
        yield words
        return
    held, size = [], 0
    for word in words:
        for i in range(0, len(word), CHUNK):
            held.append(word[i : i + CHUNK])
            size += len(held[-1]) + 1
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _places(hashes: np.ndarray, salt: int) -> np.ndarray:
    return ((hashes ^ np.uint32(salt)) * _SPREAD) >> np.uint32(32 - BITS)


def _powers(size: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(size, _BASE, np.uint32))


_POWERS = _powers(64)


def features(words: list[str]) -> np.ndarray:
    """The places of all features of some words in a row."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = codes != 32
    out = []
    rolling, inner = codes, None
    for n in range(2, max(NGRAMS) + 1):
        # A run of n code points: the one of n - 1 that starts at its place, and one more. Only its ends may be blanks.
        rolling = rolling[:-1] * _BASE + codes[n - 1 :]
        if n > 2:
            inner = letter[1:-1] if inner is None else inner[:-1] & letter[n - 2 : -1]
        if n in NGRAMS:
            out.append(_places(rolling[inner], n))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    longest = int(sizes.max())
    powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
    hashed = np.add.reduceat(codes[letter] * powers[np.arange(int(sizes.sum())) - np.repeat(starts, sizes)], starts, dtype=np.uint32)
    same = np.concatenate([[False], hashed[1:] == hashed[:-1]])
    hashed = np.where(same, _AGAIN, hashed)
    out += [_places(hashed, 0), _places(hashed[:-1] * _BASE + hashed[1:], 1)]
    return np.concatenate(out)


@dataclass(frozen=True)
class Classifier:
    """The classes, and per place what it adds to each class's output beyond the first class's."""

    classes: list[int]
    table: np.ndarray

    def chances(self, text: str | None) -> np.ndarray:
        """The chance of each class; of a text without a word, the first class's is 1."""
        total, n = np.zeros(self.table.shape[1]), 0
        for words in _chunks(text or ""):
            if words:
                places = features(words)
                total += [column[places].sum(dtype=np.float64) for column in self.table.T]
                n += len(places)
        outputs = np.concatenate([[0.0], total / n]) if n else np.array([0.0] + [-np.inf] * len(total))
        odds = np.exp(outputs - outputs.max())
        return odds / odds.sum()


def train(samples: list[tuple[int, str]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Classifier:
    """Fit on ``(class, text)`` pairs; classes count equally, however many samples they have."""
    classes = sorted({label for label, _ in samples})
    if not classes:
        return Classifier([], np.zeros((1, 0), np.float32))
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    outputs = np.zeros((len(classes), DIM), np.float32)
    read = []
    for label, text in samples:
        found = [features(words) for words in _chunks(text) if words]
        if found:
            places, n = np.unique(np.concatenate(found), return_counts=True)
            read.append((classes.index(label), places, (n / n.sum()).astype(np.float32)))
    sizes = np.bincount([label for label, _, _ in read], minlength=len(classes))
    weights = len(read) / (len(classes) * np.maximum(sizes, 1))
    steps, step = epochs * len(read), 0
    for _ in range(epochs):
        for i in draw.permutation(len(read)).tolist():
            label, places, shares = read[i]
            now = rate * (1 - step / steps) * float(weights[label])
            step += 1
            average = shares @ vectors[places]
            odds = outputs @ average
            odds = np.exp(odds - odds.max())
            slope = odds / odds.sum()
            slope[label] -= 1
            back = slope @ outputs
            # A rate of this size suits the vectors, of which each gets a small share of the slope; the outputs get all of it.
            outputs -= (0.05 * now) * np.outer(slope, average).astype(np.float32)
            vectors[places] -= now * np.outer(shares, back).astype(np.float32)
    return Classifier(classes, vectors @ (outputs[1:] - outputs[0]).T)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Classifier:
    """Learn from the labelled documents outside the held-out fold."""
    known = labels.select(F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("long").alias("label"), fold(id_col).alias("fold"))
    known = known.where(F.col("label").isNotNull() & (F.col("fold") != HELD_OUT)).groupBy("id").agg(F.max("label").alias("label"))
    order = F.xxhash64("id", F.lit("order"))
    slots = known.groupBy("label", F.pmod(F.xxhash64("id"), F.lit(SAMPLE)).alias("slot")).agg(F.min_by("id", F.struct(order, "id")).alias("id"))
    chosen = slots.select("label", "id").limit(MAX_CLASSES * SAMPLE + 1).collect()
    if len({r["label"] for r in chosen}) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in column {label_col!r}")
    wanted = docs.sparkSession.createDataFrame([(r["id"], r["label"]) for r in chosen], "id string, label long")
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(wanted), "id")
    start = F.pmod(F.xxhash64("id", F.lit("start")), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)) + 1
    stretch = F.substring("text", start.cast("int"), F.lit(SAMPLE_CHARS))
    found = rows.select("id", "label", stretch.alias("text")).groupBy("id", "label").agg(F.min("text").alias("text")).collect()
    return train([(r["label"], r["text"]) for r in sorted(found, key=lambda r: r["id"]) if r["text"]])


def score(docs: DataFrame, model: Classifier, wanted: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``score``, the chance of the class ``wanted``, of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        at = known.classes.index(wanted) if wanted in known.classes else None
        for batch in batches:
            for rows in slices(batch, "text"):
                scores = [0.0 if at is None or not t else _chance(known, t, at) for t in rows["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([rows["id"], pa.array(scores, pa.float64())], names=["id", "score"])

    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return frame.mapInArrow(run, f"id {frame.schema['id'].dataType.simpleString()}, score double")


def _chance(model: Classifier, text: bytes, at: int) -> float:
    plain = text.decode("utf-8", "replace")
    return float(model.chances(plain)[at]) if plain.split() else 0.0


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold("id") == HELD_OUT, F.lit(False))
    return scored.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
