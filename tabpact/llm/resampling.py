"""Target-distribution importance resampling with a head-tail vocabulary.

A document's features are its runs of 1 to ``max_run`` consecutive words, each in one of ``buckets`` buckets by its CRC-32. The totals of the buckets over
all documents and over the target texts give each bucket's gain, the logarithm of how much likelier the target is to hold it. A document's weight is the
mean gain of its features; documents are drawn without replacement by the highest weight plus Gumbel noise, which depends on the seed and the id alone.

Words are few that occur often. The head of the vocabulary, every word that makes up a ``HEAD``-th of some part of the corpus and of the whole, is sent to
all tasks with the words' CRC states, and the frequent pairs of such words with their buckets. A run that begins with a head word goes on from its state; a
run that begins with a word of the tail is hashed from its start. Both end in the same bucket, so the totals are exact whatever the head holds; it only saves work.
The head has ``HEAD`` words of ``LONGEST`` bytes and ``HEAD`` pairs at most by its definition, the gains one number a bucket: nothing that is sent grows with the corpus.

What is shuffled are candidates of the head (``HEAD`` a part of ``PART`` tokens at most), one row a bucket and task, and 40 bytes a document. Ranks are given by
ranges of the score, never in one task.

Defined cases: words are runs of 0-9, a-z (A-Z count as a-z) and whatever is not ASCII. A NULL or empty text has no features and weight 0. Without target texts every
target total is 0. Rows with one id share their noise and are drawn each by its own weight; equal scores and ids go by fewer features. A missing id has the noise of
the empty id and comes last among equals. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.sequence import number_rows
from ..staging import stage
from .common import NO_ID, slices, table

BUCKETS = 10_000
#: A word, or a pair of words, is frequent if it makes up such a part of the tokens.
HEAD = 20_000
#: Tokens that a task counts in one go.
PART = 1_000_000
#: Words of more bytes stay in the tail.
LONGEST = 64
SEED = 2024
SHARE = 10
MIN_WORDS = 20

#: Everything but 0-9, a-z and bytes beyond ASCII parts words; A-Z become a-z.
_LETTERS = bytes(c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(256)).lower()


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LETTERS).split()


@dataclass(frozen=True)
class Head:
    """Frequent words with their CRC states, and the buckets of frequent pairs of them by ``place(first) * size + place(second)``, sorted."""

    states: dict[bytes, int]
    pairs: np.ndarray
    pair_buckets: np.ndarray


@dataclass(frozen=True)
class Gains:
    """What weighs a document: the head, and the gain of each bucket."""

    head: Head
    gains: np.ndarray
    max_run: int


class _States(dict):
    """CRC states of words: those of the head are known, others are computed and not kept."""

    def __missing__(self, word: bytes) -> int:
        return zlib.crc32(word)


class Buckets:
    """Turns the words of a text into the buckets of its features."""

    def __init__(self, head: Head, buckets: int, max_run: int) -> None:
        self.states, self.head, self.buckets, self.max_run = _States(head.states), head, buckets, max_run
        self.places = {w: i for i, w in enumerate(head.states)} if max_run > 1 else {}

    def of(self, ws: list[bytes]) -> np.ndarray:
        states = np.fromiter(map(self.states.__getitem__, ws), np.int64, len(ws))
        parts = [states % self.buckets]
        if self.max_run > 1 and len(ws) > 1:
            parts.append(self._pairs(ws, states))
        for run in range(3, min(self.max_run, len(ws)) + 1):
            tails = (b" " + b" ".join(ws[i + 1 : i + run]) for i in range(len(ws) - run + 1))
            parts.append(np.fromiter(map(zlib.crc32, tails, states.tolist()), np.int64, len(ws) - run + 1) % self.buckets)
        return np.concatenate(parts)

    def _pairs(self, ws: list[bytes], states: np.ndarray) -> np.ndarray:
        out, known = np.empty(len(ws) - 1, np.int64), np.zeros(len(ws) - 1, bool)
        if len(self.head.pairs):
            at = np.fromiter((self.places.get(w, -1) for w in ws), np.int64, len(ws))
            keys = at[:-1] * len(self.places) + at[1:]
            found = np.minimum(np.searchsorted(self.head.pairs, keys), len(self.head.pairs) - 1)
            known = (at[:-1] >= 0) & (at[1:] >= 0) & (self.head.pairs[found] == keys)
            out[known] = self.head.pair_buckets[found[known]]
        for i in np.flatnonzero(~known).tolist():
            out[i] = zlib.crc32(b" " + ws[i + 1], int(states[i])) % self.buckets
        return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        yield from slices(rows, "text")


def _text_column(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(text_col).cast("string").cast("binary").alias("text"))


def fit_head(docs: DataFrame, text_col: str = "text", max_run: int = 1, buckets: int = BUCKETS) -> Head:
    """The head of the vocabulary of all texts.

    What makes up a ``HEAD``-th of all tokens does so in some part of the corpus, so parts hand on no others.
    """

    def part(seen: Counter[bytes], tokens: int) -> pa.RecordBatch:
        often = [(w, n) for w, n in seen.items() if n * HEAD >= tokens and len(w) <= 2 * LONGEST + 1]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in often], pa.binary()), pa.array([n for _, n in often], pa.int64())], names=["run", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single: Counter[bytes] = Counter()
        double: Counter[bytes] = Counter()
        tokens = 0
        for rows in _texts(batches):
            for text in rows["text"].to_pylist():
                ws = words(text)
                single.update(ws)
                if max_run > 1:
                    double.update(map(b"%b %b".__mod__, zip(ws, ws[1:])))
                tokens += len(ws)
                if tokens >= PART:
                    yield part(single, tokens)
                    yield part(double, tokens)
                    single, double, tokens = Counter(), Counter(), 0
        yield part(single, tokens)
        yield part(double, tokens)

    tokens = F.coalesce(F.sum(F.when(~F.contains(F.col("run"), F.lit(b" ")), F.col("n"))), F.lit(0))
    counted = stage(_text_column(docs, text_col).mapInArrow(count, "run binary, n long").groupBy("run").agg(F.sum("n").alias("n")), "head")
    total = counted.agg(tokens).first()[0]
    frequent = counted.where(F.col("n") * HEAD >= total).select("run").toPandas()["run"].map(bytes).tolist()
    states = {w: zlib.crc32(w) for w in sorted(frequent) if b" " not in w and len(w) <= LONGEST}
    places = {w: i for i, w in enumerate(states)}
    pairs = sorted((places[a] * len(places) + places[b], zlib.crc32(a + b" " + b) % buckets) for a, b in (w.split() for w in frequent if b" " in w) if a in places and b in places)
    return Head(states, np.array([k for k, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64))


def bucket_totals(docs: DataFrame, head: Head, text_col: str = "text", max_run: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket, exactly."""
    sent = docs.sparkSession.sparkContext.broadcast(head)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, totals = Buckets(sent.value, buckets, max_run), np.zeros(buckets, np.int64)
        for rows in _texts(batches):
            for text in rows["text"].to_pylist():
                if ws := words(text):
                    totals += np.bincount(place.of(ws), minlength=buckets)
        found = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(totals[found])], names=["bucket", "n"])

    rows = _text_column(docs, text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    totals = np.zeros(buckets, np.int64)
    totals[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return totals


def fit(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", max_run: int = 1, buckets: int = BUCKETS) -> Gains:
    """The gains of all buckets, counted over all documents and all target texts."""
    head = fit_head(docs, text_col, max_run, buckets)
    have, want = (bucket_totals(df, head, c, max_run, buckets) for df, c in ((docs, text_col), (target, target_col)))
    all_have, all_want = float(have.sum() + buckets), float(want.sum() + buckets)
    gains = [math.floor(1000 * math.log((t + 1) * all_have / ((s + 1) * all_want))) for s, t in zip(have.tolist(), want.tolist(), strict=True)]
    return Gains(head, np.array(gains, np.int64), max_run)


def weigh(docs: DataFrame, model: Gains, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_words``, ``n_features`` and ``weight`` (the floored mean gain, in thousandths) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        place = Buckets(known.head, len(known.gains), known.max_run)
        for rows in _texts(batches):
            n_words, sizes, weights = [], [], []
            for text in rows["text"].to_pylist():
                ws = words(text)
                at = place.of(ws) if ws else ()
                n_words.append(len(ws))
                sizes.append(len(at))
                weights.append(int(known.gains[at].sum()) // len(at) if ws else 0)
            yield pa.RecordBatch.from_arrays([rows["id"], *(pa.array(x, pa.int64()) for x in (n_words, sizes, weights))], names=["id", "n_words", "n_features", "weight"])

    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = frame.schema["id"].dataType.simpleString()
    return frame.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def resample(weighed: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """The rows of ``weigh`` with their ``score``, and the ``rank`` of the ``share`` percent drawn of those with at least ``min_words`` words."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    noise = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    scored = stage(weighed.withColumn("score", F.col("weight") + gumbel), "scores")
    order = F.struct(F.coalesce(F.col("id"), F.lit(NO_ID)).alias("id"), "n_features")
    long_enough = scored.where(F.col("n_words") >= min_words).select("*", (-F.col("score")).alias("by_score"), order.alias("by_id"))
    ranked, total = number_rows(long_enough, ["by_score", "by_id"], name="place")
    drawn = F.when(F.col("place") <= share * total // 100, F.col("place")).alias("rank")
    others = scored.where(F.col("n_words") < min_words).select("*", F.lit(None).cast("long").alias("rank"))
    return ranked.select(*scored.columns, drawn).unionByName(others)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    drawn = resample(weigh(docs, fit(docs, table(spark, sf_dir, "benchmark"))))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: DuckDB has no CRC-32: its table of 256 entries is built from the polynomial, and a word's bytes are folded over it.
CRC_SQL = """
crc_step AS (SELECT list(list_reduce(list_prepend(i::UBIGINT, list_transform(range(8), lambda k: 0::UBIGINT)),
        lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) ORDER BY i) AS steps FROM range(256) t(i))"""


def crc_sql(hexes: str) -> str:
    """The CRC-32 of a text given as its bytes in hex; ``steps`` of ``CRC_SQL`` must be in scope."""
    octets = f"list_transform(range(0, length({hexes}) // 2), lambda k: ('0x' || substr({hexes}, 2 * k::INT + 1, 2))::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {octets}), lambda c, b: xor(c // 256, steps[(xor(c, b) % 256 + 1)::INT])), 4294967295::UBIGINT)"


OP12_SQL = rf"""
WITH {CRC_SQL.strip()},
doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
item AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
tok AS (SELECT doc_id, unnest(ws) AS w FROM doc),
word AS (SELECT w, sum(s) AS s, sum(t) AS t FROM (SELECT w, 1 AS s, 0 AS t FROM tok UNION ALL SELECT w, 0, 1 FROM item) GROUP BY w),
hexed AS (SELECT w, s, t, hex(encode(w)) AS h FROM word),
placed AS (SELECT w, s, t, ({crc_sql('h')} % 10000)::BIGINT AS bucket FROM hexed, crc_step),
total AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM placed GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS g FROM total),
sums AS (SELECT doc_id, count(*) AS n, sum(g) AS g FROM tok JOIN placed USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
weighed AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight FROM doc LEFT JOIN sums USING (doc_id)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
ranked AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place,
                  count(*) FILTER (n_features >= 20) OVER () AS eligible FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * eligible // 100 THEN place END AS rank FROM ranked
"""
