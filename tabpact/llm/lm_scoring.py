"""Language-model scoring by cross-entropy difference.

Two word-bigram models share one vocabulary, one order and one smoothing: the target model is counted over all documents labelled good,
the background model over all documents. A document's score is the difference of its per-token losses under the two (target minus background, in nats):
the lower, the more it reads like the good documents rather than like the corpus as a whole.

The vocabulary is every word of the corpus, and every bigram that occurs is counted, exactly. A bigram's probability is
(c(v, w) + STRENGTH p(w)) / (c(v) + STRENGTH), with p(w) = (c(w) + 1) / (N + V) under the same model. So a document's loss is a sum over its bigrams, which needs
c(v, w) and c(w), less a sum over its words, which needs c(v) alone.

Words are counted first, into a table that grows with the vocabulary. Words that make up a ``FREQUENT``-th of all tokens, and bigrams of twice that, ``FREQUENT`` at
most of each by their definition, are counted exactly and sent to all tasks, which sum what concerns them in place. Everything else travels once: a task cuts its documents into chunks of ``HELD_TOKENS`` tokens,
sorts a chunk's bigrams and sends each shard the part that belongs to it, packed: hashes as differences of sorted neighbours, and for each occurrence the
number of its document in the chunk. A shard owns words, with all bigrams that end in them, so it knows c(v, w), c(w) and c(v) of its words without any join;
the bigrams of frequent words are dealt by the bigram. It answers each chunk with a sum per document, and the sums of a chunk meet its documents again. No key that travels makes up more
than two ``FREQUENT``-ths of all tokens, shards have about ``SHARD_TOKENS`` tokens whatever the input, and nothing is collected but the frequent words and bigrams. The ids of the good documents are sent to all
tasks if there are ``MAX_IDS`` at most, else joined. Documents other than the counted ones can be scored as well: they travel beside those. Words are told apart by 64-bit hashes, bigrams by both of theirs.

With a ``vocabulary``, its most frequent words count instead, equal counts by the word, and all others are one unknown word. The models are then two tables of
(``vocabulary`` + 2)^2 numbers that are sent to all tasks and score any document in one pass.

Defined cases: words are those between blanks, A-Z in lower case. A NULL or empty text has no tokens, NULL losses and is not selected. Without good documents the
target model knows nothing and is even over the vocabulary. Several labels for one id: the highest counts; NULL labels and ids do not. Rows with one id are scored each from
its own text, and each counts. A bigram of a scored document that was not counted has a count of 0, a word as well. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..staging import stage
from .common import slices, table

STRENGTH = 10.0
MAX_IDS = 1_000_000
#: Words that make up such a part of all tokens, and bigrams of twice that, are sent to all tasks.
FREQUENT = 100_000
#: Tokens of a chunk.
HELD_TOKENS = 1_500_000
#: Tokens that a shard is meant to own.
SHARD_TOKENS = 1_500_000
#: Bigrams are first counted in so many places, to see which may be frequent.
PLACES = 1 << 20
#: Different words that a task holds before it hands on their counts.
HELD_WORDS = 200_000
UNKNOWN, START = 0, 1


@dataclass(frozen=True)
class Models:
    """The vocabulary with its ids, and per model the loss of each (word before, word), flattened."""

    ids: dict[bytes, int]
    target: np.ndarray
    background: np.ndarray

    @property
    def size(self) -> int:
        return len(self.ids) + 2


@dataclass(frozen=True)
class Counts:
    """Of the counted documents: tokens, different words and, for the words and bigrams that are sent to all tasks, the counts; the last row of ``head`` is the start of a text.

    Every array of counts has a column for the target and one for the background.
    """

    tokens: np.ndarray
    words: int
    hashes: np.ndarray
    head: np.ndarray
    before: np.ndarray
    pairs: np.ndarray
    pair_counts: np.ndarray

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word in the head, -1 for others."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def keys(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The key of a bigram of head words, -1 if one is none; the start of a text stands behind the head."""
        return np.where((before >= 0) & (after >= 0), before * len(self.head) + after, -1)

    def frequent(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among the frequent bigrams, -1 for others."""
        if not len(self.pairs):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, at, -1)

    def above(self, bigrams: np.ndarray, words: np.ndarray) -> np.ndarray:
        """What the count of a bigram and that of its second word add to the loss."""
        return -np.log(bigrams + STRENGTH * (words + 1) / (self.tokens + self.words + 1))  # one more for the unknown word

    @staticmethod
    def below(before: np.ndarray) -> np.ndarray:
        """What the count of a word as the first of a bigram adds to the loss."""
        return np.log(before + STRENGTH)


@dataclass(frozen=True)
class Tables:
    """The counts, and the counted documents themselves, from whose rows everything else is counted while scoring."""

    counts: Counts
    docs: DataFrame
    counted: DataFrame


class _Words(dict):
    """The number of each word of a chunk, in order of appearance; 1 is the start of a text."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + START + 1
        return number

    def hashes(self) -> np.ndarray:
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((UNKNOWN, START, *map(digest, self)), np.uint64, len(self) + START + 1)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        yield from slices(rows, "text")


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` and ``n`` over all texts (``text``, as bytes)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for rows in _texts(batches):
            for text in rows["text"].to_pylist():
                seen.update((text or b"").lower().split())
            if len(seen) > HELD_WORDS:
                yield _counted(seen)
                seen = Counter()
        yield _counted(seen)

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])


def coded(text: bytes | None, ids: dict[bytes, int]) -> np.ndarray:
    words = (text or b"").lower().split()
    return np.fromiter((ids.get(w, UNKNOWN) for w in words), np.int64, len(words))


def pairs(codes: np.ndarray, size: int) -> np.ndarray:
    """The place of each (word before, word) in a model's table."""
    return np.concatenate([[START], codes[:-1]]) * size + codes


def pair_counts(docs: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """``pair``, ``n`` over all documents and ``n_good`` over those with ``good``."""
    sent, size = docs.sparkSession.sparkContext.broadcast(ids), len(ids) + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, good = np.zeros(size * size, np.int64), np.zeros(size * size, np.int64)
        for rows in _texts(batches):
            for text, is_good in zip(rows["text"].to_pylist(), rows["good"].to_pylist(), strict=True):
                codes = coded(text, sent.value)
                if len(codes):
                    found, n = np.unique(pairs(codes, size), return_counts=True)
                    every[found] += n
                    if is_good:
                        good[found] += n
        found = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(every[found]), pa.array(good[found])], names=["pair", "n", "n_good"])

    counts = docs.select("text", "good").mapInArrow(count, "pair long, n long, n_good long")
    return counts.groupBy("pair").agg(F.sum("n").alias("n"), F.sum("n_good").alias("n_good"))


def losses(counts: np.ndarray, size: int) -> np.ndarray:
    """The loss of each (word before, word), from the counts of the pairs."""
    table_of = counts.reshape(size, size).astype(np.float64)
    unigrams = table_of.sum(axis=0) + 1
    unigrams[START] = 0  # never follows
    unigrams /= unigrams.sum()
    chances = (table_of + STRENGTH * unigrams) / (table_of.sum(axis=1, keepdims=True) + STRENGTH)
    with np.errstate(divide="ignore"):
        return -np.log(chances).astype(np.float32).ravel()


def _mixed(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """One number of two hashes, to deal bigrams by."""
    x = (before * np.uint64(0x9E3779B97F4A7C15)) ^ after
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class _Chunk:
    """Some documents in a row: their rows without the text, the tokens of each, the hashes of the different words, and of each token the number of its word, of
    the word before and of its document."""

    rows: pa.Table
    sizes: np.ndarray
    hashes: np.ndarray
    before: np.ndarray
    after: np.ndarray
    doc: np.ndarray

    @property
    def last(self) -> np.ndarray:
        """Whether a token is its document's last."""
        return np.diff(self.doc, append=-1) != 0

    def of(self, column: str) -> np.ndarray:
        """A flag of each document."""
        return self.rows[column].to_numpy().astype(bool)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    words, held, tokens = _Words(), [], 0

    def chunk() -> _Chunk:
        rows, sizes, after = zip(*held)
        sizes, after = np.concatenate(sizes), np.concatenate(after)
        before = np.empty_like(after)
        before[1:] = after[:-1]
        before[(np.cumsum(sizes) - sizes)[sizes > 0]] = START
        return _Chunk(pa.Table.from_batches(rows), sizes, words.hashes(), before, after, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes))

    for rows in _texts(batches):
        split = [(t or b"").lower().split() for t in rows["text"].to_pylist()]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        after = np.fromiter(map(words.__getitem__, chain.from_iterable(split)), np.int32, int(sizes.sum()))
        held.append((rows.drop_columns(["text"]), sizes, after))
        tokens += len(after)
        if tokens >= HELD_TOKENS:
            yield chunk()
            words, held, tokens = _Words(), [], 0
    if held:
        yield chunk()


def _starts(*ordered: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins, in sorted columns."""
    if not len(ordered[0]):
        return np.empty(0, np.int64)
    changes = np.zeros(len(ordered[0]), bool)
    changes[0] = True
    for column in ordered:
        changes[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(changes)


COUNTED = "pair boolean, v long, w long, n long, good long, ends long, good_ends long"


def word_table(docs: DataFrame) -> DataFrame:
    """Of every word ``w`` how often it occurs, in good documents, and as the last of a text; with ``pair`` set, of bigrams that are frequent in some chunk a lower bound.

    What makes up some part of all tokens does so in some chunk.
    """

    names = [c.split()[0] for c in COUNTED.split(", ")]

    def rows(pair: bool, v: np.ndarray, w: np.ndarray, n: np.ndarray, *flags: np.ndarray) -> pa.RecordBatch:
        counts = [x.astype(np.int64) for x in (n, *flags)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(w), pair)), *map(pa.array, (v.view(np.int64), w.view(np.int64), *counts))], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            if not len(chunk.after):
                continue
            good, last = chunk.of("good")[chunk.doc], chunk.last
            size = len(chunk.hashes)
            n, *flags = (np.bincount(chunk.after[x], minlength=size)[START + 1 :] for x in (slice(None), good, last, good & last))
            yield rows(False, np.zeros(len(n), np.uint64), chunk.hashes[START + 1 :], n, *flags)
            # A bigram is no more frequent than its place among few, so only those in frequent places are sorted.
            place = (_mixed(chunk.before.astype(np.uint64), chunk.after.astype(np.uint64)) % np.uint64(PLACES)).astype(np.int32)
            left = np.flatnonzero((np.bincount(place, minlength=PLACES) * FREQUENT >= len(place))[place])
            key = np.sort(chunk.before[left].astype(np.int64) * size + chunk.after[left])
            starts = _starts(key)
            n = np.diff(starts, append=len(key))
            often = n * FREQUENT >= len(place)
            key, n = key[starts][often], n[often]
            yield rows(True, chunk.hashes[key // size], chunk.hashes[key % size], n, *[np.zeros(len(n))] * 3)

    sums = [F.sum(c).alias(c) for c in ("n", "good", "ends", "good_ends")]
    return docs.select("text", "good").mapInArrow(count, COUNTED).groupBy("pair", "v", "w").agg(*sums)


def count_head(docs: DataFrame) -> Counts:
    """The counts that are sent to all tasks, from rows with ``text`` and ``good``."""
    spark = docs.sparkSession
    words = stage(word_table(docs), "words")
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "good", "ends", "good_ends")]
    different, tokens, good, ends, good_ends = words.where("NOT pair").agg(F.count(F.lit(1)), *sums).first()
    often = words.where(F.col("n") * FREQUENT >= tokens).toPandas()
    single, double = often[~often["pair"]], often[often["pair"]]
    hashes = single["w"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    of = lambda *names: np.stack([single[c].to_numpy(np.float64)[order] for c in names], axis=1)
    every, last = of("good", "n"), of("good_ends", "ends")
    start = np.array([[good_ends, ends]], np.float64)
    head, before = np.concatenate([every, start]), np.concatenate([every - last, start])
    bare = Counts(np.array([good, tokens], np.float64), different, hashes[order], head, before, np.empty(0, np.int64), np.empty((0, 2)))
    v, w = (double[c].to_numpy(np.int64).view(np.uint64) for c in ("v", "w"))
    keys = np.sort(bare.keys(np.where(v == START, len(hashes), bare.places(v)), bare.places(w)))
    keys = keys[keys >= 0]
    sent = spark.sparkContext.broadcast(Counts(bare.tokens, different, bare.hashes, head, before, keys, np.empty((0, 2))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        n = np.zeros((len(known.pairs), 2), np.int64)
        for chunk in _chunks(batches) if len(known.pairs) else ():
            places = _word_places(known, chunk)
            keys = known.keys(places[chunk.before], places[chunk.after])
            both = np.flatnonzero(keys >= 0)
            at = known.frequent(keys[both])
            both, at = both[at >= 0], at[at >= 0]
            n[:, 1] += np.bincount(at, minlength=len(n))
            n[:, 0] += np.bincount(at[chunk.of("good")[chunk.doc[both]]], minlength=len(n))
        found = np.flatnonzero(n[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n[found, 0]), pa.array(n[found, 1])], names=["place", "good", "n"])

    counted = docs.select("text", "good").mapInArrow(count, "place long, good long, n long").groupBy("place").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).toPandas()
    pair_counts = np.zeros((len(keys), 2))
    pair_counts[counted["place"].to_numpy(np.int64)] = counted[["good", "n"]].to_numpy(np.float64)
    return Counts(bare.tokens, different, bare.hashes, head, before, keys, pair_counts)


def _word_places(known: Counts, chunk: _Chunk) -> np.ndarray:
    """The place in the head of each different word of a chunk, -1 for others."""
    places = known.places(chunk.hashes)
    places[START] = len(known.hashes)
    return places


def _pack(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes, so that those which hold little shrink."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(blob: bytes, kind: type, size: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, size)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind) if size else np.empty(0, kind)


#: The bits of an occurrence below its document's number in the chunk.
GOOD, IS_COUNTED, IS_SCORED, LAST, BITS = 1, 2, 4, 8, 4
PACKED = "parts array<binary>, sizes array<long>"
ANSWER = "at array<long>, target array<double>, background array<double>"


def _parcels(x: np.ndarray, v: np.ndarray, places: np.ndarray, heads: np.ndarray, codes: np.ndarray, shards: int) -> Iterator[tuple[int, list[bytes], list[int]]]:
    """What each shard gets of a chunk. ``x`` is what a bigram is dealt by: the hash of its second word, or of the bigram if that is in the head, at ``heads``;
    its first word is the hash ``v``, or a place in the head."""
    # Sorted by most of x and some of v: equal bigrams are neighbours, but for a rare stranger in between, which costs a second entry.
    order = np.argsort((x & np.uint64(0xFFFFFFFFFF000000)) | (v >> np.uint64(40)), kind="stable")
    x, v, places, heads, codes = (c[order] for c in (x, v, places, heads, codes))
    shard = ((x >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    every = _starts(x, v, heads)
    cuts = _starts(shard)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(x)]):
        pairs = every[np.searchsorted(every, a) : np.searchsorted(every, b)]
        groups = _starts(x[pairs])
        tail = places[pairs] < 0
        arrays = [
            np.diff(x[pairs][groups], prepend=np.uint64(0)),
            np.diff(groups, append=len(pairs)).astype(np.uint32),
            (places[pairs] + 1).astype(np.uint32),
            v[pairs][tail],
            (heads[pairs] + 1).astype(np.uint32),
            np.diff(pairs, append=b).astype(np.uint32),
            codes[a:b],
        ]
        yield int(shard[a]), [_pack(c) for c in arrays], [len(c) for c in arrays]


@dataclass(frozen=True)
class _Parcel:
    x: np.ndarray
    places: np.ndarray
    rest: np.ndarray
    heads: np.ndarray
    pair: np.ndarray
    codes: np.ndarray


def _opened(parts: list[bytes], sizes: list[int]) -> _Parcel:
    kinds = (np.uint64, np.uint32, np.uint32, np.uint64, np.uint32, np.uint32, np.uint32)
    steps, grouped, places, tails, heads, times, codes = (_unpack(p, k, n) for p, k, n in zip(parts, kinds, sizes, strict=True))
    places = places.astype(np.int64) - 1
    rest = np.zeros(len(places), np.uint64)
    rest[places < 0] = tails
    return _Parcel(np.repeat(np.cumsum(steps, dtype=np.uint64), grouped), places, rest, heads.astype(np.int64) - 1, np.repeat(np.arange(len(places)), times), codes)


def _send(docs: DataFrame, counts: Counts, shards: int) -> DataFrame:
    """Per chunk and shard a parcel, and per chunk a row with its documents and what was summed in place, which goes to some shard as well."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task = sent.value, TaskContext.get().partitionId()
        for number, chunk in enumerate(_chunks(batches)):
            name = (task << 32) + number
            scored, counted, good = (chunk.of(c) for c in ("scored", "counted", "good"))
            places = _word_places(known, chunk).astype(np.int32)
            before, after = places[chunk.before], places[chunk.after]
            keys = known.keys(before.astype(np.int64), after)
            at, both = np.full(len(keys), -1, np.int32), np.flatnonzero(keys >= 0)
            at[both] = known.frequent(keys[both])
            del keys, both
            sums = np.zeros((len(chunk.sizes), 2))
            here, hit = before >= 0, at >= 0
            below, above = known.below(known.before), known.above(known.pair_counts[at[hit]], known.head[after[hit]])
            for model in (0, 1):
                sums[:, model] += np.bincount(chunk.doc[here], below[before[here], model], len(sums))
                sums[:, model] += np.bincount(chunk.doc[hit], above[:, model], len(sums))
            left = np.flatnonzero(~hit & (scored | counted)[chunk.doc])
            flags = (good & counted) * GOOD + counted * IS_COUNTED + scored * IS_SCORED
            codes = ((chunk.doc << BITS) + flags[chunk.doc] + chunk.last * LAST).astype(np.uint32)
            v, w = chunk.hashes[chunk.before[left]], chunk.hashes[chunk.after[left]]
            x = np.where(after[left] >= 0, _mixed(v, w), w)
            for shard, parts, sizes in _parcels(x, v, before[left], after[left], codes[left], shards):
                yield _row(shard, name, None, None, parts, sizes, None, None, None)
            yield _row(name % shards, name, chunk.rows["id"].combine_chunks().filter(pa.array(scored)), chunk.sizes[scored], None, None, np.flatnonzero(scored), *sums[scored].T)

    def _row(shard, name, ids, tokens, parts, sizes, at, target, background) -> pa.RecordBatch:
        list_of = lambda values, kind: pa.array([None if values is None else values], pa.list_(kind))
        ids = pa.nulls(1, pa.list_(id_type)) if ids is None else pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        arrays = [
            pa.array([shard], pa.int64()),
            pa.array([name], pa.int64()),
            ids,
            list_of(tokens, pa.int64()),
            list_of(parts, pa.binary()),
            list_of(sizes, pa.int64()),
            list_of(at, pa.int64()),
            list_of(target, pa.float64()),
            list_of(background, pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["shard", "chunk", "ids", "tokens", "parts", "sizes", "at", "target", "background"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema["id"].dataType)
    return docs.mapInArrow(run, f"shard long, chunk long, ids array<{kind}>, tokens array<long>, {PACKED}, {ANSWER}")


def _alike(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, int]:
    """The number of each row's run of equal rows, and how many runs there are. Equal rows have equal keys; should others share one, all columns are sorted."""
    order = np.argsort(key, kind="stable")
    starts = _starts(*(c[order] for c in columns))
    if len(starts) != len(_starts(key[order])):
        order = np.lexsort(columns)
        starts = _starts(*(c[order] for c in columns))
    number = np.empty(len(key), np.int64)
    number[order] = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(key)))
    return number, len(starts)


def _answers(counts: Counts, parcels: list[_Parcel]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per parcel the documents that occur in it and are scored, and what they get of it under each model."""
    x, places, rest, heads = (np.concatenate([getattr(p, c) for p in parcels]) for c in ("x", "places", "rest", "heads"))
    ends = np.cumsum([len(p.x) for p in parcels])
    n = np.empty((len(x), 4))
    for p, end in zip(parcels, ends.tolist()):
        own = slice(end - len(p.x), end)
        counted, good, going_on = p.codes & IS_COUNTED > 0, p.codes & GOOD > 0, p.codes & LAST == 0
        for column, flag in enumerate((good, counted, good & going_on, counted & going_on)):
            n[own, column] = np.bincount(p.pair[flag], minlength=len(p.x))
    pair_of, pairs = _alike(_mixed(x, rest ^ (places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (heads.astype(np.uint64) << np.uint64(40))), x, heads, places, rest)
    group_of, groups = _alike(x ^ (heads.astype(np.uint64) << np.uint64(40)), x, heads)
    bigrams = np.stack([np.bincount(pair_of, n[:, k], pairs) for k in (0, 1)], axis=1)
    words = np.stack([np.bincount(group_of, n[:, k], groups) for k in range(4)], axis=1)
    in_head = heads >= 0
    word_counts = np.where(in_head[:, None], counts.head[heads], words[group_of][:, :2])
    above = counts.above(bigrams[pair_of], word_counts)
    # What a word adds as the first of a bigram is known here as well, unless it is in the head: then the sender knew it.
    below = np.where(in_head[:, None], 0.0, counts.below(words[group_of][:, 2:]))
    out = []
    for p, end in zip(parcels, ends.tolist()):
        own = slice(end - len(p.x), end)
        scored = p.codes & IS_SCORED > 0
        pair, going_on = p.pair[scored], (p.codes[scored] & LAST == 0)[:, None]
        docs, place = np.unique(p.codes[scored] >> BITS, return_inverse=True)
        given = above[own][pair] + below[own][pair] * going_on
        out.append((docs, np.stack([np.bincount(place, given[:, k], len(docs)) for k in (0, 1)])))
    return out


def _at_shard(sent: Broadcast[Counts]) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        is_parcel = rows["parts"].is_valid()
        parcels = rows.filter(is_parcel).select(["chunk", "parts", "sizes"])
        passed = rows.filter(rows["parts"].is_null()).select(["chunk", "ids", "tokens", "at", "target", "background"])
        if not parcels.num_rows:
            return passed
        found = _answers(sent.value, [_opened(p, s) for p, s in zip(parcels["parts"].to_pylist(), parcels["sizes"].to_pylist(), strict=True)])
        column = lambda values, kind: pa.array(values, pa.list_(kind))
        answers = pa.table(
            {
                "chunk": parcels["chunk"],
                "ids": pa.nulls(len(found), passed.schema.field("ids").type),
                "tokens": pa.nulls(len(found), passed.schema.field("tokens").type),
                "at": column([docs for docs, _ in found], pa.int64()),
                "target": column([sums[0] for _, sums in found], pa.float64()),
                "background": column([sums[1] for _, sums in found], pa.float64()),
            }
        )
        return pa.concat_tables([passed, answers.cast(passed.schema)])

    return run


def _met(rows: pa.Table) -> pa.Table:
    """The documents of a chunk with their losses per token."""
    own = rows.filter(rows["ids"].is_valid())
    places, tokens = (own[c].combine_chunks().flatten().to_numpy() for c in ("at", "tokens"))
    size = int(places.max(initial=-1)) + 1
    out = {}
    at = rows["at"].combine_chunks().flatten().to_numpy()
    for name in ("target", "background"):
        sums = np.bincount(at, rows[name].combine_chunks().flatten().to_numpy(), size)[places]
        out[f"loss_{name}"] = pa.array(np.where(tokens > 0, sums / np.maximum(tokens, 1), 0.0), mask=tokens == 0)
    return pa.table({"id": own["ids"].combine_chunks().flatten(), "n_tokens": pa.array(tokens), **out})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", vocabulary: int | None = None) -> Models | Tables:
    """Both models, counted over all documents."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    good = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct().withColumn("good", F.lit(True))
    few = good.limit(MAX_IDS + 1).count() <= MAX_IDS
    labelled = rows.join(F.broadcast(good) if few else good, "id", "left").withColumn("good", F.coalesce("good", F.lit(False)))
    if vocabulary is None:
        if not few:
            # A task that runs again must see its rows in the same order.
            labelled = labelled.sortWithinPartitions("id", F.xxhash64("text"))
        return Tables(count_head(labelled), docs, labelled)
    words = word_counts(rows).orderBy(F.desc("n"), "word").limit(vocabulary).collect()
    ids = {bytes(r["word"]): i + 2 for i, r in enumerate(words)}
    counted = pair_counts(labelled, ids).toPandas()
    size = len(ids) + 2
    tables = []
    for name in ("n_good", "n"):
        tables.append(np.zeros(size * size, np.int64))
        tables[-1][counted["pair"].to_numpy(np.int64)] = counted[name].to_numpy(np.int64)
    return Models(ids, *[losses(t, size) for t in tables])


def score_tables(docs: DataFrame, models: Tables, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``score``, with every word and bigram of the counted documents."""
    flag = lambda **flags: [F.lit(value).alias(name) for name, value in flags.items()]
    if docs is models.docs:
        rows = models.counted.select("id", "text", "good", *flag(counted=True, scored=True))
    else:
        others = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
        rows = models.counted.select("id", "text", "good", *flag(counted=True, scored=False)).unionByName(others.select("id", "text", *flag(good=False, counted=False, scored=True)))
    counts = models.counts
    shards = int(counts.tokens[1]) // SHARD_TOKENS + 1
    kind = rows.schema["id"].dataType.simpleString()
    at_shard = _send(rows, counts, shards).groupBy("shard").applyInArrow(_at_shard(docs.sparkSession.sparkContext.broadcast(counts)), f"chunk long, ids array<{kind}>, tokens array<long>, {ANSWER}")
    losses = at_shard.groupBy("chunk").applyInArrow(lambda rows: _met(rows), f"id {kind}, n_tokens long, loss_target double, loss_background double")
    gap = F.col("loss_target") - F.col("loss_background")
    return losses.select(F.col("id").alias(id_col), "n_tokens", "loss_target", "loss_background", gap.alias("loss_difference"), F.coalesce(gap < 0, F.lit(False)).alias("selected"))


def score(docs: DataFrame, models: Models | Tables, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, per-token ``loss_target`` and ``loss_background``, their ``loss_difference``, and ``selected`` where it is below zero."""
    if isinstance(models, Tables):
        return score_tables(docs, models, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for rows in _texts(batches):
            tokens, by_target, by_background = [], [], []
            for text in rows["text"].to_pylist():
                codes = coded(text, known.ids)
                tokens.append(len(codes))
                at = pairs(codes, known.size) if len(codes) else codes
                for out, model in ((by_target, known.target), (by_background, known.background)):
                    out.append(float(model[at].mean(dtype=np.float64)) if len(codes) else None)
            gap = [None if a is None else a - b for a, b in zip(by_target, by_background, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    rows["id"],
                    pa.array(tokens, pa.int64()),
                    *[pa.array(x, pa.float64()) for x in (by_target, by_background, gap)],
                    pa.array([g is not None and g < 0 for g in gap], pa.bool_()),
                ],
                names=["id", "n_tokens", "loss_target", "loss_background", "loss_difference", "selected"],
            )

    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = frame.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, loss_target double, loss_background double, loss_difference double, selected boolean"
    return frame.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
