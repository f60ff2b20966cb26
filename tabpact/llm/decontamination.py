"""Benchmark decontamination by edit distance.

A document is contaminated by a benchmark item if some stretch of it can be turned into the item with at
most ``MAX_EDITS`` of the item's code points inserted, deleted or replaced (both in lower case, with one
blank between words): an edit similarity of 0.8 or more.

Candidates come from the CGK embedding: a reader walks over the words of a window; at each step it writes
the word at its place and then goes on to the next word, or not, as a random bit of this step and word
says. Texts that differ by few edits fall out of step at an edit, but soon run side by side again, so their
embeddings have a small Hamming distance. A key is the embedding at a few random steps (bit sampling); there
are ``REPEATS`` walks with ``TABLES`` samples each. Every word of a document starts a window, and every word
of an item starts one as well, if its key carries enough information, so an item is found through any stretch
of it that is little changed. The target is a recall of 0.9 over edits up to the allowed distance, which a test
measures: practically all items with up to a tenth of their code points edited or a fifth of their words replaced,
about 0.9 at 15 % and 0.75 at the very limit, if the edits fall anywhere.

Items that words do not part well are found by pieces instead: those of fewer words than a walk has steps, of more than ``FEW_BLANKS`` characters a word, or
with a tenth of their characters or more from scripts without blanks. Such an item is cut into one piece more than it may have edits, so one of them at least is unchanged,
and the pieces (their first ``PIECE`` characters, if longer) are looked up at every character of every document. Nothing within the allowed edits is missed that way.

Each window of the document that meets an item's window gives a stretch as long as the item plus the
allowed edits at either end; the exact distance of the item to its best part decides.

The keys of the items are sent to all tasks, if the items have ``MAX_ITEM_BYTES`` bytes at most. Larger
benchmarks are dealt to several passes over the documents, each with items up to that size. Documents are
never shuffled or gathered.

Defined cases: a NULL or empty text, or one of blanks only, matches nothing, and so does such an item. An
item without an id has a NULL ``item_id`` in its matches. Items that are equal match each by itself; rows
with one document id are judged each by its own text; ``drop_contaminated`` judges row by row. Empty tables
give no matches. Other columns are not read.
"""

from __future__ import annotations

import random
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import table

MAX_EDITS = 0.2
#: The steps of a walk and how many of them a key samples.
WALK = (6, 2)
#: Items of more characters a word are found by pieces, of which so many characters make a key.
FEW_BLANKS = 12
PIECE = 8
#: Where scripts without blanks begin and end: Thai and Lao, Burmese, Khmer, Kana and Han.
UNSPACED = ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x2E80, 0xA000), (0xF900, 0xFB00), (0x20000, 0x40000))
#: Walks for an item, and tables for a walk, each with its own sample.
REPEATS = 2
TABLES = 8
#: The information that the words of a key must carry, by their frequency among the items; weaker keys meet too
#: much. An item keeps its strongest windows anyhow, so that one of common words is found as well.
KEY_BITS = 22
LEAST = 6
#: The bits of a key that do not choose its place in a table's bitmap.
BITMAP = np.uint64(44)
MAX_ITEM_BYTES = 8_000_000
#: Documents are embedded so many bytes at a time.
BLOCK = 500_000
#: Candidates verified in one go.
SIDE_BY_SIDE = 2_048
AT_ONCE = 16 * SIDE_BY_SIDE
SEED = 42


def normalised(text: bytes | None) -> bytes:
    """In lower case, with one blank between words."""
    return b" ".join((text or b"").decode("utf-8", "replace").lower().encode().split())


def word_codes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def code_points(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)


def _codes(points: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """The place of each character in the alphabet, its length for others."""
    at = np.searchsorted(alphabet, points)
    known = alphabet[np.minimum(at, len(alphabet) - 1)] == points
    return np.where(known, at, len(alphabet)).astype(np.int32)


def word_starts(words: list[bytes], ascii: bool) -> np.ndarray:
    """Where each word begins, in code points, with one blank between words."""
    lengths = map(len, words) if ascii else (len(w.decode("utf-8", "replace")) for w in words)
    ends = np.cumsum(np.fromiter(lengths, np.int64, len(words)) + 1)
    return np.concatenate([[0], ends[:-1]])


def samples(steps: int, sampled: int, walk: int) -> list[list[int]]:
    """The steps that each table of a walk samples."""
    draw = random.Random(f"{SEED} {steps} {walk}")
    return [sorted(draw.sample(range(steps), sampled)) for _ in range(TABLES if steps > 1 else 1)]


def embed(codes: np.ndarray, steps: int, walk: int) -> np.ndarray:
    """The place of the reader at each step, a row per step, for the window that starts at each word.

    ``codes`` ends with ``steps`` words of padding.
    """
    salt = np.uint64(random.Random(f"{SEED} {walk}").getrandbits(64) | 1)
    bits = (codes ^ salt) * np.uint64(0x9E3779B97F4A7C15)
    bits = (bits ^ (bits >> np.uint64(29))).astype(np.uint32)
    at = np.arange(len(codes) - steps, dtype=np.int32)
    places = np.empty((steps, len(at)), np.int32)
    for step in range(steps):
        places[step] = at
        at = at + ((bits[at] >> np.uint32(step)) & np.uint32(1)).astype(np.int32)
    return places


def keys_of(codes: np.ndarray, places: np.ndarray, take: list[int]) -> np.ndarray:
    keys = np.full(places.shape[1], len(take), np.uint64)
    for step in take:
        keys = (keys ^ codes[places[step]]) * np.uint64(0xBF58476D1CE4E5B9)
        keys ^= keys >> np.uint64(31)
    return keys


def by_pieces(points: np.ndarray, words: int) -> bool:
    """Whether words do not part a text well."""
    unspaced = sum(int(((points >= a) & (points < b)).sum()) for a, b in UNSPACED)
    return words < WALK[0] or len(points) > FEW_BLANKS * words or 10 * unspaced >= len(points)


def piece_keys(points: np.ndarray, length: int) -> np.ndarray:
    """The key of the ``length`` characters that begin at each character, as far as there are so many."""
    n = max(0, len(points) - length + 1)
    keys = np.full(n, length, np.uint64)
    for k in range(length if n else 0):
        keys = (keys ^ points[k : k + n]) * np.uint64(0xBF58476D1CE4E5B9)
        keys ^= keys >> np.uint64(31)
    return keys


def edit_distances(items: list[np.ndarray], stretches: list[np.ndarray], n_codes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pair, the smallest edit distance of the item to any part of the stretch, and where the first such part ends.

    Texts are arrays of character codes; ``n_codes`` in a stretch matches nothing. Bit-parallel dynamic programming in words of
    64 rows, all pairs side by side; the items of one call take the same number of words.
    """
    blocks = (len(items[0]) + 63) // 64
    one, zero = np.uint64(1), np.uint64(0)
    equal = np.zeros((len(items), n_codes + 1, blocks), np.uint64)
    for i, item in enumerate(items):
        rows = np.arange(len(item))
        np.bitwise_or.at(equal[i], (item, rows // 64), one << (rows % 64).astype(np.uint64))
    width = max(map(len, stretches))
    codes = np.full((width, len(items)), n_codes, np.int32)
    for i, stretch in enumerate(stretches):
        codes[: len(stretch), i] = stretch
    lengths = np.array([len(x) for x in items])
    high = [np.full(len(items), 1 << 63, np.uint64) for _ in range(blocks - 1)] + [one << ((lengths - 1) % 64).astype(np.uint64)]
    up = [np.full(len(items), 2**64 - 1, np.uint64) for _ in range(blocks)]
    down = [np.zeros(len(items), np.uint64) for _ in range(blocks)]
    score, best, end, each = lengths.copy(), lengths.copy(), np.zeros(len(items), np.int64), np.arange(len(items))
    for j in range(width):
        column = equal[each, codes[j]]
        gained = lost = np.zeros(len(items), np.uint64)
        for k in range(blocks):
            eq, pv, mv = column[:, k], up[k], down[k]
            vertical = eq | mv
            eq = eq | lost
            horizontal = (((eq & pv) + pv) ^ pv) | eq
            gain, loss = mv | ~(horizontal | pv), pv & horizontal
            gained_next, lost_next = (gain & high[k]) != zero, (loss & high[k]) != zero
            gain, loss = (gain << one) | gained, (loss << one) | lost
            up[k], down[k] = loss | ~(vertical | gain), gain & vertical
            gained, lost = gained_next.astype(np.uint64), lost_next.astype(np.uint64)
        score += gained_next
        score -= lost_next
        better = score < best
        best[better], end[better] = score[better], j + 1
    return best, end


@dataclass
class Items:
    """The items of one pass: texts, and the sorted keys with (item, offset) of each, per walk and repetition and per length of pieces."""

    ids: list[int | None]
    texts: list[np.ndarray]
    alphabet: np.ndarray
    tables: dict[tuple[int, int], list[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _chosen(whose: np.ndarray, apart: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The windows of each item that enter a table: the telling ones, but ``LEAST`` of an item at least."""
    out = np.zeros(len(whose), bool)
    for k in np.unique(whose):
        own = np.flatnonzero(whose == k)
        if apart[own].any():
            own = own[apart[own]]
        out[own[bits[own] >= min(KEY_BITS, np.sort(bits[own])[-LEAST:][0])]] = True
    return out


def _bitmap(keys: np.ndarray) -> np.ndarray:
    known = np.zeros(1 << 20, bool)
    known[(keys >> BITMAP).astype(np.int64)] = True
    return known


def _pieces(points: dict[int, np.ndarray], max_edits: float) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per length the bitmap, the sorted keys, and the item and the offset of each."""
    found: dict[int, list[tuple[np.uint64, int, int]]] = {}
    for k, text in points.items():
        cuts = np.linspace(0, len(text), min(len(text), int(max_edits * len(text)) + 1) + 1).astype(int).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            length = min(PIECE, b - a)
            found.setdefault(length, []).append((piece_keys(text[a : a + length], length)[0], k, a))
    tables = {}
    for length, entries in found.items():
        keys, whose, offsets = (np.array(x, t) for x, t in zip(zip(*entries, strict=True), (np.uint64, np.int64, np.int64), strict=True))
        order = np.argsort(keys, kind="stable")
        tables[length] = _bitmap(keys), keys[order], whose[order], offsets[order]
    return tables


def prepare(rows: list[tuple[int | None, bytes]], max_edits: float = MAX_EDITS) -> Items:
    texts = [(i, normalised(t)) for i, t in rows]
    texts = [(i, t) for i, t in texts if t]
    by_walk: dict[tuple[int, int], list[int]] = {}
    words = [t.split() for _, t in texts]
    points = [code_points(t) for _, t in texts]
    cut = {k: p for k, (p, w) in enumerate(zip(points, words, strict=True)) if by_pieces(p, len(w))}
    if len(cut) < len(words):
        by_walk[WALK] = [k for k in range(len(words)) if k not in cut]
    tables = {}
    frequency = Counter(w for ws in words for w in ws)
    vocabulary = {w: i for i, w in enumerate(frequency)}
    information = -np.log2(np.array(list(frequency.values()) or [1]) / max(1, frequency.total()))
    for (steps, sampled), members in by_walk.items():
        whose = np.repeat(members, [len(words[k]) - steps + 1 for k in members])
        codes = [np.append(word_codes(words[k]), np.zeros(steps, np.uint64)) for k in members]
        ranks = [np.append(np.array([vocabulary[w] for w in words[k]]), np.zeros(steps, np.int64)) for k in members]
        starts = [word_starts(words[k], texts[k][1].isascii())[: len(words[k]) - steps + 1] for k in members]
        offsets = np.concatenate(starts)
        for walk in range(REPEATS if steps > 1 else 1):
            places = [embed(c, steps, walk)[:, : len(o)] for c, o in zip(codes, starts, strict=True)]
            for take in samples(steps, sampled, walk):
                keys = np.concatenate([keys_of(c, p, take) for c, p in zip(codes, places, strict=True)])
                # A sample that reads one word twice says too little; other windows and tables have the item.
                apart = np.concatenate([(np.diff(p[take], axis=0) > 0).all(axis=0) for p in places])
                bits = np.concatenate([sum(information[c][p[step]] for step in take) for c, p in zip(ranks, places, strict=True)])
                apart = _chosen(whose, apart, bits)
                order = np.flatnonzero(apart)[np.argsort(keys[apart], kind="stable")]
                tables.setdefault((steps, walk), []).append((take, _bitmap(keys[order]), keys[order], whose[order], offsets[order]))
    alphabet = np.unique(np.concatenate([np.empty(0, np.uint32), *points]))
    return Items([i for i, _ in texts], [np.searchsorted(alphabet, p) for p in points], alphabet, tables, _pieces(cut, max_edits))


_PREPARED: dict[tuple[str, float], Items] = {}


def _prepared(sent: tuple[str, list[tuple[int | None, bytes]]], max_edits: float) -> Items:
    """The tables of the items of a broadcast, made once in a worker, which keeps the last ones only."""
    key = (sent[0], max_edits)
    if key not in _PREPARED:
        _PREPARED.clear()
        _PREPARED[key] = prepare(sent[1], max_edits)
    return _PREPARED[key]


def _sent(part: DataFrame) -> Broadcast[tuple[str, list[tuple[int | None, bytes]]]]:
    """The items of a pass, under a name that is theirs alone."""
    rows = [(r["item"], bytes(r["text"])) for r in part.where("text IS NOT NULL").collect()]
    return part.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, rows))


def _entries(keys: np.ndarray, known: np.ndarray, table_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key that a table has, and its entry there, for all pairs of both."""
    at = np.flatnonzero(known[(keys >> BITMAP).astype(np.int64)])
    first, last = np.searchsorted(table_keys, keys[at], "left"), np.searchsorted(table_keys, keys[at], "right")
    sizes = last - first
    rank = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(at, sizes), np.repeat(first, sizes) + rank


def _meetings(codes: np.ndarray, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word of the documents, item, offset in the item) for windows with equal keys."""
    for (steps, walk), tables in items.tables.items():
        padded = np.append(codes, np.zeros(steps, np.uint64))
        places = embed(padded, steps, walk)
        for take, known, table_keys, whose, offsets in tables:
            keys = keys_of(padded, places, take)
            at, entry = _entries(keys, known, table_keys)
            if len(at):
                yield at, whose[entry], offsets[entry]


def _piece_meetings(docs: list[bytes], items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, item, where the item would begin in it) for pieces that a document holds."""
    apart = np.array([2**32 - 1], np.uint32)  # no character
    points = [np.append(code_points(d), apart) for d in docs]
    ends = np.cumsum([len(p) for p in points])
    every = np.concatenate(points).astype(np.uint64)
    for length, (known, table_keys, whose, offsets) in items.pieces.items():
        at, entry = _entries(piece_keys(every, length), known, table_keys)
        if len(at):
            doc = np.searchsorted(ends, at, "right")
            yield doc, whose[entry], at - np.append(0, ends)[doc] - offsets[entry]


#: A candidate: document, item, where its stretch begins, the stretch's character codes.
Candidate = tuple[int, int, int, np.ndarray]


def candidates_in(docs: list[bytes], items: Items, max_edits: float, before: int = 0) -> list[Candidate]:
    """The stretches of texts in normal form that may hold an item; documents are numbered from ``before``."""
    words = [d.split(b" ") if d else [] for d in docs]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    if not sizes.sum() or not (items.tables or items.pieces):
        return []
    codes = word_codes([w for ws in words for w in ws])
    first_word = np.cumsum(sizes) - sizes
    found = list(_meetings(codes, items))
    by_piece = list(_piece_meetings(docs, items)) if items.pieces else []
    if not found and not by_piece:
        return []
    none = np.empty(0, np.int64)
    word, item, offset = (np.concatenate(x) for x in zip((none, none, none), *found, strict=True))
    doc = np.searchsorted(first_word, word, "right") - 1
    begin = -offset
    starts = {d: word_starts(words[d], docs[d].isascii()) for d in np.unique(doc).tolist()}
    begin += np.fromiter((starts[d][w] for d, w in zip(doc.tolist(), (word - first_word[doc]).tolist(), strict=True)), np.int64, len(doc))
    doc, item, begin = (np.concatenate(x) for x in zip((doc, item, begin), *by_piece, strict=True))
    allowed = (max_edits * np.array([len(t) for t in items.texts])).astype(np.int64)
    # Windows of one place agree on where the item begins, but for the edits: each band is verified once.
    order = np.lexsort((begin, begin // (allowed[item] + 1), item, doc))
    doc, item, begin = doc[order], item[order], begin[order]
    band = np.stack([doc, item, begin // (allowed[item] + 1)])
    first = np.flatnonzero(np.append(True, (band[:, 1:] != band[:, :-1]).any(axis=0)))
    last = np.append(first[1:], len(doc)) - 1
    lengths = np.array([len(t) for t in items.texts])
    doc, item, lo, hi = doc[first], item[first], begin[first], begin[last]
    lo, hi = np.maximum(0, lo - allowed[item]), hi + lengths[item] + allowed[item]
    points = {d: _codes(code_points(docs[d]), items.alphabet) for d in np.unique(doc).tolist()}
    found = zip(doc.tolist(), item.tolist(), lo.tolist(), hi.tolist(), strict=True)
    return [(before + d, k, a, points[d][a:b]) for d, k, a, b in found]


def verified(candidates: list[Candidate], items: Items, max_edits: float) -> list[tuple[int, int, int, int]]:
    """``(document, item, distance, end)``: the best place of each item in each document that is near enough."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    lengths = np.array([len(t) for t in items.texts])
    item = np.array([k for _, k, _, _ in candidates], np.int64)
    sizes = np.array([len(stretch) for *_, stretch in candidates], np.int64)
    blocks = (lengths[item] + 63) // 64
    by_size = np.lexsort((sizes, blocks))
    for group in np.split(by_size, np.flatnonzero(np.diff(blocks[by_size])) + 1):
        for start in range(0, len(group), SIDE_BY_SIDE):
            now = group[start : start + SIDE_BY_SIDE].tolist()
            distances, ends = edit_distances([items.texts[candidates[i][1]] for i in now], [candidates[i][3] for i in now], len(items.alphabet))
            for i, distance, end in zip(now, distances.tolist(), ends.tolist(), strict=True):
                d, k, lo, _ = candidates[i]
                if distance <= int(max_edits * lengths[k]):
                    best[d, k] = min(best.get((d, k), (distance, lo + end)), (distance, lo + end))
    return [(d, k, distance, end) for (d, k), (distance, end) in sorted(best.items())]


def matches_in(docs: list[bytes], items: Items, max_edits: float = MAX_EDITS) -> Iterator[tuple[int, int, int, int]]:
    """``(document, item, distance, end)`` for texts in normal form, a block of texts and some thousand candidates at a time."""
    waiting: list[Candidate] = []
    for start, texts in _blocks(docs):
        waiting += candidates_in(texts, items, max_edits, start)
        if len(waiting) >= AT_ONCE:
            yield from verified(waiting, items, max_edits)
            waiting = []
    if waiting:
        yield from verified(waiting, items, max_edits)


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``BLOCK`` bytes, with the number of texts before."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def item_passes(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[DataFrame]:
    """The items in parts of ``MAX_ITEM_BYTES`` at most, dealt by hash; one part as a rule."""
    rows = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 2 * int(total // MAX_ITEM_BYTES) + 1
    if parts == 1:
        return [rows]
    return [rows.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == p) for p in range(parts)]


MATCH = "doc_id long, item_id long, distance int, end long"


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: float = MAX_EDITS) -> DataFrame:
    """``doc_id``, ``item_id``, edit ``distance`` and ``end`` (in the text's normal form) of the best place per row and item."""
    frame = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def one_pass(part: DataFrame) -> DataFrame:
        sent = _sent(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _prepared(sent.value, max_edits)
            for rows in batches:
                ids = rows["doc"].to_pylist()
                found = list(matches_in([normalised(t) for t in rows["text"].to_pylist()], known, max_edits))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[d] for d, *_ in found], pa.int64()),
                        pa.array([known.ids[k] for _, k, *_ in found], pa.int64()),
                        pa.array([distance for _, _, distance, _ in found], pa.int32()),
                        pa.array([end for *_, end in found], pa.int64()),
                    ],
                    names=["doc_id", "item_id", "distance", "end"],
                )

        return frame.mapInArrow(run, MATCH)

    return reduce(DataFrame.union, [one_pass(p) for p in item_passes(items)])


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", max_edits: float = MAX_EDITS) -> DataFrame:
    """The documents, all columns, without the contaminated ones."""
    for part in item_passes(items):
        sent = _sent(part)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = _prepared(sent.value, max_edits)
            for rows in batches:
                keep = np.ones(rows.num_rows, bool)
                texts = [normalised(t.encode("utf-8", "replace")) if t is not None else b"" for t in rows[text_col].to_pylist()]
                for d, *_ in matches_in(texts, known, max_edits):
                    keep[d] = False
                yield rows.filter(pa.array(keep))

        docs = docs.mapInArrow(run, T.StructType(docs.schema.fields))
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
