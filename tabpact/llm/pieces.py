"""SentencePiece encoding and decoding, with giant documents encoded in parallel.

The model is a file of byte-pair pieces with byte fallback. Its encoding of a text is the one sequence of
pieces in which every two neighbours are stable: encoded by themselves, the two come out as they are. So the
encoding is a best path in the max-plus sense: a step from one piece to the next weighs minus the pieces that
it adds if the two are stable, and minus infinity otherwise; one path from start to end is finite.

A document of more than ``CHUNK`` code points is cut into chunks, anywhere. The state at a chunk's boundary is
the last cut at or before it and the piece that ends there. A chunk's transfer matrix holds the weight from each
state at its left boundary to each state at its right one. The matrices are combined associatively, first in blocks
of ``BLOCK`` chunks and then over the blocks, which tells the states on the finite path at each boundary; then each
chunk is traced back by itself. Chunks of one document are so encoded by many tasks, and only matrices of a few entries
meet in one. No piece goes on over a blank that follows another character, so at such an edge the states collapse to one,
and the stretch between a chunk's first and last edge is encoded once, by the library; states without an edge between
them, in text without blanks, are followed place by place.

Ids are those of the library for this model. One difference is on purpose: U+2581, with which the model writes a
blank, is encoded as bytes where a text has it, so that decoding gives back every text exactly.

Defined cases: a NULL or empty text has no pieces; a NULL decodes to a NULL. Rows with one id are encoded each from its own text. The
order of rows is not kept. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from sentencepiece import sentencepiece_model_pb2

from ..staging import stage
from .common import slices, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Pairs of pieces that a worker remembers.
HELD_PAIRS = 1_000_000
#: Rows that are decoded in one go.
AT_ONCE = 256
CHUNK = 32_768
BLOCK = 256
BLANK = "▁"
BYTE = 6  # fixed value: the model's type of a byte piece

State = tuple[int, int]  # the place of a cut in the document, the piece that ends there
START, EDGE, OTHER = -1, -2, -3  # instead of a piece: none yet, any at an edge, a character in bytes
Matrix = list[tuple[State, State, int]]

_EDGE = re.compile("[^ ](?= )")


def read_model(path: str = MODEL) -> bytes:
    """The model without its rule to put a blank before a text, which is done here."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    spec = model.normalizer_spec
    if spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not model.trainer_spec.byte_fallback:
        raise ValueError(f"{path} is not a model with byte fallback that leaves texts as they are")
    spec.add_dummy_prefix = False
    return model.SerializeToString()


class Pieces:
    """A model and what has been learned of its pieces."""

    def __init__(self, model: bytes):
        parsed = sentencepiece_model_pb2.ModelProto()
        parsed.ParseFromString(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids, self.bytes_of, self.byte_ids = {}, [], {}
        for i, piece in enumerate(parsed.pieces):
            if piece.type == BYTE:
                value = int(piece.piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            else:
                plain = piece.piece.replace(BLANK, " ")
                if piece.type == 1:
                    self.ids[plain] = i
                self.bytes_of.append(plain.encode() if piece.type == 1 else b"")
        self.texts = {i: t for t, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self._stable: dict[tuple[int, int], bool] = {}

    def plain(self, texts: Sequence[str]) -> list[list[int]]:
        """Texts encoded by themselves, by the library."""
        if not any(BLANK in t for t in texts):
            return self.library.encode(list(texts), num_threads=1)
        parts = [t.split(BLANK) for t in texts]
        found = iter(self.library.encode([p for ps in parts for p in ps], num_threads=1))
        literal = self.other(BLANK)
        out = []
        for ps in parts:
            ids = next(found)
            for _ in ps[1:]:
                ids = ids + literal + next(found)
            out.append(ids)
        return out

    def other(self, character: str) -> list[int]:
        return [self.byte_ids[b] for b in character.encode("utf-8", "replace")]

    def stable(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return True
        key = (a, b)
        if len(self._stable) > HELD_PAIRS:
            self._stable.clear()
        if key not in self._stable:
            self._stable[key] = self.library.encode(self.texts[a] + self.texts[b]) == [a, b]
        return self._stable[key]

    def follow(self, text: str, at: int, piece: int, end: int, known: dict | None = None) -> dict[int, tuple[int, int, int]]:
        """For each place up to ``end`` that a path from a cut reaches: where its last piece starts, the piece, all pieces so far.

        ``known`` is the result for another cut: once two paths agree over the longest piece, they agree for good.
        """
        reached = {at: (at, piece, 0)}
        agreed = 0
        for q in range(at + 1, end + 1):
            for r in range(max(at, q - self.longest), q):
                if r in reached:
                    found = self.ids.get(text[r:q], OTHER if q - r == 1 else None)
                    if found is not None and self.stable(reached[r][1], found):
                        added = 1 if found >= 0 else len(text[r:q].encode("utf-8", "replace"))
                        reached[q] = (r, found, reached[r][2] + added)
                        break
            if known is not None:
                # The starts must lie within the agreed places, so that counts differ by a constant.
                agreed = agreed + 1 if q in reached and q in known and reached[q][:2] == known[q][:2] else 0
                if agreed > 2 * self.longest:
                    more = reached[q][2] - known[q][2]
                    reached.update({p: (r, i, n + more) for p, (r, i, n) in known.items() if p > q})
                    break
        return reached

    def back(self, reached: dict[int, tuple[int, int, int]], text: str, at: int, end: int) -> list[int]:
        """The ids of the path that ends at a place."""
        found: list[list[int]] = []
        while end > at:
            start, piece, _ = reached[end]
            found.append([piece] if piece >= 0 else self.other(text[start:end]))
            end = start
        return [i for ids in reversed(found) for i in ids]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    # One chunk. ``text`` holds the chunk and some context before it; it starts at place ``base`` of the document,
    # and the chunk is [left, right) in places of the document. The last chunk's right boundary is the document's end.

    def _edges(self, text: str, lo: int, hi: int) -> tuple[int, int] | None:
        """The first and the last edge at or after ``lo`` and before ``hi``."""
        found = [m.end() for m in _EDGE.finditer(text, max(0, lo - 1), hi)]
        return (found[0], found[-1]) if found else None

    def states(self, text: str, base: int, boundary: int) -> list[State]:
        """All states that a path may have at a boundary within the document."""
        b = boundary - base
        edges = self._edges(text, b - self.longest + 1, b)
        low = edges[1] if edges else max(0, b - self.longest + 1)
        found = [(low + base, EDGE)] if edges else []
        for p in range(low + 1 if edges else low, b + 1):
            for r in range(max(low if edges else 0, p - self.longest), p):
                i = self.ids.get(text[r:p], OTHER if p - r == 1 else None)
                if i is not None:
                    found.append((p + base, i))
        return found

    def _exits(self, text: str, base: int, right: int, last: bool, start: int, reached: dict) -> list[tuple[State, int]]:
        """The states at the right boundary that a followed path has, with its pieces."""
        b = right - base
        if last:
            return [((right, EDGE), reached[b][2])] if b in reached else []
        edges = self._edges(text, b - self.longest + 1, b)
        low = edges[1] if edges else b - self.longest + 1
        return [
            ((p + base, EDGE if edges and p == low else reached[p][1]), reached[p][2]) for p in range(max(low, start), b + 1) if p in reached
        ]

    def _follow_all(self, text: str, base: int, left: int, right: int, entries: list[State]):
        """What all states share: the first and the last edge; and each state's path up to the first one or the right boundary."""
        edges = self._edges(text, left - base, right - base)
        known, paths = None, {}
        for p, piece in entries:
            reached = self.follow(text, p - base, piece, edges[0] if edges else right - base, known)
            known = known or reached
            paths[p, piece] = reached
        return edges, paths

    def transfer(self, text: str, base: int, left: int, right: int, last: bool) -> Matrix:
        """The finite entries of a chunk's matrix."""
        entries = [(0, START)] if left == 0 else self.states(text, base, left)
        edges, paths = self._follow_all(text, base, left, right, entries)
        if not edges:
            return [(s, t, -n) for s, reached in paths.items() for t, n in self._exits(text, base, right, last, s[0] - base, reached)]
        middle = len(self.plain([text[edges[0] : edges[1]]])[0])
        tail = self.follow(text, edges[1], EDGE, right - base)
        exits = self._exits(text, base, right, last, edges[1], tail)
        return [(s, t, -(reached[edges[0]][2] + middle + n)) for s, reached in paths.items() if edges[0] in reached for t, n in exits]

    def trace(self, text: str, base: int, left: int, right: int, last: bool, entry: State, leave: State) -> list[int]:
        """The ids from one state to another."""
        edges, paths = self._follow_all(text, base, left, right, [entry])
        reached, at, end = paths[entry], entry[0] - base, leave[0] - base
        if not edges:
            return self.back(reached, text, at, end)
        head = self.back(reached, text, at, edges[0])
        tail = self.follow(text, edges[1], EDGE, end)
        return head + self.plain([text[edges[0] : edges[1]]])[0] + self.back(tail, text, edges[1], end)


def product(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product of two matrices with finite entries only."""
    after: dict[State, list[tuple[State, int]]] = {}
    for s, t, w in b:
        after.setdefault(s, []).append((t, w))
    best: dict[tuple[State, State], int] = {}
    for s, mid, w in a:
        for t, more in after.get(mid, ()):
            if w + more > best.get((s, t), -(2**62)):
                best[s, t] = w + more
    return [(s, t, w) for (s, t), w in best.items()]


def best_states(matrices: list[Matrix], entry: State, leave: State) -> list[State]:
    """The states at all boundaries of the best path from one state to another."""
    forward = [{entry: 0}]
    for matrix in matrices:
        step: dict[State, int] = {}
        for s, t, w in matrix:
            if s in forward[-1]:
                step[t] = max(step.get(t, -(2**62)), forward[-1][s] + w)
        forward.append(step)
    states = [leave]
    for matrix, before in zip(reversed(matrices), reversed(forward[:-1]), strict=True):
        states.append(max(((before[s] + w, s) for s, t, w in matrix if t == states[-1] and s in before))[1])
    return states[::-1]


def _matrix_rows(matrix: Matrix) -> list[dict]:
    return [{"at": s[0], "piece": s[1], "to_at": t[0], "to_piece": t[1], "weight": w} for s, t, w in matrix]


def _matrix(rows: list[dict]) -> Matrix:
    return [((r["at"], r["piece"]), (r["to_at"], r["to_piece"]), r["weight"]) for r in rows]


MATRIX = "array<struct<at:long, piece:int, to_at:long, to_piece:int, weight:long>>"
CHUNKS = "row long, no long, base long, left long, right long, last boolean, text string"
ARROW_MATRIX = pa.list_(pa.struct([("at", pa.int64()), ("piece", pa.int32()), ("to_at", pa.int64()), ("to_piece", pa.int32()), ("weight", pa.int64())]))


def _parts(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    return chain.from_iterable(slices(rows, column) for rows in batches)


@cache
def _loaded(model: bytes) -> Pieces:
    return Pieces(model)


def _giants(docs: DataFrame, model, longest: int, chunk: int) -> DataFrame:
    """``row`` and ``ids`` of documents in chunks (``row``, ``text``)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row, text in zip(rows["row"].to_pylist(), rows["text"].to_pylist(), strict=True):
                whole = " " + text
                for no, left in enumerate(range(0, len(whole), chunk)):
                    base, right = max(0, left - 2 * longest), min(len(whole), left + chunk)
                    yield pa.RecordBatch.from_pylist(
                        [{"row": row, "no": no, "base": base, "left": left, "right": right, "last": right == len(whole), "text": whole[base:right]}],
                        schema=pa.schema([*[(k, pa.int64()) for k in ("row", "no", "base", "left", "right")], ("last", pa.bool_()), ("text", pa.string())]),
                    )

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(model.value)
        for rows in _parts(batches):
            found = [_matrix_rows(pieces.transfer(r["text"], r["base"], r["left"], r["right"], r["last"])) for r in rows.to_pylist()]
            yield pa.RecordBatch.from_arrays([rows["row"], rows["no"], rows["last"], pa.array(found, ARROW_MATRIX)], names=["row", "no", "last", "matrix"])

    def combine(group: pa.Table) -> pa.Table:
        """One block's matrices to one."""
        parts = sorted(group.to_pylist(), key=lambda r: r["no"])
        matrix = _matrix(parts[0]["matrix"])
        for part in parts[1:]:
            matrix = product(matrix, _matrix(part["matrix"]))
        return pa.table(
            {
                "row": pa.array([parts[0]["row"]], pa.int64()),
                "block": pa.array([parts[0]["no"] // BLOCK], pa.int64()),
                "matrix": pa.array([_matrix_rows(matrix)], ARROW_MATRIX),
            }
        )

    ends = [(k, t) for k, t in (("at", pa.int64()), ("piece", pa.int32()), ("to_at", pa.int64()), ("to_piece", pa.int32()))]

    def states(keys: dict[str, list], path: list[State]) -> pa.Table:
        columns = zip(*[(*s, *t) for s, t in zip(path, path[1:], strict=False)], strict=True)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in keys.items()} | {k: pa.array(v, t) for (k, t), v in zip(ends, columns, strict=True)})

    def over_blocks(group: pa.Table) -> pa.Table:
        """The states at both boundaries of each block of a document."""
        parts = sorted(group.to_pylist(), key=lambda r: r["block"])
        matrices = [_matrix(p["matrix"]) for p in parts]
        path = best_states(matrices, (0, START), max(t for _, t, _ in matrices[-1]))
        return states({"row": [p["row"] for p in parts], "block": [p["block"] for p in parts]}, path)

    def within_block(left: pa.Table, right: pa.Table) -> pa.Table:
        """The states at both boundaries of each chunk of a block."""
        parts = sorted(left.to_pylist(), key=lambda r: r["no"])
        bounds = right.to_pylist()[0]
        path = best_states([_matrix(p["matrix"]) for p in parts], (bounds["at"], bounds["piece"]), (bounds["to_at"], bounds["to_piece"]))
        return states({"row": [p["row"] for p in parts], "no": [p["no"] for p in parts]}, path)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(model.value)
        for rows in _parts(batches):
            ids = [
                np.array(pieces.trace(r["text"], r["base"], r["left"], r["right"], r["last"], (r["at"], r["piece"]), (r["to_at"], r["to_piece"])), np.int32)
                for r in rows.to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([rows["row"], rows["no"], pa.array(ids, pa.list_(pa.int32()))], names=["row", "no", "ids"])

    chunks = stage(docs.mapInArrow(cut, CHUNKS), "piece-chunks")
    spread = chunks.repartition(F.xxhash64("row", "no"))
    matrices = stage(spread.mapInArrow(weigh, f"row long, no long, last boolean, matrix {MATRIX}"), "piece-matrices")
    block = F.floor(F.col("no") / BLOCK).alias("block")
    bounds = "at long, piece int, to_at long, to_piece int"
    blocks = matrices.groupBy("row", block).applyInArrow(combine, f"row long, block long, matrix {MATRIX}")
    outer = blocks.groupBy("row").applyInArrow(over_blocks, f"row long, block long, {bounds}")
    inner = (
        matrices.withColumn("block", block).groupBy("row", "block").cogroup(outer.groupBy("row", "block")).applyInArrow(within_block, f"row long, no long, {bounds}")
    )
    traced = chunks.join(inner, ["row", "no"]).mapInArrow(trace, "row long, no long, ids array<int>")
    whole = traced.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("parts"))
    return whole.select("row", F.flatten("parts.ids").alias("ids"))


def _comes_back(pieces: Pieces, texts: Sequence[str | None], ids: Sequence[np.ndarray | None]) -> pa.Array:
    """Whether ids decode to their text; a missing text has none."""
    return pa.array([i is None or pieces.decode(i.tolist()) == t for t, i in zip(texts, ids, strict=True)], pa.bool_())


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL, chunk: int = CHUNK, checked: bool = False) -> DataFrame:
    """``id_col``, the text and its ``ids``, one row per row; if ``checked`` also ``round_trip``, whether they decode to the text, by the task that encodes."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    longest = _loaded(model.value).longest
    if chunk < 2 * longest:
        raise ValueError(f"a chunk needs {2 * longest} code points")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(model.value)
        for got in _parts(batches):
            texts = got["text"].to_pylist()
            found = iter(pieces.plain([" " + t for t in texts if t]))
            ids = [None if t is None else np.array(next(found) if t else [], np.int32) for t in texts]
            columns = [got["id"], got["text"], pa.array(ids, pa.list_(pa.int32())), *([_comes_back(pieces, texts, ids)] if checked else [])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(model.value)
        for got in _parts(batches):
            ids = [x.values.to_numpy() if x.is_valid else None for x in got["ids"]]
            yield pa.RecordBatch.from_arrays([got["id"], got["text"], got["ids"], _comes_back(pieces, got["text"].to_pylist(), ids)], names=names)

    names = ["id", "text", "ids", *(["round_trip"] if checked else [])]
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, text string, ids array<int>" + (", round_trip boolean" if checked else "")
    long = F.length("text") > chunk
    short = rows.where(~F.coalesce(long, F.lit(False))).mapInArrow(run, schema)
    giants = stage(rows.where(long).withColumn("row", F.monotonically_increasing_id()), "giant-texts")
    of_giants = _giants(giants.select("row", "text"), model, longest, chunk)
    joined = giants.join(of_giants, "row").select("id", "text", "ids")
    joined = joined.mapInArrow(check, schema) if checked else joined
    return short.union(joined).withColumnsRenamed({"id": id_col, "text": text_col})


def decode(ids: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model_path: str = MODEL) -> DataFrame:
    """The frame with the text of a column of ids; a column of that name is replaced."""
    model = ids.sparkSession.sparkContext.broadcast(read_model(model_path))
    columns = [c for c in ids.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(model.value)
        for rows in (whole.slice(i, AT_ONCE) for whole in batches for i in range(0, whole.num_rows, AT_ONCE)):
            texts = [None if x is None else pieces.decode(x) for x in rows[ids_col].to_pylist()]
            yield pa.RecordBatch.from_arrays([rows[c] for c in columns] + [pa.array(texts, pa.string())], names=[*columns, out_col])

    kept = ids.select(columns)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out_col, T.StringType())]))


def digest(encoded: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """``id_col``, ``n_pieces``, the SHA-256 of the ids (32-bit, little-endian) and whether they decode to the text."""
    model = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(model.value)
        for rows in _parts(batches, text_col):
            counts, sums, exact = [], [], []
            for ids, text in zip(rows["ids"], rows[text_col].to_pylist(), strict=True):
                own = np.empty(0, np.int32) if not ids.is_valid else ids.values.to_numpy()
                counts.append(len(own))
                sums.append(hashlib.sha256(own.tobytes()).hexdigest())
                exact.append(pieces.decode(own.tolist()) == (text or ""))
            yield pa.RecordBatch.from_arrays(
                [rows[id_col], pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(exact, pa.bool_())],
                names=[id_col, "n_pieces", "ids_sha256", "round_trip"],
            )

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.mapInArrow(run, f"{id_col} {kind}, n_pieces long, ids_sha256 string, round_trip boolean")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(encode(table(spark, sf_dir, "documents")))
