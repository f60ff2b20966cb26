"""Line dedup over a sharded minimal perfect hash.

A line's key is the line without blanks at its ends and with A-Z in lower case. A key of at least
``min_chars`` code points found in two documents or more keeps its lines in the document with the
smallest id only.

The distinct 64-bit line hashes are dealt to shards. Each shard builds a minimal perfect hash over its
hashes: levels of bit arrays, where a hash that is alone in its place is settled and the others go on
to the next level. The rank of a settled bit is the hash's slot in three compact arrays: a fingerprint,
the number of documents and the smallest document id. The documents' hashes, 16 bytes a line, are sent
to the shard they belong to and looked up there without a sort or a join of lines; only what must go
is sent back to the document.

A shard holds about ``KEYS_PER_SHARD`` hashes, whatever the size of the input, and lookups of a shard
with a very frequent line are dealt to several tasks, each with a copy of the shard.

Defined cases: a NULL or empty text is one empty line. Rows with one id are one document. A missing
id counts as one document that comes after all others. Only the id and the text are read; in
``dedup_lines`` all other columns are passed on. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..names import unused
from ..staging import new_folder, stage, stage_at
from .common import batch, id_key, map_batches, shuffle_partitions, table, texts

KEYS_PER_SHARD = 500_000
LOOKUPS_PER_TASK = 250_000
MIN_CHARS = 10
#: Places per hash that is left, at each level.
ROOM = 2
LEVELS = 40


def line_hash(line: bytes, min_chars: int) -> int | None:
    """The hash of a line's key, None for a key that is too short."""
    key = line.strip()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh64_intdigest(key.lower())


def _mixed(hashes: np.ndarray, level: int) -> np.ndarray:
    x = hashes ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (_mixed(hashes, LEVELS + 1) >> np.uint64(32)).astype(np.uint32)


def build_levels(hashes: np.ndarray) -> list[np.ndarray]:
    """Bit arrays (packed) of a minimal perfect hash over distinct hashes."""
    levels, left = [], hashes
    while len(left):
        if len(levels) == LEVELS:
            raise ValueError("the hashes are not distinct")
        places = ROOM * len(left) + 1
        at = (_mixed(left, len(levels)) % np.uint64(places)).astype(np.int64)
        alone = np.bincount(at, minlength=places) == 1
        levels.append(np.packbits(alone))
        left = left[~alone[at]]
    return levels


def places_of(levels: list[np.ndarray], keys: int) -> list[int]:
    """The number of places of each level, which follows from the number of hashes."""
    places, left = [], keys
    for bits in levels:
        places.append(ROOM * left + 1)
        left -= int(np.bitwise_count(bits).sum())
    return places


def slots(levels: list[np.ndarray], keys: int, hashes: np.ndarray) -> np.ndarray:
    """The slot of each hash; -1 for some that are not in the set."""
    out, todo, before = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), 0
    for level, (bits, places) in enumerate(zip(levels, places_of(levels, keys), strict=True)):
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
        at = (_mixed(hashes[todo], level) % np.uint64(places)).astype(np.int64)
        byte, bit = at >> 3, at & 7
        word = bits[byte]
        found = (word >> (7 - bit).astype(np.uint8)) & 1 == 1
        inner = np.bitwise_count(word >> (8 - bit).astype(np.uint16)).astype(np.int64)
        out[todo[found]] = before + (ranks[byte] + inner)[found]
        before += int(ranks[-1])
        todo = todo[~found]
    return out


def _build_shard(rows: pa.Table) -> pa.Table:
    hashes = rows["line"].to_numpy().view(np.uint64)
    levels = build_levels(hashes)
    slot = slots(levels, len(hashes), hashes)
    arrays = {}
    for name, values in (
        ("prints", fingerprints(hashes)),
        ("counts", np.minimum(rows["docs"].to_numpy(), 65_535).astype(np.uint16)),
        ("owners", rows["owner"].to_numpy()),
    ):
        arrays[name] = np.empty_like(values)
        arrays[name][slot] = values
    blobs = {name: [values.tobytes()] for name, values in arrays.items()}
    return pa.table(
        {
            "shard": rows["shard"].slice(0, 1),
            "keys": pa.array([len(hashes)], pa.int64()),
            "most": pa.array([int(rows["docs"].to_numpy().max())], pa.int64()),
            "levels": pa.array([[bits.tobytes() for bits in levels]], pa.list_(pa.binary())),
            **{name: pa.array(blob, pa.binary()) for name, blob in blobs.items()},
        }
    )


SHARD = "shard long, keys long, most long, levels array<binary>, prints binary, counts binary, owners binary"


def _look_up(probes: pa.Table, shard: pa.Table) -> pa.Table:
    """The (document, line) pairs that must go."""
    hashes, docs = probes["line"].to_numpy().view(np.uint64), probes["doc"].to_numpy()
    if len(hashes) and shard.num_rows:
        row = shard.slice(0, 1).to_pylist()[0]
        levels = [np.frombuffer(bits, np.uint8) for bits in row["levels"]]
        slot = slots(levels, row["keys"], hashes)
        prints, counts, owners = (np.frombuffer(row[k], t) for k, t in (("prints", np.uint32), ("counts", np.uint16), ("owners", np.int64)))
        known = (slot >= 0) & (prints[slot] == fingerprints(hashes))
        gone = known & (counts[slot] > 1) & (owners[slot] != docs)
        hashes, docs = hashes[gone], docs[gone]
    return pa.table({"doc": pa.array(docs, pa.int64()), "line": pa.array(hashes.view(np.int64), pa.int64())})


def lines_to_drop(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc`` and the hashes of the ``lines`` that it loses, for documents that lose any."""
    spark = docs.sparkSession

    def hashes(rows: pa.RecordBatch) -> pa.RecordBatch:
        ids, out, whose = rows["doc"].to_numpy(), [], []
        for doc, text in zip(ids, rows["text"].to_pylist(), strict=True):
            found = {line_hash(line, min_chars) for line in (text or b"").split(b"\n")} - {None}
            out.extend(found)
            whose.append((doc, len(found)))
        owners = np.repeat(np.array([d for d, _ in whose], np.int64), [n for _, n in whose])
        return batch(line=np.array(out, np.uint64).view(np.int64), doc=owners)

    lines, rows = stage_at(map_batches(texts(docs, id_col, text_col), hashes, "line long, doc long"), new_folder(spark, "lines"))
    n_shards = max(shuffle_partitions(spark), rows // KEYS_PER_SHARD + 1)
    shard = F.pmod(F.col("line"), F.lit(n_shards)).alias("shard")
    keys = lines.groupBy("line").agg(F.min("doc").alias("owner"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n"))
    keys = keys.select(shard, "line", "owner", F.when(F.col("owner") == F.col("last"), 1).otherwise(F.col("n")).alias("docs"))
    shards = stage(keys.groupBy("shard").applyInArrow(_build_shard, SHARD), "line-index")

    # Lookups of a shard with a very frequent line go to several tasks.
    hot = shards.select("shard", (1 + F.col("most") / LOOKUPS_PER_TASK).cast("long").alias("parts")).where("parts > 1")
    probes = lines.select(shard, "line", "doc").join(hot, "shard", "left")
    probes = probes.select("shard", F.coalesce(F.pmod(F.xxhash64("doc"), "parts"), F.lit(0)).alias("part"), "line", "doc")
    copies = shards.join(hot, "shard", "left").select(
        shards["*"], F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    )
    looked_up = probes.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(_look_up, "doc long, line long")
    return looked_up.groupBy("doc").agg(F.collect_set("line").alias("lines"))


def _kept(text: bytes | None, drop: list[int] | None, min_chars: int) -> tuple[int, list[bytes]]:
    """The number of lines and those that stay."""
    lines = (text or b"").split(b"\n")
    if not drop:
        return len(lines), lines
    gone = {x % 2**64 for x in drop}
    return len(lines), [x for x in lines if line_hash(x, min_chars) not in gone]


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document: lines before dropping, dropped lines, SHA-256 of the text that stays."""
    drops = lines_to_drop(docs, id_col, text_col, min_chars)
    frame = docs.select(F.col(id_col).alias("id"), id_key(id_col).alias("doc"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def digest(rows: pa.RecordBatch) -> pa.RecordBatch:
        total, dropped, sums = [], [], []
        for text, drop in zip(rows["text"].to_pylist(), rows["lines"].to_pylist(), strict=True):
            n, kept = _kept(text, drop, min_chars)
            total.append(n)
            dropped.append(n - len(kept))
            sums.append(hashlib.sha256(b"\n".join(kept)).hexdigest())
        return batch(
            id=rows["id"],
            n_lines=pa.array(total, pa.int64()),
            n_dropped=pa.array(dropped, pa.int64()),
            kept_sha256=pa.array(sums, pa.string()),
        )

    kind = frame.schema["id"].dataType.simpleString()
    joined = frame.join(drops, "doc", "left").select("id", "text", "lines")
    return map_batches(joined, digest, f"id {kind}, n_lines long, n_dropped long, kept_sha256 string").withColumnRenamed("id", id_col)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents, all columns, with the repeated lines gone from the text. A NULL text stays NULL."""
    drops = lines_to_drop(docs, id_col, text_col, min_chars)
    key, gone = (unused(n, docs.columns) for n in ("_doc", "_lines"))
    own = drops.select(F.col("doc").alias(key), F.col("lines").alias(gone))
    joined = docs.withColumn(key, id_key(id_col)).join(own, key, "left").drop(key)

    columns = list(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for text, drop in zip(rows[text_col].to_pylist(), rows[gone].to_pylist(), strict=True):
                if text is not None and drop is not None:
                    text = b"\n".join(_kept(text.encode(), drop, min_chars)[1]).decode("utf-8", "replace")
                out.append(text)
            kind = rows.schema.field(text_col).type
            yield pa.RecordBatch.from_arrays([pa.array(out, kind) if c == text_col else rows[c] for c in columns], names=columns)

    return joined.mapInArrow(cut, docs.schema)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH doc AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM doc),
keyed AS (
    SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
rep AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT keyed.*, coalesce(owner <> doc_id, false) AS gone FROM keyed LEFT JOIN rep USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
