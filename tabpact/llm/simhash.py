"""SimHash near-dedup by covering locality-sensitive hashing.

A text's fingerprint has bit i set if more than half of its shingles' 64-bit hashes have it set.
Fingerprints with at most ``RADIUS`` differing bits are linked; a document's component is the smallest
id it can reach over links.

Candidates come from structured bit masks: every bit position gets a random vector of RADIUS + 1 bits,
and there is a mask for each non-zero vector v, which holds the positions whose vector has an odd inner
product with v. Some v is orthogonal to the vectors of any RADIUS positions, so its mask avoids them:
two fingerprints within the radius are equal under at least one of the 2^(RADIUS+1) - 1 masks. Nothing
is missed, by construction, and with RADIUS = 2 seven tables on about 36 bits do.

Equal fingerprints are one node, so copies cost nothing. A table's bucket of up to ``SMALL`` different
fingerprints is compared in place and gives a spanning forest of its links. The fingerprints of larger
buckets are linked exactly as well, without comparing all pairs: each is sent to itself and its 64
neighbours at one differing bit, and those that meet at one place (65 at most) differ in two bits at
most; two that are linked always meet.

Defined cases: a NULL or empty text, or one of blanks only, has fingerprint zero and is linked like any
other. Rows with one id are one document, each row with the fingerprint of its own text. A row without an
id gets a fingerprint, a NULL component and no link. An empty table gives no rows. Other columns are not
read; ``drop_near_copies`` passes them on.
"""

from __future__ import annotations

import random
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..names import unused
from ..staging import stage
from .common import batch, map_batches, table
from .components import components

RADIUS = 2
SHINGLE = 3
SEED = 42
SMALL = 1_000
BITS = 64


@cache
def masks(radius: int = RADIUS) -> tuple[int, ...]:
    """The covering masks, as signed longs."""
    draw = random.Random(SEED)
    vectors = [draw.randrange(1, 2 ** (radius + 1)) for _ in range(BITS)]
    found = []
    for v in range(1, 2 ** (radius + 1)):
        mask = sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2)
        found.append(mask - 2**BITS if mask >> 63 else mask)
    return tuple(found)


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of a text in UTF-8."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, blanks \x20 and \x09-\x0D only
    if not words:
        return 0
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined, digest = b" ".join(words), xxhash.xxh64_intdigest
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: -SHINGLE].tolist()]
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    every = np.array(hashes, ">u8")
    counts = sum(
        np.unpackbits(every[i : i + 8192].view(np.uint8).reshape(-1, BITS // 8), axis=1).sum(axis=0, dtype=np.int64)
        for i in range(0, len(every), 8192)
    )
    return int.from_bytes(np.packbits(2 * counts > len(every)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc`` (may be NULL) and ``print``, one row per row, written to the shared folder."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t.as_py()) for t in rows["text"]], np.uint64)
        return batch(doc=rows["doc"], print=found.view(np.int64))

    frame = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return stage(map_batches(frame, run, "doc long, print long"), "fingerprints")


def _forest(prints: np.ndarray, nodes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what the links within one bucket connect."""
    root = np.arange(len(prints))
    for i in range(1, len(prints)):
        near = np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= radius)
        if len(near):
            joined = np.unique(np.append(root[near], i))
            root[: i + 1][np.isin(root[: i + 1], joined)] = joined[0]
    return [(int(nodes[i]), int(nodes[r])) for i, r in enumerate(root) if i != r]


def links(nodes: DataFrame, radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """Edges ``(a, b)`` of nodes that connect all fingerprints within the radius.

    ``nodes`` has one row per fingerprint: ``print`` and the smallest ``node`` that has it.
    """
    if radius != 2:
        raise ValueError("large buckets are linked for a radius of two")
    member = F.struct("print", "node").alias("member")
    tables = F.posexplode(F.array(*[F.col("print").bitwiseAND(F.lit(m)) for m in masks(radius)]))
    dealt = nodes.select(member, tables.alias("mask", "bucket"))
    sizes = dealt.groupBy("mask", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = stage(dealt.join(sizes, ["mask", "bucket"]), "buckets")

    def connect(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for members in rows["members"].to_pylist():
            prints = np.array([m["print"] for m in members], np.int64).view(np.uint64)
            found += _forest(prints, np.array([m["node"] for m in members], np.int64), radius)
        return batch(a=pa.array([a for a, _ in found], pa.int64()), b=pa.array([b for _, b in found], pa.int64()))

    gathered = met.where(F.col("n") <= small).groupBy("mask", "bucket").agg(F.array_sort(F.collect_list("member")).alias("members"))
    near = map_batches(gathered.select("members"), connect, "a long, b long")

    crowd = met.where(F.col("n") > small).select("member").distinct()
    flips = F.array(*[F.lit(0).cast("long")], *[F.lit(1 << i if i < 63 else -(2**63)).cast("long") for i in range(BITS)])
    places = crowd.select("member", F.explode(F.transform(flips, lambda x: F.col("member.print").bitwiseXOR(x))).alias("place"))
    meeting = places.groupBy("place").agg(F.array_sort(F.collect_list("member.node")).alias("met")).where(F.size("met") > 1)
    stars = meeting.select(F.col("met")[0].alias("b"), F.explode(F.slice("met", 2, BITS + 1)).alias("a")).select("a", "b")
    return near.union(stars)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc``, ``print`` and ``component``, one row per row."""
    prints = fingerprints(docs, id_col, text_col)
    nodes = stage(prints.where("doc IS NOT NULL").groupBy("print").agg(F.min("doc").alias("node")), "fingerprint-nodes")
    found = components(links(nodes))
    of_print = nodes.join(found, "node", "left").select("print", F.coalesce("component", "node").alias("component"))
    rows = prints.join(of_print, "print", "left")
    return rows.select("doc", "print", F.when(F.col("doc").isNotNull(), F.col("component")).alias("component"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents but for those whose component has a smaller id; rows without an id stay."""
    key = unused("_doc", docs.columns)
    dropped = groups(docs, id_col, text_col).where("component < doc").select(F.col("doc").alias(key)).distinct()
    return docs.join(dropped, F.col(id_col).cast("long") == F.col(key), "left_anti")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("doc").alias("doc_id"),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
