"""Strongly connected components of edge tables, by blocks.

Nodes are gathered into blocks of neighbours. Inside a block, one task finds the components of the block's own edges and replaces the block by its border: an edge from each node
where paths come in to each node where they go out, if a path leads there. The rest of the graph cannot tell the difference, so the components of the
smaller graph are those of the larger one, as far as its nodes are left; the others follow from a second look at each block, in which border nodes
of one component are one. A path of any length shrinks by the size of a block in every round, so rounds grow with the logarithm of the longest path.

Any assignment to blocks is right; neighbours make small borders. A node joins the neighbour with the smallest hash, whole groups join again while they fit a block, and a node's neighbours
that are too many for one are split by hash. A block has ``BLOCK_NODES`` nodes at most on average of its hash, whatever the graph; a graph of ``BLOCK_EDGES`` edges at most is one block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..staging import new_folder, stage, stage_at

#: Edges of a graph that one task takes whole.
BLOCK_EDGES = 1_000_000
#: Nodes that a block is meant to have at most.
BLOCK_NODES = 2_000
#: How often groups join before blocks are made of them, at most; they stop where an average group is a quarter of a block.
JOINS = 8
#: A round that leaves more than this share of the edges has not paid off.
PAYS_OFF = 0.8

INNER, ENTRY, EXIT, KNOWN = 0, 1, 2, 3


def strong_labels(src: np.ndarray, dst: np.ndarray, nodes: int) -> np.ndarray:
    """Per node 0 .. ``nodes`` - 1 the number of its strongly connected component; numbers rise from the components that paths end in."""
    order = np.argsort(src, kind="stable")
    heads = np.searchsorted(src[order], np.arange(nodes + 1)).tolist()
    tails = dst[order].tolist()
    index, low, label = [-1] * nodes, [0] * nodes, [-1] * nodes
    at = heads[:-1]
    counter = found = 0
    open_nodes: list[int] = []
    for root in range(nodes):
        if index[root] >= 0:
            continue
        index[root] = low[root] = counter
        counter += 1
        open_nodes.append(root)
        path = [root]
        while path:
            v = path[-1]
            if at[v] < heads[v + 1]:
                w = tails[at[v]]
                at[v] += 1
                if index[w] < 0:
                    index[w] = low[w] = counter
                    counter += 1
                    open_nodes.append(w)
                    path.append(w)
                elif label[w] < 0 and index[w] < low[v]:
                    low[v] = index[w]
                continue
            path.pop()
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
            if low[v] == index[v]:
                while True:
                    w = open_nodes.pop()
                    label[w] = found
                    if w == v:
                        break
                found += 1
    return np.array(label, np.int64)


def _numbered(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct values of some columns, and each column as places among them."""
    every = pa.chunked_array([chunk for c in columns for chunk in c.chunks], columns[0].type).combine_chunks()
    coded = pc.dictionary_encode(every)
    places = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.dictionary, np.split(places, np.cumsum([len(c) for c in columns])[:-1])


def _least_of(labels: np.ndarray, names: pa.Array, count: int) -> np.ndarray:
    """Per label the place of the node with the smallest name."""
    rank = np.empty(len(names), np.int64)
    rank[pc.sort_indices(names).to_numpy(zero_copy_only=False)] = np.arange(len(names))
    order = np.lexsort((rank, labels))
    first = np.full(count, -1, np.int64)
    at = np.flatnonzero(np.diff(labels[order], prepend=-1))
    first[labels[order][at]] = order[at]
    return first


def _whole(rows: pa.Table) -> pa.Table:
    """``node`` and ``comp`` of the nodes that share a component with another one."""
    names, (src, dst) = _numbered(rows["src"], rows["dst"])
    labels = strong_labels(src, dst, len(names))
    first = _least_of(labels, names, int(labels.max(initial=-1)) + 1)
    shared = np.bincount(labels)[labels] > 1
    return pa.table({"node": names.filter(pa.array(shared)), "comp": names.take(pa.array(first[labels[shared]]))})


def _border(rows: pa.Table) -> pa.Table:
    """A block as its border: ``src`` and the node ``dst`` that stands for it (``made`` false), or an edge (``made`` true)."""
    names, (src, dst) = _numbered(rows["src"], rows["dst"])
    kind = rows["kind"].to_numpy()
    inner = kind == INNER
    labels = strong_labels(src[inner], dst[inner], len(names))
    count = int(labels.max()) + 1
    first = _least_of(labels, names, count)
    entries, exits = (np.unique(labels[src[kind == k]]) for k in (ENTRY, EXIT))
    a, b = labels[src[inner]], labels[dst[inner]]
    edges = np.unique(np.stack([a[a != b], b[a != b]]), axis=1)
    made = _across(edges, entries, exits, count)
    if made is None or made.shape[1] > edges.shape[1]:
        made = edges
    u, v = first[made[0]], first[made[1]]
    return pa.table(
        {
            "src": pa.concat_arrays([names, names.take(pa.array(u))]),
            "dst": pa.concat_arrays([names.take(pa.array(first[labels])), names.take(pa.array(v))]),
            "made": pa.array(np.repeat([False, True], [len(names), len(u)])),
        }
    )


def _across(edges: np.ndarray, entries: np.ndarray, exits: np.ndarray, count: int) -> np.ndarray | None:
    """Edges from each entry to each exit that it reaches; None if a table of all pairs would be large.

    Components are numbered from where paths end, so one pass in that order knows everything that a node reaches.
    """
    if len(exits) * count > 64_000_000:
        return None
    reach = np.zeros((count, -(-max(1, len(exits)) // 8)), np.uint8)
    places = np.arange(len(exits))
    reach[exits, places >> 3] |= (128 >> (places & 7)).astype(np.uint8)
    order = np.argsort(edges[0], kind="stable")
    heads, tails = edges[0][order], edges[1][order]
    starts = np.flatnonzero(np.diff(heads, prepend=-1))
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(heads)]):
        head = heads[start]
        reach[head] |= np.bitwise_or.reduce(reach[tails[start:end]], axis=0)
    bits = np.unpackbits(reach[entries], axis=1)[:, : len(exits)]
    at, to = np.nonzero(bits)
    pairs = np.stack([entries[at], exits[to]])
    return pairs[:, pairs[0] != pairs[1]]


def _settled(rows: pa.Table) -> pa.Table:
    """``node`` and ``comp`` within a block, given the components of some of its nodes."""
    known = rows.filter(pc.equal(rows["kind"], KNOWN))
    names, (src, dst) = _numbered(rows["src"], rows["dst"])
    kind = rows["kind"].to_numpy()
    # A known component's name stands for one more node, with edges from and to each of its nodes here.
    comps, (comp,) = _numbered(known["comp"]) if known.num_rows else (names.slice(0, 0), (np.empty(0, np.int64),))
    hub, of = len(names) + comp, src[kind == KNOWN]
    inner = kind == INNER
    a, b = np.concatenate([src[inner], of, hub]), np.concatenate([dst[inner], hub, of])
    labels = strong_labels(a, b, len(names) + len(comps))
    own = labels[: len(names)]
    first = _least_of(own, names, int(labels.max(initial=-1)) + 1)
    shared = np.bincount(own, minlength=len(first))[own] > 1
    given = np.full(len(first), -1, np.int64)
    given[labels[len(names) :]] = np.arange(len(comps))
    shared |= given[own] >= 0
    every = pa.concat_arrays([names, comps])
    chosen = np.where(given[own] >= 0, len(names) + given[own], first[own])[shared]
    return pa.table({"node": names.filter(pa.array(shared)), "comp": every.take(pa.array(chosen))})


def _joined(links: DataFrame) -> DataFrame:
    """``node`` and ``block``: neighbours that joined the same group, in parts of about ``BLOCK_NODES``."""
    spark = links.sparkSession
    pairs = links.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(links.select("dst", "src"))
    labels, nodes = None, 0
    for level in range(JOINS):
        other = F.struct(F.xxhash64("b", F.lit(level)).alias("h"), F.col("b").alias("to"))
        own = F.struct(F.xxhash64("a", F.lit(level)).alias("h"), F.col("a").alias("to"))
        best = pairs.groupBy("a").agg(F.min(other).alias("best")).select("a", F.least("best", own)["to"].alias("to"))
        parent, groups = stage_at(best, new_folder(spark, "parents"))
        nodes = nodes or groups
        # Two jumps of doubling length; where the way to the smallest is longer, groups stay smaller.
        for _ in range(2):
            step = parent.select(F.col("a").alias("to"), F.col("to").alias("further"))
            parent = parent.join(step, "to").select("a", F.col("further").alias("to"))
        if labels is None:
            labels = stage(parent.select(F.col("a").alias("node"), F.col("to").alias("label")), "labels")
        else:
            asked = labels.join(parent.select(F.col("a").alias("label"), F.col("to").alias("new")), "label", "left").select("node", "label", F.coalesce("new", "label").alias("new"))
            sizes = asked.groupBy("new").agg(F.count(F.lit(1)).alias("n"))
            # Groups that would outgrow a block stay apart.
            fits = F.when(F.col("n") <= BLOCK_NODES, F.col("new")).otherwise(F.col("label"))
            labels = stage(asked.join(sizes, "new").select("node", fits.alias("label")), "labels")
        # At this level about a third of the groups are left.
        if groups * BLOCK_NODES <= 12 * nodes:
            break
        if level + 1 < JOINS:
            of = lambda c, n: labels.select(F.col("node").alias(c), F.col("label").alias(n))
            apart = links.join(of("src", "a"), "src").join(of("dst", "b"), "dst").where("a <> b").select("a", "b")
            pairs, left = stage_at(apart.union(apart.select("b", "a")).distinct(), new_folder(spark, "groups"))
            if not left:
                break
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("node", F.lit("part")), F.floor(F.col("n") / BLOCK_NODES) + 1)
    return stage(labels.join(sizes, "label").select("node", F.struct("label", part.alias("part")).alias("block")), "blocks")


def shrink(links: DataFrame) -> tuple[DataFrame, int, Callable[[DataFrame], DataFrame]]:
    """The graph with its blocks replaced by their borders, its size, and what turns its components into those of ``links``."""
    spark, node = links.sparkSession, links.schema["src"].dataType
    blocks = _joined(links)
    of = lambda c, n: blocks.select(F.col("node").alias(c), F.col("block").alias(n))
    dealt = stage(links.join(of("src", "from_block"), "src").join(of("dst", "to_block"), "dst").select("src", "dst", "from_block", "to_block"), "dealt")
    same = F.col("from_block") == F.col("to_block")
    inner = dealt.where(same).select(F.col("from_block").alias("block"), "src", "dst", F.lit(INNER).alias("kind"))
    outer = dealt.where(~same)
    leaving = outer.select(F.col("from_block").alias("block"), "src", F.col("src").alias("dst"), F.lit(EXIT).alias("kind"))
    entering = outer.select(F.col("to_block").alias("block"), F.col("dst").alias("src"), "dst", F.lit(ENTRY).alias("kind"))
    rows = inner.unionByName(leaving.unionByName(entering).distinct())
    schema = T.StructType([T.StructField("src", node), T.StructField("dst", node), T.StructField("made", T.BooleanType())])
    borders = stage(rows.groupBy("block").applyInArrow(_border, schema), "borders")
    stands = borders.where("NOT made")
    by = lambda c, n: stands.select(F.col("src").alias(c), F.col("dst").alias(n))
    across = outer.join(by("src", "new_src"), "src").join(by("dst", "new_dst"), "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))
    left = borders.where("made").select("src", "dst").union(across).where("src <> dst").distinct()
    smaller, size = stage_at(left, new_folder(spark, "shrunk"))

    def undo(known: DataFrame) -> DataFrame:
        found = known.join(blocks, "node").select("block", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(KNOWN).alias("kind"), "comp")
        rows = inner.withColumn("comp", F.lit(None).cast(node)).unionByName(found)
        out = T.StructType([T.StructField("node", node), T.StructField("comp", node)])
        return stage(rows.groupBy("block").applyInArrow(_settled, out), "settled")

    return smaller, size, undo


def whole(links: DataFrame) -> DataFrame:
    """``node`` and ``comp`` of a graph of ``BLOCK_EDGES`` edges at most, in one task."""
    node = links.schema["src"].dataType
    out = T.StructType([T.StructField("node", node), T.StructField("comp", node)])
    return stage(links.select("src", "dst").groupBy(F.lit("whole")).applyInArrow(lambda rows: _whole(rows), out), "components")
