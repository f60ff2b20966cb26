"""A Merkle manifest of a dataset: one digest for the whole, one for each group, and a proof for every row.

A row's leaf is the SHA-256 of its fields. The leaves of a group stand in order of their ids; ``fanout`` consecutive nodes become their
parent, whose digest is that of the children's digests one after another, level by level until one node, the group's subroot, is left. The subroots, in order of
the groups, become the root in the same way.

A level is one slot pivot: nodes are grouped by parent, and conditional aggregates spread the children into ``fanout`` columns by their slot. The columns
concatenated give the parent's digest; concatenated without the own column, to its left and to its right, they are a node's siblings. Proofs go down the
tree: a parent's path is joined to its pivoted row, and the children take it on with their own siblings in front, so that
siblings are never shuffled per row, only a path per parent.

A row's place in its group follows from exact row numbers over all rows, given by ranges, so that no group, however large, is sorted by
one task. Groups are met again by a join that is dealt by row number as well. A parent has ``fanout`` children at most, so nothing is hot. The number of levels is the
logarithm of the largest group; each is a written table. Only the root and the size of the largest group come to the driver.

Defined cases: a NULL field is ``-``, others are their length in bytes, a colon and the value. NULL groups and ids come first. Rows with one id are ordered by their
leaves, so equal rows are interchangeable. A group of one row has its leaf for a subroot; one group's subroot is the root; the proof of a single row is
the digest of nothing. A last run of one node is digested as well. An empty table has no rows and no root. Only the fields named are read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.sequence import number_rows
from ..staging import stage
from .common import table
from .line_quality import LOWER, UPPER
from .resampling import CRC_SQL, crc_sql

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A group's rows meet its number in so many parts.
SALTS = 16
PATH = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    """SHA-256 of texts one after another, in lower-case hex; NULLs are left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field_text(value: Column) -> Column:
    as_text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(as_text).cast("string"), F.lit(":"), as_text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return digest(*map(field_text, fields))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, level: F.sha2(F.concat(level["left"], node, level["right"]), 256))


def siblings(path: Column) -> Column:
    """The digests of all siblings, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda level: F.concat(level["left"], level["right"])), "")


@dataclass(frozen=True)
class Tree:
    """Trees that stand side by side. ``leaves``: ``tree``, ``pos``, ``n`` (nodes of the tree at this level), ``digest`` and ``row``, a struct of whatever goes
    with a leaf; ``levels``: the pivoted parents, bottom up, with the children's digests in ``c0``, ``c1``, .. and, at the lowest, their rows in ``r0``, ``r1``, .."""

    leaves: DataFrame
    levels: list[DataFrame]
    fanout: int

    def tops(self) -> DataFrame:
        """``tree`` and ``digest`` of each tree's top."""
        found = self.leaves.where("n = 1").select("tree", "digest")
        for level in self.levels:
            found = found.unionByName(level.where("n = 1").select("tree", "digest"))
        return found

    def paths(self, above: DataFrame) -> DataFrame:
        """``row``, ``digest``, ``path`` and ``more`` of every leaf; ``above`` has ``tree``, the ``path`` above its top and ``more``, whatever is to be handed down."""
        columns = ["row", "digest", "path", "more"]
        found = self.leaves.where("n = 1").join(above, "tree").select(*columns)
        down = None
        for at, level in reversed(list(enumerate(self.levels))):
            level = level.drop("digest")
            met = level.where("n = 1").join(above, "tree")
            if down is not None:
                met = met.unionByName(level.where("n > 1").join(down.select("tree", "pos", "path", "more"), ["tree", "pos"]))
            down = self._children(met, at == 0)
        return found if down is None else found.unionByName(down.select(*columns))

    def _children(self, parents: DataFrame, lowest: bool) -> DataFrame:
        names = [f"c{k}" for k in range(self.fanout)]
        each = [
            F.struct(
                (F.col("pos") * self.fanout + k).alias("pos"),
                F.col(name).alias("digest"),
                F.struct(F.concat_ws("", *names[:k]).alias("left"), F.concat_ws("", *names[k + 1 :]).alias("right")).alias("level"),
                *([F.col(f"r{k}").alias("row")] if lowest else []),
            )
            for k, name in enumerate(names)
        ]
        spread = parents.select("tree", "path", "more", F.explode(F.array(*each)).alias("child")).where("child.digest IS NOT NULL")
        row = [F.col("child.row").alias("row")] if lowest else []
        path = F.concat(F.array("child.level"), F.col("path")).alias("path")
        return spread.select("tree", F.col("child.pos").alias("pos"), F.col("child.digest").alias("digest"), path, "more", *row)


def grow(leaves: DataFrame, largest: int, fanout: int = FANOUT) -> Tree:
    """All levels over ``leaves`` (a written table), of which no tree has more than ``largest``."""
    levels: list[DataFrame] = []
    nodes, width = leaves, largest
    while width > 1:
        slot = F.pmod("pos", F.lit(fanout))
        spread = lambda column, prefix: [F.max(F.when(slot == k, F.col(column))).alias(f"{prefix}{k}") for k in range(fanout)]
        rows = [] if levels else spread("row", "r")
        parent = F.floor(F.col("pos") / fanout).cast("long").alias("pos")
        width = -(-width // fanout)
        pivoted = nodes.where("n > 1").groupBy("tree", F.ceil(F.col("n") / fanout).cast("long").alias("n"), parent).agg(*spread("digest", "c"), *rows)
        levels.append(stage(pivoted.withColumn("digest", digest(*[F.col(f"c{k}") for k in range(fanout)])), "tree-level"))
        nodes = levels[-1]
    return Tree(leaves, levels, fanout)


@dataclass(frozen=True)
class Manifest:
    """The trees of all groups, the tree of their subroots, the groups with their numbers, and the root (None of an empty table)."""

    groups: DataFrame
    trees: Tree
    top: Tree
    root: str | None

    def subroots(self) -> DataFrame:
        """``group``, its number of rows ``n`` and its ``subroot``."""
        return self.groups.join(self.trees.tops(), "tree").select("group", "n", F.col("digest").alias("subroot"))

    def proofs(self) -> DataFrame:
        """One row per row: what was carried with it, ``leaf``, ``subroot`` and ``path``, from which ``folded`` gives the root."""
        start = self.top.leaves.sparkSession.range(1).select(F.col("id").alias("tree"), F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("more"))
        above = self.top.paths(start).select(F.col("row.tree").alias("tree"), "path", F.col("digest").alias("more"))
        return self.trees.paths(above).select("row.*", F.col("digest").alias("leaf"), F.col("more").alias("subroot"), "path")


def build(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: Sequence[str] = FIELDS, carried: Mapping[str, Column] | None = None, fanout: int = FANOUT
) -> Manifest:
    """The manifest of all rows. ``carried`` names what proofs bring along, as columns of ``docs``; the id alone by default."""
    if fanout < 2:
        raise ValueError("a parent has at least two children")
    carried = carried or {id_col: F.col(id_col)}
    row = F.struct(*[column.alias(name) for name, column in carried.items()]).alias("row")
    leaf = leaf_digest([F.col(c) for c in fields]).alias("digest")
    rows = stage(docs.select(F.col(group_col).alias("group"), F.col(id_col).alias("id"), leaf, row), "leaves")
    numbered, _ = number_rows(rows, ["group", "id", "digest"], start=0, name="num")
    numbered = stage(numbered.select("group", "num", "digest", "row"), "numbered")

    sizes = stage(numbered.groupBy("group").agg(F.min("num").alias("first"), F.count(F.lit(1)).alias("n")), "sizes")
    largest = sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    groups, total = number_rows(sizes, "first", start=0, name="tree")
    groups = stage(groups, "groups")
    dealt = groups.select(F.col("group").alias("of"), "first", "n", "tree", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = numbered.withColumn("salt", F.pmod("num", F.lit(SALTS)).cast("int")).join(dealt, "salt").where(F.col("group").eqNullSafe(F.col("of")))
    leaves = stage(met.select("tree", (F.col("num") - F.col("first")).alias("pos"), "n", "digest", "row"), "placed")
    trees = grow(leaves, largest, fanout)

    subroots = trees.tops().select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(total).cast("long").alias("n"), "digest", F.struct("tree").alias("row"))
    top = grow(stage(subroots, "subroots"), total, fanout)
    root = top.tops().first()
    return Manifest(groups, trees, top, root and root["digest"])


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    touched = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    lowered = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]
    manifest = build(docs, carried={"doc_id": F.col("doc_id"), "tampered": F.when(touched, leaf_digest(lowered))})
    proofs = manifest.proofs().withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    root = F.lit(manifest.root).cast("string")
    return proofs.select(
        "doc_id",
        "leaf",
        "subroot",
        root.alias("root"),
        F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )


#: Levels of the SQL: 16 to that power rows a group.
SQL_LEVELS = 7


def _sql_levels(name: str) -> str:
    """Nodes and siblings of each level: ``{name}0`` has tree, pos, n and h."""
    parts = []
    for at in range(SQL_LEVELS):
        run = "(PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN"
        parts.append(
            f"{name}s{at} AS (SELECT tree, pos, coalesce(string_agg(h, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
            f"coalesce(string_agg(h, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{at} WHERE n > 1)"
        )
        parts.append(f"{name}{at + 1} AS (SELECT tree, pos // 16 AS pos, first((n + 15) // 16) AS n, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {name}{at} WHERE n > 1 GROUP BY tree, pos // 16)")
    tops = " UNION ALL ".join(f"SELECT tree, h FROM {name}{at} WHERE n = 1" for at in range(SQL_LEVELS + 1))
    return ",\n".join([*parts, f"{name}top AS ({tops})"])


def _sql_walk(name: str, first: str, key: str) -> str:
    """From ``first`` (doc_id, tree, pos, f, proof and ``key``) up all levels of ``name``."""
    parts = [f"{name}w0 AS ({first})"]
    for at in range(SQL_LEVELS):
        parts.append(
            f"{name}w{at + 1} AS (SELECT w.tree, w.pos // 16 AS pos, {key}, CASE WHEN s.l IS NULL THEN f ELSE sha256(s.l || f || s.r) END AS f, "
            f"proof || coalesce(s.l, '') || coalesce(s.r, '') AS proof FROM {name}w{at} w LEFT JOIN {name}s{at} s ON w.tree = s.tree AND w.pos = s.pos)"
        )
    return ",\n".join(parts)


def _sql_leaf(text: str) -> str:
    values = [text if c == "text" else c for c in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in values) + ")"


OP13_SQL = f"""
WITH {CRC_SQL.strip()},
d AS (SELECT doc_id, source, {_sql_leaf('text')} AS leaf,
             {_sql_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} AS lowered, {crc_sql("hex(encode(doc_id::VARCHAR))")} % 5 = 0 AS touched FROM documents, crc_step),
p AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
             count(*) OVER (PARTITION BY source) AS n FROM d),
a0 AS (SELECT tree, pos, n, leaf AS h FROM p),
{_sql_levels('a')},
b0 AS (SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, h FROM atop),
{_sql_levels('b')},
{_sql_walk('a', "SELECT doc_id, tree, pos, leaf, CASE WHEN touched THEN lowered ELSE leaf END AS f, '' AS proof FROM p", 'doc_id, leaf')},
{_sql_walk('b', f"SELECT doc_id, leaf, tree AS source_tree, 0 AS tree, tree AS pos, f, proof FROM aw{SQL_LEVELS}", 'doc_id, leaf, source_tree')}
SELECT doc_id, leaf, atop.h AS subroot, btop.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = btop.h AS verified
FROM bw{SQL_LEVELS} w JOIN atop ON w.source_tree = atop.tree, btop
"""
