import hashlib

import pytest
from pyspark.sql import functions as F

from tabpact.llm import manifest as M
from tests.llm.conftest import ODD, SCHEMA


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    doc, text, lang, source, n = row
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)]
    return sha("".join(parts))


def climb(nodes, fanout):
    """The top, and per leaf the siblings to its left and right at each level."""
    paths, of = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = range(0, len(nodes), fanout)
        for a in runs:
            run = nodes[a : a + fanout]
            for k in range(len(run)):
                for i in of[a + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
        of = [[i for part in of[a : a + fanout] for i in part] for a in runs]
        nodes = [sha("".join(nodes[a : a + fanout])) for a in runs]
    return nodes[0] if nodes else None, paths


def brute(rows, fanout=16):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, leaf(row)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([x for *_, x in sorted(groups[s])], fanout) for s in order]
    root, above = climb([top for top, _ in trees], fanout)
    out = []
    for s, (top, paths), over in zip(order, trees, above):
        for (known, doc, x), path in zip(sorted(groups[s]), paths):
            out.append((doc if known else None, x, top, root, tuple(path + over)))
    return sorted(out, key=repr)


def proofs(manifest):
    rows = manifest.proofs().withColumn("to", M.folded(F.col("leaf"), F.col("path"))).collect()
    assert all(r.to == manifest.root for r in rows)
    return sorted(((r.doc_id, r.leaf, r.subroot, manifest.root, tuple(tuple(p) for p in r.path)) for r in rows), key=repr)


def made(n, sources):
    return [(i * 7 % n, f"text {i}", "en", sources[i % len(sources)] if i % 3 else sources[0], i) for i in range(n)]


@pytest.mark.parametrize(("n", "fanout", "sources"), [(300, 16, ["a"]), (300, 3, ["b", None, "a", "ä", "B"]), (17, 16, [None]), (1, 16, ["x"]), (60, 2, [f"s{i}" for i in range(50)])])
def test_against_brute_force(spark, n, fanout, sources):
    rows = made(n, sources)
    assert proofs(M.build(spark.createDataFrame(rows, SCHEMA), fanout=fanout)) == brute(rows, fanout)


def test_odd_rows(spark, odd):
    """The result has none of the other columns; equal rows are told apart by their place only."""
    manifest = M.build(odd)
    assert proofs(manifest) == brute(ODD)
    assert {r.group: r.n for r in manifest.subroots().collect()} == {None: 3, "a": 4, "b": 4}


def test_no_rows(spark, nothing):
    manifest = M.build(nothing)
    assert manifest.root is None and manifest.proofs().count() == 0 and manifest.subroots().count() == 0


def test_another_order_of_rows_gives_the_same_root_and_any_change_another(spark):
    rows = made(100, ["a", "b"])
    root = M.build(spark.createDataFrame(rows, SCHEMA)).root
    assert M.build(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5)).root == root
    changed = [*rows[:50], (*rows[50][:4], None), *rows[51:]]
    assert M.build(spark.createDataFrame(changed, SCHEMA)).root != root


def test_tampered_rows_are_not_verified(spark, sf):
    got = M.op13_manifest(spark, sf).collect()
    import zlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in got:
        touched = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and texts[r.doc_id] != "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r.doc_id])
        assert r.verified != touched and (r.folded_root == r.root) == r.verified
    assert len({r.root for r in got}) == 1 and not all(r.verified for r in got)


def test_no_python_worker(spark, sf):
    plan = M.op13_manifest(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_a_fanout_of_one_is_refused(nothing):
    with pytest.raises(ValueError, match="children"):
        M.build(nothing, fanout=1)
