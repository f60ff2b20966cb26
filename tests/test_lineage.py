import random

import pytest

from tabpact import cycles, trace


def edges_of(spark, pairs, kind="int"):
    return spark.createDataFrame(pairs, f"src {kind}, dst {kind}")


def depths(pairs, start):
    seen, frontier, depth = {}, {start}, 0
    while frontier:
        depth += 1
        frontier = {d for s, d in pairs if s in frontier} - seen.keys()
        seen.update(dict.fromkeys(frontier, depth))
    return seen


def cyclic(pairs):
    return {(s, d) for s, d in pairs if s == d or s in depths(pairs, d)}


@pytest.mark.parametrize("seed", [1, 2])
def test_trace_against_search(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(12), rng.randrange(12)) for _ in range(16)]
    got = {(r.start, r.node, r.direction): r.depth for r in trace(edges_of(spark, pairs), [0, 5, 99], "both").collect()}
    back = [(d, s) for s, d in pairs]
    expected = {(s, n, "forward"): k for s in (0, 5) for n, k in depths(pairs, s).items()}
    expected.update({(s, n, "backward"): k for s in (0, 5) for n, k in depths(back, s).items()})
    assert got == expected


def test_trace_max_depth_and_starts_frame(spark):
    chain = edges_of(spark, [(i, i + 1) for i in range(5)])
    starts = spark.createDataFrame([(0,), (0,), (3,)], "any bigint")
    got = {(r.start, r.node) for r in trace(chain, starts, max_depth=2).collect()}
    assert got == {(0, 1), (0, 2), (3, 4), (3, 5)}
    with pytest.raises(ValueError):
        trace(chain, [0], "sideways")
    with pytest.raises(ValueError):
        trace(chain, [0], max_depth=0)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_cycles_against_search(spark, seed):
    rng = random.Random(seed)
    n = 14
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(20 if seed < 4 else 45)}
    assert {tuple(r) for r in cycles(edges_of(spark, list(pairs))).collect()} == cyclic(pairs)


def test_cycles_by_hand(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d"), ("f", "g"), ("b", "c")]
    edges = edges_of(spark, pairs + [(None, "a"), ("a", None)], "string")
    found = {("a", "a"), ("b", "c"), ("c", "b"), ("d", "e"), ("e", "f"), ("f", "d")}
    assert sorted(tuple(r) for r in cycles(edges).collect()) == sorted(found)
    exempt = cycles(edges, exempt_src=["b"], exempt_dst=spark.createDataFrame([("a",), ("d",)], "n string"))
    assert {tuple(r) for r in exempt.collect()} == {("c", "b"), ("d", "e"), ("e", "f")}


def test_no_edges(spark):
    empty = edges_of(spark, [])
    assert cycles(empty).count() == 0 and trace(empty, [1]).count() == 0
    assert cycles(edges_of(spark, [(1, 2), (2, 3)])).count() == 0


@pytest.mark.parametrize("shape", ["ring", "chain", "comb", "two_rings"])
def test_long_paths_take_few_rounds(spark, monkeypatch, shape):
    from pyspark.sql import functions as F

    from tabpact.operators import lineage

    rounds = []
    for name in ("_double", "_push", "_spread_labels"):
        monkeypatch.setattr(lineage, name, lambda *a, f=getattr(lineage, name): rounds.append(1) or f(*a))
    n = 10_000
    node = (F.col("id") * 7919 % n).alias("src")
    following = (F.col("id") + 1) * 7919 % n
    path = spark.range(n).select(node, following.alias("dst"))
    if shape == "chain":
        path = path.where("dst <> 0")
    if shape == "comb":  # a ring with a tail at each node
        path = path.union(spark.range(n).select(F.col("id"), F.col("id") + n))
    if shape == "two_rings":  # joined by one edge
        path = path.union(path.select(F.col("src") + n, F.col("dst") + n)).union(spark.createDataFrame([(5, n + 5)], "a bigint, b bigint"))
    got = cycles(path)
    assert got.count() == got.distinct().count() == {"ring": n, "chain": 0, "comb": n, "two_rings": 2 * n}[shape]
    assert got.join(path, ["src", "dst"], "left_anti").count() == 0
    assert len(rounds) <= {"two_rings": 120}.get(shape, 40), len(rounds)


def ladder(spark, n, closed=True):
    """Every node leads to the next two; node numbers tell nothing of the order."""
    from pyspark.sql import functions as F

    name = lambda x: x * 7919 % n
    steps = spark.range(n).select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    steps = steps if closed else steps.where(F.col("id") + F.col("k") < n)
    return steps.select(name(F.col("id")).alias("src"), name((F.col("id") + F.col("k")) % n).alias("dst"))


@pytest.mark.parametrize("closed", [True, False])
def test_a_long_ladder_takes_few_tables(spark, monkeypatch, closed):
    from tabpact import staging
    from tabpact.operators import components

    monkeypatch.setattr(components, "BLOCK_EDGES", 1_000)
    written = []
    real = staging.stage_at
    for module in ("tabpact.staging", "tabpact.operators.lineage", "tabpact.operators.components"):
        monkeypatch.setattr(f"{module}.stage_at", lambda df, path, *a: written.append(path) or real(df, path, *a))
    n = 10_000
    assert cycles(ladder(spark, n, closed)).count() == (2 * n if closed else 0)
    assert len(written) <= 60, len(written)


@pytest.mark.parametrize(("seed", "kind"), [(1, "int"), (2, "string")])
def test_blocks_against_search(spark, monkeypatch, seed, kind):
    """Graphs of several blocks, with paths between them in both directions."""
    from tabpact.operators import components, lineage

    monkeypatch.setattr(components, "BLOCK_EDGES", 30)
    monkeypatch.setattr(components, "BLOCK_NODES", 6)
    rng = random.Random(seed)
    n = 40
    pairs = {(i, (i + 1) % n) for i in range(n) if i not in (9, 22)} | {(rng.randrange(n), rng.randrange(n)) for _ in range(14)}
    pairs |= {(100 + i, 100 + (i + d) % 9) for i in range(9) for d in (1, 2, 3)}
    name = (lambda x: f"n{x}") if kind == "string" else (lambda x: x)
    edges = edges_of(spark, [(name(a), name(b)) for a, b in pairs], kind)
    expected = {(name(a), name(b)) for a, b in cyclic(pairs)}
    assert {tuple(r) for r in cycles(edges).collect()} == expected
    # Without the contraction of paths, all falls to the blocks.
    monkeypatch.setattr(lineage, "_contract", lambda links: None)
    assert {tuple(r) for r in cycles(edges).collect()} == expected


@pytest.mark.parametrize("nodes", [0, 1, 5, 9, 14])
def test_labels_of_one_task(nodes):
    import numpy as np

    from tabpact.operators.components import strong_labels

    rng = random.Random(nodes)
    for _ in range(60):
        pairs = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(rng.randrange(25) if nodes else 0)]
        label = strong_labels(np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64), nodes)
        reach = {a: depths(pairs, a) for a in range(nodes)}
        assert all((label[a] == label[b]) == (a == b or (b in reach[a] and a in reach[b])) for a in range(nodes) for b in range(nodes))
        assert all(label[a] >= label[b] for a, b in pairs)


def test_cycles_leave_one_table(spark):
    import glob

    from tabpact.staging import application_folder

    folder = application_folder(spark).removeprefix("file://")
    before = set(glob.glob(f"{folder}/*"))
    cycles(edges_of(spark, [(1, 2), (2, 1), (2, 3), (3, 4), (4, 2), (4, 1), (1, 3)])).collect()
    trace(edges_of(spark, [(1, 2), (2, 3)]), [1], "both").collect()
    assert len(set(glob.glob(f"{folder}/*")) - before) == 3


def test_a_chain_of_components_takes_few_passes(spark, monkeypatch):
    from tabpact.operators import lineage

    passes = []
    split = lineage._split_components
    monkeypatch.setattr(lineage, "_split_components", lambda links: passes.append(1) or split(links))
    pairs = [e for i in range(0, 20, 2) for e in ((i, i + 1), (i + 1, i), (i + 1, i + 2))]
    assert {tuple(r) for r in cycles(edges_of(spark, pairs)).collect()} == cyclic(set(pairs))
    assert len(passes) <= 6


def test_a_trace_writes_a_row_for_a_thousand_starts(spark):
    from tabpact.operators import lineage
    from tabpact.staging import new_folder

    starts = [f"s{i}" for i in range(1, 1_001)]
    pairs = [(s, f"c{i % 7}") for i, s in enumerate(starts)] + [(f"c{i}", "s5") for i in range(7)]
    links = edges_of(spark, pairs, "string").toDF("node", "next")
    folder = new_folder(spark, "reach")
    got = lineage._reach_sets(links, lineage._node_frame(links.toDF("src", "dst"), starts, "start"), 3, folder)
    expected = {(s, n, k) for s in starts for n, k in depths(pairs, s).items() if k <= 3}
    assert {tuple(r) for r in got.collect()} == expected
    # Seven nodes in one step, one in two, one in three: a row each, not one per 64 starts.
    assert spark.read.parquet(f"{folder}/reach").count() == 9


@pytest.mark.parametrize("few", [True, False])
def test_a_trace_is_unfolded_without_an_exchange(spark, monkeypatch, few):
    from tabpact.operators import lineage

    monkeypatch.setattr(lineage, "DRIVER_STARTS", 10_000 if few else 10)
    rng = random.Random(3)
    pairs = [(rng.randrange(150), rng.randrange(150)) for _ in range(220)]
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = trace(edges_of(spark, pairs), spark.range(150), max_depth=4)
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = [(r.start, r.node, r.depth) for r in got.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert sorted(rows) == sorted((s, n, k) for s in range(150) for n, k in depths(pairs, s).items() if k <= 4)
    # From the top: what is unfolded is neither sent nor joined any more.
    assert "Generate" in plan and "Exchange" not in plan[: plan.index("Generate")] and "Join" not in plan[: plan.index("Generate")], plan


def test_a_trace_leaves_no_shuffle_files(spark):
    import time

    from tabpact.staging import FREE_SHUFFLES

    def files():
        every = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in every.split("\n") if "/shuffle_" in f}

    edges, before = edges_of(spark, [(i, i * 7 % 50) for i in range(50)]), files()
    got = trace(edges, spark.range(50), "both")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert spark.conf.get(FREE_SHUFFLES, "false") == "false"
    # Only what the rounds wrote is gone.
    assert got.count() == got.distinct().count() == 2 * sum(len(depths({(i, i * 7 % 50) for i in range(50)}, i)) for i in range(50))


def test_freed_shuffles_may_be_nested(spark):
    from tabpact.staging import FREE_SHUFFLES, freed_shuffles

    spark.conf.set(FREE_SHUFFLES, "false")
    with freed_shuffles(spark):
        with freed_shuffles(spark):
            pass
        assert spark.conf.get(FREE_SHUFFLES) == "true"
    assert spark.conf.get(FREE_SHUFFLES) == "false"
    spark.conf.unset(FREE_SHUFFLES)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_a_dense_graph_is_joined_by_samples(spark, monkeypatch, kind):
    from tabpact.operators import components, lineage

    monkeypatch.setattr(components, "BLOCK_EDGES", 300)
    sizes, found = [], lineage._found
    monkeypatch.setattr(lineage, "_found", lambda rest, size: sizes.append(size) or found(rest, size))
    rng = random.Random(5)
    # Two dense components, edges from one to the other, and nodes before, between and behind them.
    pairs = {(g + rng.randrange(40), g + rng.randrange(40)) for g in (0, 100) for _ in range(1_500)}
    pairs |= {(3, 103), (7, 120), (200, 5), (9, 201), (201, 110), (104, 202), (202, 203), (203, 202)}
    name = (lambda x: f"n{x}") if kind == "string" else (lambda x: x)
    edges = edges_of(spark, [(name(a), name(b)) for a, b in pairs], kind)
    got = [tuple(r) for r in cycles(edges).collect()]
    assert set(got) == {(name(a), name(b)) for a, b in cyclic(pairs)} and len(got) == len(set(got))
    assert sizes and max(sizes) < len(pairs) / 2, sizes
