import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tabpact.llm import simhash
from tabpact.llm.components import components
from tests.llm.conftest import ODD, plain_lower, plain_words


def brute_print(text):
    words = plain_words(plain_lower(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(nodes, near):
    """The smallest node that each can reach."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(nodes), 2):
        if near(a, b):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {n: find(n) for n in nodes}


def test_odd_rows_against_brute_force(odd):
    rows = simhash.groups(odd).collect()
    got = sorted(((r.doc, r.print % 2**64) for r in rows), key=repr)
    assert got == sorted(((d, brute_print(t)) for d, t, *_ in ODD), key=repr)
    prints = {}
    for d, t, *_ in ODD:
        if d is not None:
            prints.setdefault(d, set()).add(brute_print(t))
    expected = reach(prints, lambda a, b: any((x ^ y).bit_count() <= 2 for x in prints[a] for y in prints[b]))
    assert {(r.doc, r.component) for r in rows} == {*expected.items(), (None, None)}


def test_no_rows(nothing):
    assert simhash.groups(nothing).count() == 0
    assert simhash.drop_near_copies(nothing).columns == nothing.columns


def test_one_of_each_group_stays(odd):
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns
    members = {r.doc: r.component for r in simhash.groups(odd).collect() if r.doc is not None}
    assert {r.doc_id for r in kept.collect()} == {d for d, c in members.items() if d == c} | {None}


def test_masks_cover_every_pair_of_bits():
    for a, b in itertools.combinations(range(64), 2):
        assert any(not m >> a & 1 and not m >> b & 1 for m in (x % 2**64 for x in simhash.masks()))
    assert len(simhash.masks()) == 7


@pytest.mark.parametrize("small", [1_000, 3])
def test_links_connect_what_is_near(spark, small):
    """Also when every bucket counts as large."""
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints):
        for _ in range(6):
            p ^= 1 << rng.randrange(64)
            prints.add(p)
    nodes = {i: p for i, p in enumerate(sorted(prints))}
    frame = spark.createDataFrame([(p - 2**64 if p >> 63 else p, i) for i, p in nodes.items()], "print bigint, node bigint")
    found = {r.node: r.component for r in components(simhash.links(frame, small=small)).collect()}
    expected = reach(nodes, lambda a, b: (nodes[a] ^ nodes[b]).bit_count() <= 2)
    assert {n: found.get(n, n) for n in nodes} == expected


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, 200), (5, 6), (5, 6)]
    linked = {p for p in pairs} | {(b, a) for a, b in pairs}
    nodes = {x for p in pairs for x in p if p[0] != p[1]}
    expected = reach(nodes, lambda a, b: (a, b) in linked)
    got = components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    assert len(got) == len(nodes) and {r.node: r.component for r in got} == expected
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_query_against_brute_force(spark, documents, tmp_path):
    """The whole fixture, all pairs compared."""
    documents.where("doc_id < 300").write.parquet(f"{tmp_path}/documents.parquet")
    rows = simhash.op8_simhash(spark, str(tmp_path)).collect()
    prints = {r.doc_id: brute_print(r.text) for r in documents.where("doc_id < 300").collect()}
    assert {r.doc_id: r.fingerprint for r in rows} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == reach(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)


def test_many_copies_are_one_node(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("the same few words in every row").alias("text"))
    assert simhash.groups(docs).where("component = 0").count() == 500
