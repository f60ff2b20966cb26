import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tabpact.llm import resampling as R
from tests.llm.conftest import ODD, plain_lower

ITEMS = ["The quick brown fox; jumps over", "größe 漢字 x1 y2", None, "", "the the the"]


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain_lower(text or ""))


def runs(text, longest):
    ws = plain_words(text)
    return [" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]


def brute(rows, items, longest, share, least):
    bucket = lambda f: zlib.crc32(f.encode()) % R.BUCKETS
    have, want = (Counter(bucket(f) for t in texts for f in runs(t, longest)) for texts in ([t for _, t in rows], items))
    s_all, t_all = sum(have.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * (s_all + R.BUCKETS) / ((have[b] + 1) * (t_all + R.BUCKETS))))
    out = []
    for doc, text in rows:
        found = runs(text, longest)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(text))])
    eligible = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, row in enumerate(eligible[: share * len(eligible) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.fixture(scope="module")
def rows():
    words = [f"w{i % 37}x" for i in range(400)] + ["tail" + str(i) for i in range(50)]
    made = [(100 + i, " ".join(words[(i * 7 + k * (i % 5 + 1)) % len(words)] for k in range(5 + i % 60))) for i in range(80)]
    return [(d, t) for d, t, *_ in ODD] + made + [(500, "one-two_three" + "\x00" + "four"), (501, "z" * 300 + " " + "z" * 300)]


@pytest.mark.parametrize(("longest", "head"), [(1, 20_000), (1, 5), (2, 20_000), (2, 30), (3, 50)])
def test_against_brute_force(spark, rows, monkeypatch, longest, head):
    """Whatever the head holds, the results are the same."""
    monkeypatch.setattr(R, "HEAD", head)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    target = spark.createDataFrame([(i, t) for i, t in enumerate(ITEMS)], "item_id bigint, text string")
    model = R.fit(docs, target, max_run=longest)
    assert head > 100 or 0 < len(model.head.states) <= head
    assert longest == 1 or len(model.head.pairs)
    got = R.resample(R.weigh(docs, model), share=30, min_words=10).select("id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, ITEMS, longest, 30, 10)


def test_head_words_and_pairs_are_exact(spark):
    docs = spark.createDataFrame([(1, "a b " * 500 + " ".join(f"t{i}" for i in range(300)))], "doc_id bigint, text string")
    head = R.fit_head(docs, max_run=2)
    assert head.states["a".encode()] == zlib.crc32(b"a")
    place = {w: i for i, w in enumerate(head.states)}
    at = np.searchsorted(head.pairs, place[b"a"] * len(place) + place[b"b"])
    assert head.pair_buckets[at] == zlib.crc32(b"a b") % R.BUCKETS


def test_odd_rows_and_empty_tables(spark, odd, nothing):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    got = R.resample(R.weigh(odd, R.fit(odd, empty)), share=100, min_words=0).collect()
    assert len(got) == len(ODD) and sorted(r["rank"] for r in got) == list(range(1, len(ODD) + 1))
    assert {(r.n_features, r.weight) for r in got if r.id in (1, 2, 3)} == {(0, 0)}
    assert R.resample(R.weigh(nothing, R.fit(nothing, empty))).count() == 0
