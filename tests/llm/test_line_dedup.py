import hashlib

import numpy as np
import pytest

from tabpact.llm import line_dedup
from tests.llm.conftest import ODD, plain_lower


def brute(rows):
    key = lambda line: plain_lower(line.strip(" \t\n\x0b\x0c\r"))
    first, seen = {}, {}
    for doc, text, *_ in rows:
        order = 2**63 - 1 if doc is None else doc
        for line in (text or "").split("\n"):
            k = key(line)
            if len(k) >= 10:
                seen.setdefault(k, set()).add(order)
    for k, docs in seen.items():
        if len(docs) > 1:
            first[k] = min(docs)
    out = []
    for doc, text, *_ in rows:
        order = 2**63 - 1 if doc is None else doc
        lines = (text or "").split("\n")
        kept = [x for x in lines if first.get(key(x), order) == order]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def digests(rows):
    return sorted(((d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in rows), key=repr)


def test_odd_rows_against_brute_force(odd):
    got = [tuple(r) for r in line_dedup.line_report(odd).collect()]
    assert sorted(got, key=repr) == digests(brute(ODD))


def test_texts_keep_their_columns(odd):
    got = line_dedup.dedup_lines(odd)
    assert got.columns == odd.columns
    rows = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    expected = sorted(((d, None if t is None else kept) for (d, t, *_), (_, _, _, kept) in zip(ODD, brute(ODD))), key=repr)
    assert rows == expected


def test_empty_table(nothing):
    assert line_dedup.line_report(nothing).count() == 0
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_a_hot_line_is_looked_up_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LOOKUPS_PER_TASK", 10)
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 5)
    rows = [(i, f"a line that all documents have\nline of document number {i}") for i in range(80)]
    got = [tuple(r) for r in line_dedup.line_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(got, key=repr) == digests(brute(rows))


@pytest.mark.parametrize("n", [1, 2, 1000, 50_000])
def test_hash_is_minimal_and_perfect(n):
    hashes = np.random.default_rng(n).integers(0, 2**64, n, np.uint64)
    levels = line_dedup.build_levels(hashes)
    assert sorted(line_dedup.slots(levels, n, hashes).tolist()) == list(range(n))
    assert sum(8 * len(x) for x in levels) < 5 * n + 400
    others = np.random.default_rng(n + 1).integers(0, 2**64, 1000, np.uint64)
    slot = line_dedup.slots(levels, n, others)
    assert ((slot >= -1) & (slot < n)).all()
