import math
from collections import Counter

import pytest

from tabpact.llm import lm_scoring as M
from tests.llm.conftest import ODD, plain_lower, plain_words


def brute(rows, good, vocabulary):
    words = {i: plain_words(plain_lower(t or "")) for i, (_, t) in enumerate(rows)}
    counts = Counter(w for ws in words.values() for w in ws)
    known = {w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:vocabulary]}
    coded = {i: [w if w in known else None for w in ws] for i, ws in words.items()}
    size = len(known) + 1

    def model(docs):
        pairs = Counter(p for ws in docs for p in zip(["<s>", *ws], ws))
        first, second = Counter(), Counter()
        for (v, w), n in pairs.items():
            first[v] += n
            second[w] += n
        total = sum(second.values())
        chance = lambda w: (second[w] + 1) / (total + size)
        return lambda v, w: -math.log((pairs[v, w] + M.STRENGTH * chance(w)) / (first[v] + M.STRENGTH))

    target = model([coded[i] for i, (d, _) in enumerate(rows) if d in good])
    background = model(list(coded.values()))
    out = []
    for i, (d, _) in enumerate(rows):
        ws = coded[i]
        losses = [sum(m(v, w) for v, w in zip(["<s>", *ws], ws)) / len(ws) if ws else None for m in (target, background)]
        out.append((d, len(ws), *losses))
    return out


@pytest.mark.parametrize("vocabulary", [5, 1_000])
def test_against_brute_force(spark, vocabulary):
    rows = [(d, t) for d, t, *_ in ODD] + [(10, "the fox and the dog"), (11, "the dog and the fox and THE")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(10, 1), (10, 0), (5, 1), (None, 1), (11, None), (4, 0), (99, 1)], "doc_id bigint, quality int")
    got = M.score(docs, M.fit(docs, labels, vocabulary=vocabulary)).collect()
    expected = brute(rows, {10, 5}, vocabulary)
    assert len(got) == len(expected)
    key = lambda r: (repr(r[0]), r[1], r[3] or 0)
    for mine, other in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key)):
        assert mine[:2] == other[:2]
        assert mine[2:4] == (None, None) if other[2] is None else mine[2:4] == pytest.approx(other[2:], abs=1e-4)
        assert mine[5] == (mine[4] is not None and mine[4] < 0)


def test_good_documents_score_lower(spark, sf):
    from pyspark.sql import functions as F

    scored = M.op3_lm_scoring(spark, sf)
    means = {r.quality: r.m for r in scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality").agg(F.mean("loss_difference").alias("m")).collect()}
    assert means[1] < 0 < means[0]
    assert scored.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_a_large_set_of_good_ids_is_joined(spark, sf, documents, monkeypatch):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    sent = M.fit(documents, labels, vocabulary=50)
    monkeypatch.setattr(M, "MAX_IDS", 3)
    joined = M.fit(documents, labels, vocabulary=50)
    assert sent.ids == joined.ids and (sent.target == joined.target).all() and (sent.background == joined.background).all()


def test_no_rows(spark, nothing, odd):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert M.score(nothing, M.fit(nothing, labels)).count() == 0
    got = M.score(odd, M.fit(odd, labels)).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.loss_target) for r in got if r.n_tokens)


@pytest.mark.parametrize("frequent", [1, 20, 1_000_000])
def test_every_word_and_bigram_counts(spark, monkeypatch, frequent):
    """More words than any fixed vocabulary holds, and documents that differ in rare words only."""
    monkeypatch.setattr(M, "FREQUENT", frequent)
    rows = [(d, t) for d, t, *_ in ODD]
    rows += [(100 + i, " ".join(f"w{(7 * i + j) % 1500}" for j in range(60))) for i in range(300)]
    rows += [(1000, "the rare alpha word"), (1001, "the rare beta word"), (1002, "the rare alpha word again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(d, 1) for d in (100, 110, 120, 1002, 5)], "doc_id bigint, quality int")
    got = M.score(docs, M.fit(docs, labels)).collect()
    expected = brute(rows, {100, 110, 120, 1002, 5}, 10**9)
    key = lambda r: (repr(r[0]), r[1], r[3] or 0)
    assert len(got) == len(expected)
    for mine, other in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key)):
        assert mine[:2] == other[:2]
        assert mine[2:4] == (None, None) if other[2] is None else mine[2:4] == pytest.approx(other[2:], abs=1e-4)
    scores = {r.doc_id: r.loss_difference for r in got}
    assert scores[1000] < scores[1001] - 0.01


def _rows():
    rows = [(d, t) for d, t, *_ in ODD]
    return rows + [(100 + i, " ".join(f"w{(7 * i + j * j) % 90}" for j in range(i % 50))) for i in range(200)]


def _same(got, expected):
    key = lambda r: (repr(r[0]), r[1], r[3] or 0)
    assert len(got) == len(expected)
    for mine, other in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key)):
        assert mine[:2] == other[:2]
        assert mine[2:4] == (None, None) if other[2] is None else mine[2:4] == pytest.approx(other[2:], abs=1e-6)


@pytest.mark.parametrize("frequent", [6, 60, 3_000])
def test_many_chunks_and_shards(spark, monkeypatch, frequent):
    """Words that are tail, head, or head in frequent bigrams only, met over several chunks and shards."""
    for name, value in (("FREQUENT", frequent), ("HELD_TOKENS", 300), ("SHARD_TOKENS", 2_000)):
        monkeypatch.setattr(M, name, value)
    docs = spark.createDataFrame(_rows(), "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(d, 1) for d in range(100, 300, 7)], "doc_id bigint, quality int")
    models = M.fit(docs, labels)
    assert 0 < len(models.counts.hashes) <= frequent
    _same(M.score(docs, models).collect(), brute(_rows(), set(range(100, 300, 7)), 10**9))


def test_other_documents_than_those_counted(spark):
    """They do not change the counts; what was never seen counts as 0."""
    docs = spark.createDataFrame(_rows(), "doc_id bigint, text string")
    labels = spark.createDataFrame([(d, 1) for d in range(100, 300, 7)], "doc_id bigint, quality int")
    models = M.fit(docs, labels)
    own = {r.doc_id: r for r in M.score(docs, models).collect() if r.doc_id in (130, 140)}
    texts = dict(_rows())
    others = spark.createDataFrame([(1, texts[130]), (2, texts[140]), (3, "neverx seenx wordsx"), (4, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in M.score(others, models).collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[4].loss_target is None and got[3].n_tokens == 3
    for a, b in ((130, 1), (140, 2)):
        assert (own[a].loss_target, own[a].loss_background) == pytest.approx((got[b].loss_target, got[b].loss_background))
    # Three words of which none was ever seen: only the shares of the unknown word are left.
    tokens, words = models.counts.tokens, models.counts.words
    starts, s = models.counts.before[-1], M.STRENGTH
    for model, loss in enumerate((got[3].loss_target, got[3].loss_background)):
        chance = 1 / (tokens[model] + words + 1)
        expected = (-math.log(s * chance / (starts[model] + s)) - 2 * math.log(chance)) / 3
        assert loss == pytest.approx(expected)
