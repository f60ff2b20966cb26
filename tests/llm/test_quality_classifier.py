import zlib

import numpy as np
import pytest

from tabpact.llm import quality_classifier as Q
from tests.llm.conftest import ODD


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def plain_features(words):
    """The places one by one, in Python integers."""
    cut = 2**32
    place = lambda h, salt: ((h ^ salt) * int(Q._SPREAD) % cut) >> (32 - Q.BITS)
    found, before = [], None
    for word in words:
        codes = [32, *map(ord, word), 32]
        for n in Q.NGRAMS:
            for i in range(len(codes) - n + 1):
                h = 0
                for c in codes[i : i + n]:
                    h = (h * int(Q._BASE) + c) % cut
                found.append(place(h, n))
    hashes = [sum(ord(c) * pow(int(Q._BASE), k + 1, cut) for k, c in enumerate(w)) % cut for w in words]
    read = [int(Q._AGAIN) if i and hashes[i - 1] == h else h for i, h in enumerate(hashes)]
    found += [place(h, 0) for h in read]
    found += [place((a * int(Q._BASE) + b) % cut, 1) for a, b in zip(read, read[1:])]
    return sorted(found)


@pytest.mark.parametrize("text", ["a", "ab", "a b", "the fox, THE fox!!", "no no no yes", "größe 漢字 😀 é", "x" * 200 + " y"])
def test_features_one_by_one(text):
    assert sorted(Q.features(text.split()).tolist()) == plain_features(text.split())


def test_held_out_accuracy(spark, sf, documents):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = Q.op11_quality(spark, sf).collect()
    assert len(got) == documents.count()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    judged = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum((s >= 0.5) == y for s, y in judged) >= 0.97 * len(judged)
    good, bad = ([s for s, y in judged if y == k] for k in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) >= 0.99


def test_held_out_labels_do_not_matter(spark, sf, documents):
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    changed = labels.withColumn("quality", F.when(Q.fold("doc_id") == 1, 7).otherwise(F.col("quality")))
    a, b = Q.fit(documents, labels), Q.fit(documents.withColumn("lang", F.lit("x")), changed)
    assert a.classes == b.classes == [0, 1] and (a.table == b.table).all()


def test_scores_are_those_of_the_vectors():
    """The table of contributions gives what averaging, outputs and softmax give."""
    model = Q.Classifier([0, 1, 2], np.random.default_rng(1).normal(size=(1 << Q.BITS, 2)).astype(np.float32))
    places = Q.features("some words of a text".split())
    z = np.concatenate([[0], model.table[places].astype(float).mean(axis=0)])
    assert model.chances("some  words\nof a text") == pytest.approx(np.exp(z) / np.exp(z).sum())


def test_chunks_hold_every_word(monkeypatch):
    monkeypatch.setattr(Q, "CHUNK", 10)
    chunks = list(Q._chunks("aa bbb cccc dd " + "x" * 25 + " e"))
    assert [w for c in chunks for w in c] == ["aa", "bbb", "cccc", "dd", "x" * 10, "x" * 10, "x" * 5, "e"] and len(chunks) > 3


def test_odd_rows(spark, odd, documents, sf):
    model = Q.fit(documents, spark.read.parquet(f"{sf}/labels.parquet"))
    got = Q.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.id in (1, 2, 3)} == {0.0}


def test_labels_missing_repeated_or_of_one_class(spark, nothing):
    ids = [i for i in range(40) if not held_out(i)]
    docs = spark.createDataFrame([(i, f"text {'good' if i % 2 else 'bad'} {i}") for i in ids] + [(ids[0], "aa copy of this id"), (None, "x")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in Q.score(docs, Q.fit(docs, none)).collect()} == {0.0}
    assert Q.score(nothing, Q.fit(nothing, none)).count() == 0
    one = spark.createDataFrame([(i, 1) for i in ids], "doc_id bigint, quality int")
    assert {r.score for r in Q.score(docs, Q.fit(docs, one)).collect()} == {1.0}
    both = spark.createDataFrame([(i, i % 2) for i in ids] + [(ids[1], None), (None, 0), (999, 1)], "doc_id bigint, quality int")
    more = both.union(spark.createDataFrame([(i, 0) for i in ids], "doc_id bigint, quality int"))
    assert (Q.fit(docs, both).table == Q.fit(docs, more).table).all()


def test_too_many_classes_are_refused(spark):
    labels = spark.createDataFrame([(i, i) for i in range(60)], "doc_id bigint, quality int")
    with pytest.raises(ValueError, match="classes"):
        Q.fit(spark.createDataFrame([], "doc_id bigint, text string"), labels)
