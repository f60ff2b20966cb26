import zlib

import pytest

from tabpact.llm import language
from tests.llm.conftest import ODD


def test_held_out_accuracy(spark, sf, documents):
    rows = language.op2_language(spark, sf).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == documents.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) < 0.02 * len(rows)


def test_labels_ids_and_held_out_rows_do_not_matter(spark, documents):
    """The dictionaries do not change when held-out rows do."""
    from pyspark.sql import functions as F

    changed = documents.withColumn("lang", F.when(language.fold("doc_id") == 1, "xx").otherwise(F.col("lang")))
    assert language.fit(changed) == language.fit(documents)


def test_odd_rows(spark, odd, documents):
    known = language.fit(documents)
    got = language.identify(odd, known).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert isinstance(r.score, float)
        if r.text is None or not any(map(str.isalpha, r.text)):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in {lang for lang, _ in known}
    kept = language.keep_known(odd)
    assert kept.columns == odd.columns


def test_nothing_to_learn_from(spark, nothing, documents):
    assert language.fit(nothing) == []
    assert language.identify(nothing, []).count() == 0
    assert {r.lang_pred for r in language.identify(documents.limit(3), []).collect()} == {"und"}
    alone = spark.createDataFrame([(0, "some words of one language only", "aa")], "doc_id bigint, text string, lang string")
    one = language.fit(alone)
    row = language.identify(alone, one).first()
    assert (row.lang_pred, row.score, row.rejected) == ("aa", 1.0, False)


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 2)
    docs = spark.createDataFrame([(i, "words", f"l{i}") for i in range(12)], "doc_id bigint, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        language.fit(docs)


def test_equal_totals_go_to_the_first():
    tools = language.compressors([("b", b"same words"), ("a", b"same words")])
    assert language.classify("same words", ["b", "a"], tools) == ("b", 0.0)
