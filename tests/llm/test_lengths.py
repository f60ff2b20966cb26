import pytest

from tabpact.llm import lengths
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def ranks():
    return lengths.read_ranks()


def check(sums, found, limits):
    rows = sums.collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(found))
    for r in rows:
        assert r.n_docs == found.count(r.n_tokens) and r.docs_total == len(found) and r.tokens_total == sum(found)
        assert r.docs_longer == sum(x > r.n_tokens for x in found) and r.tokens_longer == sum(x for x in found if x > r.n_tokens)
        assert r.tokens_truncated == sum(min(x, r.n_tokens) for x in found)
    for r in lengths.at_limits(sums, limits).collect():
        assert (r.docs, r.tokens) == (len(found), sum(found))
        assert r.docs_longer == sum(x > r.limit for x in found) and r.tokens_truncated == sum(min(x, r.limit) for x in found)
    ordered = sorted(found)
    for r in lengths.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == next(x for x in ordered if sum(y <= x for y in found) / len(found) >= r.share)


def test_query_against_brute_force(spark, sf, documents, ranks):
    found = [lengths.count_tokens(r.text, ranks) for r in documents.collect()]
    check(lengths.op4_lengths(spark, sf), found, [0, 1, 100, 777, 10**7])


def test_odd_rows(odd, ranks):
    found = [lengths.count_tokens(t, ranks) for _, t, *_ in ODD]
    assert found[0] == found[1] == 0
    check(lengths.truncated(lengths.histogram(odd)), found, [0, 5, 5, 10**6])


def test_no_rows(nothing):
    sums = lengths.truncated(lengths.histogram(nothing))
    assert sums.count() == 0
    assert [tuple(r) for r in lengths.at_limits(sums, [7]).collect()] == [(7, 0, 0, 0, 0)]
    assert [tuple(r) for r in lengths.quantiles(sums, [0.5]).collect()] == [(0.5, None)]


def test_long_runs_of_blanks(ranks):
    cut, _ = lengths._encodings(ranks)
    for text in ("x" + " " * 700 + "y", " " * 600, "a\n" + "\n" * 800 + "  b", "\t" * 501 + "c" + " " * 999):
        assert lengths.count_tokens(text, ranks) == len(cut.encode_ordinary(text))
    assert lengths.count_tokens("a" + " " * 300_000 + "b", ranks) > 0
    assert lengths.count_tokens("<|endoftext|>", ranks) > 1
