import random

import pytest
import sentencepiece

from tabpact.llm import pieces
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.fixture(scope="module")
def known():
    return pieces.Pieces(pieces.read_model())


def by_scan(known, text, chunk):
    whole, cuts = " " + text, []
    for left in range(0, len(whole), chunk):
        base, right = max(0, left - 2 * known.longest), min(len(whole), left + chunk)
        cuts.append((whole[base:right], base, left, right, right == len(whole)))
    matrices = [known.transfer(*c) for c in cuts]
    product = matrices[0]
    for m in matrices[1:]:
        product = pieces.product(product, m)
    ((entry, leave, weight),) = product
    path = pieces.best_states(matrices, entry, leave)
    ids = [i for c, s, t in zip(cuts, path, path[1:]) for i in known.trace(*c, s, t)]
    assert -weight == len(ids)
    return ids


def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice("abcdeinrst") for _ in range(rng.randrange(1, 300))) for _ in range(20)]
    made += ["".join(rng.choice("ab  \n.ç漢字é😀") for _ in range(rng.randrange(1, 200))) for _ in range(30)]
    return made + ["a" * 300, " " * 200, "aaaa " * 50, "theinternational" * 20, " the   end  ", "\t\n", "x", " " * 17 + "a" * 33 + " " * 40]


@pytest.mark.parametrize("chunk", [32, 41, 100])
def test_scan_gives_the_ids_of_the_library(known, library, chunk):
    for text in texts():
        assert by_scan(known, text, chunk) == library.encode(text)


def test_products_are_associative(known):
    whole = " " + "theinternational" * 20
    cuts = [(whole[max(0, a - 32) : a + 40], max(0, a - 32), a, min(len(whole), a + 40), a + 40 >= len(whole)) for a in range(0, len(whole), 40)]
    a, b, c = (known.transfer(*x) for x in cuts[:3])
    assert sorted(pieces.product(pieces.product(a, b), c)) == sorted(pieces.product(a, pieces.product(b, c)))


def test_round_trip(known):
    for text in [*texts(), "a literal ▁ and ▁▁", "▁", "<s> </s> <unk> <0x41>", "\x00 ́ \U0010ffff"]:
        assert known.decode(known.plain([" " + text])[0]) == text


def test_documents_against_the_library(spark, documents, library, monkeypatch):
    """Most documents are giants here, in several blocks."""
    monkeypatch.setattr(pieces, "BLOCK", 3)
    some = documents.where("doc_id < 120").union(spark.createDataFrame([(9_000, "abcdefg" * 1_000, None, None, None)], documents.schema))
    rows = pieces.encode(some, chunk=300).collect()
    assert len(rows) == some.count()
    for r in rows:
        assert r.ids == library.encode(r.text), r.doc_id


def test_odd_rows(spark, odd, nothing):
    got = pieces.encode(odd, chunk=1_000)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(((d, t) for d, t, *_ in ODD), key=repr)
    assert all((r.ids is None) == (r.text is None) for r in got.collect())
    assert pieces.digest(got).where("NOT round_trip").count() == 0
    back = pieces.decode(got).collect()
    assert all(r.decoded == r.text for r in back)
    assert pieces.encode(nothing).count() == 0 and pieces.digest(pieces.encode(nothing)).count() == 0
    with pytest.raises(ValueError):
        pieces.encode(odd, chunk=10)


def test_query(spark, sf, documents, library):
    import hashlib

    import numpy as np

    got = {r.doc_id: r for r in pieces.op9_pieces(spark, sf).collect()}
    for r in documents.where("doc_id % 7 = 0").collect():
        ids = library.encode(r.text)
        assert got[r.doc_id].n_pieces == len(ids) and got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, np.int32).tobytes()).hexdigest()
    assert len(got) == documents.count() and all(r.round_trip for r in got.values())
