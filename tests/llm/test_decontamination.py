import random

import numpy as np

from tabpact.llm import decontamination as D


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        above, row = row, [i] + [0] * len(text)
        for j, x in enumerate(text, 1):
            row[j] = min(above[j - 1] + (c != x), above[j] + 1, row[j - 1] + 1)
    return min(row), row.index(min(row))


def edited(text, n, rng):
    chars = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(chars)), rng.random()
        if kind < 0.34:
            chars[at] = rng.choice("abcdefghij")
        elif kind < 0.67:
            chars.insert(at, rng.choice("abcdefghij"))
        else:
            del chars[at]
    return "".join(chars)


def norm(text):
    return D.normalised(text.encode()).decode()


def test_edit_distances_are_exact():
    rng = random.Random(2)
    for size in (3, 60, 64, 65, 130):
        items = [[rng.randrange(4) for _ in range(size)] for _ in range(12)]
        texts = [[rng.randrange(5) for _ in range(rng.randrange(0, 200))] for _ in items]
        for item, text in zip(items, texts):
            if rng.random() < 0.5:
                text[len(text) // 2 : len(text) // 2] = [c for c in item if rng.random() < 0.9]
        best, end = D.edit_distances([np.array(x) for x in items], [np.array(x, np.int32) for x in texts], 4)
        for item, text, b, e in zip(items, texts, best.tolist(), end.tolist()):
            assert (b, e) == brute_distance(item, text)


def test_recall_over_edits_up_to_the_limit(spark, sf, documents):
    """Each item put into a document after random edits, from none to the allowed distance."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    known = D.prepare([(i, t.encode()) for i, t in items])
    around = [norm(r.text)[:800] for r in documents.where("n_chars > 2000").limit(40).collect()]
    rng, found, tried = random.Random(7), 0, 0
    for share in (0.0, 0.05, 0.1, 0.15, 0.2):
        texts = []
        for _, text in items:
            plain = norm(text)
            other = rng.choice(around)
            texts.append(norm(other[:400] + " " + edited(plain, int(share * len(plain)), rng) + " " + other[400:]).encode())
        hits = {(d, k) for d, k, *_ in D.matches_in(texts, known)}
        found += sum((i, i) in hits for i in range(len(items)))
        tried += len(items)
        if share <= 0.1:
            assert sum((i, i) in hits for i in range(len(items))) >= 0.97 * len(items)
    assert found >= 0.9 * tried


def test_query_against_brute_force(spark, sf, documents):
    """All exact passages are found, and whatever is found is near enough."""
    items = {r.item_id: norm(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    texts = {r.doc_id: norm(r.text) for r in documents.collect()}
    rows = D.op10_decontamination(spark, sf).collect()
    assert {(d, i) for d, t in texts.items() for i, x in items.items() if x in t} <= {(r.doc_id, r.item_id) for r in rows}
    for r in rows:
        lo = max(0, r.end - 2 * len(items[r.item_id]))
        assert r.distance <= 0.2 * len(items[r.item_id])
        assert brute_distance(items[r.item_id], texts[r.doc_id][lo : r.end])[0] == r.distance


def test_odd_rows(spark, odd):
    items = spark.createDataFrame(
        [(1, "one line of words that is THERE twice"), (2, None), (3, ""), (None, "größe äö 漢字"), (4, "fox"), (5, "fox"), (6, "to be " * 30), (7, "short")],
        "item_id bigint, text string",
    )
    got = {(r.doc_id, r.item_id, r.distance) for r in D.matches(odd, items).collect()}
    assert got == {(5, 1, 0), (None, 1, 0), (4, 4, 0), (4, 5, 0), (5, 7, 0)} | {x for x in got if x[1] is None}
    kept = D.drop_contaminated(odd, items)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 3, 6}
    assert not {4, 5} & {r.doc_id for r in kept.collect()}


def test_items_of_common_words_are_found(spark):
    docs = spark.createDataFrame([(1, "so it goes: " + "to be or not " * 9 + "and more"), (2, "to be or not")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "to be or not " * 9), (2, "and and and and and and and")], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id, r.distance) for r in D.matches(docs, items).collect()] == [(1, 1, 0)]


def test_empty_tables_and_several_passes(spark, nothing, odd, monkeypatch):
    items = spark.createDataFrame([(i, f"number {i} of the benchmark items with words {i * 7} in it") for i in range(30)], "item_id bigint, text string")
    assert D.matches(nothing, items).count() == 0
    assert D.matches(odd, items.limit(0)).count() == 0
    assert D.drop_contaminated(odd, items.limit(0)).count() == odd.count()
    docs = items.selectExpr("item_id AS doc_id", "concat('before it ', text, ' and after') AS text")
    once = sorted(tuple(r) for r in D.matches(docs, items).collect())
    monkeypatch.setattr(D, "MAX_ITEM_BYTES", 500)
    assert len(D.item_passes(items)) > 1
    assert sorted(tuple(r) for r in D.matches(docs, items).collect()) == once and len(once) >= 30
    assert D.drop_contaminated(docs, items).count() == 0


def test_items_without_blanks_and_short_items_are_all_found():
    """Within longer runs, next to punctuation, and after edits anywhere up to the limit."""
    rng = random.Random(11)
    han = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(120))
    token = "".join(rng.choice("abcdef0123456789") for _ in range(48))
    items = [han[30:70], han[80:92], token, "sphinx of quartz", "ภาษาไทยไม่มีช่องว่างระหว่างคำ", "judge my vow", "quokka"]
    known = D.prepare([(i, t.encode()) for i, t in enumerate(items)])
    for share in (0.0, 0.1, 0.2):
        for _ in range(20):
            texts = [norm(f"甲乙丙丁x{edited(t, int(share * len(t)), rng)}戊己庚辛, and more words").encode() for t in items]
            hits = {(d, k): distance for d, k, distance, _ in D.matches_in(texts, known)}
            assert all(hits[i, i] <= int(0.2 * len(t)) for i, t in enumerate(items))
    # One character changed in each word.
    text = norm("they wrote: sphunx af quortz! judqe my vow").encode()
    assert {k: d for _, k, d, _ in D.matches_in([text, b"nothing here"], known)} == {3: 3, 5: 1}


def test_pieces_against_brute_force():
    rng = random.Random(12)
    items = ["".join(rng.choice("ab 漢字") for _ in range(rng.randrange(1, 14))) for _ in range(30)]
    texts = ["".join(rng.choice("ab 漢字c") for _ in range(rng.randrange(0, 40))) for _ in range(30)]
    items, texts = [norm(t) or "a" for t in items], [norm(t) for t in texts]
    known = D.prepare([(i, t.encode()) for i, t in enumerate(items)])
    got = {(d, k): distance for d, k, distance, _ in D.matches_in([t.encode() for t in texts], known)}
    expected = {(d, k): brute_distance(i, t)[0] for d, t in enumerate(texts) if t for k, i in enumerate(items) if len(i.split()) < 6}
    expected = {x: n for x, n in expected.items() if n <= int(0.2 * len(items[x[1]]))}
    assert {x: n for x, n in got.items() if len(items[x[1]].split()) < 6} == expected and expected
