"""The operators made of DataFrame functions only."""

from pyspark.sql import functions as F

from tabpact.llm import licences, line_quality
from tests.llm.conftest import ODD, plain_words


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def brute_counts(text):
    text = text or ""
    words = plain_words(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if plain_words(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_of_odd_rows(spark, odd):
    rows = [(d, t) for d, t, *_ in ODD if t is None or len(t) < 1_000] + [(20, "a b c a b c a b c # x"), (21, "a a a a"), (22, "a b\na b\n\n a b\na b"), (23, "é x 漢 ##|<>")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("source", F.lit("s"))
    got = line_quality.quality(frame).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(((r.doc_id, *(r[n] for n in names)) for r in got), key=repr) == sorted(((d, *brute_counts(t)) for d, t in rows), key=repr)
    full = line_quality.quality(odd)
    assert full.count() == len(ODD)
    long = [r for r in full.collect() if r.doc_id == 4]
    assert len(long) == 2 and all(r.n_repeat_words == r.n_words == 54_000 and r.base_failed and not r.kept for r in long)


def test_frequent_lines_of_a_host(spark):
    """A notice on every page of a host goes; a text that is nothing else is depleted; the first copy stays; other hosts do not count."""
    body = lambda i: " ".join(f"word{i}x{k}" for k in range(60))
    notice = " ".join(f"notice{k}" for k in range(55))
    rows = [(i, f"{body(i)}\n{notice}", "a") for i in range(1, 13)] + [(20, notice.upper() + "  ", "a"), (0, notice, "a"), (30, notice, "b")]
    got = {r.doc_id: r for r in line_quality.quality(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert [d for d, r in sorted(got.items()) if not r.kept] == [20]
    assert got[20].left_share == 0 and got[0].left_share == 1 and got[30].left_share == 1 and 0.3 < got[5].left_share < 0.7


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, "a")] * 15 + [(2, text, "a")]
    assert line_quality.quality(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).where("kept").count() == 16


def test_no_rows(nothing):
    assert line_quality.quality(nothing).count() == 0
    assert licences.findings(nothing).count() == 0


def test_licences_by_hand(spark, odd):
    rows = [
        (1, "Some text.\nReleased under the MIT License.\nmore"),
        (2, "RELEASED under   the (MIT) license"),
        (3, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."),
        (4, "This work is licensed under the GNU General Public License, version 3."),
        (5, "A licence is not needed under the sun."),
        (6, licences.TEMPLATES["MIT-grant"].replace(",", ",\n")),
        (None, "Released under the MIT License."),
        (8, "the the the the " * 3_000),
    ]
    got = {(r.doc_id, r.licence, r.n_found) for r in licences.findings(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(1, "MIT", 1), (2, "MIT", 1), (3, "CC-BY-NC-4.0", 3), (4, "GPL-3.0", 1), (6, "MIT-grant", 1), (None, "MIT", 1)}
    assert licences.findings(odd).count() == 0


def test_bounds_lose_nothing(spark, documents):
    """Without them the same is found."""
    text = "\n".join(t[: len(t) * 9 // 10] for t in licences.TEMPLATES.values())
    lines = [(i, x) for i, x in enumerate(text.split("\n"))]
    got = {(r.doc_id, round(r.dice, 9)) for r in licences.findings(spark.createDataFrame(lines, "doc_id bigint, text string")).collect()}
    expected = set()
    for i, line in lines:
        a = set(licences.template_bigrams(line))
        best = max(2 * len(a & set(b)) / (len(a) + len(b)) if a else 0 for b in map(licences.template_bigrams, licences.TEMPLATES.values()))
        if best >= 0.8:
            expected.add((i, round(best, 9)))
    assert got == expected and got


def test_licences_of_long_parts_agree_with_the_sql(spark):
    """A notice that fills a text over and over, and a line of many words, on both sides."""
    import duckdb
    import pandas as pd

    notice = licences.TEMPLATES["MIT"]
    rows = [(1, f"{notice} " * 100), (2, f"{notice}\n" * 100), (3, " ".join(f"w{i}" for i in range(900)) + "\n" + licences.TEMPLATES["ISC"]), (4, None), (5, "")]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = {(r.doc_id, r.licence, round(r.dice, 9), r.n_found) for r in licences.findings(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(d, name, round(dice, 9), n) for d, name, dice, n in con.execute(licences.OP6_SQL).fetchall()}
    assert {d for d, *_ in got} == {1, 2, 3}


def test_notices_within_longer_texts(spark):
    """Wrapped above code, inside a longer line, edited a little, the whole licence text with other text around; on both sides."""
    import textwrap

    import duckdb
    import pandas as pd

    code = "\n".join(f"def f{i}(x): return x + {i}" for i in range(40))
    wrapped = {n: "\n".join(f"# {x}" for x in textwrap.wrap(licences.TEMPLATES[n], 60)) for n in ("MIT-grant", "GPL-3.0-header", "Apache-2.0-header", "BSD-3-Clause-text", "MIT-text", "ISC-text")}
    rows = [(i, f"Copyright 2020 Someone\n{notice}\n{code}") for i, notice in enumerate(wrapped.values())]
    inside = "Some words before this. " + licences.TEMPLATES["CC-BY-4.0"] + " And then many more words that go on and on for quite a while in the same line."
    edited = licences.TEMPLATES["MIT-text"].replace("without limitation", "with no limitation").replace("furnished", "given")
    rows += [(10, inside), (11, f"{code}\n{edited}\n{code}"), (12, code), (13, "the software is provided to the software of the software " * 30), (None, inside)]
    got = {(r.doc_id, r.licence, round(r.dice, 9), r.n_found) for r in licences.findings(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.array([d for d, _ in rows], "Int64"), "text": [t for _, t in rows]}))
    assert got == {(d, name, round(dice, 9), n) for d, name, dice, n in con.execute(licences.OP6_SQL).fetchall()}
    names = {}
    for doc, name, dice, _ in got:
        names.setdefault(doc, set()).add(name)
    for i, name in enumerate(wrapped):
        assert name in names[i], name
    assert names[10] == names[None] == {"CC-BY-4.0"} and names[11] == {"MIT-text"} and not {12, 13} & names.keys()
    assert names[4] == {"MIT-text"}


def test_no_python_in_the_plans(documents):
    assert no_python(line_quality.quality(documents)) and no_python(licences.findings(documents))


def test_frequent_lines_are_removed_from_the_texts(spark, odd):
    """What is left of the texts is what the report says."""
    body = lambda i: " ".join(f"word{i}x{k}" for k in range(60))
    notice = " ".join(f"notice{k}" for k in range(55))
    rows = [(i, f"{body(i)}\n\n {notice}\n{body(i)}\n{notice}", "a") for i in range(1, 13)] + [(20, notice.upper() + "  ", "a"), (0, notice, "a"), (30, notice, "b"), (40, None, "a"), (41, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    clean = line_quality.without_frequent_lines(docs)
    assert clean.columns == docs.columns and no_python(clean)
    got = {r.doc_id: r.text for r in clean.collect()}
    assert got == {i: f"{body(i)}\n\n{body(i)}" for i in range(1, 13)} | {20: "", 0: notice, 30: notice, 40: None, 41: ""}
    chars = lambda t: sum(len("".join(plain_words(x))) for x in {x.strip().lower() for x in (t or "").split("\n")})
    share = {r.doc_id: r.left_share for r in line_quality.quality(docs).collect()}
    texts = {d: t for d, t, _ in rows}
    assert all(abs(share[d] - (chars(got[d]) / chars(texts[d]) if chars(texts[d]) else 1)) < 1e-9 for d in texts)
    assert line_quality.without_frequent_lines(odd).count() == len(ODD)
