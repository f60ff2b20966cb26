"""Every registered query of the subpackage against its SQL, and the pipeline stage by stage."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tabpact.llm import language, line_dedup, queries, simhash
from tests.compare import difference, oracle
from tabpact.staging import application_folder, stage
from tests.llm.conftest import ODD, SCHEMA


@pytest.fixture(scope="module")
def duck(sf):
    return oracle(sf)


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert set(queries.queries()) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf, duck, name):
    assert difference(queries.queries()[name](spark, sf), duck, queries.oracle_sql()[name]) is None


def test_stages(spark, sf, documents):
    """Each stage against what its operator says of its input."""
    functions = dict(corpus_pipeline.STAGES)
    known = stage(functions["language_id"](spark, documents, sf), "t")
    rejected = language.identify(documents, language.fit(documents)).where("rejected")
    assert known.columns == documents.columns
    assert known.exceptAll(documents).count() == 0 and known.count() == documents.count() - rejected.count()

    lines = stage(functions["line_dedup"](spark, known, sf), "t")
    report = {r.doc_id: r.kept_sha256 for r in line_dedup.line_report(known).collect()}
    import hashlib

    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in lines.collect()} == report
    assert lines.where("n_chars <> length(text)").count() == 0 and lines.columns == documents.columns

    single = stage(functions["simhash_near_dedup"](spark, lines, sf), "t")
    heads = {r.component for r in simhash.groups(lines).collect()}
    assert {r.doc_id for r in single.collect()} == heads

    clean = stage(functions["benchmark_decontamination"](spark, single, sf), "t")
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {r.doc_id: " ".join(r.text.lower().split()) for r in clean.collect()}
    assert not any(x in t for t in kept.values() for x in items)
    gone = [r for r in single.collect() if r.doc_id not in kept]
    assert gone and len(gone) < 0.05 * single.count()

    last = functions["sentencepiece"](spark, clean, sf)
    assert last.columns == ["doc_id", "n_pieces", "ids", "round_trip"] and last.count() == len(kept)
    assert last.where("NOT round_trip").count() == 0
    assert last.where("n_pieces <> size(ids)").count() == 0


def test_run(spark, tmp_path):
    """Odd rows and empty tables go through all stages."""
    benchmark = spark.createDataFrame([(1, "größe äö 漢字"), (None, None)], "item_id bigint, text string")
    for name, rows in (("odd", ODD), ("none", [])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        benchmark.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    import glob

    folder = application_folder(spark).removeprefix("file://")
    before = set(glob.glob(f"{folder}/*"))
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()} <= {4, 5, 6, None}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert len(set(glob.glob(f"{folder}/*")) - before) == 2
