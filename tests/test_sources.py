import pytest

from tabpact import ColumnSpec, DefinitionError, SourceContract, custom_source, read_source, read_with_rejects, record_source, split_rejects

CONTRACT = SourceContract("P", [ColumnSpec("id", "int"), ColumnSpec("day", "date", nullable=True), ColumnSpec("v", "decimal(12,2)", nullable=True)])


def test_split_rejects(spark):
    df = spark.createDataFrame([("1", "2.5", "a"), ("x", "2.5", "b"), (None, None, "c"), ("y", "z", "d"), ("99999999999", "1", "e")], "i string, d string, k string")
    good, bad = split_rejects(df, {"i": "int", "d": "double"})
    assert {tuple(r) for r in good.collect()} == {(1, 2.5, "a"), (None, None, "c")}
    assert {(r.k, tuple(r.reject_columns)) for r in bad.collect()} == {("b", ("i",)), ("d", ("i", "d")), ("e", ("i",))}
    good, bad = split_rejects(df, {})
    assert (good.count(), bad.count()) == (5, 0)


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_file_rejects(spark, folder, fmt):
    lines = {
        "csv": ["1,2020-01-01,1.50", "x,2020-01-01,1.50", "2,,", "3,nodate,1", "4,2020-01-01"],
        "json": ['{"id":1,"day":"2020-01-01","v":1.50}', '{"id":"x"}', '{"id":2}', '{"id":3,"day":"nodate"}', "{broken"],
    }[fmt]
    spark.createDataFrame([(x,) for x in lines], "l string").coalesce(1).write.text(f"{folder}/t")
    good, bad = read_with_rejects(spark, CONTRACT, f"{folder}/t", fmt)
    assert sorted(r.id for r in good.collect()) == [1, 2]
    assert sorted(r._corrupt_record for r in bad.collect()) == sorted([lines[1], lines[3], lines[4]])
    assert [good.count(), good.select("id").count(), bad.count()] == [2, 2, 3]
    assert sorted(r.id for r in good.select("id").collect()) == [1, 2]
    assert bad.select("_corrupt_record").count() == 3
    assert good.columns == ["id", "day", "v"]


def test_table_rejects(spark, folder):
    spark.createDataFrame([("1", "2020-01-01", "7.25"), ("2", "soon", "1")], "id string, day string, v string").write.parquet(f"{folder}/t")
    good, bad = read_with_rejects(spark, CONTRACT, f"{folder}/t", "parquet")
    assert [r.id for r in good.collect()] == [1] and good.schema["v"].dataType.simpleString() == "decimal(12,2)"
    assert [r.reject_columns for r in bad.collect()] == [["day"]]


def test_text_formats_get_the_contract_schema(spark, folder):
    spark.createDataFrame([("1,2020-01-01,1.5",)], "l string").write.text(f"{folder}/t")
    row = read_source(spark, CONTRACT, f"{folder}/t", "csv").first()
    assert row.id == 1 and str(row.day) == "2020-01-01" and str(row.v) == "1.50"


def test_catalog_table(spark):
    spark.range(3).selectExpr("CAST(id AS int) id", "CAST(NULL AS date) day", "CAST(1 AS decimal(12,2)) v").createOrReplaceTempView("ptable")
    assert read_source(spark, CONTRACT, "ptable", "table").count() == 3


def test_record_source_partitions(spark):
    def read(part):
        for i in range(part, part + 2):
            yield (i, f"r{i}")

    df = record_source("tabpact_rows", "i int, s string", [0, 10, 20], read).load(spark)
    assert df.rdd.getNumPartitions() == 3
    assert sorted(r.i for r in df.collect()) == [0, 1, 10, 11, 20, 21]


def test_filters_reach_a_record_source(spark):
    from pyspark.sql import functions as F

    from tabpact import DelimitedSink, FilterParam, Pipeline

    def read(part, min_id, odd):
        yield from ((i, f"{min_id}") for i in range(part, part + 10) if i >= min_id)

    contract = SourceContract(
        "R",
        [ColumnSpec("i", "int"), ColumnSpec("s", "string")],
        filters=[FilterParam("min_id", "int"), FilterParam("odd", "boolean", default=None, optional=True, predicate=lambda v: (F.col("i") % 2 == 1) == v)],
    )
    source = record_source("tabpact_filtered", "i int, s string", [0, 10], read)

    def rows(**filters):
        plan = Pipeline("P").source("a", contract, custom=source, **filters).sink("o", DelimitedSink("unused")).pipe("a -> o")
        return sorted(tuple(r) for r in plan.frames(spark)["o"].collect())

    assert rows(min_id=7) == [(i, "7") for i in range(7, 20)]
    assert rows(min_id=15, odd=True) == [(15, "15"), (17, "15"), (19, "15")]


def test_a_filter_without_predicate_is_an_error_on_a_table(spark, folder):
    from tabpact import DelimitedSink, FilterParam, Pipeline

    contract = SourceContract("F", [ColumnSpec("id", "bigint")], filters=[FilterParam("x", "int", default=None, optional=True)])
    spark.range(3).write.parquet(f"{folder}/t")
    assert read_source(spark, contract, f"{folder}/t").count() == 3
    with pytest.raises(DefinitionError, match="no predicate"):
        read_source(spark, contract, f"{folder}/t", filters={"x": 1})
    with pytest.raises(DefinitionError, match="no predicate"):
        Pipeline("P").source("a", contract, f"{folder}/t", x=1).sink("o", DelimitedSink("p")).pipe("a -> o").validate()


def test_a_bad_value_does_not_pass_as_null(spark, folder):
    spark.createDataFrame([("1,2020-01-01,1.5",), ("2,2020-01-01,n/a",)], "l string").coalesce(1).write.text(f"{folder}/t")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        read_source(spark, CONTRACT, f"{folder}/t", "csv").collect()
    good, bad = read_with_rejects(spark, CONTRACT, f"{folder}/t", "csv")
    assert (good.count(), bad.count()) == (1, 1)
    loose = read_source(spark, CONTRACT, f"{folder}/t", "csv", options={"mode": "DROPMALFORMED"})
    assert [r.id for r in loose.collect()] == [1]


def test_record_source_failure_fails_the_job(spark):
    def read(part):
        yield (1,)
        raise RuntimeError("source broke")

    with pytest.raises(Exception, match="source broke"):
        record_source("tabpact_broken", "i int", [0], read).load(spark).collect()


def test_custom_source_name():
    with pytest.raises(DefinitionError):
        custom_source("not a name", lambda spark: None)


def _lines(part):
    """Slices with a reject at the start, in the middle and at the end."""
    from tabpact import Reject

    for i in range(part, part + 6):
        yield Reject(f"line {i}", "no number") if i % 5 in (0, 3) else (i, f"v{i}")


def _batches(part):
    import pyarrow as pa

    from tabpact import Reject

    yield Reject(f"head {part}", "early")
    for i in range(part, part + 3):
        yield pa.RecordBatch.from_pydict({"i": pa.array([i, i + 100], pa.int32()), "s": ["a", None]})
        yield Reject(f"after {i}", "late")


@pytest.mark.parametrize("read", [_lines, _batches])
def test_rejects_of_a_record_source(spark, folder, read):
    """Rows and rejects of one reading, whatever order they come in."""
    from tabpact import DelimitedSink, Pipeline, Reject

    opened = f"{folder}/opened"
    import os

    os.mkdir(opened)

    def counting(part):
        open(f"{opened}/{part}-{len(os.listdir(opened))}", "w").close()
        yield from read(part)

    contract = SourceContract("R", [ColumnSpec("i", "int"), ColumnSpec("s", "string", nullable=True)])
    source = record_source(f"tabpact_rejects{read.__name__}", "i int NOT NULL, s string", [0, 10], counting)
    plan = Pipeline("P").source("a", contract, custom=source, rejects_path=f"{folder}/rejects").sink("o", DelimitedSink(f"{folder}/out")).pipe("a -> o")
    plan.run(spark)
    items = [x for part in (0, 10) for x in read(part)]
    expected = [(x.record, x.reason) for x in items if isinstance(x, Reject)]
    rows = [r for x in items if not isinstance(x, Reject) for r in ([x[0]] if isinstance(x, tuple) else x.column(0).to_pylist())]
    assert sorted(tuple(r) for r in spark.read.parquet(f"{folder}/rejects").collect()) == sorted(expected)
    assert sorted(r.i for r in spark.read.schema("i int, s string").csv(f"{folder}/out").collect()) == sorted(rows)
    assert len(os.listdir(opened)) == 2  # each slice was read once
    bare = Pipeline("P").source("a", contract, custom=source).sink("o", DelimitedSink(f"{folder}/bare")).pipe("a -> o")
    with pytest.raises(Exception, match=expected[0][1]):
        bare.run(spark)
    assert not os.path.exists(f"{folder}/bare")
    with pytest.raises(Exception, match=expected[0][1]):
        source.load(spark).select("s").count()


def test_a_slice_of_rejects_only(spark):
    from tabpact import Reject
    from tabpact.sources.custom import split_tagged

    source = record_source("tabpact_all_rejects", "i int", [0], lambda part: (Reject(str(i), "no") for i in range(2_500)))
    rows, rejects = split_tagged(source.load_tagged(spark))
    assert (rows.count(), rejects.count()) == (0, 2_500)


def test_rejects_of_a_function_source(spark, folder):
    from pyspark.sql import functions as F

    from tabpact import REJECT, DelimitedSink, Pipeline

    def rows(spark):
        broken = F.when(F.col("id") % 4 == 1, F.struct(F.col("id").cast("string").alias("record"), F.lit("one too many").alias("reason")))
        return spark.range(10).select(F.col("id").cast("int").alias("id"), broken.alias(REJECT))

    contract = SourceContract("R", [ColumnSpec("id", "int")])
    plan = lambda source, **k: Pipeline("P").source("a", contract, custom=source, **k).sink("o", DelimitedSink(f"{folder}/out")).pipe("a -> o")
    plan(custom_source("some", rows, rejects=True), rejects_path=f"{folder}/rejects").run(spark)
    assert sorted(r.record for r in spark.read.parquet(f"{folder}/rejects").collect()) == ["1", "5", "9"]
    with pytest.raises(DefinitionError, match="has no rejects"):
        plan(custom_source("none", rows), rejects_path=f"{folder}/other").validate()
    with pytest.raises(DefinitionError, match="is taken"):
        record_source("clash", f"i int, {REJECT} string", [0], _lines)


@pytest.mark.parametrize("fmt", ["csv", "json"])
@pytest.mark.parametrize("stream", [False, True])
def test_a_bad_value_in_a_column_that_nobody_asks_for(spark, folder, fmt, stream):
    from tabpact import DelimitedSink, Pipeline
    from tabpact.streaming import stream_source

    lines = {"csv": ["1,2020-01-01,1.5", "2,2020-01-01,n/a", "3,2020-01-01,2"], "json": ['{"id":1,"v":1.5}', '{"id":2,"v":"n/a"}', '{"id":3}']}[fmt]
    spark.createDataFrame([(x,) for x in lines], "l string").coalesce(1).write.text(f"{folder}/t")
    plan = Pipeline("P").source("a", CONTRACT, f"{folder}/t", fmt, policy="fail").sink("o", DelimitedSink(f"{folder}/o"))
    plan.adapter("f", onto="o", mapping=[("id", "id")]).pipe("a -> f")
    if stream:
        with pytest.raises(Exception, match="MALFORMED|malformed|STREAM_FAILED"):
            stream_source(spark, CONTRACT, f"{folder}/t", fmt).select("id").writeStream.format("memory").queryName(f"bad_{fmt}").trigger(availableNow=True).start().awaitTermination()
        with pytest.raises(Exception, match="MALFORMED|malformed|STREAM_FAILED"):
            for q in plan.run_stream(spark, f"{folder}/checkpoint"):
                q.awaitTermination()
        return
    source = read_source(spark, CONTRACT, f"{folder}/t", fmt)
    for asked in (source.select("id").collect, source.count, lambda: plan.run(spark)):
        with pytest.raises(Exception, match="MALFORMED|malformed"):
            asked()


@pytest.mark.parametrize(("condition", "opened"), [("i >= 25", {20, 30}), ("i < 10", {0}), ("i = 12", {10}), ("i IN (5, 39)", {0, 30}), ("i > 100", set()), ("i >= 5 AND s = 'v7'", {0, 10, 20, 30})])
def test_slices_outside_a_filter_are_not_opened(spark, folder, condition, opened):
    import os

    def read(part):
        open(f"{folder}/{part}", "w").close()
        yield from ((i, f"v{i}") for i in range(part, part + 10))

    source = record_source("tabpact_bounded", "i int, s string", [0, 10, 20, 30], read, bounds=lambda part: {"i": (part, part + 9)})
    rows = source.load(spark).where(condition)
    every = spark.range(40).selectExpr("CAST(id AS int) AS i", "concat('v', id) AS s").where(condition)
    assert sorted(rows.collect()) == sorted(every.collect())
    assert {int(n) for n in os.listdir(folder)} == opened


def test_slices_of_a_stream_by_identity(spark, folder):
    """Listed in any order, each slice is read once, over restarts."""
    from tabpact import DelimitedSink, Pipeline

    contract = SourceContract("R", [ColumnSpec("i", "int")])

    def run(*slices):
        source = record_source("tabpact_logged", "i int", slices, lambda part: iter([(part,)]), log=f"{folder}/log")
        plan = Pipeline("P").source("a", contract, custom=source).sink("o", DelimitedSink(f"{folder}/o")).pipe("a -> o")
        for q in plan.run_stream(spark, f"{folder}/cp"):
            q.awaitTermination()
        return sorted(int(r.value) for r in spark.read.text(f"{folder}/o/batch_id=*").collect())

    assert run(3, 9) == [3, 9]
    assert run(9, 1, 3, 5) == [1, 3, 5, 9]
    assert run(5) == [1, 3, 5, 9]
