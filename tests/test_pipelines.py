import glob

import pytest
from pyspark.sql import functions as F

from tabpact import (
    Check,
    ColumnSpec,
    DefinitionError,
    DelimitedSink,
    Field,
    FilterParam,
    Pipeline,
    SourceContract,
    custom_source,
    track_column,
    track_field,
    track_function,
)
from tabpact.plans.employment import EMPLOYMENT, FIELDS, MONTH, feed

NUMBERS = SourceContract(
    "Numbers",
    [ColumnSpec("n", "bigint", checks=Check(lambda c: c % 10 != 7, name="no_seven"))],
    filters=[
        FilterParam("lo", "bigint", default=0, predicate=lambda v: F.col("n") >= v),
        FilterParam("hi", "bigint", default=None, optional=True, predicate=lambda v: F.col("n") < v),
    ],
)


@pytest.fixture(scope="module")
def numbers(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("numbers") / "t")
    spark.range(100).withColumnRenamed("id", "n").write.parquet(path)
    return path


def lines_of(path):
    return sorted("".join(open(f).read() for f in glob.glob(f"{path}/part-*")).split())


def test_all_problems_at_once(numbers):
    plan = (
        Pipeline("bad name")
        .source("a", NUMBERS, numbers, lo="x", unknown=1)
        .source("a", NUMBERS, numbers)
        .source("b", NUMBERS, numbers, policy="maybe")
        .source("c", NUMBERS)
        .source("d", NUMBERS, numbers, filters={"lo": 1}, lo=2)
        .source("q", NUMBERS, numbers, policy="quarantine")
        .sink("s", DelimitedSink, path="p", delimiter="")
        .sink("t", DelimitedSink, nothing=1)
        .adapter("u", onto="nowhere", mapping=[])
        .pipe("a -> nowhere")
        .pipe("nobody -> a -> b")
        .pipe("nobody", "s")
    )
    with pytest.raises(DefinitionError) as e:
        plan.validate()
    text = "\n".join(e.value.problems)
    for part in (
        "'bad name' is not an identifier",
        "'lo': invalid literal",
        "unknown filter 'unknown'",
        "'a' already exists",
        "unknown policy 'maybe'",
        "'c' needs either",
        "'lo' is set twice",
        "needs a bad_path",
        "the delimiter must not be empty",
        "nothing",
        "'nowhere' not found",
        "not of the form",
        "source 'nobody' not found",
    ):
        assert part in text, part


def test_bindings_do_not_share_values(spark, numbers, folder):
    plan = (
        Pipeline("Two")
        .source("small", NUMBERS, numbers, policy="drop", hi=5)
        .source("large", NUMBERS, numbers, policy="drop", filters={"lo": 95})
        .sink("s", DelimitedSink(f"{folder}/s"))
        .sink("l", DelimitedSink(f"{folder}/l"))
        .pipe("small -> s")
        .pipe("large -> l")
    )
    plan.run(spark)
    assert lines_of(f"{folder}/s") == ["0", "1", "2", "3", "4"]
    assert lines_of(f"{folder}/l") == ["95", "96", "98", "99"]


def test_fan_in_is_one_write(spark, numbers, folder):
    plan = Pipeline("In").sink("s", DelimitedSink(f"{folder}/s"))
    for name, lo, hi in (("a", 0, 3), ("b", 2, 4)):
        plan.source(name, NUMBERS, numbers, lo=lo, hi=hi).pipe(name, "s")
    plan.run(spark)
    assert lines_of(f"{folder}/s") == ["0", "1", "2", "2", "3"]


def test_fan_out_reads_once(spark, folder):
    calls = spark.sparkContext.accumulator(0)

    def rows(spark, lo, hi):
        def seen(batches):
            for b in batches:
                calls.add(b.num_rows)
                yield b

        return spark.range(10).withColumnRenamed("id", "n").mapInArrow(seen, "n bigint")

    plan = Pipeline("Out").source("a", NUMBERS, custom=custom_source("rows", rows), policy="drop")
    plan.sink("x", DelimitedSink(f"{folder}/x")).sink("y", DelimitedSink(f"{folder}/y")).pipe("a -> x").pipe("a -> y")
    plan.run(spark)
    assert lines_of(f"{folder}/x") == lines_of(f"{folder}/y") == [str(i) for i in range(10) if i != 7]
    assert calls.value == 10


def test_policies(spark, numbers, folder):
    def plan(policy, **kw):
        return (
            Pipeline("P")
            .source("a", NUMBERS, numbers, policy=policy, hi=10, key=["n"], **kw)
            .sink("s", DelimitedSink(f"{folder}/{policy}"))
            .pipe("a -> s")
        )

    with pytest.raises(Exception, match="a row breaks no_seven"):
        plan("fail").run(spark)
    assert not glob.glob(f"{folder}/fail/part-*") and not glob.glob(f"{folder}/fail/_SUCCESS")
    plan("quarantine", bad_path=f"{folder}/bad").run(spark)
    assert "7" not in lines_of(f"{folder}/quarantine")
    bad = spark.read.parquet(f"{folder}/bad").collect()
    assert [(r.n, r.violations[0].check_id) for r in bad] == [(7, "no_seven")]
    plan("report", bad_path=f"{folder}/report_rows").run(spark)
    assert "7" in lines_of(f"{folder}/report")
    assert [r.check_id for r in spark.read.parquet(f"{folder}/report_rows").collect()] == ["no_seven"]


def test_all_widths_are_checked_before_the_first_write(spark, numbers, folder):
    plan = Pipeline("W").source("a", NUMBERS, numbers, policy="drop")
    plan.sink("x", DelimitedSink(f"{folder}/x")).sink("y", DelimitedSink(f"{folder}/y", header=["a", "b"])).sink("z", DelimitedSink(f"{folder}/z", header=["a", "b", "c"]))
    plan.pipe("a -> x").pipe("a -> y").pipe("a -> z")
    with pytest.raises(DefinitionError) as e:
        plan.run(spark)
    assert len(e.value.problems) == 2 and not glob.glob(f"{folder}/x")


def test_fail_without_rules(spark, numbers, folder):
    bare = SourceContract("Bare", [ColumnSpec("n", "bigint", nullable=True)])
    plan = Pipeline("P").source("a", bare, numbers).sink("s", DelimitedSink(f"{folder}/s")).pipe("a -> s")
    plan.run(spark)
    assert len(lines_of(f"{folder}/s")) == 100


def test_nothing_is_left_of_a_shared_source(spark, numbers, folder):
    from tabpact.staging import application_folder

    before = set(glob.glob(f"{application_folder(spark).removeprefix("file://")}/*"))
    plan = Pipeline("P").source("a", NUMBERS, numbers, policy="drop").sink("s", DelimitedSink(f"{folder}/s")).sink("t", DelimitedSink(f"{folder}/t"))
    plan.pipe("a -> s").pipe("a -> t").run(spark)
    assert set(glob.glob(f"{application_folder(spark).removeprefix("file://")}/*")) == before


def test_failed_definition_runs_no_job(spark, numbers):
    # A status tracker would see a job; reading a path that does not exist would raise another error.
    plan = Pipeline("P").source("a", NUMBERS, "/does/not/exist", lo="x").sink("s", DelimitedSink("p")).pipe("a -> s")
    with pytest.raises(DefinitionError):
        plan.run(spark)


def test_feed_returns_the_row_count(spark, sf, folder):
    outcome = feed(f"{sf}/orders.parquet", f"{folder}/o", exclude_terminations=True, **MONTH).run(spark)
    assert outcome == {"feed": 118}
    first = sorted(glob.glob(f"{folder}/o/part-*"))[0]
    assert open(first).readline().replace('"', "") == "#,Employee ID,Hire Date,Termination Date,Salary,Department,Job Title\n"


def test_lineage_of_a_pipeline(spark, sf):
    edges = feed(f"{sf}/orders.parquet", "unused").edges(spark)
    assert {r.node for r in track_column(edges, "er", "meta").collect()} == {
        "sink:feed.Department",
        "sink:feed.Job Title",
        "sink:csv.Department",
        "sink:csv.Job Title",
    }
    assert {r.node for r in track_field(edges, "csv", "Salary").collect()} == {"source:er.salary"}
    both = {(r.node, r.direction) for r in track_function(edges, "map_get").collect()}
    assert ("source:er.meta", "backward") in both and ("sink:csv.Job Title", "forward") in both


def test_edges_without_adapter(spark, numbers):
    plan = Pipeline("P").source("a", NUMBERS, numbers).sink("s", DelimitedSink("p")).pipe("a -> s")
    assert [tuple(r) for r in plan.edges(spark).collect()] == [("source:a.n", "sink:s.n")]


def test_adapter_fields_are_the_sample_record():
    assert [f.name for f in FIELDS] == ["Employee ID", "Hire Date", "Termination Date", "Salary", "Department", "Job Title"]
    assert EMPLOYMENT.column_names == ["employee_id", "hire_date", "termination_date", "salary", "meta"]
    assert Field("x", "a + b").inputs() == () and Field("x", "a").inputs() == ("a",)


@pytest.mark.parametrize("order", [("good", "bad"), ("bad", "good")])
def test_all_sinks_or_none(spark, numbers, folder, order):
    """One sink breaks in the middle of its rows: no output, no quarantined rows, nothing pending is left."""
    import os

    from tabpact import custom_sink

    class Writer:
        def put(self, row):
            if row.n == 50:
                raise RuntimeError("the sink broke")

        def done(self):
            return None

    seen = []
    sinks = {"good": DelimitedSink(f"{folder}/good"), "bad": custom_sink("tabpact_breaking", lambda part, attempt: Writer())}
    plan = Pipeline("P").source("a", NUMBERS, numbers, policy="quarantine", bad_path=f"{folder}/quarantine")
    for name in order:
        plan.sink(name, sinks[name]).pipe(f"a -> {name}")
    with pytest.raises(Exception, match="the sink broke"):
        plan.run(spark)
    assert os.listdir(folder) == []


def test_a_custom_sink_commits_after_all_are_written(spark, numbers, folder):
    class Writer:
        def __init__(self):
            self.n = 0

        def put(self, row):
            self.n += 1

        def done(self):
            return self.n

    from tabpact import custom_sink

    def plan(name, second):
        sink = custom_sink(name, lambda part, attempt: Writer(), committed.append, aborted.append)
        made = Pipeline("P").source("a", NUMBERS, numbers, policy="drop").sink("s", sink).sink("t", second)
        return made.pipe("a -> s").pipe("a -> t")

    committed, aborted = [], []
    plan("tabpact_counting", DelimitedSink(f"{folder}/t")).run(spark)
    assert [sum(results) for results in committed] == [90] and not aborted
    with pytest.raises(Exception, match="exists"):
        plan("tabpact_counting_again", DelimitedSink(f"{folder}/t")).run(spark)
    assert len(committed) == 1 and [sum(results) for results in aborted] == [90]


def test_lineage_needs_no_declaration(spark, sf, folder):
    """Expressions, functions over rows, an adapter on an adapter and user functions, read off the plan."""
    twice = F.udf(lambda x: 2 * x, "double").asNondeterministic()
    orders = SourceContract(
        "O",
        [
            ColumnSpec("price", "double", source="o_totalprice", checks=Check("price > 0")),
            ColumnSpec("who", "bigint", source="o_custkey"),
            ColumnSpec("day", "date", source="CAST(o_orderdate AS date)"),
        ],
        filters=[FilterParam("status", "string", default=None, optional=True, predicate=lambda v: F.col("o_orderstatus") == v)],
    )
    plan = (
        Pipeline("P")
        .source("a", orders, f"{sf}/orders.parquet", policy="drop", status="F")
        .sink("o", DelimitedSink("p"))
        .adapter("named", onto="o", mapping=[("amount", "price * 2"), ("key", "concat(who, '/', day)"), ("double", lambda: twice("price"))])
        .adapter("free", onto="named", mapping=lambda df: df.where("who > 3").groupBy("who", "day").agg(F.sum("price").alias("price")))
        .pipe("a -> named")
        .pipe("a -> free")
    )
    edges = {tuple(r) for r in plan.edges(spark).collect()}
    assert {
        ("source:a.price", "sink:named.amount"),
        ("source:a.who", "sink:named.key"),
        ("source:a.day", "sink:named.key"),
        ("source:a.price", "fn:<lambda>"),
        ("fn:<lambda>", "sink:named.double"),
        ("source:a.price", "sink:free.price"),
        ("source:a.who", "sink:free.who"),
        ("sink:free.price", "sink:named.amount"),
        ("sink:named.amount", "sink:o.amount"),
    } <= edges
    assert not any(a.startswith(("table:", "rows:")) for a, _ in edges)
    stored = {tuple(r) for r in plan.edges(spark, stored=True).collect()}
    assert {b for a, b in stored if a == "table:a.o_orderstatus"} == {"rows:a"}
    assert {("table:a.o_orderdate", "source:a.day"), ("source:a.price", "rows:a"), ("rows:a", "sink:named.key")} <= stored


def test_lineage_of_a_frame(spark):
    from tabpact import column_lineage

    left = spark.createDataFrame([], "a int, b int, l array<int>").alias("x")
    right = spark.createDataFrame([], "k int, v int").alias("y")
    left.createOrReplaceTempView("lineage_x")
    joined = left.where("a > 0").join(right, F.col("a") == F.col("k")).groupBy("b").agg(F.sum(F.col("v") * 2).alias("s"))
    found = column_lineage(joined)
    assert found.columns == {"b": {("x", "b")}, "s": {("y", "v")}}
    assert found.rows == {("x", "a"), ("y", "k"), ("x", "b")}
    exploded = column_lineage(left.select("b", F.explode("l").alias("e")))
    assert exploded.columns == {"b": {("x", "b")}, "e": {("x", "l")}}
    union = column_lineage(left.select("a").union(right.select("v")))
    assert union.columns == {"a": {("x", "a"), ("y", "v")}}
    opaque = column_lineage(left.drop("l").mapInArrow(lambda b: b, "p int, q int"))
    assert opaque.columns["p"] == {("x", "a"), ("x", "b")}
    text = column_lineage(spark.sql("WITH z AS (SELECT a, sum(b) AS c FROM lineage_x WHERE l IS NOT NULL GROUP BY a) SELECT c + 1 AS d FROM z WHERE a IN (SELECT b FROM lineage_x)"))
    assert text.columns == {"d": {("x", "b")}} and text.rows == {("x", c) for c in "abl"}  # the view is of an aliased frame


def test_a_source_in_one_partition_is_shared_in_many_files(spark, numbers, folder, monkeypatch):
    from tabpact.plans import pipeline

    monkeypatch.setattr(pipeline, "ROWS_PER_FILE", 10)
    files, staged = [], pipeline.stage
    monkeypatch.setattr(pipeline, "stage", lambda *a: files.append(staged(*a)) or files[-1])
    counted, prepare = [], DelimitedSink.prepare
    monkeypatch.setattr(DelimitedSink, "prepare", lambda self, df, *a: counted.append(len(df.inputFiles())) or prepare(self, df, *a))
    contract = SourceContract("Rows", columns=[ColumnSpec("id", "bigint")])
    plan = Pipeline("Shared").source("s", contract, custom=custom_source("one", lambda spark, **_: spark.range(95).coalesce(1)))
    plan.sink("a", DelimitedSink(f"{folder}/a")).sink("b", DelimitedSink(f"{folder}/b")).pipe("s -> a").pipe("s -> b").run(spark)
    assert counted == [10, 10]
    assert sorted(int(r[0]) for r in spark.read.csv(f"{folder}/a").collect()) == list(range(95))
