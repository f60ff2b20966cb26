import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tabpact import DelimitedSink, Pipeline, RowSequence, check_counts, stream_sink, stream_source
from tabpact.operators import enforce, violations
from tabpact.plans.queries import EVENTS
from tests.test_sinks import folder_sink


@pytest.fixture(scope="module")
def events(spark, sf, tmp_path_factory):
    """The events in six files."""
    path = str(tmp_path_factory.mktemp("events") / "t")
    spark.read.parquet(f"{sf}/events.parquet").repartitionByRange(6, "event_id").write.parquet(path)
    return path


def numbered(folder):
    return DelimitedSink(f"{folder}/out", row_sequence=RowSequence(["ts", "event_id"], start=100, name="n", rows_per_range=500))


def read_numbered(spark, folder):
    schema = "n bigint, event_id bigint, ts string, user_id bigint, event_type string, value double"
    return spark.read.schema(schema).csv(f"{folder}/out/batch_id=*")


def test_numbers_go_on_across_batches(spark, events, folder):
    stream = stream_source(spark, EVENTS, events, options={"maxFilesPerTrigger": "2"})
    stream_sink(stream, numbered(folder), f"{folder}/cp").awaitTermination()
    assert len(glob.glob(f"{folder}/out/batch_id=*")) == 3
    rows = read_numbered(spark, folder).collect()
    total = spark.read.parquet(events).count()
    assert sorted(r.n for r in rows) == list(range(100, 100 + total))
    assert len({r.event_id for r in rows}) == total


def test_restart_and_repeated_batch(spark, events, folder):
    files = sorted(glob.glob(f"{events}/part-*"))
    shutil.copytree(events, f"{folder}/in", ignore=lambda d, names: [n for n in names if f"{d}/{n}" not in files[:3]])

    def run():
        stream = stream_source(spark, EVENTS, f"{folder}/in", options={"maxFilesPerTrigger": "1"})
        stream_sink(stream, numbered(folder), f"{folder}/cp").awaitTermination()

    run()
    before = {(r.n, r.event_id) for r in read_numbered(spark, folder).collect()}
    # The last batch failed after its output was written: its commit is gone, so it runs again.
    commits = f"{folder}/cp/query/commits"
    for name in os.listdir(commits):
        if name in ("2", ".2.crc"):
            os.unlink(f"{commits}/{name}")
    for f in files[3:]:
        shutil.copy(f, f"{folder}/in")
    run()
    rows = {(r.n, r.event_id) for r in read_numbered(spark, folder).collect()}
    total = spark.read.parquet(events).count()
    assert before <= rows and len(rows) == total
    assert sorted(n for n, _ in rows) == list(range(100, 100 + total))


def test_stream_equals_batch(spark, events, folder):
    plan = (
        Pipeline("Watch")
        .source("ev", EVENTS, events, options={"maxFilesPerTrigger": "2"}, policy="quarantine", bad_path=f"{folder}/bad", min_value=5)
        .sink("out", DelimitedSink(f"{folder}/out"))
        .adapter("slim", onto="out", mapping=[("id", "event_id"), ("kind", "event_type")])
        .pipe("ev -> slim")
    )
    queries = plan.run_stream(spark, f"{folder}/cp")
    for q in queries:
        q.awaitTermination()
    batch = plan.sources["ev"].rows(spark)
    good, bad = enforce(batch, EVENTS, "quarantine")
    written = spark.read.schema("id bigint, kind string").csv(f"{folder}/out/batch_id=*")
    expected = good.select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    assert written.count() == expected.count() and written.exceptAll(expected).count() == 0
    assert spark.read.parquet(f"{folder}/bad").count() == bad.count()
    counts = check_counts(spark, f"{folder}/cp", "ev").collect()
    assert {c.batch_id for c in counts} == {0, 1, 2}
    assert sum(c.tested for c in counts if c.scope == "rows") == batch.count()
    failures = {r.check_id: r["count"] for r in violations(batch, EVENTS, ["event_id"]).groupBy("check_id").count().collect()}
    assert {k: sum(c.failed for c in counts if c.check_id == k) for k in failures} == failures


def many_files(spark, events, path, number):
    spark.read.parquet(events).repartitionByRange(number, "event_id").write.mode("append").parquet(path)


def test_counts_of_more_than_a_hundred_batches_and_a_restart(spark, events, folder):
    """Numbered sink, one file a batch: every row is counted once, also by the batches that the progress has forgotten."""
    from tabpact.staging import application_folder

    before = set(glob.glob(f"{application_folder(spark).removeprefix("file://")}/*"))
    many_files(spark, events, f"{folder}/in", 104)
    files = spark.read.parquet(f"{folder}/in")
    plan = (
        Pipeline("Many")
        .source("ev", EVENTS, f"{folder}/in", options={"maxFilesPerTrigger": "1"}, policy="drop")
        .sink("out", DelimitedSink(f"{folder}/out", row_sequence=RowSequence(["event_id"], name="n")))
        .pipe("ev -> out")
    )

    def run():
        for q in plan.run_stream(spark, f"{folder}/cp"):
            q.awaitTermination()

    run()
    total = files.count()
    many_files(spark, events, f"{folder}/in", 3)
    run()
    counts = check_counts(spark, f"{folder}/cp", "ev").collect()
    assert len({c.batch_id for c in counts}) == 107
    assert sum(c.tested for c in counts if c.scope == "rows") == 2 * total
    written = spark.read.schema("n bigint, event_id bigint").csv(f"{folder}/out/batch_id=*")
    good = files.where("event_type <> 'error' AND value < 200").count()
    assert sorted(r.n for r in written.collect()) == list(range(1, 2 * good + 1))
    assert set(glob.glob(f"{application_folder(spark).removeprefix("file://")}/*")) == before


def test_lost_numbers_stop_the_stream(spark, events, folder):
    stream = stream_source(spark, EVENTS, events, options={"maxFilesPerTrigger": "2"})
    shutil.copytree(events, f"{folder}/in")
    stream = stream_source(spark, EVENTS, f"{folder}/in", options={"maxFilesPerTrigger": "2"})
    stream_sink(stream, numbered(folder), f"{folder}/cp").awaitTermination()
    shutil.rmtree(f"{folder}/cp/last_number")
    many_files(spark, events, f"{folder}/in", 1)
    with pytest.raises(Exception, match="numbers cannot go on"):
        stream_sink(stream, numbered(folder), f"{folder}/cp").awaitTermination()


def test_no_counts_yet(spark, folder):
    assert check_counts(spark, folder, "none").collect() == []


def test_rejects_of_a_stream(spark, folder):
    from tabpact import ColumnSpec, SourceContract

    contract = SourceContract("P", [ColumnSpec("id", "int"), ColumnSpec("v", "double", nullable=True)])
    spark.createDataFrame([("1,2.5",), ("2,n/a",), ("3,",)], "l string").coalesce(1).write.text(f"{folder}/in")
    plan = Pipeline("R").source("a", contract, f"{folder}/in", "csv", rejects_path=f"{folder}/rejects")
    plan.sink("o", DelimitedSink(f"{folder}/o")).pipe("a -> o")
    for q in plan.run_stream(spark, f"{folder}/cp"):
        q.awaitTermination()
    assert [r._corrupt_record for r in spark.read.parquet(f"{folder}/rejects").collect()] == ["2,n/a"]
    assert sorted(r.value for r in spark.read.text(f"{folder}/o/batch_id=*").collect()) == ["1,2.5", "3,"]
    strict = Pipeline("S").source("a", contract, f"{folder}/in", "csv").sink("o", DelimitedSink(f"{folder}/s")).pipe("a -> o")
    with pytest.raises(Exception):
        for q in strict.run_stream(spark, f"{folder}/cp2"):
            q.awaitTermination()


def test_adapter_over_a_custom_sink_on_a_stream(spark, events, folder):
    import json

    stream = stream_source(spark, EVENTS, events)
    sink = folder_sink(folder, "tabpact_adapted_folder").adapt([("id", "event_id")]).adapt([("event_id", "event_id + 0")])
    stream_sink(stream.select("event_id").where("event_id <> 13"), sink, f"{folder}/cp").awaitTermination()
    got = [i for p in glob.glob(f"{folder}/part-*") for i in json.load(open(p))]
    assert sorted(got) == sorted(r.event_id for r in spark.read.parquet(events).where("event_id <> 13").collect())


def test_custom_sink_on_a_stream(spark, events, folder):
    stream = stream_source(spark, EVENTS, events).select(F.col("event_id").alias("id")).where("id <> 13")
    stream_sink(stream, folder_sink(folder, "tabpact_stream_folder"), f"{folder}/cp").awaitTermination()
    import json

    got = [i for p in glob.glob(f"{folder}/part-*") for i in json.load(open(p))]
    assert len(got) == len(set(got)) == spark.read.parquet(events).count() - 1


def test_sources_without_a_stream(spark, folder):
    from tabpact import DefinitionError, custom_source

    plan = Pipeline("P").source("a", EVENTS, custom=custom_source("x", lambda s, min_value: None))
    plan.sink("o", DelimitedSink(f"{folder}/o")).pipe("a -> o")
    with pytest.raises(DefinitionError, match="cannot be read as a stream"):
        plan.run_stream(spark, f"{folder}/cp")


def test_a_record_source_as_a_stream(spark, folder):
    """Slices that have come since the last run are read, and none twice."""
    from tabpact import ColumnSpec, FilterParam, SourceContract, record_source

    contract = SourceContract("R", [ColumnSpec("i", "int")], filters=[FilterParam("least", "int")])
    os.makedirs(f"{folder}/slices")

    def read(part, least):
        yield from ((i,) for i in range(part, part + 10) if i >= least)

    def slices():
        return sorted(int(name) for name in os.listdir(f"{folder}/slices"))

    def run(*new):
        for part in new:
            open(f"{folder}/slices/{part}", "w").close()
        plan = Pipeline("P").source("a", contract, custom=record_source("tabpact_sliced", "i int", slices, read), least=3)
        plan.sink("o", DelimitedSink(f"{folder}/o")).pipe("a -> o")
        for q in plan.run_stream(spark, f"{folder}/cp"):
            q.awaitTermination()
        return sorted(int(r.value) for r in spark.read.text(f"{folder}/o/batch_id=*").collect())

    assert run(0, 10) == list(range(3, 20))
    assert run(20) == list(range(3, 30))
    counts = check_counts(spark, f"{folder}/cp", "a").where("scope = 'rows'").collect()
    assert sum(c.tested for c in counts) == 27


def test_a_run_stopped_between_two_sinks(spark, events, folder):
    """The batch is repeated: the output that was there is not made again, the missing one is; counts and bad rows are there once."""
    from tabpact import custom_sink

    committed = {"first": [], "second": []}
    broken = [True]

    class Writer:
        def __init__(self):
            self.ids = []

        def put(self, row):
            self.ids.append(row.event_id)

        def done(self):
            return self.ids

    def sink(name):
        def commit(results, batch_id):
            if name == "second" and batch_id == 1 and broken:
                broken.pop()
                raise RuntimeError("stopped in between")
            committed[name].append((batch_id, sorted(i for ids in results for i in ids)))

        return custom_sink(f"tabpact_between_{name}", lambda part, attempt: Writer(), commit)

    plan = Pipeline("Between").source("ev", EVENTS, events, options={"maxFilesPerTrigger": "1"}, policy="quarantine", bad_path=f"{folder}/bad")
    for name in committed:
        plan.sink(name, sink(name)).pipe(f"ev -> {name}")
    plan.sink("lines", DelimitedSink(f"{folder}/lines", row_sequence=RowSequence(["event_id"], name="n"))).pipe("ev -> lines")

    def run():
        queries = plan.run_stream(spark, f"{folder}/cp")
        assert len(queries) == 1
        queries[0].awaitTermination()

    with pytest.raises(Exception, match="stopped in between"):
        run()
    assert [b for b, _ in committed["first"]] == [0, 1] and [b for b, _ in committed["second"]] == [0]
    run()
    assert committed["first"] == committed["second"] and [b for b, _ in committed["first"]] == list(range(len(committed["first"])))
    good, bad = enforce(plan.sources["ev"].rows(spark), EVENTS, "quarantine")
    assert sorted(i for _, ids in committed["first"] for i in ids) == sorted(r.event_id for r in good.collect())
    lines = spark.read.schema("n bigint, event_id bigint").csv(f"{folder}/lines/batch_id=*").collect()
    assert sorted(r.n for r in lines) == list(range(1, good.count() + 1))
    assert spark.read.parquet(f"{folder}/bad").count() == bad.count()
    counts = check_counts(spark, f"{folder}/cp", "ev").where("scope = 'rows'").collect()
    assert sum(c.tested for c in counts) == good.count() + bad.count()


def test_sources_that_meet_in_a_sink_are_one_query(spark, events, folder):
    """What pipes connect is one query; what they do not is another."""
    from tabpact import ColumnSpec, SourceContract

    ids = SourceContract("Ids", [ColumnSpec("event_id", "bigint")])
    plan = Pipeline("Meet").source("a", ids, events).source("b", ids, events).source("apart", EVENTS, events, policy="drop")
    for name in ("both", "own", "alone"):
        plan.sink(name, DelimitedSink(f"{folder}/{name}"))
    plan.pipe("a -> both").pipe("apart -> alone").pipe("b -> own").pipe("b -> both")
    queries = plan.run_stream(spark, f"{folder}/cp")
    for q in queries:
        q.awaitTermination()
    total = spark.read.parquet(events).count()
    count = lambda name: spark.read.text(f"{folder}/{name}/batch_id=*").count()
    assert len(queries) == 2 and count("own") == total and count("both") == 2 * total and 0 < count("alone") < total
