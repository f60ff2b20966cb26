import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tabpact import with_sequence
from tabpact.operators import sequence as module


def numbers(df, key, name="rec_num"):
    return {r[key]: r[name] for r in df.select(key, name).collect()}


@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_same_numbers_for_any_partitioning(spark, sf, partitions):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderdate")
    expected = {
        r.o_orderkey: i
        for i, r in enumerate(sorted(orders.collect(), key=lambda r: (r.o_orderdate, r.o_orderkey)), 1)
    }
    got = with_sequence(orders.repartition(partitions), ["o_orderdate", "o_orderkey"], rows_per_range=700)
    assert numbers(got, "o_orderkey") == expected


def test_partitions_follow_the_numbers(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"))
    spans = (
        with_sequence(df, "k", start=0, rows_per_range=500)
        .groupBy(F.spark_partition_id().alias("p"))
        .agg(F.min("rec_num").alias("lo"), F.max("rec_num").alias("hi"))
        .orderBy("p")
        .collect()
    )
    assert len(spans) > 5
    assert spans[0].lo == 0 and spans[-1].hi == 4999
    assert all(a.hi + 1 == b.lo for a, b in zip(spans, spans[1:]))


def test_one_shuffle_of_the_rows(spark):
    df = spark.range(5000).withColumn("payload", F.lit("x"))
    plan = with_sequence(df, "id", rows_per_range=500)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange shufflepartitionidpassthrough") == 1
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("ascending", [True, False, [True, False], [False, True]])
def test_directions_and_nulls(spark, ascending):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3]), i) for i in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "a int, b int")
    ups = [ascending] * 2 if isinstance(ascending, bool) else ascending
    order = [F.col(c).asc() if up else F.col(c).desc() for c, up in zip("ab", ups)]
    expected = {r.b: i for i, r in enumerate(df.orderBy(*order).collect(), 10)}
    got = with_sequence(df, ["a", "b"], start=10, ascending=ascending, rows_per_range=100)
    assert numbers(got, "b") == expected


def test_key_types(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(microseconds=i // 3), f'q"{i % 7},\\', float(i), i) for i in range(1500)]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "t timestamp, s string, x double, i int")
    df = df.withColumns({"n": F.col("t").cast("timestamp_ntz"), "d": F.col("x").cast("decimal(10,3)"), "y": F.to_date("t")})
    for key in (["t", "s", "i"], ["n", "i"], ["s", "x"], ["x"], ["d"], ["y", "s", "i"]):
        expected = {r.i: k for k, r in enumerate(df.orderBy(*key).collect(), 1)}
        assert numbers(with_sequence(df, key, rows_per_range=100), "i") == expected, key


def test_copies_are_split_and_all_numbered(spark):
    # A third of the rows are copies of one row.
    rows = [(0, "same")] * 4000 + [(i, "other") for i in range(1, 8001)]
    df = spark.createDataFrame(rows, "k int, v string").repartition(8)
    numbered = with_sequence(df, "k", rows_per_range=300)
    got = numbered.collect()
    assert sorted(r.rec_num for r in got) == list(range(1, 12001))
    assert {r.rec_num for r in got if r.k == 0} == set(range(1, 4001))
    assert all(r.rec_num == 4000 + r.k for r in got if r.k)
    largest = numbered.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 4000 / 3


def test_hot_first_key_needs_no_staging(spark, monkeypatch):
    monkeypatch.setattr(module, "stage", lambda df, label: df if label == "keys" else pytest.fail("staged"))
    df = spark.createDataFrame([(0 if i % 3 == 0 else i, i) for i in range(6000)], "k int, u int")
    expected = {r.u: i for i, r in enumerate(df.orderBy("k", "u").collect(), 1)}
    assert numbers(with_sequence(df, ["k", "u"], rows_per_range=300), "u") == expected


def test_staged_input(spark):
    df = spark.range(1000).select("id")
    assert numbers(with_sequence(df, "id", rows_per_range=100, staged=True), "id") == {i: i + 1 for i in range(1000)}


def test_empty_and_small(spark):
    empty = spark.createDataFrame([], "k int")
    assert with_sequence(empty, "k").count() == 0
    assert [r.rec_num for r in with_sequence(spark.range(3), "id", start=7).collect()] == [7, 8, 9]
    assert with_sequence(spark.range(3), "id").schema["rec_num"].dataType.simpleString() == "bigint"


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        with_sequence(spark.range(3), [])
    with pytest.raises(ValueError):
        with_sequence(spark.range(3), ["id"], ascending=[True, False])


def test_mostly_missing_key(spark):
    df = spark.createDataFrame([(None if i % 3 else i, i) for i in range(3000)], "k int, u int").repartition(4)
    got = {r.u: r.rec_num for r in with_sequence(df, "k", rows_per_range=200).collect()}
    assert sorted(got.values()) == list(range(1, 3001))
    assert [u for u in sorted(got, key=got.get) if u % 3 == 0] == list(range(0, 3000, 3))
    assert min(got[u] for u in range(0, 3000, 3)) == 2001  # missing keys come first


def test_many_columns(spark):
    wide = spark.range(3_000).select("id", *[(F.col("id") * k).alias(f"c{k}") for k in range(150)])
    rows = with_sequence(wide, "id", rows_per_range=200)
    assert len(rows.columns) == 152
    assert rows.where("rec_num <> id + 1").count() == 0 and rows.count() == 3_000


def test_an_input_that_changes_is_noticed(spark):
    """Other keys at the second evaluation put more rows into some range than were counted there."""
    with pytest.raises(Exception, match="second time"):
        with_sequence(spark.range(100).mapInArrow(_changing, "id bigint"), "id", rows_per_range=30).collect()
    staged = with_sequence(spark.range(100).mapInArrow(_changing, "id bigint"), "id", rows_per_range=30, staged=True)
    assert sorted(r.rec_num for r in staged.collect()) == list(range(1, 101))


def _changing(batches):
    import random

    import pyarrow as pa

    for rows in batches:
        yield pa.RecordBatch.from_pydict({"id": pa.array([random.randrange(10**6) for _ in range(rows.num_rows)], pa.int64())})


def test_no_key_folder_is_left(spark):
    import glob

    from tabpact.staging import application_folder

    folder = application_folder(spark).removeprefix("file://")
    before = set(glob.glob(f"{folder}/*"))
    assert with_sequence(spark.range(500), "id", rows_per_range=50).count() == 500
    assert set(glob.glob(f"{folder}/*")) == before


@pytest.mark.parametrize("rows_per_range", [30, 10_000])
def test_fewer_rows_the_second_time_are_noticed(spark, tmp_path, rows_per_range):
    """Half of the rows are gone at the second pass; with short ranges some have none left."""
    flag = tmp_path / "second"

    def rows(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_pylist()
            yield batch.filter(pa.array([i < 150 or not os.path.exists(str(flag)) for i in ids]))

    numbered = with_sequence(spark.range(300).mapInArrow(rows, "id bigint"), "id", rows_per_range=rows_per_range)
    flag.touch()
    with pytest.raises(Exception, match="second time"):
        numbered.collect()


def test_columns_with_names_used_inside(spark):
    names = ["_bounds", "_rank", "_row", "_file", "_range", "_end", "_RANK_"]
    df = spark.range(3_000).select("id", *[F.lit(777 + i).alias(n) for i, n in enumerate(names)])
    wrong = " OR ".join(f"{n} <> {777 + i}" for i, n in enumerate(names))
    for key, source in (("id", df), ("same", df.withColumn("same", F.lit(0)))):  # the second one's keys crowd a range
        got = with_sequence(source, key, rows_per_range=100)
        assert got.columns == [*source.columns, "rec_num"]
        assert got.where(wrong).count() == 0 and got.select("rec_num").distinct().count() == 3_000
    assert with_sequence(df, "_rank", name="_end_", rows_per_range=100).agg(F.max("_end_")).first()[0] == 3_000
