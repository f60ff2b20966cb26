"""The physical plans the operators are meant to get."""

import pytest
from pyspark.sql import functions as F

from tabpact import check_summary, enforce, first_violation, map_record, render_rows, violations, with_sequence
from tabpact.plans import queries as q
from tabpact.plans.employment import EMPLOYMENT, FIELDS


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "build",
    [
        lambda s, d: violations(q._lines(s, d), q.LINES, ["l_orderkey"]),
        lambda s, d: first_violation(q._lines(s, d), q.LINES, ["l_orderkey"]),
        lambda s, d: enforce(q._lines(s, d), q.LINES, "quarantine")[0],
        lambda s, d: enforce(q._lines(s, d), q.LINES, "quarantine")[1],
        lambda s, d: enforce(q._lines(s, d), q.LINES, "fail")[0],
        lambda s, d: render_rows(map_record(q.employees(s, d), FIELDS)),
    ],
)
def test_narrow_operators_are_one_stage_in_the_jvm(spark, sf, build):
    plan = plan_of(build(spark, sf))
    assert "Exchange" not in plan and "Python" not in plan and plan.count("FileScan") == 1


@pytest.mark.parametrize("build", [violations, first_violation])
def test_reports_stay_in_generated_code(spark, sf, build):
    operators = [line for line in plan_of(build(q._lines(spark, sf), q.LINES, ["l_orderkey"])).splitlines() if line.strip()]
    assert all("*(" in line for line in operators if "FileScan" not in line)


def test_good_rows_push_their_rules_to_the_scan(spark, sf):
    plan = plan_of(enforce(q._lines(spark, sf), q.LINES, "drop")[0])
    pushed = plan.split("PushedFilters: ")[1]
    assert "IsNotNull(l_orderkey)" in pushed and "LessThanOrEqual(l_discount,0.08)" in pushed


def test_only_needed_columns_are_read(spark, sf):
    summary = plan_of(check_summary(q._lines(spark, sf), q.LINES))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_discount:double>" in summary
    one = plan_of(violations(q._customers(spark, sf).drop("c_name"), q.SourceContract("C", [q.CUSTOMERS.columns[2]]), []))
    assert "ReadSchema: struct<c_acctbal:double>" in one


def test_summary_shuffles_one_row_per_task(spark, sf):
    plan = plan_of(check_summary(q._lines(spark, sf), q.LINES))
    assert plan.count("Exchange") == 1 and "partial_count" in plan


def test_sequence_routes_rows_in_generated_code(spark, sf):
    orders = q.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    plan = plan_of(with_sequence(orders, ["o_orderdate", "o_orderkey"], rows_per_range=1_000))
    assert plan.count("shufflepartitionidpassthrough") == 1 and "Python" not in plan
    assert "SinglePartition" not in plan and "rangepartitioning" not in plan


def test_key_pass_of_a_sequence_reads_only_the_key(spark, sf, monkeypatch):
    from tabpact.operators import sequence

    seen = []

    def spy(df, label):
        seen.append((label, plan_of(df)))
        return df

    monkeypatch.setattr(sequence, "stage", spy)
    with_sequence(q.table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], rows_per_range=1_000)
    assert [label for label, _ in seen] == ["keys"]
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in seen[0][1]


def test_a_hub_is_split_when_the_frontier_is_too_large_to_broadcast(spark):
    """What a round of the lineage operators does, with thresholds that make the test data large."""
    small = {
        "spark.sql.shuffle.partitions": "32",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        ids = spark.range(60_000, numPartitions=8)
        links = ids.select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("node"), F.col("id").alias("next"))
        frontier = spark.range(40_000).select(F.lit(1).alias("start"), F.col("id").alias("node"))
        step = frontier.join(links, "node").select("start", F.col("next").alias("node")).distinct()
        step.collect()
        assert "skew=true" in plan_of(step)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_employment_filters_reach_the_scan(spark, sf):
    rows = q.employees(spark, sf, date_from="1996-01-01", date_to="1996-02-01", exclude_terminations=True)
    pushed = plan_of(rows).split("PushedFilters: ")[1]
    assert "o_orderdate" in pushed and "Not(EqualNullSafe(o_orderstatus,F))" in pushed
    assert EMPLOYMENT.column_names == rows.columns
