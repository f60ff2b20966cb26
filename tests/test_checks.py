import pytest
from pyspark.sql import functions as F

from tabpact import Check, ColumnSpec, SourceContract, check_summary, enforce, first_violation, violations
from tabpact.functions import matches, min_len

CONTRACT = SourceContract(
    "People",
    columns=[
        ColumnSpec("id", "int"),
        ColumnSpec("name", "string", checks=[Check(lambda c: min_len(c, 2), "two bytes"), "name <> 'bob'"]),
        ColumnSpec("age", "int", nullable=True, checks=Check(lambda c: c >= 18, "adult", when_present=True, name="adult")),
        ColumnSpec("city", "string", nullable=True, checks=Check("city = 'x'", name="city")),
    ],
    column_checks=Check("age > id", when_present=True, name="row_rule"),
)
ROWS = [
    (1, "anna", 30, "x"),
    (2, None, 30, "x"),  # required value missing, other rules on it skipped
    (3, "b", None, "x"),  # too short; age and row rule skipped
    (4, "bob", 3, None),  # bad name, minor, city unknown, 3 < 4
    (5, "ö", 50, "y"),  # two bytes but one character
    (None, "carl", 20, "x"),  # row rule NULL
]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(ROWS, "id int, name string, age int, city string")


def test_violations(people):
    got = sorted((r.id or 0, r.check_id, r.scope, r.explain, r.value) for r in violations(people, CONTRACT, ["id"]).collect())
    assert got == sorted(
        [
            (2, "name.required", "required", "a value is required", None),
            (3, "name.check_1", "column", "two bytes", "b"),
            (4, "name.check_2", "column", None, "bob"),
            (4, "adult", "column", "adult", "3"),
            (4, "city", "column", None, None),
            (4, "row_rule", "row", None, None),
            (5, "city", "column", None, "y"),
            (0, "id.required", "required", "a value is required", None),
        ]
    )


def test_first_violation_is_in_declared_order(people):
    got = {r.id: r.check_id for r in first_violation(people, CONTRACT, ["id"]).collect()}
    assert got == {2: "name.required", 3: "name.check_1", 4: "name.check_2", 5: "city", None: "id.required"}


def test_summary(people):
    got = {r.check_id: (r.tested, r.failed, r.skipped) for r in check_summary(people, CONTRACT).collect()}
    assert got == {
        "id.required": (6, 1, 0),
        "name.required": (6, 1, 0),
        "name.check_1": (5, 1, 1),
        "name.check_2": (5, 1, 1),
        "adult": (5, 1, 1),
        "city": (6, 2, 0),
        "row_rule": (4, 1, 2),
    }


def test_good_and_bad_are_the_input(people):
    good, bad = enforce(people, CONTRACT, "quarantine")
    assert [r.id for r in good.collect()] == [1]
    assert good.count() + bad.count() == people.count()
    reasons = {r.id: [v.check_id for v in r.violations] for r in bad.collect()}
    assert reasons[4] == ["name.check_2", "adult", "city", "row_rule"]
    assert enforce(people, CONTRACT, "drop")[1] is None


def test_report_keeps_all_rows(people):
    rows, report = enforce(people, CONTRACT, "report", key=["id"])
    assert rows.count() == 6 and report.count() == 8


def test_fail_stops_the_job(people):
    rows, _ = enforce(people, CONTRACT, "fail")
    with pytest.raises(Exception, match="a row breaks"):
        rows.collect()
    assert enforce(people.where("id = 1"), CONTRACT, "fail")[0].count() == 1


def test_filtered_rows_cannot_fail(people):
    filtered = people.where("name = 'anna'")
    assert enforce(filtered, CONTRACT, "fail")[0].count() == 1


def test_unknown_policy(people):
    with pytest.raises(ValueError):
        enforce(people, CONTRACT, "ignore")


def test_no_checks(people):
    free = SourceContract("F", [ColumnSpec("id", "int", nullable=True)])
    assert violations(people, free, ["id"]).count() == 0
    assert first_violation(people, free, ["id"]).columns == ["id", "scope", "column", "check_id", "explain", "value"]
    assert check_summary(people, free).count() == 0
    good, bad = enforce(people, free, "quarantine")
    assert (good.count(), bad.count()) == (6, 0)


def test_empty_input(spark, people):
    empty = people.limit(0)
    assert violations(empty, CONTRACT, ["id"]).count() == 0
    assert {(r.tested, r.failed) for r in check_summary(empty, CONTRACT).collect()} == {(0, 0)}


def test_nested_value_is_shown_as_json(spark):
    c = SourceContract("M", [ColumnSpec("m", "map<string,string>", checks=Check(lambda m: F.size(m) == 0, name="empty"))])
    df = spark.createDataFrame([({"a": "1"},)], "m map<string,string>")
    assert violations(df, c, []).first().value == '{"a":"1"}'


def test_report_is_one_scan_without_shuffle(people):
    plan = violations(people, CONTRACT, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan") == 1


def test_violation_condition_reaches_the_scan(spark, sf):
    from tabpact.plans.queries import LINES, _lines

    plan = violations(_lines(spark, sf), LINES, ["l_orderkey"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "IsNull(l_discount)" in plan.split("PushedFilters")[1]


def test_regex_end(spark):
    df = spark.createDataFrame([("SID123456",), ("SID123456\n",), ("xSID123456",), ("SID١٢٣٤٥٦",), (None,)], "v string")
    ask = lambda pattern, **kw: [r[0] for r in df.select(matches("v", pattern, **kw)).collect()]
    assert ask(r"^SID\d{6}$") == [True, False, False, False, None]
    assert ask(r"^SID\d{6}$", unicode_classes=True) == [True, False, False, True, None]
    assert ask(r"SID") == [True, True, True, True, None]
    assert ask(r"[$]|\$") == [False, False, False, False, None]
