import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from tabpact import (
    Check,
    ColumnSpec,
    DefinitionError,
    FilterParam,
    Param,
    SinkContract,
    SourceContract,
    apply_filters,
    conform,
    read_source,
)
from tabpact.contracts import flatten_params, to_python, data_type
from tabpact.plans.employment import EMPLOYMENT


def source(**kw):
    return SourceContract("S", [ColumnSpec("a", "int")], **kw)


def test_names_must_be_identifiers_and_unique():
    with pytest.raises(DefinitionError) as e:
        SourceContract("1x", [ColumnSpec("a b", "int"), ColumnSpec("c", "int"), ColumnSpec("c", "int")])
    assert len(e.value.problems) == 3


def test_filter_values_are_typed_and_all_problems_listed():
    c = source(
        filters=[
            FilterParam("d", "date"),
            FilterParam("n", "int", checks=Check(lambda v: v > 0, "positive")),
            FilterParam("flag", "boolean", default=None, optional=True),
        ]
    )
    assert c.bind_filters({"d": "2019-01-01", "n": 3}) == {"d": dt.date(2019, 1, 1), "n": 3, "flag": None}
    with pytest.raises(DefinitionError) as e:
        c.bind_filters({"n": -1, "flag": "yes", "other": 1})
    text = str(e.value)
    assert len(e.value.problems) == 4
    assert "unknown filter 'other'" in text and "'d' has neither" in text and "positive" in text


def test_default_is_checked_too():
    c = source(filters=[FilterParam("n", "int", default=0, checks=Check(lambda v: v > 0, "positive"))])
    with pytest.raises(DefinitionError):
        c.bind_filters({})


def test_cross_filter_check():
    with pytest.raises(DefinitionError, match="date_from must be before"):
        EMPLOYMENT.bind_filters({"date_from": "2019-02-01", "date_to": "2019-01-01"})
    assert EMPLOYMENT.bind_filters({"date_from": "2019-01-01"})["date_to"] is None


@pytest.mark.parametrize(
    "value,type_name,expected",
    [
        ("2020-02-29", "date", dt.date(2020, 2, 29)),
        ("5", "int", 5),
        (2.0, "bigint", 2),
        ("1.25", "decimal(12,2)", decimal.Decimal("1.25")),
        (1, "double", 1.0),
        ("2020-01-01", "timestamp_ntz", dt.datetime(2020, 1, 1)),
    ],
)
def test_conversion(spark, value, type_name, expected):
    assert to_python(value, data_type(type_name)) == expected


@pytest.mark.parametrize(
    "value,type_name",
    [("2020-02-30", "date"), (2.5, "int"), (2**31, "int"), (True, "int"), ("x", "double"), (1, "string"), ("1.234", "decimal(12,2)")],
)
def test_conversion_refused(spark, value, type_name):
    with pytest.raises((TypeError, ValueError)):
        to_python(value, data_type(type_name))


def test_sink_contract():
    c = SinkContract(
        "K",
        [
            Param("path", "string"),
            Param("header", None, default=None, optional=True, checks=Check(lambda h: len(h) > 0, "not empty", when_present=True)),
            Param("sep", "string", default=",", checks=Check(lambda s: len(s) >= 1, "not empty")),
        ],
        checks=Check(lambda v: v["header"] is None or v["sep"] not in v["header"], "the delimiter is no name"),
    )
    assert c.bind(path="p") == {"path": "p", "header": None, "sep": ","}
    with pytest.raises(DefinitionError) as e:
        c.bind(header=[], sep="")
    assert len(e.value.problems) == 3
    with pytest.raises(DefinitionError, match="no name"):
        c.bind(path="p", header=[","])


def test_nested_params_get_dotted_keys():
    assert flatten_params({"a": {"b": 1, "c": {"d": 2}}, "e": 3}) == {"a.b": 1, "a.c.d": 2, "e": 3}
    with pytest.raises(DefinitionError):
        flatten_params({"a": {"b": 1}, "a.b": 2})


def test_unset_optional_filter_leaves_no_trace(spark):
    c = source(filters=[FilterParam("n", "int", default=None, optional=True, predicate=lambda v: F.col("a") >= v)])
    df = spark.createDataFrame([(1,), (None,)], "a int")
    assert apply_filters(df, c).count() == 2
    assert "Filter" not in apply_filters(df, c)._jdf.queryExecution().optimizedPlan().toString()
    assert apply_filters(df, c, {"n": 1}).count() == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    df = read_source(
        spark, EMPLOYMENT, f"{sf}/orders.parquet", filters={"date_from": "1996-01-01", "date_to": "1996-02-01"}
    ).select("hire_date")
    plan = plan_of(df)
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz>" in plan


def test_conform_lists_everything(spark):
    c = SourceContract("S", [ColumnSpec("a", "bigint"), ColumnSpec("b", "int"), ColumnSpec("c", "string"), ColumnSpec("d", "double")])
    df = spark.createDataFrame([(1, 2, 3.5)], "a int, b bigint, d float")
    with pytest.raises(DefinitionError) as e:
        conform(df, c, strict_nulls=True)
    assert len(e.value.problems) == 5  # c missing, b narrows, and a, b, d may be null
    good = conform(spark.createDataFrame([("x", 3.5, 1, 2)], "c string, d float, a int, b int"), c)
    assert good.columns == ["a", "b", "c", "d"] and good.schema["a"].dataType.simpleString() == "bigint"


def test_missing_column_and_comment(spark, folder):
    spark.createDataFrame([(1,)], "a int").write.parquet(f"{folder}/t")
    with pytest.raises(DefinitionError, match="'b' is missing"):
        read_source(spark, SourceContract("S", [ColumnSpec("b", "int")]), f"{folder}/t")
    df = read_source(spark, SourceContract("S", [ColumnSpec("a", "bigint", explain="the key")]), f"{folder}/t")
    assert df.schema["a"].metadata == {"comment": "the key"} and df.schema["a"].dataType.simpleString() == "bigint"
    assert SourceContract("S", [ColumnSpec("a", "bigint", explain="the key")]).schema()["a"].nullable is False


def test_checks_in_sql_on_parameters(spark):
    from tabpact import Check, DefinitionError, Param, SinkContract

    contract = SinkContract(
        "S",
        [
            Param("delimiter", "string", default=",", checks="length(delimiter) >= 1"),
            Param("lo", "date", default=None, optional=True, checks=Check("lo >= DATE'2000-01-01'", when_present=True)),
            Param("hi", "date", default=None, optional=True),
            Param("names", None, default=(), checks=Check(lambda v: len(v) < 3)),
        ],
        checks=Check("lo < hi", "lo before hi", when_present=True),
    )
    assert contract.bind(lo="2001-01-01", hi="2002-01-01")["delimiter"] == ","
    assert contract.bind(lo="2001-01-01")["hi"] is None
    for wrong in ({"delimiter": ""}, {"lo": "1999-01-01"}, {"lo": "2002-01-01", "hi": "2001-01-01"}, {"names": (1, 2, 3)}):
        with pytest.raises(DefinitionError):
            contract.bind(**wrong)
