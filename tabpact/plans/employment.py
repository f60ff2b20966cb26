"""The sample plan: employment records, checked, mapped, numbered and written as delimited text.

The record is derived from the ``orders`` table by fixed rules, some of which make records that break
the contract on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..contracts import Check, ColumnSpec, FilterParam, SourceContract
from ..functions import MONEY_TYPE, date_range, exclude_when, map_get, matches, money_from_double
from ..operators.mapping import Field
from ..sinks.delimited import DelimitedSink, RowSequence
from .pipeline import Pipeline

# The form of an employee id and the header of the output.
EMPLOYEE_ID_PATTERN = r"^SID\d{6}$"
HEADER = ("#", "Employee ID", "Hire Date", "Termination Date", "Salary", "Department", "Job Title")

EMPLOYEE_ID_SQL = (
    "concat('SID', CASE WHEN o_orderkey % 97 = 0 OR o_orderkey >= 1000000 THEN string(o_orderkey) "
    "ELSE lpad(string(o_orderkey), 6, '0') END)"
)
TERMINATION_SQL = (
    "CASE WHEN o_orderstatus = 'F' THEN date_add(CAST(o_orderdate AS date), CAST(o_orderkey % 120 AS int)) END"
)
META_SQL = (
    "CASE WHEN o_orderstatus = 'O' THEN map('department', o_orderpriority, 'job_title', 'clerk') "
    "ELSE map('department', o_orderpriority) END"
)


def _hired_from(value: Column) -> Column:
    return date_range("o_orderdate", lo=value.cast("timestamp_ntz"))


def _hired_before(value: Column) -> Column:
    return date_range("o_orderdate", hi=value.cast("timestamp_ntz"))


def _not_terminated(value: Column) -> Column:
    return exclude_when(F.col("o_orderstatus").eqNullSafe("F"), value)


EMPLOYMENT = SourceContract(
    "EmploymentRecord",
    columns=[
        ColumnSpec(
            "employee_id",
            "string",
            source=EMPLOYEE_ID_SQL,
            checks=Check(lambda c: matches(c, EMPLOYEE_ID_PATTERN), "SID and six digits", name="employee_id.form"),
        ),
        ColumnSpec("hire_date", "date", source="CAST(o_orderdate AS date)"),
        ColumnSpec("termination_date", "date", nullable=True, source=TERMINATION_SQL),
        ColumnSpec("salary", MONEY_TYPE, source=lambda: money_from_double("o_totalprice")),
        ColumnSpec("meta", "map<string,string>", nullable=True, source=META_SQL),
    ],
    filters=[
        FilterParam("date_from", "date", default=None, optional=True, predicate=_hired_from),
        FilterParam("date_to", "date", default=None, optional=True, predicate=_hired_before),
        FilterParam("exclude_terminations", "boolean", default=None, optional=True, predicate=_not_terminated),
    ],
    filter_checks=Check(
        lambda v: v["date_from"] is None or v["date_to"] is None or v["date_from"] < v["date_to"],
        "date_from must be before date_to",
    ),
)

FIELDS = (
    Field("Employee ID", "employee_id"),
    Field("Hire Date", "hire_date"),
    Field("Termination Date", "termination_date"),
    Field("Salary", "salary"),
    Field("Department", lambda: map_get("meta", "department"), uses=("meta",), via="map_get"),
    Field("Job Title", lambda: map_get("meta", "job_title"), uses=("meta",), via="map_get"),
)

#: The month the sample reports on; the upper end is not included.
MONTH = {"date_from": "1996-01-01", "date_to": "1996-02-01"}


def feed(orders_path: str, out_path: str, policy: str = "drop", start: int = 1, **filters) -> Pipeline:
    """er -> feed: the employment records of the filters, through the adapter, to delimited files."""
    sink = DelimitedSink(
        out_path,
        date_fmt="%Y-%m-%d",
        header=HEADER,
        row_sequence=RowSequence(("Hire Date", "Employee ID"), start=start, rows_per_range=20_000),
    )
    return (
        Pipeline("EmploymentFeed")
        .source("er", EMPLOYMENT, orders_path, policy=policy, filters=filters)
        .sink("csv", sink)
        .adapter("feed", onto="csv", mapping=FIELDS)
        .pipe("er -> feed")
    )
