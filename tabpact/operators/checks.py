"""Data checks: report, count, drop, quarantine or refuse rows that break a rule.

Every operator here is one narrow pass over the data (the summary adds one aggregate). Rules are
boolean Columns with three outcomes. True passes and false fails. NULL passes for a ``when_present``
rule. On a required column a NULL is reported once, as missing, and the column's other rules are
skipped. Any other NULL outcome fails, because the rule has not been shown to hold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..contracts import Check, ColumnSpec, SourceContract

POLICIES = ("fail", "drop", "quarantine", "report")


@dataclass(frozen=True)
class BoundCheck:
    """A check as Columns. In ``passed``, ``failed`` and ``skipped`` NULL means no.

    ``passed`` may leave to the required-value check what that one already decides.
    """

    scope: str
    column: str | None
    check_id: str
    explain: str | None
    passed: Column
    failed: Column
    skipped: Column
    value: Column

    def labels(self) -> list[Column]:
        return [
            F.lit(self.scope).alias("scope"),
            F.lit(self.column).cast("string").alias("column"),
            F.lit(self.check_id).alias("check_id"),
            F.lit(self.explain).cast("string").alias("explain"),
        ]

    def violation(self) -> Column:
        return F.struct(*self.labels(), self.value.alias("value"))


def _text(spec: ColumnSpec) -> Column:
    nested = isinstance(spec.data_type, (T.MapType, T.ArrayType, T.StructType, T.VariantType))
    return F.to_json(F.col(spec.name)) if nested else F.col(spec.name).cast("string")


def _verdicts(outcome: Column, when_present: bool) -> tuple[Column, Column, Column]:
    """Passed, failed and skipped for an outcome."""
    if when_present:
        return outcome | outcome.isNull(), ~outcome, outcome.isNull()
    return outcome, ~outcome | outcome.isNull(), F.lit(False)


def _column_check(spec: ColumnSpec, number: int, check: Check) -> BoundCheck:
    col = F.col(spec.name)
    outcome = F.expr(check.expr) if isinstance(check.expr, str) else check.expr(col)
    passed, failed, skipped = _verdicts(outcome, check.when_present)
    if not spec.nullable:
        failed, skipped = col.isNotNull() & failed, col.isNull() | skipped
    name = check.name or f"{spec.name}.check_{number}"
    return BoundCheck("column", spec.name, name, check.explain, passed, failed, skipped, _text(spec))


def _row_check(number: int, check: Check) -> BoundCheck:
    outcome = F.expr(check.expr) if isinstance(check.expr, str) else check.expr()
    name = check.name or f"row.check_{number}"
    nothing = F.lit(None).cast("string")
    return BoundCheck("row", None, name, check.explain, *_verdicts(outcome, check.when_present), nothing)


def bind_checks(contract: SourceContract) -> list[BoundCheck]:
    """All rules of a contract in declared order: per column the required rule first, then row rules."""
    bound: list[BoundCheck] = []
    for spec in contract.columns:
        if not spec.nullable:
            col, nothing = F.col(spec.name), F.lit(None).cast("string")
            outcome = (col.isNotNull(), col.isNull(), F.lit(False))
            name = f"{spec.name}.required"
            bound.append(BoundCheck("required", spec.name, name, "a value is required", *outcome, nothing))
        bound += [_column_check(spec, i, check) for i, check in enumerate(spec.checks, 1)]
    bound += [_row_check(i, check) for i, check in enumerate(contract.column_checks, 1)]
    return bound


def _any_failed(checks: Sequence[BoundCheck]) -> Column:
    if not checks:
        return F.lit(False)
    return reduce(lambda a, b: a | b, (c.failed for c in checks))


def row_passes(contract: SourceContract) -> Column:
    """True where a row breaks no rule. NULL means false, which is all that ``where`` needs, and keeps
    every rule a conjunct that can reach the scan."""
    passed = [c.passed for c in bind_checks(contract)]
    return reduce(lambda a, b: a & b, passed) if passed else F.lit(True)


def violation_array(contract: SourceContract) -> Column:
    """All violations of a row, in declared order."""
    found = [F.when(c.failed, c.violation()) for c in bind_checks(contract)]
    return F.array_compact(F.array(*found)) if found else F.array().cast(f"array<struct<{VIOLATION_DDL}>>")


VIOLATION_DDL = "scope: string, column: string, check_id: string, explain: string, value: string"


def violations(df: DataFrame, contract: SourceContract, key: Sequence[str]) -> DataFrame:
    """One row per record and failed check.

    Rows that break nothing are filtered out first. That condition is a plain disjunction, so the
    scan can skip the parts of a file whose statistics rule out a violation.
    """
    checks = bind_checks(contract)
    if not checks:
        schema = T.StructType([df.schema[k] for k in key] + T.DataType.fromDDL(f"struct<{VIOLATION_DDL}>").fields)
        return df.sparkSession.createDataFrame([], schema)
    # One slot per check, empty slots dropped afterwards, stays in generated code; compacting the array
    # first would not.
    slots = F.explode(F.array(*[F.when(c.failed, c.violation()) for c in checks])).alias("_violation")
    exploded = df.where(_any_failed(checks)).select(*[F.col(k) for k in key], slots)
    return exploded.where(F.col("_violation").isNotNull()).select(*key, "_violation.*")


def first_violation(df: DataFrame, contract: SourceContract, key: Sequence[str]) -> DataFrame:
    """Per failing record only the first failed check in declared order."""
    checks = bind_checks(contract)
    if not checks:
        return violations(df, contract, key)
    first = F.coalesce(*[F.when(c.failed, c.violation()) for c in checks])
    return df.where(_any_failed(checks)).select(*[F.col(k) for k in key], first.alias("_violation")).select(
        *key, "_violation.*"
    )


def check_summary(df: DataFrame, contract: SourceContract, with_rows: bool = False) -> DataFrame:
    """Per check the rows tested, failed and skipped because a value is missing, from one aggregate.

    ``with_rows`` adds a row of scope "rows" with the number of all rows as ``tested``.
    """
    checks = bind_checks(contract)
    totals = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(checks):
        totals += [F.count_if(c.failed).alias(f"_failed_{i}"), F.count_if(c.skipped).alias(f"_skipped_{i}")]
    rows = [
        F.struct(
            *c.labels(),
            (F.col("_rows") - F.col(f"_skipped_{i}")).alias("tested"),
            F.col(f"_failed_{i}").alias("failed"),
            F.col(f"_skipped_{i}").alias("skipped"),
        )
        for i, c in enumerate(checks)
    ]
    if with_rows:
        nothing, none = F.lit(None).cast("string"), F.lit(0).cast("bigint")
        labels = [F.lit("rows").alias("scope"), nothing.alias("column"), F.lit("rows").alias("check_id"), nothing.alias("explain")]
        rows.insert(0, F.struct(*labels, F.col("_rows").alias("tested"), none.alias("failed"), none.alias("skipped")))
    if not rows:
        ddl = "scope string, column string, check_id string, explain string, tested bigint, failed bigint, skipped bigint"
        return df.sparkSession.createDataFrame([], ddl)
    return df.agg(*totals).select(F.explode(F.array(*rows)).alias("_check")).select("_check.*")


def enforce(
    df: DataFrame, contract: SourceContract, policy: str = "quarantine", key: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame | None]:
    """Split by the contract's rules.

    =============  ==========================  =================================================
    policy         first frame                 second frame
    =============  ==========================  =================================================
    ``fail``       rows, the job stops at the  None
                   first bad one
    ``drop``       good rows                   None
    ``quarantine`` good rows                   bad rows with an array of their violations
    ``report``     all rows                    the violation report, keyed by ``key``
    =============  ==========================  =================================================

    The good and the quarantined rows together are exactly the input: a row is good where the
    condition is true and bad where it is false or NULL.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}, not {policy!r}")
    if policy == "report":
        return df, violations(df, contract, key)
    passes = row_passes(contract)
    if policy == "fail" and not bind_checks(contract):
        return df, None
    if policy == "fail":
        ids = F.transform(violation_array(contract), lambda v: v["check_id"])
        message = F.concat(F.lit(f"source {contract.name}: a row breaks "), F.array_join(ids, ", "))
        return df.where(F.when(passes, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))), None
    good = df.where(passes)
    if policy == "drop":
        return good, None
    return good, df.where(~F.coalesce(passes, F.lit(False))).withColumn("violations", violation_array(contract))
