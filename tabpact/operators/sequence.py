"""Exact row numbers without funnelling the rows through one task.

The order key is cut into ranges. Each row goes straight to the partition of its range, is ranked
there, and gets the number of rows in all earlier ranges added. The order key alone is written to the
shared folder; the ranges are found and counted there, which shuffles nothing but a bounded sample and
one count per range and task. The full rows are shuffled once. The range of a row follows from the row
alone, so a task that is run again after a failure gives the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..names import unused
from ..staging import stage, temporary_folders

#: Sampled keys per range; more makes the ranges more even and never changes a number.
SAMPLES_PER_RANGE = 40
#: Bounds travel with every task, so their number is limited; larger tables get larger ranges.
MAX_RANGES = 20_000
#: However many rows the caller wants in a range, one task is not given more while there are ranges to be had.
MAX_ROWS_PER_RANGE = 1_000_000
#: Bounds are carried as JSON; a timestamp must come back to the microsecond or the bounds lose their order.
_EXACT = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def _sort_columns(keys: Sequence[str], ascending: Sequence[bool]) -> list[Column]:
    return [F.col(k).asc() if asc else F.col(k).desc() for k, asc in zip(keys, ascending)]


def _not_before(bound: Column, keys: Sequence[str], ascending: Sequence[bool]) -> Column:
    """Whether a row's key sorts at or after a bound; NULL sorts first ascending, last descending."""
    if all(ascending):
        return F.struct(*keys) >= bound
    expr = F.lit(True)
    for key, asc in reversed(list(zip(keys, ascending))):
        value, limit = F.col(key), bound.getField(key)
        low, high = (limit, value) if asc else (value, limit)
        after = F.coalesce(high > low, low.isNull() & high.isNotNull())
        expr = after | (value.eqNullSafe(limit) & expr)
    return bound.isNotNull() & expr


def _with_range(df: DataFrame, name: str, bounds: list[str], keys: Sequence[str], ascending: Sequence[bool]) -> DataFrame:
    """Add the number of bounds at or before each row, by a binary search of log2(bounds) columns."""
    if not bounds:
        return df.withColumn(name, F.lit(0))
    held = unused("_bounds", [*df.columns, name])
    key_type = T.StructType([df.schema[k] for k in keys])
    parsed = F.from_json(F.lit("[" + ",".join(bounds) + "]"), T.ArrayType(key_type), _EXACT)
    # As a subquery the bounds are parsed once and stand in the plan once, not in every comparison.
    lookup = df.sparkSession.range(1).select(parsed.alias("bounds")).scalar()
    df = df.withColumn(held, lookup).withColumn(name, F.lit(0))
    step = 1 << (len(bounds).bit_length() - 1)
    while step:
        reached = F.col(name) + step
        bound = F.get(held, reached - 1)
        df = df.withColumn(name, F.when(_not_before(bound, keys, ascending), reached).otherwise(F.col(name)))
        step >>= 1
    return df.drop(held)


def _pick_bounds(
    slim: DataFrame, total: int, ranges: int, keys: Sequence[str], ascending: Sequence[bool]
) -> list[str]:
    """Evenly spaced keys, as JSON, of a sample whose size depends on the number of ranges, not of rows.

    A key that fills more than a range comes up more than once and leaves fewer bounds than asked for.
    """
    wanted = ranges * SAMPLES_PER_RANGE
    sample = slim if wanted >= total else slim.sample(min(1.0, wanted / total), seed=17)
    ordered = sample.repartition(1).sortWithinPartitions(*_sort_columns(keys, ascending))
    ordered = ordered.select(F.to_json(F.struct(*keys), _EXACT))
    rows = [row[0] for row in ordered.collect()]
    if not rows:
        return []
    return list(dict.fromkeys(rows[i * len(rows) // ranges] for i in range(1, ranges)))


def _range_counts(slim: DataFrame, bounds: list[str], keys: Sequence[str], ascending: Sequence[bool]) -> list[int]:
    """Rows per range; at most MAX_RANGES numbers come to the driver."""
    name = unused("_range", slim.columns)
    counted = _with_range(slim, name, bounds, keys, ascending).groupBy(F.col(name).alias("range")).agg(F.count(F.lit(1)).alias("rows"))
    found = {row["range"]: row["rows"] for row in counted.collect()}
    return [found.get(i, 0) for i in range(len(bounds) + 1)]


def number_rows(
    df: DataFrame,
    order_by: str | Sequence[str],
    start: int = 1,
    name: str = "rec_num",
    ascending: bool | Sequence[bool] = True,
    rows_per_range: int = 100_000,
    staged: bool = False,
) -> tuple[DataFrame, int]:
    """As :func:`with_sequence`, and also the number of rows."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    directions = [ascending] * len(keys) if isinstance(ascending, bool) else list(ascending)
    if not keys or len(directions) != len(keys):
        raise ValueError("order_by needs at least one column, and ascending one entry for each")
    output = list(df.columns) + [name]
    if staged:
        df = stage(df, "sequence")
    with temporary_folders(df.sparkSession):  # the result does not read the keys
        slim = df.select(*keys) if staged else stage(df.select(*keys), "keys")
        total = slim.count()
        ranges = max(1, min(MAX_RANGES, -(-total // min(rows_per_range, MAX_ROWS_PER_RANGE))))
        bounds = _pick_bounds(slim, total, ranges, keys, directions) if ranges > 1 else []
        crowded = len(bounds) < ranges - 1
        counts = [] if crowded else _range_counts(slim, bounds, keys, directions) if bounds else [total]
    if crowded:
        # Equal keys crowd a range. Their place in a written table tells such rows apart, identical
        # copies included, and splits them over several ranges.
        origin = df if staged else stage(df, "sequence")
        file, row = (unused(n, df.columns) for n in ("_file", "_row"))
        df = origin.withColumns({file: F.xxhash64("_metadata.file_path"), row: F.col("_metadata.row_index")})
        keys, directions = keys + [file, row], directions + [True, True]
        slim = df.select(*keys)
        bounds = _pick_bounds(slim, total, ranges, keys, directions)
        counts = _range_counts(slim, bounds, keys, directions)

    before = [0, *accumulate(counts)]
    offsets = F.split(F.lit(",".join(str(start + n) for n in before[:-1])), ",").cast("array<bigint>")
    place, rank, end = (unused(n, [*df.columns, name]) for n in ("_range", "_rank", "_end"))
    ranged, order = _with_range(df, place, bounds, keys, directions), _sort_columns(keys, directions)
    checked = not staged and not crowded
    if checked:
        # The rows were evaluated before for their keys. A row behind the last of each range tells whether as many have come again.
        ends = df.sparkSession.range(len(counts)).select(F.col("id").cast("int").alias(place), F.lit(True).alias(end))
        ranged = ranged.withColumn(end, F.lit(False)).unionByName(ends, allowMissingColumns=True)
        order = [F.col(end).asc(), *order]
    in_range = F.row_number().over(Window.partitionBy(place).orderBy(*order))
    numbered = ranged.repartitionById(len(counts), F.col(place)).withColumn(rank, in_range)
    if checked:
        sizes = F.split(F.lit(",".join(map(str, counts))), ",").cast("array<bigint>")
        changed = F.raise_error(F.lit("the input gave other rows the second time; number it with staged=True")).cast("boolean")
        numbered = numbered.where(F.when(~F.col(end), F.lit(True)).when(F.col(rank) == F.get(sizes, F.col(place)) + 1, F.lit(False)).otherwise(changed))
    number = F.get(offsets, F.col(place)) + F.col(rank) - 1
    return numbered.withColumn(name, number.cast("bigint")).select(*output), total


def with_sequence(
    df: DataFrame,
    order_by: str | Sequence[str],
    start: int = 1,
    name: str = "rec_num",
    ascending: bool | Sequence[bool] = True,
    rows_per_range: int = 100_000,
    staged: bool = False,
) -> DataFrame:
    """Number the rows ``start``, ``start + 1``, .. in the given order, in a bigint column.

    The order key should identify a row. Rows with equal keys still get distinct numbers without a
    gap, but which of them comes first may differ between runs. The result is partitioned and sorted
    in number order, so a writer produces its part files in sequence.

    The input is evaluated twice, the first time for the order key alone. Set ``staged`` to write it
    once to the shared folder when it is costly to compute or does not give the same rows again; a range that
    gets more or fewer rows the second time fails the job. Columns of any names are left as they are.
    """
    return number_rows(df, order_by, start, name, ascending, rows_per_range, staged)[0]
