"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Stands for a missing document id: it comes after every other id.
NO_ID = 2**63 - 1

#: The characters that part words and are stripped from lines.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_key(name: str) -> Column:
    """A document id that is never NULL."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``doc`` (never NULL) and ``text`` as UTF-8 bytes; other columns, whatever their names, do not matter."""
    return docs.select(id_key(id_col).alias("doc"), F.col(text_col).cast("string").cast("binary").alias("text"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` on every Arrow batch; it sees bounded batches, never a whole partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(fn, batches)

    return df.mapInArrow(run, schema)


def slices(rows: pa.RecordBatch, column: str, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts with about ``size`` bytes of a text column each, so that what Python makes of them stays small."""
    lengths = pc.fill_null(pc.binary_length(rows[column]), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // size
    starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    for start, end in zip(starts, [*starts[1:], rows.num_rows], strict=True):
        yield rows.slice(start, end - start)


def batch(**columns: np.ndarray | pa.Array | list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def lists(parts: list[np.ndarray], dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """Arrays one after another, and the length of each."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate(parts).astype(dtype, copy=False) if parts else np.empty(0, dtype)), sizes


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
