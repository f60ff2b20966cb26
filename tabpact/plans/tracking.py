"""Lineage questions about a pipeline, asked of its edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.lineage import trace


def track_column(edges: DataFrame, source: str, column: str) -> DataFrame:
    """From a source column to all sink fields it feeds."""
    reached = trace(edges, [f"source:{source}.{column}"], "forward")
    return reached.where(F.col("node").startswith("sink:"))


def track_field(edges: DataFrame, sink: str, field: str) -> DataFrame:
    """From a sink field back to all source columns it is made of."""
    reached = trace(edges, [f"sink:{sink}.{field}"], "backward")
    return reached.where(F.col("node").startswith("source:"))


def track_function(edges: DataFrame, function: str) -> DataFrame:
    """Everything a function's input comes from and its output goes to."""
    return trace(edges, [f"fn:{function}"], "both")
