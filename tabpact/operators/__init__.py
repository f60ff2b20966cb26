"""Operators on DataFrames."""

from .checks import check_summary, enforce, first_violation, row_passes, violations
from .filters import apply_filters
from .lineage import cycles, trace
from .mapping import Field, map_record
from .plan_lineage import ColumnLineage, column_lineage
from .rendering import format_cells, render_line, render_rows
from .sequence import number_rows, with_sequence

__all__ = [name for name in dir() if not name.startswith("_")]
