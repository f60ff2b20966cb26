"""Contract-checked table and stream pipelines on Spark."""

from .contracts import REQUIRED, Check, ColumnSpec, FilterParam, Param, SinkContract, SourceContract
from .errors import DefinitionError, RefusedError, SealedError
from .operators import (
    Field,
    apply_filters,
    check_summary,
    column_lineage,
    cycles,
    enforce,
    first_violation,
    format_cells,
    map_record,
    render_rows,
    trace,
    violations,
    with_sequence,
)
from .plans import Pipeline, track_column, track_field, track_function
from .sinks import DELIMITED, CustomSink, DelimitedSink, Pending, RowSequence, Sink, custom_sink
from .sources import (
    REJECT,
    REJECT_TYPE,
    CustomSource,
    Reject,
    conform,
    custom_source,
    read_source,
    read_with_rejects,
    record_source,
    split_rejects,
)
from .streaming import check_counts, stream_sink, stream_source

__all__ = [name for name in dir() if not name.startswith("_")]
