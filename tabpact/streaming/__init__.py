"""The same contracts, checks, sinks and pipelines on Structured Streaming."""

from .pipes import check_counts, run_pipeline
from .scan import stream_source
from .sinks import stream_sink

__all__ = [name for name in dir() if not name.startswith("_")]
