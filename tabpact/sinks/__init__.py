"""Sinks."""

from .base import AdaptedSink, Sink
from .custom import CustomSink, RecordWriter, custom_sink
from .delimited import DELIMITED, DelimitedSink, RowSequence
from .publish import Pending

__all__ = [name for name in dir() if not name.startswith("_")]
