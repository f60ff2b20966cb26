"""Sources."""

from .custom import REJECT, REJECT_TYPE, CustomSource, Reject, custom_source, record_source
from .reader import conform, load, read_source, select_columns
from .rejects import read_with_rejects, split_rejects

__all__ = [name for name in dir() if not name.startswith("_")]
