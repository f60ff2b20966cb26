"""Pipelines and the sample plans built from them."""

from .pipeline import Pipeline, SourceBinding
from .tracking import track_column, track_field, track_function

__all__ = ["Pipeline", "SourceBinding", "track_column", "track_field", "track_function"]
