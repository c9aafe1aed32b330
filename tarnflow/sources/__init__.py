"""Sources and sinks."""

from .changes import as_updates, change_log
from .constants import generate_series, single_row, values
from .sinks import BagSink, KeyedSink, print_changes
from .tables import SCHEMAS, Relation, load

__all__ = ["SCHEMAS", "BagSink", "KeyedSink", "Relation", "as_updates", "change_log", "generate_series", "load", "print_changes", "single_row", "values"]
