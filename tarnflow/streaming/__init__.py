"""Incremental evaluation: weighted DataFrames, view graphs and the Structured Streaming driver."""

from . import zset
from .driver import append, decode_log, encode_log, start
from .graph import Aggregate, Constant, Join, Keyed, Linear, Source, Union, View
from .sql import columns_read, compile_sql, restored

__all__ = ["Aggregate", "Constant", "Join", "Keyed", "Linear", "Source", "Union", "View", "append", "columns_read", "compile_sql", "decode_log", "encode_log", "restored", "start", "zset"]
