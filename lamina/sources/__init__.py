"""Sources and sinks: columns, tables, slices, row positions."""

from .columns import adopt, byte_count, column, load, slice_rows, store
from .position import rank_rows, with_file_pos, with_pos
from .written import new_path

__all__ = ["adopt", "byte_count", "column", "load", "new_path", "rank_rows", "slice_rows", "store", "with_file_pos", "with_pos"]
