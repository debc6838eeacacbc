"""Operators of the column algebra; each takes and returns lazy DataFrames."""

from .arithmetic import Arithmetic
from .filters import Filter
from .grouping import GroupBuilder, distinct_key_count, group_ids, group_sum, lookup_gids, representatives
from .joins import JoinBuilder, lookup_join, payload
from .gather import materialize
from .selection import Selection
from .setops import intersect, unite
from .sorting import argsort, clusters, multi_sort, refine, sort_pairs, sort_values

__all__ = [
    "Arithmetic", "Filter", "GroupBuilder", "JoinBuilder", "Selection", "argsort", "clusters", "distinct_key_count", "group_ids", "group_sum", "intersect",
    "lookup_gids", "lookup_join", "materialize", "multi_sort", "payload", "refine", "representatives", "sort_pairs", "sort_values", "unite",
]
