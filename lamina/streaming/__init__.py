"""Streaming forms of the incremental builders."""

from .grouped import stream_group_sum

__all__ = ["stream_group_sum"]
