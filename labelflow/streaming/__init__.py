"""Structured Streaming: scoring and evaluation of streams."""

from .evaluate_stream import count_stream, stream_counts, stream_metrics, stream_report  # noqa: F401
from .score_stream import score_stream, table_source  # noqa: F401
