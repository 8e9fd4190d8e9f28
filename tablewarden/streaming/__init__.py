"""Structured Streaming forms of the checks and of episode scoring."""

from .episodes import broadcast_truth, keep_until_done, score_batches, score_rows, stream_episodes
from .quality import findings_stream, first_rows, repeated_keys, sink_findings, windowed_quality

__all__ = [
    "broadcast_truth", "findings_stream", "first_rows", "keep_until_done", "repeated_keys", "score_batches", "score_rows", "sink_findings",
    "stream_episodes", "windowed_quality",
]
