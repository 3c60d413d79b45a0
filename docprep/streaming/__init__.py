"""The same work on streams."""

from docprep.streaming.feeds import clean_stream, line_feed, run_to_end, stream_lines, warning_rollup
from docprep.streaming.states import stream_latest, stream_sessions, stream_states

__all__ = ["clean_stream", "line_feed", "run_to_end", "stream_latest", "stream_lines", "stream_sessions", "stream_states", "warning_rollup"]
