"""The same analysis on unbounded event streams."""

from bandwise.streaming.allocation import (
    StreamAllocation,
    gather_periods,
    rolled_decisions,
    threshold_stream,
)
from bandwise.streaming.batches import (
    allocation_windows,
    batch_rollup,
    predict_stream,
    stream_events,
    stream_spells,
    until_end,
)
from bandwise.streaming.deadband import decide_stream
from bandwise.streaming.sinks import write_bounded, write_stream

__all__ = [
    "StreamAllocation",
    "allocation_windows",
    "batch_rollup",
    "decide_stream",
    "gather_periods",
    "predict_stream",
    "rolled_decisions",
    "stream_events",
    "stream_spells",
    "threshold_stream",
    "until_end",
    "write_bounded",
    "write_stream",
]
