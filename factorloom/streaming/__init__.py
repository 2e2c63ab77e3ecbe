"""The same operators over streams of bars."""

from .bars import stream_bars
from .factors import stream_cusum, stream_last_values, stream_recursive

__all__ = ["stream_bars", "stream_cusum", "stream_last_values", "stream_recursive"]
