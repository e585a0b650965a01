"""Dead-band data reduction analytics on Spark DataFrames and streams."""

from bandwise.params import AdaptiveConfig, AllocationConfig, Params
from bandwise.session import configure

__all__ = ["AdaptiveConfig", "AllocationConfig", "Params", "configure"]
