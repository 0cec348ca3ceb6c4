"""Running queries over streams."""

from windrose.streaming.runtime import ContinuousQuery

__all__ = ["ContinuousQuery"]
