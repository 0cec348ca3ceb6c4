"""Continuous SQL over Spark: windowed relations, streaming runtimes, sources and sinks."""

__all__ = ["ContinuousQuery", "StreamContext"]


def __getattr__(name: str):  # Python workers import this package for single modules
    if name == "StreamContext":
        from windrose.context import StreamContext

        return StreamContext
    if name == "ContinuousQuery":
        from windrose.streaming import ContinuousQuery

        return ContinuousQuery
    raise AttributeError(name)
