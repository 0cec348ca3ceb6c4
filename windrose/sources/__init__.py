"""Stream and table sources by name, as CREATE TABLE ... USING names them."""

from windrose.sources.providers import PROVIDERS, SourceError, is_live, kafka_options, open_source, replay

__all__ = ["PROVIDERS", "SourceError", "is_live", "kafka_options", "open_source", "replay"]
