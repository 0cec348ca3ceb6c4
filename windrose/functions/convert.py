"""Message converters. A converter is two sets of column expressions, so no message passes through Python."""

from __future__ import annotations

import re
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Converter(Protocol):
    def to_row(self, value: Column, schema: StructType) -> list[Column]:
        """A column for each field, from a message."""

    def to_message(self, df: DataFrame) -> Column:
        """A message from a row."""


class DelimiterConverter:
    """Fields by position between delimiters (plain text, not a pattern).

    No message fails: missing fields and ones that don't cast are null, further ones are ignored.
    """

    def __init__(self, delimiter: str = " "):
        self.delimiter = delimiter

    def to_row(self, value: Column, schema: StructType) -> list[Column]:
        parts = F.split(value, re.escape(self.delimiter))
        return [F.get(parts, i).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)]

    def to_message(self, df: DataFrame) -> Column:
        return F.concat_ws(self.delimiter, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in df.columns])


class JsonConverter:
    """JSON objects by field name; what isn't JSON gives nulls, and the text in ``corrupt`` if the schema has that field."""

    def __init__(self, corrupt: str = "_corrupt_record"):
        self.corrupt = corrupt

    def to_row(self, value: Column, schema: StructType) -> list[Column]:
        j = F.from_json(value, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": self.corrupt})
        return [j.getField(f.name).alias(f.name) for f in schema.fields]

    def to_message(self, df: DataFrame) -> Column:
        return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))


_KNOWN: dict[str, Converter] = {"delimiter": DelimiterConverter(), "space": DelimiterConverter(), "tab": DelimiterConverter("\t"), "comma": DelimiterConverter(","), "json": JsonConverter()}


def register_converter(name: str, c: Converter) -> None:
    _KNOWN[name.lower()] = c


def converter(name: str | Converter) -> Converter:
    if not isinstance(name, str):
        return name
    key = name.split(".")[-1].lower()
    found = _KNOWN.get(key) or _KNOWN.get(re.sub("(message)?(converter|delimiter)$", "", key) or "delimiter")
    if found is None:
        raise ValueError(f"no converter {name!r}; known are {', '.join(sorted(_KNOWN))}")
    return found
