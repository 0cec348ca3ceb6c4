"""Message converters: text messages to typed columns and back."""

from windrose.functions.convert import Converter, DelimiterConverter, JsonConverter, converter, register_converter

__all__ = ["Converter", "DelimiterConverter", "JsonConverter", "converter", "register_converter"]
