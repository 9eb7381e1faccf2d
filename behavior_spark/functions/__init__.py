"""Column helpers. Each one is a plain Spark expression, so it stays inside code generation."""

from behavior_spark.functions.jsontext import decimal_of, double_of, json_array, json_object, json_objects, parsed_once, text_of, uint_of
from behavior_spark.functions.numbers import (
    js_number,
    js_trim,
    number_of_trimmed,
    round_half_even,
    round_half_up,
    to_fixed,
    to_uint_or_null,
    whole_number,
)
from behavior_spark.functions.texts import blank_to_null, digest_id, first_filled, url_hash
from behavior_spark.functions.times import event_month, parse_event_time, span_seconds, to_millis

__all__ = [
    "blank_to_null",
    "decimal_of",
    "digest_id",
    "double_of",
    "event_month",
    "first_filled",
    "js_number",
    "js_trim",
    "json_array",
    "json_object",
    "json_objects",
    "number_of_trimmed",
    "parse_event_time",
    "parsed_once",
    "round_half_even",
    "round_half_up",
    "span_seconds",
    "text_of",
    "to_fixed",
    "to_millis",
    "to_uint_or_null",
    "uint_of",
    "url_hash",
    "whole_number",
]
