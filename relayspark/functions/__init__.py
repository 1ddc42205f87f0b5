"""Scalar column functions (X-01 .. X-10)."""

from relayspark.functions.message import (
    message_size,
    header_bytes,
    header_get,
    header_put,
    utf8_text,
    encode_utf8,
    iso_time,
    message_size_sql,
)
from relayspark.functions.strict_json import (
    with_strict_json,
    json_key,
    json_key_route,
    json_set_keys,
    python_number_text_sql,
)

__all__ = [
    "message_size",
    "header_bytes",
    "header_get",
    "header_put",
    "utf8_text",
    "encode_utf8",
    "iso_time",
    "message_size_sql",
    "with_strict_json",
    "json_key",
    "json_key_route",
    "json_set_keys",
    "python_number_text_sql",
]
