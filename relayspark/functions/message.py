"""Message-level scalar expressions. All are built-in Spark expressions, so they
stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _header_bytes_sql(h: str) -> str:
    values = f"array_join(map_values({h}), '')"
    return (
        f"CASE WHEN octet_length({values}) = octet_length(array_join(map_values({h}), '', '?')) "
        f"THEN CAST(octet_length(array_join(map_keys({h}), '')) AS BIGINT) + octet_length({values}) END"
    )


def header_bytes(headers: str | Column = "headers") -> Column:
    """UTF-8 bytes of all header keys and values; NULL when a value is NULL.

    UTF-8 length adds up under concatenation, so the keys and the values are
    each joined once and measured. ``array_join`` is code-generated, unlike a
    lambda ``aggregate``, so the size stays inside whole-stage codegen. A NULL
    value is detected by joining again with a one-byte stand-in for NULLs.
    """
    if isinstance(headers, str):
        return F.expr(_header_bytes_sql(headers))
    h = headers
    values = F.map_values(h)
    plain = F.octet_length(F.array_join(values, ""))
    marked = F.octet_length(F.array_join(values, "", "?"))
    total = F.octet_length(F.array_join(F.map_keys(h), "")).cast("bigint") + plain
    return F.when(plain == marked, total)


def message_size_sql(payload: str = "payload", headers: str = "headers", key: str = "key") -> str:
    """X-01 as SQL text (one expression, parsed once on the JVM)."""
    return (
        f"CAST(CAST(octet_length({payload}) AS BIGINT) + ({_header_bytes_sql(headers)}) "
        f"+ coalesce(octet_length({key}), 0) AS BIGINT)"
    )


def message_size(
    payload: str | Column = "payload", headers: str | Column = "headers", key: str | Column = "key"
) -> Column:
    """X-01: payload bytes + UTF-8 bytes of every header key and value + key bytes.

    A null payload (tombstone) or a null header value gives NULL: the message
    cannot be measured, which the routing step turns into a source error.
    """
    if isinstance(payload, str) and isinstance(headers, str) and isinstance(key, str):
        return F.expr(message_size_sql(payload, headers, key))
    key_bytes = F.coalesce(F.octet_length(_c(key)), F.lit(0))
    return (F.octet_length(_c(payload)).cast("bigint") + header_bytes(headers) + key_bytes).cast("bigint")


def header_get(name: str, default: str | None = None, headers: str | Column = "headers") -> Column:
    """X-02: header value, or ``default`` when absent. An empty value is kept."""
    value = _c(headers).getItem(name)
    if default is None:
        return value
    return F.coalesce(value, F.lit(default))


def header_put(entries: dict[str, str | Column], headers: str | Column = "headers") -> Column:
    """X-07: upsert headers (the new value wins; needs mapKeyDedupPolicy=LAST_WIN)."""
    kv: list[Column] = []
    for k, v in entries.items():
        kv.append(F.lit(k))
        kv.append(v if isinstance(v, Column) else F.lit(v))
    return F.map_concat(_c(headers), F.create_map(*kv))


def utf8_text(col: str | Column) -> Column:
    """X-03: strict UTF-8 decode; NULL when the bytes are not valid UTF-8."""
    return F.try_validate_utf8(_c(col).cast("string"))


def encode_utf8(col: str | Column) -> Column:
    """X-10: UTF-8 encode text to bytes."""
    return F.encode(_c(col), "UTF-8")


def iso_time(ts: str | Column) -> Column:
    """X-08: ISO-8601 text of a timestamp as Python's ``isoformat`` prints it:
    microseconds only when they are not zero."""
    t = _c(ts)
    micros = F.pmod(F.unix_micros(t), F.lit(1_000_000))
    return F.when(micros == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )
