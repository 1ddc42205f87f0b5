"""Strict, dynamic JSON as native expressions (X-04 .. X-06, X-09).

``try_parse_json`` alone accepts trailing text after the first value. Wrapping
the text twice, once as an array element and once as an object member, closes
that gap: a text that is not exactly one JSON value breaks at least one of the
two wrappers. Both parses are staged as columns so Catalyst evaluates each once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A JSON object is the only value that begins with "{" (after JSON whitespace).
_OBJECT_START = r"^[ \t\n\r]*\{"


def _path(key: str) -> str:
    if "'" not in key:
        return f"$['{key}']"
    if '"' not in key:
        return f'$["{key}"]'
    raise ValueError(f"JSON key holds both quote characters: {key!r}")


# First byte of a payload that may hold a JSON object: "{" or JSON whitespace.
OBJECT_GATE_SQL = "substring({payload}, 1, 1) IN (X'7B', X'20', X'09', X'0A', X'0D')"


# First byte of a payload that may hold any JSON value: { [ " - digits t f n
# or JSON whitespace.
VALUE_GATE_SQL = (
    "substring({payload}, 1, 1) IN (X'7B', X'5B', X'22', X'2D', X'30', X'31', X'32', X'33', X'34', "
    "X'35', X'36', X'37', X'38', X'39', X'74', X'66', X'6E', X'20', X'09', X'0A', X'0D')"
)


def value_gate(payload: str = "payload") -> str:
    """SQL test on the raw payload bytes, O(1): false means the payload cannot
    be any JSON text."""
    return VALUE_GATE_SQL.format(payload=payload)


def object_gate(payload: str = "payload") -> str:
    """SQL test on the raw payload bytes, O(1): false means the payload cannot
    be a JSON object, so it need not be decoded at all."""
    return OBJECT_GATE_SQL.format(payload=payload)


def with_strict_json(
    df: DataFrame, text: str | Column, out: str, objects_only: bool = True, gate: str | None = None
) -> DataFrame:
    """X-04: add column ``out`` (VARIANT) holding the parsed text when the text is
    exactly one JSON value, else NULL.

    ``text`` is a column or a SQL expression (for example
    ``"try_validate_utf8(CAST(payload AS STRING))"``). With ``objects_only``
    only texts that start like an object are parsed at all, which is exact for
    callers that treat every non-object like invalid JSON (payload-key routing,
    priority tagging) and spares the parse of large non-JSON payloads.
    ``gate`` (SQL, see ``object_gate``) skips even the decode of ``text`` for
    rows where it is false.
    """
    t = F.expr(text) if isinstance(text, str) else text
    if gate is not None:
        t = F.when(F.expr(gate), t)
    arr, obj, src, raw = f"__{out}_a", f"__{out}_o", f"__{out}_t", f"__{out}_r"
    if objects_only:
        # The decoded text is staged first so that the object test and the
        # parse input share one decode.
        df = df.withColumn(raw, t)
        df = df.withColumn(src, F.when(F.col(raw).rlike(_OBJECT_START), F.col(raw)))
    else:
        df = df.withColumn(src, t)
    df = df.withColumns(
        {
            arr: F.expr(f"try_parse_json(concat('[', {src}, ']'))"),
            obj: F.expr(f"""try_parse_json(concat('{{"v":', {src}, '}}'))"""),
        }
    )
    parsed = F.expr(
        f"CASE WHEN {obj} IS NOT NULL AND {arr} IS NOT NULL "
        f"AND try_variant_get({arr}, '$[1]', 'variant') IS NULL "
        f"THEN try_variant_get({arr}, '$[0]', 'variant') END"
    )
    keep = [c for c in df.columns if c not in (arr, obj, src, raw, out)]
    return df.select(*keep, parsed.alias(out))


def json_key(value: str | Column, key: str) -> Column:
    """X-05: top-level member ``key`` of a parsed object as VARIANT.

    NULL when the key is absent; a JSON ``null`` member is a non-NULL VARIANT
    holding null. The bracket path keeps ``a.b`` one key.
    """
    v = F.col(value) if isinstance(value, str) else value
    return F.try_variant_get(v, _path(key), "variant")


def json_key_route(member: str | Column, default: str = "default") -> Column:
    """Route text of a member: its string, or the JSON text of a non-string value;
    ``default`` when absent; NULL for a JSON null."""
    m = F.col(member) if isinstance(member, str) else member
    return F.when(m.isNull(), F.lit(default)).otherwise(F.try_variant_get(m, "$", "string"))


def json_set_keys(obj: str | Column, entries: dict[str, str]) -> Column:
    """X-06: set top-level keys (values given as JSON literals) and serialise.

    Output is compact JSON; an existing key keeps its place and takes the new
    value (needs mapKeyDedupPolicy=LAST_WIN).
    """
    o = F.col(obj) if isinstance(obj, str) else obj
    kv: list[Column] = []
    for k, json_literal in entries.items():
        kv.append(F.lit(k))
        kv.append(F.parse_json(F.lit(json_literal)))
    return F.to_json(F.map_concat(F.variant_get(o, "$", "map<string,variant>"), F.create_map(*kv)))


def python_number_text_sql(x: str) -> str:
    """Text of a double expression ``x`` as Python's ``repr`` prints it.

    Spark prints the shortest round-trip digits like Python does, but in
    plain notation only for 1e-3 <= |x| < 1e7 and as ``d.dddEn`` otherwise;
    Python uses plain notation for exponents -4 .. 15 and ``d.ddde-05`` /
    ``d.ddde+16`` beyond. The ``E`` form is rewritten: in Python's plain range
    with as many fraction digits as the shortest mantissa needs (at least
    one), else as Python's exponent form.
    """
    j = f"CAST({x} AS STRING)"
    m = f"substring_index({j}, 'E', 1)"
    e = f"CAST(substring_index({j}, 'E', -1) AS INT)"
    frac = f"length(TRIM(TRAILING '0' FROM substring_index({m}, '.', -1)))"
    plain = f"format_string(concat('%.', CAST(greatest({frac} - {e}, 1) AS STRING), 'f'), {x})"
    mant = f"CASE WHEN endswith({m}, '.0') THEN substring({m}, 1, length({m}) - 2) ELSE {m} END"
    exp = (
        f"concat(CASE WHEN {e} < 0 THEN '-' ELSE '+' END, "
        f"CASE WHEN abs({e}) < 10 THEN concat('0', CAST(abs({e}) AS STRING)) ELSE CAST(abs({e}) AS STRING) END)"
    )
    return (
        f"CASE WHEN NOT contains({j}, 'E') THEN {j} "
        f"WHEN {e} >= -4 AND {e} < 16 THEN {plain} "
        f"ELSE concat({mant}, 'e', {exp}) END"
    )

