"""X-01 .. X-10 and the strict JSON recipe against Python's json as oracle."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from relayspark.functions import header_get, header_put, iso_time, message_size, utf8_text
from relayspark.operators.processors import priority_tag
from relayspark.operators.routing import fan
from tests.conftest import msg

# FIXTURES §5 payloads (lookup key "p", minimum 5), plus NaN.
PAYLOADS = [
    b'{"p":"a"}', b'{"p":"a"} x', b'{"p":"a"}{"p":1}', b'{"p":"a"}]',
    b'{"p":"a"}}', b'{"p":"a"},{"p":2}', b'{"p":"a"}]}', b'{"p":null}',
    b"{}", b"[1]", b"5", b'"s"',
    b"null", b"bad", b"", b"\xff",
    b'{"p":3}', b'{"p":true}', b'{"p":3.0}', b'{"p":"3"}',
    b'{"p":[1]}', b'{"p":{"z":1}}', b'{"p":1,"p":9}', b'{"p":-2.5}',
    b'{"p":1e2}', b' {"p":""} ', b'{"q":1}', b'{"p":"x","p":null}',
]
# Documented route differences (Q-03): JSON text instead of Python str().
KNOWN_ROUTE_DIFF = {b'{"p":true}': "true", b'{"p":3.0}': "3", b'{"p":{"z":1}}': '{"z":1}'}


def py_route(payload: bytes):
    try:
        body = json.loads(payload.decode("utf-8"))
        return body.get("p", "default")
    except Exception:
        return "default"


def py_priority(payload: bytes, minimum=5):
    try:
        body = json.loads(payload.decode("utf-8"))
        pr = body.get("p", 0)
        if pr < minimum:
            return "true", f"priority {pr} < {minimum}"
        return "false", None
    except Exception:
        return "false", "parse_error"


def test_size_counts_payload_headers_key(spark, make):
    df = make([msg("abc", {"h": "xyz", "é": "ü"}, key="kk"), msg("", {}, key=""), msg(None, {"a": "b"})])
    got = [r[0] for r in df.select(message_size()).collect()]
    assert got == [3 + 1 + 3 + 2 + 2 + 2, 0, None]


def test_header_get_default_and_empty(spark, make):
    df = make([msg("x", {"d": ""}), msg("x", {})])
    got = [r[0] for r in df.select(header_get("d", "default")).collect()]
    assert got == ["", "default"]


def test_header_put_last_wins(spark, make):
    df = make([msg("x", {"a": "1", "b": "2"})])
    got = df.select(header_put({"a": "9", "c": "3"})).first()[0]
    assert got == {"a": "9", "b": "2", "c": "3"}


def test_utf8_strict(spark, make):
    df = make([msg(b"\xff"), msg("ok")])
    assert [r[0] for r in df.select(utf8_text("payload")).collect()] == [None, "ok"]


def test_iso_time_like_python(spark):
    rows = [(datetime(2024, 5, 1, 12, 30, 45, 123456),), (datetime(2024, 5, 1, 12, 30, 45),)]
    df = spark.createDataFrame(rows, "t timestamp")
    got = [r[0] for r in df.select(iso_time("t")).collect()]
    assert got == [r[0].isoformat() for r in rows]


def test_strict_json_route_matches_python(spark, make):
    df = make([msg(p, offset=i) for i, p in enumerate(PAYLOADS)])
    routed = fan(df, {"type": "payload_key", "key": "p"}).orderBy("offset")
    got = [r["dest_topic"] for r in routed.select("offset", "dest_topic").collect()]
    for p, g in zip(PAYLOADS, got):
        if p in KNOWN_ROUTE_DIFF:
            assert g == KNOWN_ROUTE_DIFF[p], p
            continue
        want = py_route(p)
        assert g == (None if want is None else str(want)), p


def test_strict_json_priority_matches_python(spark, make):
    df = make([msg(p, offset=i) for i, p in enumerate(PAYLOADS)])
    tagged = priority_tag(fan(df, {"type": "header", "key": "x"}), key="p", min_priority=5).orderBy("offset")
    rows = tagged.select(F.col("headers")["filtered"], F.col("headers")["reason"]).collect()
    for p, r in zip(PAYLOADS, rows):
        assert (r[0], r[1]) == py_priority(p), p


def test_nan_is_rejected(spark, make):
    """Q-17: Python accepts NaN; the strict parser does not (documented deviation)."""
    df = make([msg(b'{"p":NaN}')])
    assert fan(df, {"type": "payload_key", "key": "p"}).first()["dest_topic"] == "default"


def test_payload_keys_with_path_characters(spark, make):
    """X-05: member names with path characters are one key each."""
    import pytest

    df = make([msg('{"a]b":"x","it\'s":"y","q\\"k":"z","a":{"b":"no"}}')])
    for key, want in (("a]b", "x"), ("it's", "y"), ('q"k', "z")):
        assert fan(df, {"type": "payload_key", "key": key}).first()["dest_topic"] == want, key
    with pytest.raises(ValueError):
        fan(df, {"type": "payload_key", "key": "a'\"b"})
