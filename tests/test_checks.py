"""V-01 .. V-06, including the exact salted top-n against brute force."""

from pyspark.sql import functions as F

from relayspark.operators import checks
from relayspark.operators.routing import fan
from relayspark.session import plan_text
from tests.conftest import msg

HEADER = {"type": "header", "key": "d"}


def table(make, n=40):
    rows = [msg(f'{{"i": {i}}}', {"d": "a" if i % 4 else "b", "h": str(i)}, partition=i % 3, offset=i) for i in range(n)]
    return fan(make(rows), HEADER)


def test_counts(spark, make):
    got = {r["topic"]: (r["actual_count"], r["expected_count"], r["ok"]) for r in checks.check_counts(table(make), {"a": 30, "b": 9, "c": 1}).collect()}
    assert got == {"a": (30, 30, True), "b": (10, 9, False), "c": (0, 1, False)}


def test_contains_and_header(spark, make):
    c = {r["topic"]: r["found"] for r in checks.check_contains(table(make), '"i": 4}').collect()}
    assert c == {"a": False, "b": True}
    h = {r["topic"]: r["matching"] for r in checks.check_header(table(make), "h", "5").collect()}
    assert h == {"a": 1, "b": 0}


def test_equal_json_aware(spark, make):
    t = fan(make([msg('{"x": 1, "y": [1, 2]}', {"d": "a"}), msg('{"y":[1,2],"x":1}', {"d": "a"}), msg("nope", {"d": "a"})]), HEADER)
    assert checks.check_equal(t, {"x": 1, "y": [1, 2]}).first()["matching"] == 2
    assert checks.check_equal(t, "nope").first()["matching"] == 1


def brute_first(rows, n):
    out = {}
    for r in sorted(rows, key=lambda r: (r["partition"], r["offset"])):
        out.setdefault(r["dest_topic"], [])
        if len(out[r["dest_topic"]]) < n:
            out[r["dest_topic"]].append(r["offset"])
    return out


def test_bounded_read_matches_brute_force(spark, make):
    t = table(make, 60)
    rows = t.collect()
    for n in (1, 3, 50):
        got = {}
        for r in checks.bounded_read(t, n).orderBy("rank").collect():
            got.setdefault(r["dest_topic"], []).append(r["offset"])
        assert got == brute_first(rows, n)


def test_salted_top_n_matches_brute_force(spark, make):
    t = table(make, 60)
    rows = t.collect()
    got = {}
    for r in checks.first_n(t, 7).orderBy("rank").collect():
        got.setdefault(r["dest_topic"], []).append(r["offset"])
    assert got == brute_first(rows, 7)


def test_top_n_limits_before_shuffle(spark, make):
    t = table(make, 60)
    df = checks.bounded_read(t, 5)
    df.collect()
    assert "WindowGroupLimit" in plan_text(df)


def test_order(spark, make):
    t = table(make, 20)
    first = {k: [f'{{"i": {i}}}' for i in v] for k, v in brute_first(t.collect(), 3).items()}
    got = {r["topic"]: r["ok"] for r in checks.check_order(t, first).collect()}
    assert got == {"a": True, "b": True}
    wrong = {"a": list(reversed(first["a"]))}
    assert checks.check_order(t, wrong).first()["ok"] is False
