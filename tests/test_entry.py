"""Driver contract: entry(), queries() / oracle_sql() consistency, and a few
queries against their DuckDB oracle on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_mod

TABLES = ["events", "documents", "conversations"]


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["dest_topic", "message_count", "total_bytes"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    qs, orc = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 40


@pytest.mark.parametrize("name", ["fan_payload_key", "priority_tag", "source_metrics", "normalise_kafka", "check_order"])
def test_query_matches_oracle(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = entry_mod.queries()[name](spark, sf).toPandas()
    want = con.execute(entry_mod.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    g = sorted((tuple(None if v != v else v for v in r) for r in got[cols].itertuples(index=False, name=None)), key=key)
    w = sorted((tuple(None if v != v else v for v in r) for r in want[cols].itertuples(index=False, name=None)), key=key)
    assert len(g) == len(w)
    for a, b in zip(g, w):
        for x, y in zip(a, b):
            if isinstance(x, float) and isinstance(y, float):
                assert abs(x - y) <= 1e-9 * max(1.0, abs(y))
            else:
                assert str(x) == str(y) or x == y
