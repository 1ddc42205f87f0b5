import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from relayspark.schema import MESSAGE  # noqa: E402
from relayspark.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    state = str(tmp_path_factory.mktemp("state"))
    s = build_session("local[4]", 8, app_name="relayspark-tests", extra={"spark.checkpoint.dir": state})
    s.sparkContext.setLogLevel("ERROR")
    yield s


def msg(payload, headers=None, topic="t", key=None, partition=None, offset=None, timestamp=None):
    if isinstance(payload, str):
        payload = payload.encode("utf-8")
    return (payload, headers or {}, topic, key, partition, offset, timestamp)


@pytest.fixture
def make(spark):
    def _make(rows):
        return spark.createDataFrame([r if isinstance(r, tuple) else msg(r) for r in rows], MESSAGE)

    return _make


T0 = datetime(2024, 1, 1, 0, 0, 0)


@pytest.fixture(autouse=True)
def shared_schemas_unchanged():
    """No operator may change the shared schema objects in place."""
    from relayspark import schema

    before = {n: getattr(schema, n).simpleString() for n in ("MESSAGE", "ROUTED", "KAFKA_RAW", "DELIVERED")}
    yield
    after = {n: getattr(schema, n).simpleString() for n in before}
    assert after == before
