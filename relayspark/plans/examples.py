"""Example processors, loadable by dotted name (P-02)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from relayspark.operators.processors import header_stamp


class ParityProcessor:
    """Row processor: header ``k_parity`` = ``even``/``odd`` from the payload's
    ``k``. A payload that is not a JSON object raises (a processor failure)."""

    def __init__(self, key: str = "k"):
        self.key = key

    def process(self, message):
        body = json.loads(message.payload.decode("utf-8"))
        value = body.get(self.key, 0)
        message.headers["k_parity"] = "even" if int(value) % 2 == 0 else "odd"
        return message


class StampProcessor:
    """DataFrame processor: header ``stamped_by`` = ``relay``."""

    def apply(self, df: DataFrame) -> DataFrame:
        return header_stamp(df, "stamped_by", "relay")


class BadOutputProcessor:
    """Row processor whose results can't be sent, but for every fifth offset: a
    header that is no text, a payload that is no bytes, none, a key that is no
    text."""

    def process(self, message):
        kind = message.offset % 5
        if kind == 0:
            message.headers["n"] = 1
        elif kind == 1:
            message.payload = "text"
        elif kind == 2:
            message.payload = None
        elif kind == 3:
            message.key = 7
        return message
