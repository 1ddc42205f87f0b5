"""The three routing modes as whole flows: read -> route -> process.

Routing always precedes processing (F-08), so a processor can never change a
destination. Any source works with any sink (F-07): a flow is only a
DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame

from relayspark.operators.processors import process
from relayspark.operators.routing import fan, funnel, one_to_one


def fan_flow(source: DataFrame, resolver: Mapping[str, str], processor=None) -> DataFrame:
    return process(fan(source, resolver), processor)


def funnel_flow(sources: Iterable[DataFrame], destination_topic: str, processor=None) -> DataFrame:
    return process(funnel(sources, destination_topic), processor)


def one_to_one_flow(source: DataFrame, routes, processor=None) -> DataFrame:
    return process(one_to_one(source, routes), processor)


def cross_system(source: DataFrame, route: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame], DataFrame], processor=None) -> DataFrame:
    """F-07: one source, one router, one egress projection."""
    return sink(process(route(source), processor))
