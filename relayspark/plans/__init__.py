"""Composed flows (route -> process -> deliver) and the registered queries."""

from relayspark.plans.flows import fan_flow, funnel_flow, one_to_one_flow, cross_system

__all__ = ["fan_flow", "funnel_flow", "one_to_one_flow", "cross_system"]
