"""Operators put together."""

from plumbspark.plans.conformance import conformance_report, conformance_results

__all__ = ["conformance_report", "conformance_results"]
