"""Desired-state conformance over tables and text corpora, on Spark."""

from plumbspark.operators import *  # noqa: F403
from plumbspark.operators import __all__ as _operators

__all__ = list(_operators)
