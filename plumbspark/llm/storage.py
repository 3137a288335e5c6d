"""Cutting lineage, and the package where Python workers find it."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

from plumbspark.sources.storage import checkpoint_dir, cut

__all__ = ["checkpoint_dir", "cut", "ship_package"]


def ship_package(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package from wherever the session was started.

    On a cluster the package comes with the job (``--py-files`` or ``PYTHONPATH``).
    """
    context = spark.sparkContext
    package = Path(__file__).resolve().parents[1]
    if context.master.startswith("local[") and not any(x.rstrip("/").endswith(f"/{package.name}") for x in context.listFiles):
        context.addFile(str(package), recursive=True)
