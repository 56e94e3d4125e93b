"""How files and sources are dealt to shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_runs(units: DataFrame, order: str, per_shard: int) -> DataFrame:
    """Adds ``planned``: ``per_shard`` consecutive units (files, segments) go to one shard."""
    return units.withColumn("planned", F.floor((F.row_number().over(Window.orderBy(order)) - 1) / per_shard).cast("long"))


def halves(units: DataFrame, order: str, size: str) -> DataFrame:
    """Adds ``half``: 0 until the running size reaches half of the total, then 1. ``units`` are files or segments, not documents."""
    running = F.sum(size).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum(size).over(Window.partitionBy())
    return units.withColumn("half", F.when(F.coalesce(running, F.lit(0)) * 2 >= total, 1).otherwise(0))
