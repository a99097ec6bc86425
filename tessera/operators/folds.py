"""Folds over rows in order that hold no group as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame


def in_order(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Each group's rows in one task and in order: ``mapInPandas`` then sees them batch by batch, group after group."""
    return rows.repartition(group).sortWithinPartitions(group, order)
