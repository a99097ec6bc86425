"""Latency figures: percentiles by the lower nearest rank."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def percentile_of(values: list[float], p: float) -> float | None:
    """``sorted[floor(p / 100 * (n - 1))]``; none of nothing."""
    return sorted(values)[int(p / 100 * (len(values) - 1))] if values else None


def percentiles(rows: DataFrame, col: str, ps: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """One row: ``n, mean`` and ``p50 ...`` of a column, nulls left out.

    Equal values are counted first and the ranks taken over the counts, so the final step sees distinct values, in
    ranges, and never a list of all rows.
    """
    counts = rows.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count("*").alias("c"))
    # Ranks come from range buckets: counts of whole buckets, then a running sum within each.
    edges = counts.agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 1000)).scalar()
    spread = counts.withColumn("__edges", F.coalesce(edges, F.array().cast("array<double>"))).withColumn("b", F.size(F.filter("__edges", lambda e: e < F.col("v")))).drop("__edges")
    before = spread.groupBy("b").agg(F.sum("c").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("b")) - F.col("n")).select(F.col("b").alias("__b"), "before")
    ranked = spread.join(F.broadcast(before), F.col("b") == F.col("__b")).withColumn("last", F.col("before") + F.sum("c").over(Window.partitionBy("b").orderBy("v")))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")).scalar()
    pick = [F.min(F.when(F.col("last") > F.floor(F.lit(p) * (F.col("total") - 1) / 100), F.col("v"))).alias(f"p{p}") for p in ps]
    return ranked.withColumn("total", total).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.try_divide(F.sum(F.col("v") * F.col("c")), F.sum("c")).alias("mean"), *pick)


def measure(action: Callable[[], object], runs: int = 10) -> dict[str, float]:
    """Milliseconds of a driver-side action."""
    took = []
    for _ in range(runs):
        t = time.perf_counter()
        action()
        took.append((time.perf_counter() - t) * 1000)
    return {**{f"p{p}": percentile_of(took, p) for p in (50, 95, 99)}, "mean": sum(took) / len(took)}
