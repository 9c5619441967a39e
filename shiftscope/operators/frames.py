"""Frames that a plot can draw as they are: the data side of bars, lines, heat maps, grids and scatters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftscope.functions.text import marker_size, transition


def bars(counts: DataFrame, top_n: int | None = None) -> DataFrame:
    """(slot, count) over all periods, greatest first, the first top_n if asked."""
    total = counts.groupBy("slot").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "slot")
    return total if top_n is None else total.limit(top_n)


def lines(dist: DataFrame, order: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """Distances in the order of their transitions, with the p- and q-values of a test table where there is one."""
    out = dist.join(order.select(F.col("period").alias("period_1"), "ord"), "period_1").withColumn("transition", transition())
    if tests is not None:
        values = [c for c in ("p_value", "q_value", "significant_raw", "significant_fdr") if c in tests.columns]
        out = out.join(tests.select("slot", "period_1", "period_2", *values).dropDuplicates(["slot", "period_1", "period_2"]), ["slot", "period_1", "period_2"], "left")
    return out.orderBy("slot", "ord")


def heat_map(matrix: DataFrame, periods: list[str]) -> DataFrame:
    """A row a period, a column a period."""
    return matrix.groupBy("slot", "period_1").pivot("period_2", periods).agg(F.first("value")).orderBy("slot", "period_1")


def grid(contributions: DataFrame) -> DataFrame:
    """(slot, transition, items): each transition's shifted values in order, for a hover text or a grid."""
    item = F.struct("rank", "item", "direction", "contribution")
    return contributions.groupBy("slot", transition().alias("transition")).agg(F.array_sort(F.collect_list(item)).alias("items"))


def scatter(points: DataFrame, small: float = 6.0, large: float = 24.0) -> DataFrame:
    """Projected points with marker sizes scaled within the period."""
    return points.withColumn("size", marker_size(F.col("count"), Window.partitionBy("period"), small, large))


def dropdown(contributions: DataFrame) -> DataFrame:
    """The choices of slot and transition that have any value to show."""
    return contributions.select("slot", transition().alias("transition")).distinct().orderBy("slot", "transition")
