"""Distances between periods of the long observation relation.

Observations are rows (period, slot, item[, weight]).  Counts per (slot, period, item) are
one partially aggregated shuffle; everything after works on counts.  A period's place comes
from a periods relation (period, ord), or from the periods' sorted names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftscope.functions.measures import Measure, direction, measure

MODES = ("all", "data_only")


def check_arguments(min_freq: int = 1, k: float = 1, mode: str = "all") -> None:
    if min_freq < 1:
        raise ValueError("min_freq must be at least 1")
    if k <= 0:
        raise ValueError("k must be positive")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")


def item_counts(obs: DataFrame) -> DataFrame:
    weight = F.sum("weight") if "weight" in obs.columns else F.count(F.lit(1))
    return obs.where(F.col("period").isNotNull() & F.col("item").isNotNull()).groupBy("slot", F.col("period").cast("string").alias("period"), "item").agg(weight.cast("double").alias("n"))


def counted(obs: DataFrame) -> DataFrame:
    """The observations with equal ones as one weighted row; those without an item or a period stay, as periods are read of them."""
    weight = F.sum("weight") if "weight" in obs.columns else F.count(F.lit(1))
    return obs.groupBy("slot", "period", "item").agg(weight.alias("weight"))


def period_order(obs: DataFrame, periods: list[str] | DataFrame | None = None) -> DataFrame:
    """(period, ord), one row a period: the given order, or the order of names."""
    if isinstance(periods, DataFrame):
        return periods.select(F.col("period").cast("string").alias("period"), F.col("ord").cast("long").alias("ord"))
    if periods is not None:
        listed = obs.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(str(p)) for p in periods])).alias("ord", "period"))
        return listed.select("period", F.col("ord").cast("long").alias("ord"))
    # few rows: one array of the distinct periods, sorted
    names = obs.select(F.col("period").cast("string").alias("period")).where("period IS NOT NULL").distinct().agg(F.sort_array(F.collect_set("period")).alias("p"))
    return names.select(F.posexplode("p").alias("ord", "period")).select("period", F.col("ord").cast("long").alias("ord"))


def period_pairs(counts: DataFrame, order: DataFrame, mode: str) -> DataFrame:
    """(slot, period_1, period_2, o1, o2) to compare."""
    if mode == "data_only":
        have = counts.select("slot", "period").distinct().join(order, "period")
        w = Window.partitionBy("slot").orderBy("ord")
        out = have.select("slot", F.col("period").alias("period_1"), F.lead("period").over(w).alias("period_2"), F.col("ord").alias("o1"), F.lead("ord").over(w).alias("o2"))
        return out.where("period_2 IS NOT NULL")
    listed = order.agg(F.sort_array(F.collect_list(F.struct("ord", "period"))).alias("p"))  # the periods dimension
    if mode == "matrix":
        pairs = F.flatten(F.transform("p", lambda a: F.transform(F.filter("p", lambda b: b["ord"] > a["ord"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    else:
        pairs = F.transform(F.expr("sequence(1, greatest(size(p) - 1, 1))"), lambda i: F.struct(F.get("p", i - 1).alias("a"), F.get("p", i).alias("b")))
    flat = listed.select(F.explode(pairs).alias("x")).select(F.col("x.a.period").alias("period_1"), F.col("x.b.period").alias("period_2"), F.col("x.a.ord").alias("o1"), F.col("x.b.ord").alias("o2"))
    return flat.where("period_2 IS NOT NULL")


def aligned(obs: DataFrame, periods=None, mode: str = "all", min_freq: int = 1, keep_empty: bool = False) -> DataFrame:
    """(slot, period_1, period_2, o1, o2, item, a, b, na, nb, pa, pb) of the items whose mixed count reaches min_freq."""
    counts = item_counts(obs)
    pairs = period_pairs(counts, period_order(obs, periods), mode)
    # each period's places in pairs, so that counts are read and joined once
    place = F.explode(F.array(F.struct(F.col("period_1").alias("period"), F.lit(True).alias("first")), F.struct(F.col("period_2").alias("period"), F.lit(False).alias("first")))).alias("x")
    sides = pairs.select(*pairs.columns, place).select(*pairs.columns, "x.period", "x.first")
    by = ["slot", "period"] if mode == "data_only" else ["period"]
    both = counts.join(sides, by).groupBy("slot", "period_1", "period_2", "o1", "o2", "item").agg(
        F.sum(F.when(F.col("first"), F.col("n")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("first"), 0.0).otherwise(F.col("n"))).alias("b")
    ).where(F.col("a") + F.col("b") >= min_freq)
    w = Window.partitionBy("slot", "period_1", "period_2")
    both = both.withColumn("na", F.sum("a").over(w)).withColumn("nb", F.sum("b").over(w))
    if not keep_empty:
        both = both.where((F.col("na") > 0) & (F.col("nb") > 0))
    return both.withColumn("pa", F.col("a") / F.col("na")).withColumn("pb", F.col("b") / F.col("nb"))


def _support(k: float) -> tuple[Column, Column]:
    count = F.least(F.first("na"), F.first("nb"))
    return count, F.least(F.lit(1.0), count / F.lit(float(k)))


def distances(obs: DataFrame, measures: tuple[str | Measure, ...] = ("tvd",), periods=None, mode: str = "all", min_freq: int = 1) -> DataFrame:
    """(slot, period_1, period_2, measure, dist) of consecutive periods; pairs with an empty side are left out."""
    check_arguments(min_freq, 1, mode)
    return _scores(aligned(obs, periods, mode, min_freq), [measure(m) for m in measures])


def _scores(rows: DataFrame, found: list[Measure]) -> DataFrame:
    scored = rows.groupBy("slot", "period_1", "period_2").agg(*[m.score(F.col("pa"), F.col("pb")).alias(m.name) for m in found])
    stacked = F.explode(F.array(*[F.struct(F.lit(m.name).alias("measure"), F.col(m.name).alias("dist")) for m in found])).alias("x")
    return scored.select("slot", "period_1", "period_2", stacked).select("slot", "period_1", "period_2", "x.measure", "x.dist")


def support(obs: DataFrame, k: float = 30, periods=None, mode: str = "all", min_freq: int = 1, include_zero_slots: bool = False) -> DataFrame:
    """(slot, period_1, period_2, support_count, support_weight) with w = min(1, min(n1, n2) / k)."""
    check_arguments(min_freq, k, mode)
    rows = aligned(obs, periods, mode, min_freq)
    count, weight = _support(k)
    found = rows.groupBy("slot", "period_1", "period_2").agg(count.alias("support_count"), weight.alias("support_weight"))
    if not include_zero_slots:
        return found
    counts = item_counts(obs)
    pairs = period_pairs(counts, period_order(obs, periods), mode)
    slots = counts.select("slot").distinct()
    grid = pairs.select("slot", "period_1", "period_2") if mode == "data_only" else slots.join(F.broadcast(pairs.select("period_1", "period_2")), F.lit(True))  # a row a pair of adjacent periods
    return grid.join(found, ["slot", "period_1", "period_2"], "left").fillna(0.0, ["support_count", "support_weight"])


def weighted_distances(obs: DataFrame, which: str | Measure = "tvd", k: float = 20, periods=None, mode: str = "all", min_freq: int = 1) -> DataFrame:
    """Distance, support and their product in one aggregation."""
    check_arguments(min_freq, k, mode)
    m = measure(which)
    count, weight = _support(k)
    rows = aligned(obs, periods, mode, min_freq).groupBy("slot", "period_1", "period_2")
    out = rows.agg(m.score(F.col("pa"), F.col("pb")).alias("dist"), count.alias("support_count"), weight.alias("support_weight"))
    return out.select("slot", "period_1", "period_2", F.lit(m.name).alias("measure"), "dist", "support_count", "support_weight", (F.col("dist") * F.col("support_weight")).alias("weighted_dist"))


def multiply_by_support(dist: DataFrame, sup: DataFrame) -> DataFrame:
    """The same from two tables; a distance without support, or with two, raises an error."""
    keys = ["slot", "period_1", "period_2"]
    one = sup.groupBy(*keys).agg(F.count("*").alias("rows"), F.first("support_count").alias("support_count"), F.first("support_weight").alias("support_weight"))
    met = dist.join(one, keys, "left")
    ok = F.when(F.coalesce("rows", F.lit(0)) == 1, F.col("support_weight")).otherwise(F.raise_error(F.lit("a distance row needs exactly one support row")).cast("double"))
    return met.withColumn("weighted_dist", F.col("dist") * ok).drop("rows")


def period_matrix(obs: DataFrame, which: str | Measure = "tvd", k: float | None = None, periods=None, min_freq: int = 1) -> DataFrame:
    """(slot, period_1, period_2, value) of all pairs, both ways, with zeros where they meet."""
    check_arguments(min_freq, k or 1)
    m = measure(which)
    count, weight = _support(k or 1)
    value = m.score(F.col("pa"), F.col("pb")) * (weight if k else F.lit(1.0))
    upper = aligned(obs, periods, "matrix", min_freq).groupBy("slot", "period_1", "period_2").agg(value.alias("value"))
    lower = upper.select("slot", F.col("period_2").alias("period_1"), F.col("period_1").alias("period_2"), "value")
    same = item_counts(obs).select("slot", F.col("period").alias("period_1"), F.col("period").alias("period_2"), F.lit(0.0).alias("value")).distinct()
    return upper.unionByName(lower).unionByName(same)


def contributions(obs: DataFrame, which: str | Measure = "tvd", top_n: int | None = 10, k: float | None = None, periods=None, mode: str = "all", min_freq: int = 1, positive_only: bool = True) -> DataFrame:
    """(slot, period_1, period_2, rank, item, direction, contribution, dist): what moved, greatest first."""
    check_arguments(min_freq, k or 1, mode)
    m = measure(which)
    w = Window.partitionBy("slot", "period_1", "period_2")
    pa, pb = F.col("pa"), F.col("pb")
    weight = F.least(F.lit(1.0), F.least("na", "nb") / F.lit(float(k))) if k else F.lit(1.0)
    rows = aligned(obs, periods, mode, min_freq).withColumn("raw", m.part(pa, pb, w)).withColumn("weight_", weight)
    if m.name == "cosine":
        norm = F.sqrt(F.sum(pa * pa).over(w) * F.sum(pb * pb).over(w))
        rows = rows.withColumn("dist", 1 - F.sum(pa * pb).over(w) / norm)
    else:
        rows = rows.withColumn("dist", F.sum("raw").over(w))
    rows = rows.withColumn("contribution", F.col("raw") * F.col("weight_")).withColumn("dist", F.col("dist") * F.col("weight_"))
    if positive_only:
        rows = rows.where("contribution > 0")
    # equal contributions of float sums are ordered by item
    rows = rows.withColumn("rank", F.row_number().over(w.orderBy(F.round("contribution", 12).desc(), "item")))
    if top_n is not None:
        rows = rows.where(F.col("rank") <= top_n)
    return rows.select("slot", "period_1", "period_2", "rank", "item", direction(pa, pb).alias("direction"), "contribution", "dist")
