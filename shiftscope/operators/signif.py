"""Permutation tests of consecutive distances, and correction for many tests.

The null model shuffles period labels within a slot, so both margins stay.  Seeds are drawn
on the driver pair by pair from one generator, and permutations run in parallel by pair and
chunk of seeds.  ``null="reference"`` keeps only permutations in which the slot's first row
falls into the earlier period, ``null="full"`` keeps all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftscope.functions.measures import measure
from shiftscope.operators.distance import check_arguments, period_order

RESULT = (
    "slot string, period_1 string, period_2 string, measure string, observed double, n_permutations long, p_value double, "
    "null_mean double, null_sd double, null_q95 double, null_q99 double, excess double"
)


def fdr(tests: DataFrame, alpha: float = 0.05, by: str = "slot", p_col: str = "p_value") -> DataFrame:
    """Adds q_value and significant_fdr (Benjamini and Yekutieli) and significant_raw within each slot; null and NaN p-values take no part."""
    out_ = F.col(p_col).isNull() | F.isnan(F.col(p_col).cast("double"))
    w = Window.partitionBy(by, out_).orderBy(p_col)
    group = Window.partitionBy(by, out_)
    rank = F.row_number().over(w)
    m = F.count(F.lit(1)).over(group)
    ranked = tests.withColumn("_r", rank).withColumn("_m", m)
    # sums of reciprocals once for each group size
    harmonic = F.aggregate(F.sequence(F.lit(1), F.col("_m").cast("int")), F.lit(0.0), lambda a, i: a + 1 / i)
    sizes = ranked.select("_m").distinct().withColumn("_h", harmonic)
    ranked = ranked.join(sizes, "_m").withColumn("_u", F.col(p_col) * F.col("_m") * F.col("_h") / F.col("_r"))
    back = Window.partitionBy(by, out_).orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    q = F.when(~out_, F.least(F.lit(1.0), F.min("_u").over(back)))
    out = ranked.withColumn("q_value", q).drop("_r", "_m", "_h", "_u")
    return out.withColumn("significant_raw", F.coalesce(~out_ & (F.col(p_col) <= alpha), F.lit(False))).withColumn("significant_fdr", F.coalesce(F.col("q_value") <= alpha, F.lit(False)))


def fdr_summary(corrected: DataFrame, by: str = "slot") -> DataFrame:
    """Counts and shares per slot, and the transitions that the correction took away."""
    label = F.concat_ws(" vs ", "period_1", "period_2")
    lost = F.col("significant_raw") & ~F.col("significant_fdr")
    n = F.count(F.lit(1))
    raw, kept, gone = F.count_if("significant_raw"), F.count_if("significant_fdr"), F.count_if(lost)
    return corrected.groupBy(by).agg(
        n.alias("total"), raw.alias("raw_significant"), kept.alias("fdr_significant"), gone.alias("lost"),
        (100 * raw / n).alias("raw_percent"), (100 * kept / n).alias("fdr_percent"),
        F.array_join(F.sort_array(F.collect_list(F.when(lost, label))), "; ").alias("lost_transitions"),
    )


def _score(name: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of count rows a and b (permutations by items)."""
    pa, pb = a / a.sum(axis=1, keepdims=True), b / b.sum(axis=1, keepdims=True)
    if name == "tvd":
        return 0.5 * np.abs(pa - pb).sum(axis=1)
    if name == "cosine":
        return 1 - (pa * pb).sum(axis=1) / np.sqrt((pa**2).sum(axis=1) * (pb**2).sum(axis=1))
    if name == "jsd":
        m = (pa + pb) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(pa > 0, pa * np.log2(pa / m), 0) + np.where(pb > 0, pb * np.log2(pb / m), 0)
        return np.maximum(0.5 * t.sum(axis=1), 0)
    raise ValueError(f"no permutation kernel for {name}")


def permutation_test(obs: DataFrame, which: str = "tvd", periods=None, n_permutations: int = 1000, k: float | None = None, min_freq: int = 1, seed: int = 42, chunk: int = 100, null: str = "full", order_col: str | None = None) -> DataFrame:
    """One row per slot and transition with the p-value of the observed distance.

    The support weight is the same in every permutation, so it scales the observed and the
    null values alike.  Rows of a slot are shuffled in the order of ``order_col`` (else item).
    A pair's occurrences meet in one task for each chunk of seeds in the reference null; the
    full null draws counts from the multivariate hypergeometric law and moves counts only.
    """
    check_arguments(min_freq, k or 1)
    if null not in ("full", "reference"):
        raise ValueError("null must be 'full' or 'reference'")
    if n_permutations < 1 or chunk < 1:
        raise ValueError("n_permutations and chunk must be positive")
    m = measure(which)
    names = [r.period for r in period_order(obs, periods).orderBy("ord").collect()]  # the periods dimension
    have = {r.period for r in obs.select(F.col("period").cast("string").alias("period")).distinct().collect()}
    rng = np.random.default_rng(seed)
    jobs = []
    for a, b in zip(names[:-1], names[1:]):
        if a in have and b in have:  # a pair without data takes no seeds
            seeds = rng.integers(low=0, high=2**32 - 1, size=n_permutations, dtype=np.uint32)
            jobs += [(a, b, i, [int(s) for s in seeds[i : i + chunk]]) for i in range(0, n_permutations, chunk)]
    spark = obs.sparkSession
    seeds_df = spark.createDataFrame(jobs, "period_1 string, period_2 string, chunk int, seeds array<long>")
    pairs = seeds_df.select("period_1", "period_2").distinct()
    place = F.explode(F.array(F.struct(F.col("period_1").alias("period"), F.lit(True).alias("first")), F.struct(F.col("period_2").alias("period"), F.lit(False).alias("first")))).alias("x")
    sides = pairs.select("period_1", "period_2", place).select("period_1", "period_2", "x.period", "x.first")  # two rows a pair of periods
    own = obs.select(F.col("slot").cast("string").alias("slot"), F.col("period").cast("string").alias("period"), F.col("item").cast("string").alias("item"), (F.col(order_col) if order_col else F.lit(0)).cast("long").alias("ix"))
    if null == "full":  # counts first: occurrences are never repeated by pair
        counts = own.groupBy("slot", "period", "item").agg(F.count("*").alias("n"))
        sided = counts.join(F.broadcast(sides), "period")
        rows = sided.groupBy("slot", "period_1", "period_2", "item").agg(F.sum(F.when(F.col("first"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("first"), 0).otherwise(F.col("n"))).alias("b")).where(F.col("a") + F.col("b") >= min_freq)
        keys = ["slot", "period_1", "period_2", "chunk"]
        schema = "slot string, period_1 string, period_2 string, observed double, support double, value double"
    else:
        sided = own.join(F.broadcast(sides), "period")
        w = Window.partitionBy("slot", "period_1", "period_2", "item")
        rows = sided.withColumn("mixed", F.count(F.lit(1)).over(w)).where(F.col("mixed") >= min_freq).select("slot", "period_1", "period_2", "period", "item", "ix")
        keys = ["period_1", "period_2", "chunk"]
        schema = "slot string, period_1 string, period_2 string, observed double, support double, value double"
    name = m.name

    def full(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("item")
        a, b = frame["a"].to_numpy(np.int64), frame["b"].to_numpy(np.int64)
        n1, n2 = int(a.sum()), int(b.sum())
        empty = pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        if not n1 or not n2:
            return empty
        values = []
        for s in frame["seeds"].iloc[0]:
            draw = np.random.default_rng([int(s), abs(hash_text(key[0]))]).multivariate_hypergeometric(a + b, n1, method="marginals")
            values.append(_score(name, draw[None, :].astype(float), (a + b - draw)[None, :].astype(float))[0])
        seen = _score(name, a[None, :].astype(float), b[None, :].astype(float))[0]
        return pd.DataFrame({"slot": key[0], "period_1": key[1], "period_2": key[2], "observed": seen, "support": float(min(n1, n2)), "value": values})

    def shuffled(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        frame = frame.sort_values(["slot", "ix", "item"], kind="stable")
        groups = [(slot, g["item"].astype("category").cat.codes.to_numpy(), (g["period"] == key[0]).to_numpy()) for slot, g in frame.groupby("slot", sort=True)]
        for s in frame["seeds"].iloc[0]:
            rng = np.random.default_rng(np.uint32(s))
            for slot, item, first in groups:
                labels = np.where(first, key[0], key[1]).astype(object)
                rng.shuffle(labels)
                now = labels == key[0]
                n_items = int(item.max()) + 1
                if not first.any() or first.all():
                    continue
                count = lambda mask: np.bincount(item[mask], minlength=n_items)[None, :].astype(float)
                value = _score(name, count(now), count(~now))[0] if now[0] else np.nan
                out.append((slot, key[0], key[1], _score(name, count(first), count(~first))[0], float(min(first.sum(), (~first).sum())), value))
        return pd.DataFrame(out, columns=["slot", "period_1", "period_2", "observed", "support", "value"])

    met = rows.join(F.broadcast(seeds_df), ["period_1", "period_2"])  # n_permutations numbers a pair of periods
    draws = met.groupBy(*keys).applyInPandas(full if null == "full" else shuffled, schema)
    weight = F.least(F.lit(1.0), F.col("support") / F.lit(float(k))) if k else F.lit(1.0)
    draws = draws.withColumn("observed", F.col("observed") * weight).withColumn("value", F.col("value") * weight).where(~F.isnan("value") | F.col("value").isNull())
    n = F.count("value")
    out = draws.groupBy("slot", "period_1", "period_2").agg(
        F.first("observed").alias("observed"), n.alias("n_permutations"), ((1 + F.count_if(F.col("value") >= F.col("observed"))) / (n + 1)).alias("p_value"),
        F.avg("value").alias("null_mean"), F.stddev_samp("value").alias("null_sd"), F.percentile("value", 0.95).alias("null_q95"), F.percentile("value", 0.99).alias("null_q99"),
    )
    out = out.withColumn("excess", F.col("observed") - F.col("null_mean"))
    return out.select("slot", "period_1", "period_2", F.lit(name).alias("measure"), "observed", "n_permutations", "p_value", "null_mean", "null_sd", "null_q95", "null_q99", "excess")


def hash_text(text: str | None) -> int:
    import zlib

    return zlib.crc32((text or "").encode())


def empty_result(spark) -> DataFrame:
    return spark.createDataFrame([], RESULT)


def exploded(obs: DataFrame) -> DataFrame:
    """One row for each occurrence of weighted observations."""
    return obs.withColumn("_n", F.explode(F.expr("sequence(1, cast(weight as int))"))).drop("_n", "weight")


def shuffled_periods(obs: DataFrame, seed: int = 42) -> DataFrame:
    """Period labels dealt anew within each slot; margins stay."""
    w = Window.partitionBy("slot")
    marked = obs.withColumn("_a", F.row_number().over(w.orderBy("id", "item"))).withColumn("_b", F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), "slot", "id", "item"), "id")))
    labels = marked.select("slot", F.col("_b").alias("_a"), "period")
    return marked.drop("period", "_b").join(labels, ["slot", "_a"]).drop("_a")


def keyed(dist: DataFrame, value: str = "dist") -> DataFrame:
    """(slot, period_1, period_2, observed) of a distance table; a missing column is an error."""
    missing = {"slot", "period_1", "period_2", value} - set(dist.columns)
    if missing:
        raise ValueError(f"the distance table lacks {sorted(missing)}")
    return dist.select("slot", "period_1", "period_2", F.col(value).cast("double").alias("observed"))


def for_transitions(dist: DataFrame, tests: DataFrame, value: str = "dist") -> DataFrame:
    """The rows of a permutation test for the transitions of a distance table, whose values must be the observed ones."""
    own = keyed(dist, value).withColumnRenamed("observed", "_given")
    met = tests.join(own, ["slot", "period_1", "period_2"])
    off = F.abs(F.col("observed") - F.col("_given")) > 1e-9
    checked = F.when(off, F.raise_error(F.lit("the distance table is not that of these observations")).cast("double")).otherwise(F.col("observed"))
    return met.withColumn("observed", checked).drop("_given")
