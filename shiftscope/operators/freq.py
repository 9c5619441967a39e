"""Frequencies of slots and fillers by period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def slot_counts(obs: DataFrame, by: str = "slot") -> DataFrame:
    """(period, slot, count)."""
    weight = F.sum("weight") if "weight" in obs.columns else F.count(F.lit(1))
    return obs.groupBy("period", F.col(by).alias("slot")).agg(weight.cast("long").alias("count"))


def dense(counts: DataFrame) -> DataFrame:
    """Every (period, slot) cell, zeros where nothing was counted."""
    grid = counts.select("period").distinct().join(counts.select("slot").distinct(), F.lit(True))  # cells of a report table
    return grid.join(counts, ["period", "slot"], "left").select("period", "slot", F.coalesce("count", F.lit(0)).alias("count"))


def wide(counts: DataFrame, slots: list[str] | None = None) -> DataFrame:
    """A row a period, a column a slot, zeros filled."""
    return counts.groupBy("period").pivot("slot", slots).agg(F.sum("count")).fillna(0)


def melt(frame: DataFrame, value: str = "count") -> DataFrame:
    """The wide form back to rows (period, slot, value)."""
    return frame.unpivot("period", [c for c in frame.columns if c != "period"], "slot", value)


def relative(counts: DataFrame) -> DataFrame:
    """Adds the share of the period's total; 0 in an empty period."""
    total = F.sum("count").over(Window.partitionBy("period"))
    return counts.withColumn("share", F.when(total > 0, F.col("count") / total).otherwise(0.0))


def normalised(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds count / total of the period from (period, total); names match with _ as -; a missing period is an error."""
    have = totals.select(F.replace(F.col("period"), F.lit("_"), F.lit("-")).alias("key"), F.col("total"))
    met = counts.withColumn("key", F.replace(F.col("period"), F.lit("_"), F.lit("-"))).join(have, "key", "left")
    total = F.when(F.col("total").isNull(), F.raise_error(F.concat(F.lit("no token count for period "), F.col("period"))).cast("long")).otherwise(F.col("total"))
    return met.select("period", "slot", "count", (F.col("count") / total).alias("per_token"))


def top_union(counts: DataFrame, n: int, show: str = "raw", totals: DataFrame | None = None) -> DataFrame:
    """Dense counts of the slots that are among a period's n most frequent (ties by name) in any period.

    ``show``: "raw"; "relative" adds the share of the period's total within the union, 0 in an
    empty period; "normalised" adds the count by the period's token total in ``totals``.
    """
    if show not in ("raw", "relative", "normalised"):
        raise ValueError("show must be 'raw', 'relative' or 'normalised'")
    if show == "normalised" and totals is None:
        raise ValueError("normalised counts need the periods' totals")
    cells = dense(counts)
    rank = F.row_number().over(Window.partitionBy("period").orderBy(F.desc("count"), "slot"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= n).select("slot").distinct()
    out = cells.join(top, "slot", "left_semi").select("period", "slot", "count")
    return out if show == "raw" else relative(out) if show == "relative" else normalised(out, totals)


def top_fillers(obs: DataFrame, n: int) -> DataFrame:
    """(period, item, count, norm_count) of the fillers among any period's top n; norm_count divides by the ids that have one."""
    count = obs.groupBy("period", "item").agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy("period").orderBy(F.desc("count"), "item"))
    top = count.withColumn("rank", rank).where(F.col("rank") <= n).select("item").distinct()
    ids = obs.join(top, "item", "left_semi").groupBy("period").agg(F.count_distinct("id").alias("ids"))
    return count.join(top, "item", "left_semi").join(ids, "period").select("period", "item", "count", (F.col("count") / F.col("ids")).alias("norm_count"))


def keyword_counts(tokens: DataFrame, lemma: str, pos: str | None = None, match: str = "exact") -> DataFrame:
    """(period, total) of a keyword; ``match="substring"`` also counts lemmas that end in it."""
    if match not in ("exact", "substring"):
        raise ValueError("match must be 'exact' or 'substring'")
    hit = F.col("lemma") == lemma if match == "exact" else F.col("lemma").endswith(lemma)
    if pos is not None:
        hit = hit & (F.col("pos") == pos)
    return tokens.groupBy("period").agg(F.count_if(hit).alias("total"))


def token_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("period").agg(F.count("*").alias("total"))


def filler_counts(obs: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(period, slot, filler, count), ordered by period, falling count, filler."""
    out = obs.groupBy("period", "slot", F.col("item").alias("filler")).agg(F.count("*").alias("count"))
    if order is None:
        return out.orderBy("period", F.desc("count"), "filler")
    return out.join(order, "period").orderBy("ord", F.desc("count"), "filler").drop("ord")


def vocabulary(tokens: DataFrame, fmt: str = "lemma/pos") -> DataFrame:
    """(period, word, count) in one of the filler formats."""
    from shiftscope.functions.text import filler

    return tokens.groupBy("period", filler(fmt).alias("word")).agg(F.count("*").alias("count"))
