"""Connected components of a links table by alternating large and small stars.

Each step replaces links by links to the smallest neighbour (Kiveris et al. 2014); the
number of links never grows, nothing is gathered on the driver but a count and a
checksum, and each step is written to the shared folder.  Null ends and loops are
ignored, repeated links count once, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftscope.llm.common import durable


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; a component is its smallest node."""
    own = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = durable(own.distinct())
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        edges = durable(large)
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = durable(small.filter("u != v").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == (now.n, now.s):
            break
        mark = (now.n, now.s)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
