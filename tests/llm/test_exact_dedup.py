import hashlib
import re

import pandas as pd
from pyspark.sql import functions as F
from shiftscope.llm import exact_dedup as ed


def brute(rows):
    docs = sorted({(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    group = {}
    for i, t in docs:
        group.setdefault(t, []).append(i)
    return sorted(((i, group[t][0], len(group[t]), i == group[t][0], hashlib.sha256(t.encode()).hexdigest()) for i, t in docs), key=str)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in ed.groups(df).collect()), key=str)


ROWS = [(5, "a b"), (2, "a  b"), (9, "a\n\t b"), (3, "a b "), (4, None), (1, ""), (7, " "), (8, "é"), (8, "é"), (8, "other"), (None, "a b"), (None, "only"), (6, "x" * 300_000), (10, "x" * 300_000)]


def test_groups(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("h", F.lit("clash")).withColumn("maybe", F.lit(1))
    assert got(df.repartition(5)) == brute(ROWS)
    assert got(df.limit(0)) == []


def test_hot_group(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(6000)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)) == brute(rows)


def test_slices_of_the_filter_keep_its_cells_a_row(spark, monkeypatch):
    monkeypatch.setattr(ed, "SLICE_CELLS", 1 << 16)
    monkeypatch.setattr(ed, "SLICES_AT_ONCE", 2)
    rows = [(i, f"text {i % 17_000}") for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert ed.slices_for(len(rows)) == 5
    assert got(df) == brute(rows)
    assert sorted(r.doc_id for r in ed.dedup(df).collect()) == list(range(17_000))
    h = ed._by_slice(df.select(F.xxhash64("text").alias("h")), len(rows))
    assert h.select("slice").distinct().count() == 5
    maybe = ed.Repeats(h, len(rows)).mark(h).filter("maybe").count()
    assert 6000 <= maybe < 6300  # 3,000 texts stand twice; the rest are false positives


def test_full_filter_only_costs_rows(spark, monkeypatch):
    monkeypatch.setattr(ed, "CELLS_PER_ROW", 0)
    rows = [(i, f"text {i % 5000}") for i in range(40_000, 60_000)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_filter_passes_every_repeat(spark):
    df = spark.createDataFrame(pd.DataFrame({"h": [i * 2654435761 for i in range(3000)] + [i * 2654435761 for i in range(0, 3000, 7)]}))
    df = ed._by_slice(df, df.count())
    seen = ed.Repeats(df, df.count()).mark(df).withColumnRenamed("maybe", "m").groupBy("h").agg(F.count("*").alias("n"), F.min("m").alias("m")).collect()
    assert all(r.m for r in seen if r.n > 1)
    assert sum(r.m for r in seen if r.n == 1) < 100


def test_dedup_keeps_columns(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("sha", F.lit("x")).withColumn("maybe", F.col("doc_id"))
    out = ed.dedup(df.repartition(3))
    assert out.columns == df.columns
    assert sorted(((r.doc_id, re.sub(r"\s+", " ", r.text or "")) for r in out.collect()), key=str) == sorted({(i, re.sub(r"\s+", " ", t or "")) for i, t in ROWS if any(b[0] == i and b[3] and b[4] == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() for b in brute(ROWS))}, key=str)
