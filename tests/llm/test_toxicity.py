import itertools
import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from shiftscope.llm import toxicity as tx


def test_segments_match_definition():
    """Ruzzo and Tompa: the segments are found by taking the best run and going on left and right of it."""

    def define(score, at=0):
        best = max(((sum(score[i:j]), i - j, -i, i, j) for i in range(len(score)) for j in range(i + 1, len(score) + 1)), default=None)
        if best is None or best[0] <= 1e-12:
            return []
        _, _, _, i, j = max((b for b in ((sum(score[i:j]), j - i, -i, i, j) for i in range(len(score)) for j in range(i + 1, len(score) + 1)) if abs(b[0] - best[0]) < 1e-12), key=lambda b: (-b[1], b[2]))
        return define(score[:i], at) + [(at + i, at + j - 1)] + define(score[j:], at + j)

    rng = random.Random(3)
    for _ in range(200):
        score = [rng.choice([-3, -2, -1, 1, 2, 4]) + rng.random() * 0.1 for _ in range(rng.randint(0, 14))]
        got = tx.maximal_segments(np.array(score))
        assert [(a, b) for a, b, _ in got] == define(score)
        assert all(abs(s - sum(score[a : b + 1])) < 1e-9 for a, b, s in got)


def test_best_segment():
    rng = np.random.default_rng(1)
    rows = [rng.normal(-0.3, 1, n) for n in (0, 5, 1, 0, 40, 300)]
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    want = [max([0.0, *(r[i:j].sum() for i, j in itertools.combinations(range(len(r) + 1), 2))]) if len(r) <= 40 else None for r in rows]
    got = tx.best_segment(np.concatenate(rows), first)
    assert all(w is None or abs(g - w) < 1e-9 for g, w in zip(got, want))


def test_equal_rows_side_by_side_score_alike():
    part = pa.RecordBatch.from_pydict({"text": ["", "bad", "bad", "", "ok bad", "bad bad", ""]})
    keys, which, first = tx.tokens(part)
    word = tx.tokens(pa.RecordBatch.from_pydict({"text": ["bad"]}))[0][0]
    model = tx.Model(word, np.array([5.0]), np.array([4.0]))
    assert (tx.token_scores(model, keys, which, first) + tx.DRIFT).tolist() == [5.0, 5.0, 0.0, 5.0, 5.0, 0.0]


def test_scores_do_not_depend_on_order_or_batches(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = tx.fit(docs, labels)
    again = tx.fit(docs.repartition(5).orderBy(F.desc("doc_id")), labels.repartition(3))
    assert (model.lam, model.k, model.weights) == (again.lam, again.k, again.weights)
    want = {r.doc_id: (r.score, r.best, r.segments) for r in tx.score(docs, model).collect()}
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = {r.doc_id: (r.score, r.best, r.segments) for r in tx.score(docs.repartition(7, F.xxhash64("doc_id")).sortWithinPartitions(F.desc("text")), model).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert got == want


def test_segments_of_a_very_long_text_take_linear_time():
    rng = np.random.default_rng(5)
    for drift in (-0.05, -0.5, -2.0):
        score = rng.normal(drift, 1, 1_000_000)
        began = time.perf_counter()
        found = tx.maximal_segments(score)
        assert time.perf_counter() - began < 10
        assert all(b < c for (_, b, _), (c, _, _) in zip(found, found[1:]))


def test_every_significant_token_is_kept(spark):
    n = 120_000
    counts = spark.range(n).select(F.col("id").alias("h"), F.when(F.col("id") % 2 == 0, 200).otherwise(20).cast("long").alias("toxic"), F.when(F.col("id") % 2 == 0, 20).otherwise(200).cast("long").alias("clean"))
    assert tx.log_odds(counts).count() == n


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = tx.fit(docs, labels)
    out = tx.score(docs, model)
    assert out.count() == docs.count()
    held = out.where("held_out").join(labels, "doc_id").toPandas()
    assert (held.predicted == held.toxic).mean() > 0.95
    assert held.score.between(0, 1).all() and ((held.score >= 0.5) == (held.predicted == 1)).all()
    want = docs.select(((F.crc32(F.col("doc_id").cast("string")) % 5) == 0).alias("h")).where("h").count()
    assert out.where("held_out").count() == want


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = tx.fit(docs, labels), tx.fit(docs, other)
    assert a.weights == b.weights and (a.hashes == b.hashes).all() and (a.scores == b.scores).all()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (None, "a b", 0.0), (2, "z" * 100_000, 0.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = tx.fit(docs, none)
    rows = tx.score(docs, model).collect()
    assert len(rows) == 4 and all(r.predicted == 0 and r.score < 1e-6 for r in rows)
    assert tx.score(docs.limit(0), model).count() == 0
    kept = tx.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == 4
