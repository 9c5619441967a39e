import random
import time

import numpy as np
from pyspark.sql import functions as F
from shiftscope.llm import ngram_join as nj
from shiftscope.llm.ngram_join import clusters, keep_one
from tests_llm_helpers import components as brute


def check(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).repartition(parts)
    got = clusters(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_generated_groups(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    hot = [rng.choice(vocab) for _ in range(60)]
    rows, n = [], 0
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 40, 150, 400]))]
        for _ in range(rng.choice([1, 2, 5, 60])):
            w = list(base)
            for _ in range(rng.randint(0, max(0, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                w = hot + w
            rows.append((n * 7 % 10007, " ".join(w)))
            n += 1
    rows += [(20000 + i, " ".join(hot + [rng.choice(vocab) for _ in range(rng.randint(0, 16))])) for i in range(150)]
    rng.shuffle(rows)
    check(spark, rows)


def test_long_lists_are_dealt_in_blocks(spark, monkeypatch):
    """Every list is long: all pairs come from pairs of blocks."""
    monkeypatch.setattr(nj, "LONG", 0)
    monkeypatch.setattr(nj, "BLOCK", 16)
    dealt = []
    monkeypatch.setattr(nj, "durable", lambda df, real=nj.durable: (out := real(df), "meets" in df.columns and dealt.append(out.where("data is not null").count()))[0])
    rng = random.Random(8)
    common = [[f"c{k}_{i}" for i in range(40)] for k in range(12)]
    rows = []
    for i in range(420):  # shared blocks in many mixtures: few link, all share frequent shingles
        rows.append((i * 11 % 4201, " ".join(w for k in rng.sample(range(12), rng.randint(4, 7)) for w in common[k])))
    rows += [(9000 + i, rows[i][1] + " tail") for i in range(0, 60, 3)]
    check(spark, rows)
    assert dealt[0] > 50


def test_a_long_list_without_links_takes_bounded_time(spark):
    """Texts of shared passages, none linked: every posting list is long."""
    rng = np.random.default_rng(4)
    passages = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(40)]
    rows = [(i, " ".join(passages[k] for k in rng.choice(40, 5, replace=False))) for i in range(20_000)]
    began = time.perf_counter()
    out = clusters(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    n = out.select("component_id").distinct().count()
    assert n > 1000 and time.perf_counter() - began < 240


def test_equal_batches_come_out_as_often(spark):
    df = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    out = clusters(df.union(df).union(df)).collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in out] == [(1, 3, 1)] * 3


def test_edges(spark):
    check(spark, [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A\tB"), (6, "b a"), (7, "a b c d e"), (8, "A b C d e\n"), (9, "a b c d e f"), (10, "x" * 100000), (11, "X" * 100000)], 2)


def test_real_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in clusters(docs).collect()} == want
    assert any(c != i for i, (_, c) in want.items())


def test_repeats_nulls_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "z"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in clusters(df).collect()) == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1)]
    assert clusters(df.limit(0)).count() == 0


def test_keep_one(spark):
    df = spark.createDataFrame([(3, "a b c d e f", "p"), (1, "a b c d e f", "q"), (2, "x", "r"), (None, "x", "s"), (None, None, "t")], "doc_id long, text string, component_id string")
    out = keep_one(df)
    assert out.columns == df.columns
    assert sorted(r.component_id for r in out.collect()) in (["q", "r", "t"], ["q", "r"])
