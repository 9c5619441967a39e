import numpy as np
import pytest
from pyspark.sql import functions as F
from shiftscope.llm import mixing as mx


def projected(n, p, goal, least=0.0, steps=4000):
    """Plain projected gradient in the unscaled problem's metric, to convergence."""
    r = np.full(len(n), max(1.0, least))
    size = n @ p
    for _ in range(steps):
        r = np.maximum(least, r - p @ (((n * r) @ p - goal) / size))
    return r


@pytest.mark.parametrize(("least", "total"), [(0.0, 1.0), (0.0, 0.2), (1.0, "cover")])
def test_solver_matches_brute_force(spark, least, total):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3, 0.5, 0.4], 400)
    n = rng.integers(0, 900, 400).astype(float)
    df = spark.createDataFrame([(float(a), b.tolist()) for a, b in zip(n, p)], "n double, p array<double>")
    want = {"a": 0.6, "b": 0.3, "c": 0.1}
    got = mx.solve(df, ["a", "b", "c"], want, total, least)
    goal = np.array([got.target[k] for k in "abc"])
    if total == "cover":
        assert (goal >= n @ p - 1e-6).all()
    else:
        assert np.allclose(goal, total * n.sum() * np.array([0.6, 0.3, 0.1]))
    rates = np.array([r.x for r in df.select(got.rate(F.col("p")).alias("x")).collect()])
    assert (rates >= least).all()
    loss = lambda r: ((((n * r) @ p - goal) ** 2) / (n @ p)).sum()
    assert loss(rates) <= loss(projected(n, p, goal, least)) + 1e-3 * (goal**2 / (n @ p)).sum()
    if total == 1.0:
        assert np.allclose((n * rates) @ p, goal, atol=2e-4 * n.sum())


@pytest.mark.filterwarnings("error::UserWarning")
def test_weak_posteriors_reach_their_targets(spark):
    rng = np.random.default_rng(11)
    p = rng.dirichlet([14.0, 14.0, 14.0], 3000)
    n = rng.integers(1, 900, 3000).astype(float)
    df = spark.createDataFrame([(float(a), b.tolist()) for a, b in zip(n, p)], "n double, p array<double>").cache()
    share = np.array([0.55, 0.27, 0.18])
    got = mx.solve(df, ["a", "b", "c"], dict(zip("abc", share)))
    rates = np.array([r.x for r in df.select(got.rate(F.col("p")).alias("x")).collect()])
    assert (rates >= 0).all()
    assert np.abs((n * rates) @ p / n.sum() - share).max() <= mx.CLOSE
    assert max(map(abs, got.missed.values())) <= mx.CLOSE * n.sum()


def test_targets_out_of_reach_are_told(spark):
    p, n = [[0.7, 0.3], [0.4, 0.6], [0.5, 0.5]], [10.0, 20.0, 5.0]
    df = spark.createDataFrame(list(zip(n, p)), "n double, p array<double>")
    with pytest.warns(UserWarning, match="misses its targets"):
        got = mx.solve(df, ["a", "b"], {"a": 0.9, "b": 0.1})
    size = np.array(n) @ np.array(p)
    # only the first posterior counts: least squares of one number
    x = (0.7 * 31.5 / size[0] + 0.3 * 3.5 / size[1]) / (0.49 / size[0] + 0.09 / size[1])
    assert np.allclose([got.expected[d] for d in "ab"], [0.7 * x, 0.3 * x], atol=1e-4 * sum(n))
    assert np.allclose([got.missed[d] for d in "ab"], [0.7 * x - 31.5, 0.3 * x - 3.5], atol=1e-4 * sum(n))


def test_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = mx.mix(docs, labels).toPandas()
    assert len(got) == docs.count() and (got.rate >= 0).all()
    assert np.allclose([sum(x.values()) for x in got.posterior], 1)
    total = got.n_tokens.sum()
    for k in mx.fit(docs, labels).domains:
        expected = sum(r.rate * r.n_tokens * r.posterior[k] for r in got.itertuples())
        assert abs(expected / total - mx.TARGETS.get(k, 0.0)) < 0.005, (k, expected / total)
    assert (got.copies - got.rate).abs().max() < 1
    held = got.merge(labels.toPandas(), on="doc_id")
    right = held.domain == "quality=" + held.quality.astype(str) + ",toxic=" + held.toxic.astype(str)
    assert right.mean() > 0.85
    again = mx.resample(docs, labels)
    assert again.columns == docs.columns
    assert again.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict() == {r.doc_id: r.copies for r in got.itertuples() if r.copies}
    assert mx.resample(docs, labels, total="cover", least=1.0).select("doc_id").distinct().count() == len(got)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "k"), (1, "a b", "k"), (None, "", None)], "doc_id long, text string, n string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = mx.mix(docs, none, total=2.0).collect()
    assert sorted((r.n_tokens, r.domain, round(r.rate, 6)) for r in rows) == [(0, "all", 2.0), (0, "all", 2.0), (2, "all", 2.0)]
    assert mx.mix(docs.limit(0), none).count() == 0
    assert mx.resample(docs, none, total=2.0).count() == 6
    some = spark.createDataFrame([(1, 1, None), (1, 1, 0), (None, 0, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.domain for r in mx.mix(docs, some).collect()} == {"all"}
