import math

import pytest
from pyspark.sql import functions as F

from shiftscope.functions import measures
from shiftscope.operators import distance as ds


@pytest.fixture(scope="module")
def tiny(spark):
    rows = [("1", "s", "x"), ("1", "s", "x"), ("1", "s", "y"), ("1", "s", "y"), ("2", "s", "x"), ("2", "s", "x"), ("2", "s", "x"), ("2", "s", "x"), ("3", "s", "z"), ("1", "t", "q"), ("3", "t", "q")]
    return spark.createDataFrame(rows, "period string, slot string, item string")


def found(df, value="dist"):
    return {(r.slot, r.period_1, r.period_2): r[value] for r in df.collect()}


def test_analytic_cases(tiny):
    assert found(ds.distances(tiny, ("tvd",))) == {("s", "1", "2"): 0.5, ("s", "2", "3"): 1.0}
    assert found(ds.distances(tiny, ("cosine",)))[("s", "1", "2")] == pytest.approx(1 - 1 / math.sqrt(2))
    assert found(ds.distances(tiny, ("JSD",)))[("s", "2", "3")] == pytest.approx(1.0)
    assert found(ds.distances(tiny, ("tvd",), mode="data_only"))[("t", "1", "3")] == 0.0


def test_period_order_and_weights(tiny):
    assert set(found(ds.distances(tiny, ("tvd",), periods=["3", "2", "1"]))) == {("s", "3", "2"), ("s", "2", "1")}
    counts = tiny.groupBy("period", "slot", "item").agg(F.count("*").alias("weight"))
    assert found(ds.distances(counts, ("jsd",))) == pytest.approx(found(ds.distances(tiny, ("jsd",))))


def test_min_freq_is_on_the_pair(spark):
    df = spark.createDataFrame([("1", "s", "a"), ("2", "s", "a"), ("1", "s", "b"), ("2", "s", "c"), ("2", "s", "c")], "period string, slot string, item string")
    assert found(ds.distances(df, ("tvd",), min_freq=2))[("s", "1", "2")] == pytest.approx(2 / 3)


def test_support_and_errors(tiny):
    assert found(ds.support(tiny, k=8), "support_weight") == {("s", "1", "2"): 0.5, ("s", "2", "3"): 0.125}
    zero = found(ds.support(tiny, k=8, include_zero_slots=True), "support_count")
    assert zero[("t", "1", "2")] == 0.0 and len(zero) == 4
    for bad in ({"min_freq": 0}, {"mode": "x"}):
        with pytest.raises(ValueError):
            ds.distances(tiny, ("tvd",), **bad)
    with pytest.raises(ValueError, match="jsd"):
        measures.measure("none")
    with pytest.raises(Exception, match="exactly one"):
        ds.multiply_by_support(ds.distances(tiny, ("tvd",)), ds.support(tiny).limit(1)).collect()


@pytest.mark.parametrize("name", ["tvd", "jsd", "cosine"])
def test_contributions_sum_to_the_distance(spark, name):
    rows = [(str(p), "s", f"w{(p * 7 + i * i) % (9 + p)}") for p in (1, 2, 3) for i in range(200)]
    df = spark.createDataFrame(rows, "period string, slot string, item string")
    whole = ds.contributions(df, name, None, positive_only=False).groupBy("slot", "period_1", "period_2").agg(F.sum("contribution").alias("total"), F.first("dist").alias("dist"))
    want = found(ds.distances(df, (name,)))
    for r in whole.collect():
        assert r.total == pytest.approx(want[(r.slot, r.period_1, r.period_2)]) == pytest.approx(r.dist)
    top = ds.contributions(df, name, 3).collect()
    assert all(r.contribution > 0 for r in top) and max(r["rank"] for r in top) == 3
    assert {r.direction for r in top} <= {"bo", "lo", "", "in", "de"}


def test_matrix_is_symmetric(tiny):
    m = found(ds.period_matrix(tiny), "value")
    assert all(m[(s, b, a)] == v for (s, a, b), v in m.items()) and m[("s", "1", "1")] == 0


def test_counted_observations_stand_for_all(spark):
    """Weighted rows give the distances of the rows they count; a period without an item is a period still."""
    obs = spark.createDataFrame([("a", "s", x) for x in "xxyz"] + [("b", "s", None), ("b", "t", "x"), (None, "s", "x")] + [("c", "s", x) for x in "xyy"] + [("d", "s", x) for x in "zz"], "period string, slot string, item string")
    own = ds.counted(obs)
    assert own.count() == 9 and ds.counted(own).count() == 9
    for mode in ("all", "data_only"):
        want, got = (sorted((*r[:4], round(r.dist, 12)) for r in ds.distances(f, ("tvd", "jsd"), mode=mode).collect()) for f in (obs, own))
        assert got == want and want
