import pytest
from pyspark.sql import functions as F

from shiftscope.operators import distance, signif

#: Counts of relation types around one adjective in six periods (fixed values).
PERIODS = {
    "1995-2000": {"pa_amod": 42, "chi_conj": 5, "pa_advmod": 3, "chi_punct": 3, "chi_cc": 1, "pa_conj": 1, "chi_case": 1, "chi_det": 1, "pa_obl": 1},
    "2001-2005": {"pa_amod": 27, "chi_punct": 2, "chi_cc": 2, "pa_conj": 2, "pa_advmod": 1, "chi_advmod": 1},
    "2006-2010": {"pa_amod": 102, "pa_advmod": 6, "chi_cc": 3, "pa_conj": 2, "chi_conj": 2, "chi_advcl": 1},
    "2011-2015": {"pa_amod": 134, "pa_advmod": 25, "chi_punct": 20, "chi_conj": 6, "chi_advmod": 6, "chi_nsubj": 5, "chi_cop": 5, "pa_conj": 3, "chi_obl": 2, "chi_cc": 2, "pa_parataxis": 2, "chi_appos": 1, "chi_parataxis": 1, "chi_advcl": 1, "pa_appos": 1},
    "2016-2020": {"pa_amod": 134, "pa_advmod": 128, "chi_advmod": 9, "chi_punct": 6, "pa_conj": 5, "chi_conj": 5, "chi_cc": 3, "chi_case": 2, "chi_det": 2, "pa_obl": 1, "pa_nmod": 1},
    "2021-2025": {"pa_advmod": 340, "pa_amod": 212, "chi_advmod": 17, "chi_punct": 14, "chi_conj": 14, "pa_conj": 9, "chi_cc": 7, "chi_obl": 5, "chi_det": 4, "chi_nsubj": 3, "chi_cop": 2, "pa_acl": 1, "chi_acl": 1, "pa_nmod": 1, "chi_case": 1, "pa_advcl": 1},
}
#: Stored results for them (fixed values): weighted distance (k = 100), permutations kept of 1,000 with seed 42, p-value.
STORED = [
    (0.05637931034482758, 598, 0.5175292153589316),
    (0.054913793103448266, 241, 0.08264462809917356),
    (0.27682887528198513, 368, 0.0027100271002710027),
    (0.34191083606971456, 389, 0.002564102564102564),
    (0.13419432090318165, 345, 0.008670520231213872),
]


@pytest.fixture(scope="module")
def types(spark):
    rows, n = [], 0
    for p, counts in PERIODS.items():
        for item, k in counts.items():
            for _ in range(k):
                rows.append((p, "type", item, n))
                n += 1
    return spark.createDataFrame(rows, "period string, slot string, item string, ix long")


def test_reference_null_replays_stored_results(types):
    got = signif.permutation_test(types, "tvd", list(PERIODS), 1000, k=100, null="reference", order_col="ix").orderBy("period_1").collect()
    for r, (observed, n, p) in zip(got, STORED, strict=True):
        assert r.observed == pytest.approx(observed, abs=1e-12)
        assert r.n_permutations == n
        assert r.p_value == pytest.approx(p, abs=1e-12)


def test_full_null_keeps_all(types):
    got = signif.permutation_test(types, "tvd", list(PERIODS), 300, k=100).orderBy("period_1").collect()
    assert [r.n_permutations for r in got] == [300] * 5
    for r, (observed, _, p) in zip(got, STORED):
        assert r.observed == pytest.approx(observed, abs=1e-12)
        assert abs(r.p_value - p) < 0.08


def test_by_correction(spark):
    p = [0.001, 0.01, 0.02, 0.04, 0.5, None]
    df = spark.createDataFrame([("s", str(i), str(i + 1), x) for i, x in enumerate(p)], "slot string, period_1 string, period_2 string, p_value double")
    got = {r.p_value: r for r in signif.fdr(df).collect()}
    h = sum(1 / i for i in range(1, 6))
    want, low = {}, 1.0
    for rank in range(5, 0, -1):
        low = min(low, p[rank - 1] * 5 * h / rank)
        want[p[rank - 1]] = low
    assert {k: r.q_value for k, r in got.items() if k is not None} == pytest.approx(want)
    assert got[None].q_value is None and not got[None].significant_fdr
    total = signif.fdr_summary(signif.fdr(df)).first()
    assert (total.total, total.raw_significant, total.fdr_significant) == (6, 4, 1 + (want[0.01] <= 0.05))


def test_shuffle_keeps_margins(types):
    df = types.withColumn("id", types.ix)
    got = signif.shuffled_periods(df.select("id", "period", "slot", "item"))
    count = lambda f, c: sorted((r[0], r[1]) for r in f.groupBy(c).count().collect())
    assert count(got, "period") == count(df, "period") and count(got, "item") == count(df, "item")


def test_nan_and_null_p_values_take_no_part(spark):
    rows = [("s", "a", "b", 0.01), ("s", "b", "c", 0.02), ("s", "c", "d", float("nan")), ("s", "d", "e", None)]
    out = {r.period_1: r for r in signif.fdr(spark.createDataFrame(rows, "slot string, period_1 string, period_2 string, p_value double")).collect()}
    assert [round(out[p].q_value, 9) for p in "ab"] == [0.03, 0.03]
    assert out["c"].q_value is None and out["d"].q_value is None and not out["c"].significant_raw and not out["c"].significant_fdr


def test_permutations_join_by_period_alone(spark):
    obs = spark.createDataFrame([("s", p, i) for p in "abc" for i in "xyz" * 4], "slot string, period string, item string")
    for null in ("full", "reference"):
        plan = signif.permutation_test(obs, n_permutations=3, null=null)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_a_test_for_a_distance_table(spark):
    obs = spark.createDataFrame([("s", p, i) for p, items in (("a", "xxy"), ("b", "xyy"), ("c", "yyz")) for i in items], "slot string, period string, item string")
    tests = signif.permutation_test(obs, n_permutations=5)
    dist = distance.distances(obs).where("period_1 = 'a'")
    assert [r.period_1 for r in signif.for_transitions(dist, tests).collect()] == ["a"]
    with pytest.raises(ValueError):
        signif.keyed(dist.drop("dist"))
    with pytest.raises(Exception, match="not that of these observations"):
        signif.for_transitions(dist.withColumn("dist", F.lit(0.9)), tests).collect()
