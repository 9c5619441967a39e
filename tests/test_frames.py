import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftscope.operators import distance, frames
from shiftscope.sources import vectors


def test_frames(spark):
    rows = [(str(p), "s", f"w{(p * i) % (3 + p)}") for p in (1, 2, 3) for i in range(30)]
    obs = spark.createDataFrame(rows, "period string, slot string, item string")
    counts = obs.groupBy("period", F.col("item").alias("slot")).agg(F.count("*").alias("count"))
    top = frames.bars(counts, 2).collect()
    assert len(top) == 2 and top[0]["count"] >= top[1]["count"]
    order = distance.period_order(obs)
    tests = spark.createDataFrame([("s", "1", "2", 0.01)], "slot string, period_1 string, period_2 string, p_value double")
    line = frames.lines(distance.distances(obs, ("tvd",)), order, tests).collect()
    assert [(r.transition, r.p_value) for r in line] == [("1 vs 2", 0.01), ("2 vs 3", None)]
    heat = frames.heat_map(distance.period_matrix(obs), ["1", "2", "3"]).collect()
    assert [r["1"] == 0 for r in heat] == [True, False, False]
    moved = distance.contributions(obs, "tvd", 2)
    assert [x.rank for x in frames.grid(moved).orderBy("transition").first()["items"]] == [1, 2]
    assert frames.dropdown(moved).count() == 2
    sized = frames.scatter(spark.createDataFrame([("p", 1), ("p", 3), ("q", 5)], "period string, count long")).collect()
    assert sorted(r.size for r in sized) == [6.0, 15.0, 24.0]


def test_series_and_training_files(spark, tmp_path):
    rows = np.ones((2, 3), np.float32)
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "1.bin").write_bytes(vectors.encode_binary(["a", "b"], rows))
    (tmp_path / "m" / "2.txt").write_text("a 1 2 3\nc 1 2 3\n")
    got = vectors.read_series(spark, str(tmp_path / "m"), ["1", "2"])
    assert sorted((r.period, r.word) for r in got.collect()) == [("1", "a"), ("1", "b"), ("2", "a"), ("2", "c")]
    with pytest.raises(FileNotFoundError):
        vectors.read_series(spark, str(tmp_path / "m"), ["3"])
    for p in ("1", "2"):
        (tmp_path / "t" / p).mkdir(parents=True)
        (tmp_path / "t" / p / "a.txt").write_text(" A  b\n\nc\n")
    assert sorted(r.line for r in vectors.training_lines(spark, str(tmp_path / "t"), True).where("period = '1'").collect()) == ["a b", "c"]
    (tmp_path / "t" / "1" / "b.txt").write_text("x")
    with pytest.raises(ValueError, match="one is needed"):
        vectors.training_lines(spark, str(tmp_path / "t"))
