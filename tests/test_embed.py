import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftscope.operators import cluster, distance, embed, freq


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    centre = np.eye(6)[:3]
    rows = []
    for p in ("a", "b", "c"):
        for i in range(30):
            k = i % 3 if p != "c" or i % 3 < 2 else 5
            v = (centre[k] if k < 3 else np.eye(6)[4]) + rng.normal(0, 0.05, 6)
            rows.append((p, "s", f"w{i:02d}", 1 + i % 7, v.tolist(), k))
    return spark.createDataFrame(rows, "period string, slot string, filler string, count long, vector array<double>, truth int")


def groups(rows, key):
    out = {}
    for r in rows:
        out.setdefault((r.period, r[key]), set()).add(r.filler)
    return {frozenset(v) for v in out.values()}


def test_individual_clusters_find_the_groups(points):
    got = cluster.individual(points, 0.6).collect()
    assert groups(got, "cluster_id") == groups(points.collect(), "truth")
    total = {}
    for r in got:
        total[(r.period, r.cluster_id)] = total.get((r.period, r.cluster_id), 0) + r["count"]
    assert all(total[(p, 0)] >= total[(p, 1)] >= total[(p, 2)] for p in "abc")


def test_average_linkage_matches_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        v = rng.normal(size=(12, 3))
        got = cluster.average_linkage(v, 0.3)
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        d = 1 - u @ u.T
        sets = [[i] for i in range(12)]
        while len(sets) > 1:
            best = min((d[np.ix_(x, y)].mean(), i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j)
            if best[0] >= 0.7:
                break
            sets[best[1]] += sets.pop(best[2])
        assert {frozenset(s) for s in sets} == {frozenset(np.flatnonzero(got == k).tolist()) for k in set(got)}
    assert cluster.average_linkage(np.zeros((1, 2)), 0.5).tolist() == [0]


def test_incremental_events(points, spark):
    got = cluster.incremental(points, ["a", "b", "c"], 0.6).collect()
    events = {(r.period, r.event) for r in got}
    assert events == {("a", "initial"), ("b", "continued"), ("c", "continued"), ("c", "new_cluster")}
    assert len({r.cluster_id for r in got}) == 4
    df = spark.createDataFrame(got)
    moved = cluster.reassignments(df, distance.period_order(df)).collect()
    assert {r.filler for r in moved} == {f"w{i:02d}" for i in range(2, 30, 3)} and {r.to_period for r in moved} == {"c"}
    assert {r.events[0] for r in cluster.incremental_summary(df).where("period = 'b'").collect()} == {"continued"}


def test_centroids_and_matches(points):
    assigned = points.withColumn("cluster_id", F.col("truth"))
    cents = {(r.period, r.cluster_id): np.array(r.centroid) for r in cluster.centroids(assigned).collect()}
    rows = [r for r in assigned.collect() if (r.period, r.truth) == ("a", 1)]
    want = np.average([r.vector for r in rows], axis=0, weights=[r["count"] for r in rows])
    assert np.allclose(cents[("a", 1)], want / np.linalg.norm(want))
    assert {(r.cluster_a, r.cluster_b) for r in cluster.matches(cluster.centroids(assigned), "a", "b").collect()} == {(0, 0), (1, 1), (2, 2)}


def test_procrustes_undoes_a_rotation(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 5))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    turn, again = (np.linalg.qr(rng.normal(size=(5, 5)))[0] for _ in range(2))
    rows = [(p, f"w{i}", v.tolist()) for p, m in (("1", base), ("2", base @ turn), ("3", base @ turn @ again)) for i, v in enumerate(m)]
    got, anchors = embed.align(spark.createDataFrame(rows, "period string, word string, vec array<double>"), ["1", "2", "3"])
    at = {(r.period, r.word): np.array(r.vec) for r in got.collect()}
    assert all(np.allclose(at[(p, f"w{i}")], base[i], atol=1e-9) for p in "123" for i in range(40)) and anchors == {"2": 40, "3": 40}
    with pytest.raises(ValueError, match="shared words"):
        embed.align(spark.createDataFrame(rows[:3] + rows[40:43], "period string, word string, vec array<double>"), ["1", "2"])


def test_pca(points):
    got = embed.project(points).where("period = 'a'").orderBy("filler").collect()
    m = np.array([r.vector for r in points.where("period = 'a'").orderBy("filler").collect()])
    u, s, _ = np.linalg.svd(m - m.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs([[r.x, r.y] for r in got]), np.abs((u * s)[:, :2]))


def test_training_learns_neighbours(spark):
    rng = np.random.default_rng(5)
    lines = [("p", " ".join(rng.choice(["cat", "dog", "pet", "fur"] if i % 2 else ["car", "bus", "road", "fuel"], 8))) for i in range(300)]
    df = spark.createDataFrame(lines, "period string, line string")
    for sg in (True, False):
        vec = {r.word: np.array(r.vec) for r in embed.train(df, embed.Training(dim=16, min_count=2, epochs=4, alpha=0.1, sg=sg)).collect()}
        cos = lambda a, b: vec[a] @ vec[b] / np.linalg.norm(vec[a]) / np.linalg.norm(vec[b])
        assert cos("cat", "dog") > cos("cat", "bus") + 0.2
    with pytest.raises(ValueError):
        embed.Training(dim=0)
    words = df.select("period", F.explode(F.split("line", " ")).alias("word"))
    assert embed.top_vocabulary(words, 1, 3).count() == 3


def test_frequent_words_are_sampled(spark):
    assert np.allclose(embed.keep_chance(np.array([90.0, 10.0]), 0.1), [np.sqrt(1 / 9) + 1 / 9, 1.0])
    assert (embed.keep_chance(np.array([90.0, 10.0]), 0.0) == 1).all()
    df = spark.createDataFrame([("p", "the cat the dog the cat")] * 20, "period string, line string")
    vec = lambda x: {r.word: r.vec for r in embed.train(df, embed.Training(dim=4, min_count=1, sample=x)).collect()}
    whole, some = vec(0.0), vec(1e-3)
    assert set(whole) == set(some) == {"the", "cat", "dog"} and whole["the"] != some["the"] and some == vec(1e-3)
    with pytest.raises(ValueError):
        embed.Training(sample=-1.0)


def test_fillers(points):
    counts = points.select("period", "filler", "count")
    assert {r.filler for r in embed.select_fillers(counts, 7, 2, ["a"]).collect()} == {"w06", "w13"}
    found, missing = embed.attach(counts, points.where("truth = 0").select("period", F.col("filler").alias("word"), F.col("vector").alias("vec")))
    assert found.count() + missing.count() == 90 and embed.nonzero(found).count() == 30


def test_frequencies(spark):
    c = spark.createDataFrame([("1_a", "x", 4), ("1_a", "y", 1), ("2", "z", 2)], "period string, slot string, count long")
    assert freq.dense(c).count() == 6
    assert {(r.period, r.slot): r["count"] for r in freq.top_union(c, 1).collect()} == {("1_a", "x"): 4, ("1_a", "z"): 0, ("2", "x"): 0, ("2", "z"): 2}
    totals = spark.createDataFrame([("1-a", 8)], "period string, total long")
    assert freq.normalised(c.where("slot = 'x'"), totals).first().per_token == 0.5
    with pytest.raises(Exception, match="no token count"):
        freq.normalised(c, totals).collect()


def test_stream(spark, tmp_path):
    from shiftscope.streaming.slots import windowed_counts

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("slots").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.period, r.slot): r["count"] for r in events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("period"), F.col("event_type").alias("slot")).count().collect()}
    assert {(r.period, r.slot): r["count"] for r in spark.table("slots").collect()} == want


def test_average_linkage_holds_no_matrix_of_all_pairs():
    import tracemalloc

    rng = np.random.default_rng(2)
    v = rng.normal(size=(6000, 16))
    v[::3] = v[0]
    tracemalloc.start()
    got = cluster.average_linkage(v, 0.7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6000 * 6000 * 8 / 2 and len(set(got[::3].tolist())) == 1


def test_incremental_with_many_clusters_is_blocked(spark, monkeypatch):
    """As whole as by blocks of one row, and as a plain replay says."""
    rng = np.random.default_rng(4)
    rows = [(p, "s", f"w{i:03d}", 1 + i % 5, rng.normal(size=5).tolist()) for p in "ab" for i in range(120)]
    pts = spark.createDataFrame(rows, "period string, slot string, filler string, count long, vector array<double>")
    got = {(r.period, r.filler): (r.cluster_id, r.event) for r in cluster.incremental(pts, ["a", "b"], 0.7).collect()}
    cents = {k: np.average([r[4] for r in rows if r[0] == "a" and got["a", r[2]][0] == k], axis=0, weights=[r[3] for r in rows if r[0] == "a" and got["a", r[2]][0] == k]) for k in {c for (p, _), (c, _) in got.items() if p == "a"}}
    for p, _, f, _, v in rows:
        if p == "b":
            sim = {k: np.dot(c, v) / np.linalg.norm(c) / np.linalg.norm(v) for k, c in cents.items()}
            best = max(sim, key=sim.get)
            assert got[p, f] == (best, "continued") if sim[best] >= 0.7 else got[p, f][1] == "new_cluster" and got[p, f][0] >= len(cents)
    monkeypatch.setattr(cluster, "CELLS", 1)
    assert cluster.average_linkage(np.array([r[4] for r in rows[:120]]), 0.7).max() + 1 == len(cents)


def test_many_points_are_clustered_in_tiles_as_in_one_task(spark, monkeypatch):
    """Equal and zero vectors, a period small enough for one task, and no task that sees a period."""
    rng = np.random.default_rng(6)
    rows = [(p, "s", f"w{i:03d}", 1 + i % 5, rng.normal(size=5).tolist()) for p, n in (("a", 160), ("b", 120), ("c", 9)) for i in range(n)]
    rows += [("a", "s", "x1", 2, rows[3][4]), ("a", "s", "x2", 9, rows[3][4]), ("b", "s", "x3", 1, [0.0] * 5), ("b", "s", "x4", 1, [0.0] * 5)]
    pts = spark.createDataFrame(rows, "period string, slot string, filler string, count long, vector array<double>")
    each = lambda: {(r.period, r.filler): r.cluster_id for r in cluster.individual(pts, 0.8).collect()}
    fold = lambda: {(r.period, r.filler): (r.cluster_id, r.event, round(r.similarity_to_cluster, 9)) for r in cluster.incremental(pts, ["a", "b", "c"], 0.8).collect()}
    want, carried = each(), fold()
    monkeypatch.setattr(cluster, "ALONE", 40)
    monkeypatch.setattr(cluster, "SIDE", 50)
    tiled = []
    monkeypatch.setattr(cluster, "nearest", lambda *a, f=cluster.nearest, **k: (tiled.append(a), f(*a, **k))[1])
    assert each() == want and fold() == carried and len(tiled) > 4
    assert len({k for (p, _), k in want.items() if p == "a"}) > 5


def test_a_sentence_is_prepared_at_once():
    """Pairs and draws as a loop over words finds them; a word's draws of itself do not count, repeats count as often."""
    rng = np.random.default_rng(7)
    s, reach = rng.integers(0, 6, 15), rng.integers(1, 4, 15)
    word, near = embed._sentence(s, reach, 3)
    want = [(i, j) for i in range(15) for j in range(max(0, i - reach[i]), min(15, i + reach[i] + 1)) if j != i]
    assert list(zip(word.tolist(), near.tolist())) == want
    own, drawn = s[word], rng.integers(0, 6, (len(word), 5))
    outs, weights = embed._choices(own, drawn, 6)
    for c, d, out, weight in zip(own, drawn, outs, weights):
        against = {w: k for w, k in zip(out[1:].tolist(), weight[1:].tolist()) if w != 6}
        assert out[0] == c and weight[0] == 1 and against == {w: d.tolist().count(w) for w in set(d.tolist()) - {c}}
        assert not weight[1:][out[1:] == 6].any()


def test_training_steps_are_those_of_word2vec(spark):
    """Against a plain statement of the steps on the same draws, repeats and draws of the word itself among them."""
    rng = np.random.default_rng(8)
    lines = sorted(" ".join(rng.choice(["a", "b", "c", "d"], 7)) for _ in range(30))
    df = spark.createDataFrame([("p", x) for x in lines], "period string, line string")
    for sg in (True, False):
        how = embed.Training(dim=4, window=2, min_count=1, epochs=2, alpha=0.3, sg=sg, seed=3)
        got = {r.word: np.array(r.vec) for r in embed.train(df, how).collect()}
        count = {w: sum(x.split().count(w) for x in lines) for w in "abcd"}
        vocab = sorted("abcd", key=lambda w: (-count[w], w))
        rng = np.random.default_rng(3)
        w_in, w_out, noise = (rng.random((4, 4)) - 0.5) / 4, np.zeros((4, 4)), np.array([count[w] for w in vocab]) ** 0.75
        noise, done = np.cumsum(noise / noise.sum()), 0
        for _ in range(2):
            for k in rng.permutation(30):
                s = [vocab.index(w) for w in lines[k].split()]
                rate, done = max(how.min_alpha, 0.3 * (1 - done / 420)), done + 7
                reach = rng.integers(1, 3, 7)
                near = [[j for j in range(max(0, i - reach[i]), min(7, i + reach[i] + 1)) if j != i] for i in range(7)]
                steps = [(i, [j]) for i in range(7) for j in near[i]] if sg else list(enumerate(near))
                for (i, js), drawn in zip(steps, np.minimum(np.searchsorted(noise, rng.random((len(steps), 5))), 3)):
                    ctx, out = [s[j] for j in js], [s[i], *(d for d in drawn if d != s[i])]
                    h = w_in[ctx].mean(axis=0)
                    g = (np.r_[1.0, np.zeros(len(out) - 1)] - 1 / (1 + np.exp(-w_out[out] @ h))) * rate
                    back = g @ w_out[out]
                    np.add.at(w_out, out, g[:, None] * h)
                    np.add.at(w_in, ctx, back / len(ctx))
        assert all(np.allclose(got[w], w_in[i], atol=1e-6) for i, w in enumerate(vocab))
