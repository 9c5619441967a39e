"""Clusters of filler vectors: one period at a time, matched between periods, or carried on."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftscope.functions.text import cosine_similarity, unit
from shiftscope.sources.folders import kept

#: Similarities held at once in the search for nearest clusters.
CELLS = 1 << 20
#: Points that one task clusters; the search among more is cut in tiles and dealt over tasks until so few are left.
ALONE = 1 << 16
#: Rows of a side of a tile.
SIDE = 1 << 15


def _nearest(x: np.ndarray, y: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the first row of y of greatest similarity, its own place left out, and that similarity.

    Blocks that fit a core's cache: a search in many processes at once is bound by memory otherwise.
    """
    near, best = np.zeros(len(x), int), np.full(len(x), -np.inf)
    step = max(1, int(CELLS**0.5))
    for i in range(0, len(x), step):
        for j in range(0, len(y), step):
            sim = x[i : i + step] @ y[j : j + step].T
            if own is not None:
                at = own[i : i + step] - j
                hit = np.flatnonzero((at >= 0) & (at < sim.shape[1]))
                sim[hit, at[hit]] = -np.inf
            at = sim.argmax(axis=1)
            top = sim[np.arange(len(sim)), at]
            up = np.flatnonzero(top > best[i : i + step])
            near[i + up], best[i + up] = at[up] + j, top[up]
    return near, best


def average_linkage(vectors: np.ndarray, min_similarity: float) -> np.ndarray:
    """Labels of agglomerative clusters by mean cosine distance, merged while under 1 - min_similarity.

    The mean similarity of two clusters is the product of their mean unit vectors, so no matrix of
    all pairs is held. A merge brings no cluster nearer to a third than its parts were: clusters
    nearest to each other merge in any order, a nearest cluster stays so until it merges itself,
    and one without a cluster under the limit is done. Equal vectors are one cluster from the start.
    """
    n = len(vectors)
    if n < 2:
        return np.zeros(n, int)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    v = vectors / np.where(norm > 0, norm, 1)
    label = np.arange(n)
    if min_similarity < 1:
        first = {}
        label = np.array([first.setdefault(row.tobytes(), i) if z else i for i, (row, z) in enumerate(zip(v + 0.0, norm[:, 0] > 0))])
    ids, back, size = np.unique(label, return_inverse=True, return_counts=True)
    return np.unique(_merged(v[ids], size.astype(float), min_similarity)[back], return_inverse=True)[1]


def _merged(mean: np.ndarray, size: np.ndarray, min_similarity: float) -> np.ndarray:
    """For each cluster the first of those it ends up with; ``mean`` and ``size`` are worked on in place."""
    ids = np.arange(len(mean))
    into = np.arange(len(mean))
    near, best = np.full(len(ids), -1), np.zeros(len(ids))
    while len(ids) > 1:
        ask = np.flatnonzero(near < 0)
        near[ask], best[ask] = _nearest(mean[ask], mean, ask)
        live = 1 - best < 1 - min_similarity
        if not live.any():
            break
        i = np.flatnonzero(live & (near[near] == np.arange(len(ids))) & (np.arange(len(ids)) < near))
        if not len(i):  # rounding may leave ties in a circle
            i = np.array([np.where(live, best, -np.inf).argmax()])
        j = near[i]
        into[ids[j]] = ids[i]
        mean[i] = (size[i, None] * mean[i] + size[j, None] * mean[j]) / (size[i] + size[j])[:, None]
        size[i] += size[j]
        gone = np.zeros(len(ids), bool)
        gone[i] = gone[j] = True
        near[gone] = -1
        stay = live.copy()
        stay[i], stay[j] = True, False
        near[~stay[near] | gone[near]] = -1
        place = np.cumsum(stay) - 1
        near = np.where(near < 0, -1, place[near])[stay]
        ids, size, mean, best = ids[stay], size[stay], mean[stay], best[stay]
    while (into[into] != into).any():
        into = into[into]
    return into


def _matrix(rows: pa.Table, name: str = "vec") -> np.ndarray:
    own = rows[name].combine_chunks()
    return own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)


def nearest(ask: DataFrame, of: DataFrame, n_ask: int, n_of: int, same: bool = False) -> DataFrame:
    """(id, near, best): for each row of ``ask`` (period, id, vec) the row of ``of`` in its period of greatest dot
    product, ties to the smallest id; with ``same`` a row is not its own nearest, and one without another goes.

    Rows are dealt into blocks, and each pair of blocks is a group of its own: a task holds two blocks of about SIDE rows.
    """
    n, m = -(-n_ask // SIDE), -(-n_of // SIDE)
    a, b = F.pmod(F.xxhash64("id"), F.lit(n)), F.pmod(F.xxhash64("id"), F.lit(m))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    left = ask.select("period", "id", "vec", a.alias("a"), every(m).alias("b"))
    right = of.select("period", "id", "vec", b.alias("b"), every(n).alias("a"))

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        if one.num_rows and two.num_rows:
            x, y = _matrix(one), _matrix(two)
            own, other = one["id"].to_numpy(), two["id"].to_numpy()
            order = np.argsort(other)
            y, other = y[order], other[order]
            place = np.minimum(np.searchsorted(other, own), len(other) - 1)
            at, top = _nearest(x, y, np.where(other[place] == own, place, -1) if same else None)
            ok = top > -np.inf
            return pa.table({"id": own[ok], "near": other[at[ok]], "best": top[ok]})
        return pa.table({"id": pa.array([], pa.int64()), "near": pa.array([], pa.int64()), "best": pa.array([], pa.float64())})

    tiles = left.groupBy("period", "a", "b").cogroup(right.groupBy("period", "a", "b")).applyInArrow(run, "id long, near long, best double")
    return tiles.groupBy("id").agg(F.max(F.struct("best", (-F.col("near")).alias("k"))).alias("x")).select("id", (-F.col("x.k")).alias("near"), "x.best")


def _sizes(rows: DataFrame) -> dict[str, int]:
    return {r.period: r["count"] for r in rows.groupBy("period").count().collect()}  # a row a period


def linkage(points: DataFrame, min_similarity: float) -> DataFrame:
    """(id, root): the clusters of ``average_linkage`` in each period of (period, id, vector), named by a member; ids are unique.

    A period of more than ALONE clusters is worked on in rounds: each finds the clusters nearest to each other
    in tiles and merges them, and those without one under the limit are done. State is in the shared folder.
    """
    vec = F.transform(unit(F.col("vector")), lambda x: x + F.lit(0.0))
    apart = F.when(F.lit(min_similarity >= 1) | ~F.exists("vector", lambda x: x != 0), F.col("id"))
    alike = Window.partitionBy("period", "vec", "apart")
    base = kept(points.select("period", "id", vec.alias("vec"), apart.alias("apart")).select("period", "id", F.min("id").over(alike).alias("root"), F.count("*").over(alike).alias("size"), "vec"))
    none = F.lit(None)
    state = base.where("id = root").select("period", "id", "size", "vec", none.cast("long").alias("near"), none.cast("double").alias("best"))
    links, rest = [base.select("id", "root")], []
    while True:
        sizes = _sizes(state)
        large = F.coalesce(F.col("period").isin([p for p, n in sizes.items() if n > ALONE]), F.lit(False))
        rest.append(state.where(~large))
        state = state.where(large)
        most = max(sizes.values(), default=0)
        if most <= ALONE:
            break
        asking = state.where("near IS NULL")
        found = nearest(asking, state, max(_sizes(asking).values(), default=1), most, same=True)
        known = state.where("near IS NOT NULL").select("id", "near", "best").unionByName(found)
        live = kept(known.where(1 - F.col("best") < 1 - min_similarity).select("id", "near", "best"))
        back = live.select(F.col("id").alias("near"), F.col("near").alias("id"))
        pairs = kept(live.select("id", "near").join(back, ["id", "near"]).where("id < near").select(F.col("id").alias("root"), F.col("near").alias("id")))
        if not pairs.head(1):  # rounding may leave ties in a circle
            rest.append(state)
            break
        links.append(pairs)
        ends = pairs.select(F.col("root").alias("id"), "root").unionByName(pairs.select("id", "root"))
        own = live.join(ends, "id", "left")
        to = live.select(F.col("id").alias("near"), F.lit(True).alias("there")).join(ends.select(F.col("id").alias("near"), F.lit(True).alias("gone")), "near", "left")
        own = own.join(to, "near", "left")
        stays = F.col("root").isNull() & F.col("there") & F.col("gone").isNull()
        own = own.select("id", F.coalesce("root", "id").alias("root"), F.when(stays, F.col("near")).alias("near"), F.when(stays, F.col("best")).alias("best"))
        both = state.select("period", "id", "size", "vec").join(own, "id").groupBy("period", "root").agg(F.array_sort(F.collect_list(F.struct("id", "size", "vec"))).alias("m"), F.max("near").alias("near"), F.max("best").alias("best"))
        x, y = F.get("m", 0), F.get("m", 1)
        mean = F.when(F.size("m") > 1, F.zip_with(x["vec"], y["vec"], lambda p, q: (x["size"] * p + y["size"] * q) / (x["size"] + y["size"]))).otherwise(x["vec"])
        size = x["size"] + F.coalesce(y["size"], F.lit(0))
        state = kept(both.select("period", F.col("root").alias("id"), size.alias("size"), mean.alias("vec"), "near", "best"))

    def finish(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        own = rows["id"].to_numpy()
        return pa.table({"id": own, "root": own[_merged(_matrix(rows).copy(), rows["size"].to_numpy().astype(float), min_similarity)]})

    last = rest[0]
    for more in rest[1:]:
        last = last.unionByName(more)
    links.append(last.select("period", "id", "size", "vec").groupBy("period").applyInArrow(finish, "id long, root long").where("id <> root"))
    out = links[0]
    for more in links[1:]:
        out = out.join(more.select(F.col("id").alias("root"), F.col("root").alias("to")), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    return out


def _numbered(points: DataFrame) -> DataFrame:
    """The points with ids in the order of periods and fillers, in the shared folder."""
    return kept(points.orderBy("period", "filler").withColumn("id", F.monotonically_increasing_id()))


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows with roots, with their cluster's number within the period: larger ones first."""
    each = rows.groupBy("period", "root").agg(F.sum("count").alias("total"), F.min("filler").alias("word"))
    rank = F.row_number().over(Window.partitionBy("period").orderBy(F.desc("total"), "word", "root")) - 1
    return rows.join(each.select("root", rank.alias("cluster_id")), "root")


def _own(points: DataFrame) -> DataFrame:
    return points.select("period", "filler", F.col("count").cast("long").alias("count"), F.col("vector").cast("array<double>").alias("vector"))


def centroids(assigned: DataFrame, by: tuple[str, ...] = ("period", "cluster_id"), count: str = "count", vector: str = "vector") -> DataFrame:
    """Count-weighted mean vectors at length 1, with the number of fillers and their total count."""
    each = assigned.select(*by, F.col(count).alias("c"), F.posexplode(vector).alias("i", "x"))
    sums = each.groupBy(*by, "i").agg((F.sum(F.col("x").cast("double") * F.col("c")) / F.sum("c")).alias("x"))
    mean = sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    size = assigned.groupBy(*by).agg(F.count("*").alias("n_fillers"), F.sum(count).alias("total_count"))
    return size.join(mean, list(by)).select(*by, "n_fillers", "total_count", unit(F.col("m")).alias("centroid"))


ASSIGNED = "period string, cluster_id int, filler string, count long, vector array<double>"


def individual(points: DataFrame, min_similarity: float = 0.5) -> DataFrame:
    """(period, period_cluster_id, cluster_id, filler, count, vector): each period by itself, larger clusters first.

    A period of up to ALONE points is clustered in one task, a larger one in rounds of many (see ``linkage``).
    """

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("filler").reset_index(drop=True)
        frame["label"] = average_linkage(np.stack(frame["vector"]).astype(float), min_similarity)
        rank = frame.groupby("label").agg(total=("count", "sum"), word=("filler", "min")).sort_values(["total", "word"], ascending=[False, True])
        frame["cluster_id"] = frame["label"].map({label: i for i, label in enumerate(rank.index)}).astype("int32")
        return frame[["period", "cluster_id", "filler", "count", "vector"]]

    own = _own(points)
    if max(_sizes(own).values(), default=0) > ALONE:
        own = _numbered(own)
        out = _ranked(own.join(linkage(own, min_similarity), "id"))
    else:
        out = own.groupBy("period").applyInPandas(run, ASSIGNED)
    return out.select("period", F.concat_ws("_", "period", "cluster_id").alias("period_cluster_id"), "cluster_id", "filler", "count", "vector")


def summary(assigned: DataFrame) -> DataFrame:
    """(period, cluster_id, n_fillers, total_count, fillers): members by falling count."""
    members = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), "filler"))), lambda x: x["filler"]), ", ")
    return assigned.groupBy("period", "cluster_id").agg(F.count("*").alias("n_fillers"), F.sum("count").alias("total_count"), members.alias("fillers"))


def matches(cents: DataFrame, a: str, b: str, top_n: int = 1) -> DataFrame:
    """(cluster_a, cluster_b, similarity, rank) by the cosine of two periods' centroids."""
    left = cents.where(F.col("period") == a).select(F.col("cluster_id").alias("cluster_a"), F.col("centroid").alias("x"))
    right = cents.where(F.col("period") == b).select(F.col("cluster_id").alias("cluster_b"), F.col("centroid").alias("y"))
    scored = left.join(right, F.lit(True)).select("cluster_a", "cluster_b", cosine_similarity(F.col("x"), F.col("y")).alias("similarity"))  # a centroid a cluster
    rank = F.row_number().over(Window.partitionBy("cluster_a").orderBy(F.round("similarity", 12).desc(), "cluster_b"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top_n)


INCREMENTAL = "period string, filler string, count long, cluster_id int, event string, similarity_to_cluster double"


def incremental(points: DataFrame, periods: list[str], min_similarity: float = 0.5) -> DataFrame:
    """Clusters carried from period to period.

    The first period is clustered from scratch; later fillers join the cluster of the most
    similar centroid if that reaches min_similarity, whose centroid the period's members then
    replace, and the rest form new clusters.  Clusters without members stay open to matches.
    State is a fold over periods: up to ALONE points it runs in one task, more are searched in many (see ``_folded``).
    """
    own = _own(points.where(F.col("period").isin(periods)))
    if sum(_sizes(own).values()) > ALONE:
        return _folded(own, periods, min_similarity)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        state: np.ndarray | None = None
        out = []

        def centres(v: np.ndarray, weight: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
            """Weighted means of the groups 0..k-1 at length 1."""
            order = np.argsort(group, kind="stable")
            starts = np.searchsorted(group[order], np.arange(k))
            sums = np.add.reduceat((v * weight[:, None])[order], starts) / np.add.reduceat(weight[order], starts)[:, None]
            n = np.linalg.norm(sums, axis=1, keepdims=True)
            return sums / np.where(n > 0, n, 1)

        for p in periods:
            rows = frame[frame["period"] == p].sort_values("filler").reset_index(drop=True)
            if rows.empty:
                continue
            v, weight = np.stack(rows["vector"]).astype(float), rows["count"].to_numpy(float)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            u = v / np.where(n > 0, n, 1)
            cluster, close, held = np.zeros(len(v), int), np.zeros(len(v)), np.zeros(len(v), bool)
            event = "initial" if state is None else "new_cluster"
            if state is not None:
                cluster, close = _nearest(u, state)
                held = close >= min_similarity
                if held.any():
                    which, group = np.unique(cluster[held], return_inverse=True)
                    state[which] = centres(v[held], weight[held], group, len(which))
            fresh = np.flatnonzero(~held)
            if len(fresh):
                label = average_linkage(v[fresh], min_similarity)
                total, word = np.bincount(label, weight[fresh]), np.unique(label, return_index=True)[1]  # rows are in the order of fillers
                rank = np.argsort(np.lexsort((word, -total)))
                own = centres(v[fresh], weight[fresh], rank[label], len(total))
                close[fresh] = np.einsum("ij,ij->i", u[fresh], own[rank[label]])
                cluster[fresh] = rank[label] + (0 if state is None else len(state))
                state = own if state is None else np.concatenate([state, own])
            out.append(pd.DataFrame({"period": p, "filler": rows["filler"], "count": rows["count"], "cluster_id": cluster.astype("int32"), "event": np.where(held, "continued", event), "similarity_to_cluster": close}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("period", "filler", "count", "cluster_id", "event", "similarity_to_cluster")})

    return own.withColumn("_k", F.lit(1)).groupBy("_k").applyInPandas(run, INCREMENTAL)


def _folded(points: DataFrame, periods: list[str], min_similarity: float) -> DataFrame:
    """``incremental`` with state in the shared folder: centroids are searched in tiles and averaged in aggregations."""
    points = _numbered(points)
    sizes = _sizes(points)
    state, n_state, out = None, 0, []
    for p in (p for p in periods if p in sizes):
        rows = points.where(F.col("period") == p)
        vec = rows.select("period", "id", unit(F.col("vector")).alias("vec"))
        fresh, event = rows, "initial"
        if state is not None:
            event = "new_cluster"
            close = nearest(vec, state.select(F.lit(p).alias("period"), F.col("cluster_id").alias("id"), F.col("centroid").alias("vec")), sizes[p], n_state)
            close = kept(close.where(F.col("best") >= min_similarity).select("id", F.col("near").alias("cluster_id"), F.col("best").alias("similarity_to_cluster")))
            held = rows.join(close, "id")
            moved = centroids(held, ("cluster_id",)).select("cluster_id", F.col("centroid").alias("now"))
            state = state.join(moved, "cluster_id", "left").select("cluster_id", F.coalesce("now", "centroid").alias("centroid"))
            out.append(held.withColumn("event", F.lit("continued")))
            fresh = rows.join(close.select("id"), "id", "left_anti")
        made = kept(_ranked(fresh.join(linkage(fresh.select("period", "id", "vector"), min_similarity), "id")).withColumn("cluster_id", (F.col("cluster_id") + n_state).cast("long")))
        own = kept(centroids(made, ("cluster_id",)).select("cluster_id", "centroid"))
        dot = F.aggregate(F.zip_with(unit(F.col("vector")), "centroid", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        out.append(made.join(own, "cluster_id").withColumn("similarity_to_cluster", dot).withColumn("event", F.lit(event)))
        state = kept(own if state is None else state.unionByName(own))
        n_state = state.count()
    whole = [x.select("period", "filler", "count", F.col("cluster_id").cast("int").alias("cluster_id"), "event", "similarity_to_cluster") for x in out]
    for more in whole[1:]:
        whole[0] = whole[0].unionByName(more)
    return whole[0]


def incremental_summary(assigned: DataFrame) -> DataFrame:
    return summary(assigned).join(assigned.groupBy("period", "cluster_id").agg(F.array_sort(F.collect_set("event")).alias("events")), ["period", "cluster_id"])


def top_members(assigned: DataFrame, n: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("period", "cluster_id").orderBy(F.desc("count"), "filler"))
    top = assigned.withColumn("rank", rank).where(F.col("rank") <= n)
    shown = top.groupBy("period", "cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "filler"))), lambda x: x["filler"]), ", ").alias("members"))
    return assigned.select("period", "cluster_id").distinct().join(shown, ["period", "cluster_id"], "left")


def reassignments(assigned: DataFrame, order: DataFrame) -> DataFrame:
    """(filler, from_period, to_period, from_cluster, to_cluster) where a filler's cluster differs from its last appearance."""
    w = Window.partitionBy("filler").orderBy("ord")
    own = assigned.join(order, "period").withColumn("from_period", F.lag("period").over(w)).withColumn("from_cluster", F.lag("cluster_id").over(w))
    return own.where(F.col("from_cluster").isNotNull() & (F.col("from_cluster") != F.col("cluster_id"))).select("filler", "from_period", F.col("period").alias("to_period"), "from_cluster", F.col("cluster_id").alias("to_cluster"))
