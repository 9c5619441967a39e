"""Diachronic word vectors: training, alignment, attachment to fillers, projection."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftscope.functions.text import unit


ROOT = 2**0.5


@dataclass(frozen=True)
class Training:
    """Parameters of skip-gram (sg) or CBOW training with negative sampling.

    ``sample``: threshold of the random downsampling of frequent words, as a share of the
    period's words (the reference's default is 1e-5); 0 keeps every word.
    """

    dim: int = 100
    window: int = 5
    min_count: int = 5
    max_vocab: int | None = None
    sg: bool = True
    negative: int = 5
    ns_exponent: float = 0.75
    sample: float = 0.0
    epochs: int = 5
    alpha: float = 0.025
    min_alpha: float = 0.0001
    seed: int = 1

    def __post_init__(self):
        if min(self.dim, self.window, self.min_count, self.epochs) < 1 or self.negative < 1:
            raise ValueError("dim, window, min_count, epochs and negative must be positive")
        if self.max_vocab is not None and self.max_vocab < 1:
            raise ValueError("max_vocab must be positive")
        if not 0 <= self.sample < 1:
            raise ValueError("0 <= sample < 1")
        if not 0 < self.min_alpha <= self.alpha:
            raise ValueError("0 < min_alpha <= alpha")


def top_vocabulary(words: DataFrame, min_count: int = 5, max_vocab: int | None = None) -> DataFrame:
    """(period, word, count): words of min_count or more, the most frequent first, ties by name."""
    counts = words.groupBy("period", "word").agg(F.count("*").alias("count")).where(F.col("count") >= min_count)
    if max_vocab is None:
        return counts
    rank = F.row_number().over(Window.partitionBy("period").orderBy(F.desc("count"), "word"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= max_vocab).drop("rank")


def shuffled(lines: DataFrame, seed: int = 1) -> DataFrame:
    return lines.orderBy(F.xxhash64(F.lit(seed), "line"), "line")


def keep_chance(count: np.ndarray, sample: float) -> np.ndarray:
    """word2vec's chance that an occurrence of a word with this count is kept."""
    share = sample * count.sum() / count
    return np.minimum(1.0, np.sqrt(share) + share) if sample else np.ones(len(count))


def _sentence(s: np.ndarray, reach: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of words, places of words near them): each word with those within its reach, in the order of the text."""
    step = np.delete(np.arange(-window, window + 1), window)
    near = np.arange(len(s))[:, None] + step
    word, k = np.nonzero((np.abs(step) <= reach[:, None]) & (near >= 0) & (near < len(s)))
    return word, near[word, k]


def _choices(own: np.ndarray, drawn: np.ndarray, empty: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, weights): the word and the distinct words drawn against it, with the number of draws; draws of the word
    itself and repeats are the ``empty`` row at no weight."""
    drawn = np.sort(drawn, axis=1)
    new = np.ones(drawn.shape, bool)
    new[:, 1:] = drawn[:, 1:] != drawn[:, :-1]
    starts = np.flatnonzero(new)
    times = np.zeros(drawn.size)
    times[starts] = np.diff(np.append(starts, drawn.size))
    times = times.reshape(drawn.shape)
    times[drawn == own[:, None]] = 0
    return np.column_stack([own, np.where(times > 0, drawn, empty)]), np.column_stack([np.ones(len(own)), times])


def train(lines: DataFrame, how: Training = Training()) -> DataFrame:
    """(period, word, vec): one model a period, each trained in its own task, as a sequential process must be.

    Steps follow each other as in word2vec; what does not depend on the vectors is worked out for a sentence at once.
    """

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own_lines = frame["line"].sort_values().tolist()
        count: Counter = Counter()
        for line in own_lines:
            count.update(line.split())
        vocab = sorted((w for w in count if count[w] >= how.min_count), key=lambda w: (-count[w], w))[: how.max_vocab]
        if not vocab:
            return pd.DataFrame({"period": [], "word": [], "vec": []})
        index = {w: i for i, w in enumerate(vocab)}
        rng = np.random.default_rng(how.seed)
        # both matrices are held over the root of 2: a product of theirs is half of the models', as the step needs it
        w_in = (rng.random((len(vocab), how.dim)) - 0.5) / how.dim / ROOT
        vectors = list(w_in)
        w_out = np.zeros((len(vocab) + 1, how.dim))  # the last row stands for no word and stays 0
        noise = np.array([count[w] for w in vocab], float) ** how.ns_exponent
        noise = np.cumsum(noise / noise.sum())
        ids = [np.array([index[w] for w in line.split() if w in index], np.int32) for line in own_lines]
        chance = keep_chance(np.array([count[w] for w in vocab], float), how.sample)
        total, done = max(1, how.epochs * sum(map(len, ids))), 0
        sign = np.r_[1.0, -np.ones(how.negative)]
        g, move, back = np.empty(1 + how.negative), np.empty((1 + how.negative, how.dim)), np.empty(how.dim)
        column, dot, tanh, subtract, multiply = g[:, None], np.dot, np.tanh, np.subtract, np.multiply

        def step(h: np.ndarray, out: np.ndarray, weight: np.ndarray) -> np.ndarray:
            """Moves the rows ``out`` by a step; what h is to be moved by. (The logistic function of x is (1 + tanh(x / 2)) / 2.)"""
            rows = w_out.take(out, 0)
            dot(rows, h, g)
            tanh(g, g)
            subtract(sign, g, g)
            multiply(g, weight, g)
            dot(g, rows, back)
            multiply(column, h, move)
            rows += move
            w_out[out] = rows
            return back

        for _ in range(how.epochs):
            for k in rng.permutation(len(ids)):
                s = ids[k]
                rate = max(how.min_alpha, how.alpha * (1 - done / total))
                done += len(s)
                if how.sample and len(s):
                    s = s[rng.random(len(s)) < chance[s]]
                if len(s) < 2:
                    continue
                word, near = _sentence(s, rng.integers(1, how.window + 1, len(s)), how.window)
                own = s[word] if how.sg else s
                drawn = np.minimum(np.searchsorted(noise, rng.random((len(own), how.negative))), len(vocab) - 1)
                outs, weights = _choices(own, drawn, len(vocab))
                weights *= rate / 2
                if how.sg:
                    for ctx, out, weight in zip(s[near].tolist(), outs, weights):
                        h = vectors[ctx]
                        h += step(h, out, weight)
                else:
                    begin = np.searchsorted(word, np.arange(len(s) + 1))
                    for i, (out, weight) in enumerate(zip(outs, weights)):
                        ctx = s[near[begin[i] : begin[i + 1]]]
                        np.add.at(w_in, ctx, step(w_in[ctx].mean(axis=0), out, weight) / len(ctx))
        return pd.DataFrame({"period": key[0], "word": vocab, "vec": [v.astype(np.float32) for v in w_in * ROOT]})

    return lines.select("period", "line").groupBy("period").applyInPandas(fit, "period string, word string, vec array<float>")


def align(vectors: DataFrame, periods: list[str], min_anchors: int | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Each period rotated onto the one before (orthogonal Procrustes over shared words).

    Products of neighbouring periods are summed in parallel against the unrotated models; only
    a dim x dim matrix for each pair reaches the driver, where rotations are multiplied up.
    """
    own = vectors.select("period", "word", unit(F.col("vec").cast("array<double>")).alias("vec"))
    turn: dict[str, np.ndarray] = {}
    anchors: dict[str, int] = {}
    for a, b in zip(periods[:-1], periods[1:]):
        base, other = own.where(F.col("period") == a).select("word", F.col("vec").alias("x")), own.where(F.col("period") == b).select("word", F.col("vec").alias("y"))

        def products(frames):
            total, n = None, 0
            for f in frames:
                if len(f):
                    x, y = np.stack(f["x"]), np.stack(f["y"])
                    total, n = y.T @ x if total is None else total + y.T @ x, n + len(f)
            if total is not None:
                yield pd.DataFrame({"m": [total.ravel()], "n": [n]})

        parts = base.join(other, "word").select("x", "y").mapInPandas(products, "m array<double>, n long")
        summed = parts.select(F.posexplode("m").alias("i", "v"), "n").groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("i").collect()  # dim x dim
        n = summed[0].n if summed else 0
        dim = int(round(len(summed) ** 0.5))
        if n < (min_anchors or max(dim, 1)):
            raise ValueError(f"{n} shared words between {a} and {b}; at least {min_anchors or dim} are needed")
        u, _, vt = np.linalg.svd(np.array([r.v for r in summed]).reshape(dim, dim))
        turn.setdefault(periods[0], np.eye(dim))
        turn[b] = (u @ vt) @ turn[a]
        anchors[b] = n

    def rotate(frames):
        for f in frames:
            for p, own in f.groupby("period", sort=False):
                rows = list(np.stack(own["vec"]) @ turn[p]) if p in turn else list(own["vec"])
                yield pd.DataFrame({"period": p, "word": own["word"].to_numpy(), "vec": rows})

    return own.mapInPandas(rotate, "period string, word string, vec array<double>"), anchors


def common_words(vectors: DataFrame, a: str, b: str) -> DataFrame:
    """(word): words with a vector in both periods."""
    return vectors.where(F.col("period") == a).select("word").join(vectors.where(F.col("period") == b).select("word"), "word")


def shared_words(vectors: DataFrame, a: str, b: str) -> int:
    return common_words(vectors, a, b).count()


def select_fillers(counts: DataFrame, min_freq: int = 1, top_n: int | None = None, periods: list[str] | None = None) -> DataFrame:
    """Fillers of min_freq or more, a period's top n by count, ties by name."""
    own = counts.where(F.col("count") >= min_freq)
    own = own.where(F.col("period").isin(periods)) if periods is not None else own
    if top_n is None:
        return own
    rank = F.row_number().over(Window.partitionBy("period").orderBy(F.desc("count"), "filler"))
    return own.withColumn("rank", rank).where(F.col("rank") <= top_n).drop("rank")


def attach(counts: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fillers with their period's vector, fillers without one)."""
    key = vectors.select("period", F.col("word").alias("filler"), F.col("vec").alias("vector"))
    return counts.join(key, ["period", "filler"]), counts.join(key, ["period", "filler"], "left_anti")


def nonzero(points: DataFrame) -> DataFrame:
    return points.where(F.exists("vector", lambda x: x != 0))


def project(points: DataFrame, dims: int = 2) -> DataFrame:
    """(period, slot, filler, count, x, y): each period's points on their first principal axes; under two points none."""

    def pca(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["slot", "filler"])
        if len(frame) < 2:
            return pd.DataFrame({c: [] for c in ("period", "slot", "filler", "count", "x", "y")})
        m = np.stack(frame["vector"]).astype(float)
        u, s, vt = np.linalg.svd(m - m.mean(axis=0), full_matrices=False)
        sign = np.where(np.take_along_axis(vt, np.abs(vt).argmax(axis=1)[:, None], 1).ravel() < 0, -1.0, 1.0)
        xy = np.zeros((len(frame), 2))
        k = min(dims, 2, len(s))
        xy[:, :k] = (u * s * sign)[:, :k]
        return frame[["period", "slot", "filler", "count"]].assign(x=xy[:, 0], y=xy[:, 1])

    return points.select("period", "slot", "filler", F.col("count").cast("long"), "vector").groupBy("period").applyInPandas(pca, "period string, slot string, filler string, count long, x double, y double")
