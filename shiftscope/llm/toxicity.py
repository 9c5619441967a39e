"""Operator 3 - toxicity by maximum-scoring segments over token log-odds.

Training (labels of rows whose crc32(id as text) mod 5 is not 0, at most ``MAX_TRAIN``
of them, chosen by hash): token counts by label give log-odds with an informative
Dirichlet prior (Monroe, Colaresi and Quinn 2008); tokens are lower-cased words, backed
off to prefixes of 7, 5, 4 and 3 bytes so that inflected forms share evidence; of a word
and its prefixes the one whose log-odds are furthest from 0 by their lower bound counts.  Token counts
come from remainders 1-3, the calibration below from remainder 4.

Scoring: one linear scan (Ruzzo and Tompa 1999) finds all maximal-scoring segments of a
text.  Segment scores of clean text follow an extreme-value law, P(max >= x) =
1 - exp(-K n exp(-lambda x)) (Karlin and Altschul 1990), whose lambda and K are fitted on
clean calibration texts.  Segments with an E-value under ``MAX_E`` are significant; the
sum of their excess -ln(E) and the best segment's -ln(E) enter a logistic calibration.

Only the text is an input of a score.  Defined results: null and empty texts have no
segments and get the score of that; repeated rows are scored one by one; null labels or
ids in the labels table are ignored, of several labels of one id the greatest counts;
without labelled rows of both kinds every score is 0; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftscope.llm import textkernel as tk
from shiftscope.llm.common import durable, only, slices, table

#: Bound of the labelled sample that the model is fitted on, and so of the token table that is broadcast.
MAX_TRAIN = 50_000
PREFIXES = (7, 5, 4, 3)
PRIOR_TOKENS = 2_000.0
MIN_COUNT, MIN_Z, MIN_DELTA = 3, 2.5, 1.0
DRIFT = 0.5
CLIP = 8.0
#: Token scores are whole multiples of 1 / UNIT, so that sums are exact in any order and batch.
UNIT = 65536.0
MAX_E = 0.05

_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_SALTS = tuple(np.uint64(0xA5A5A5A55A5A5A5A * (k + 1) % (1 << 64)) for k in range(len(PREFIXES)))

TOKEN_SCHEMA = "h long, toxic long, clean long"
SCORE_SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_words long, n_segments long, best double, segments array<struct<first_word:int,last_word:int,score:double>>"
_SEGMENTS = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("score", pa.float64())]))


@dataclass(frozen=True)
class Model:
    """All that the scan needs; sizes are bounded by the words of MAX_TRAIN rows."""

    hashes: np.ndarray  # sorted uint64
    scores: np.ndarray
    sure: np.ndarray  # |log-odds| less two standard errors
    lam: float = 1.0
    k: float = 1.0
    weights: tuple[float, float, float] = (-50.0, 0.0, 0.0)


def tokens(part: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """([hash, prefix hashes] of each distinct word, the distinct word of each word, first word of each row).

    Words are lower-cased and lose outer ASCII punctuation.
    """
    raw, offsets = tk.buffer_of(part.column("text"))
    raw = tk.lower_ascii(raw)
    start, end, first = tk.spans(raw, offsets)
    for _ in range(3):
        start = start + (_PUNCT[raw[start]] & (start + 1 < end))
        end = end - (_PUNCT[raw[end - 1]] & (start + 1 < end))
    word, at, which = np.unique(tk.span_hashes(raw, start, end), return_index=True, return_inverse=True)
    start, end = start[at], end[at]
    return [word, *(tk.span_hashes(raw, start, np.minimum(end, start + k)) ^ salt for k, salt in zip(PREFIXES, _SALTS))], which, first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        keys, which, first = tokens(part)
        label = np.repeat(part.column("toxic").to_numpy(zero_copy_only=False), np.diff(first))
        h, at = np.unique(np.concatenate(keys), return_inverse=True)
        toxic, clean = np.bincount(which, label, len(keys[0])), np.bincount(which, 1 - label, len(keys[0]))
        yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "toxic": np.bincount(at, np.tile(toxic, len(keys)), len(h)).astype(np.int64), "clean": np.bincount(at, np.tile(clean, len(keys)), len(h)).astype(np.int64)})


def log_odds(counts: DataFrame) -> DataFrame:
    """(h, delta, z) of the tokens whose log-odds differ from 0."""
    n = counts.agg(F.sum("toxic").alias("n1"), F.sum("clean").alias("n0"))
    a = F.lit(PRIOR_TOKENS) * (F.col("toxic") + F.col("clean")) / (F.col("n1") + F.col("n0"))
    y1, y0 = F.col("toxic") + a, F.col("clean") + a
    delta = F.log(y1 / (F.col("n1") + PRIOR_TOKENS - y1)) - F.log(y0 / (F.col("n0") + PRIOR_TOKENS - y0))
    z = delta / F.sqrt(1 / y1 + 1 / y0)
    full = counts.filter(F.col("toxic") + F.col("clean") >= MIN_COUNT).crossJoin(F.broadcast(n)).select("h", delta.alias("delta"), z.alias("z"))
    return full.filter((F.abs("z") >= MIN_Z) & (F.abs("delta") >= MIN_DELTA))


def token_scores(model: Model, keys: list[np.ndarray], which: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log-odds less the drift of each word; a word right after itself in its row is no new evidence."""
    score, sure = np.zeros(len(keys[0])), np.zeros(len(keys[0]))
    if len(model.hashes):
        for h in keys:
            at = np.minimum(np.searchsorted(model.hashes, h), len(model.hashes) - 1)
            hit = np.flatnonzero((model.hashes[at] == h) & (model.sure[at] > sure))
            score[hit], sure[hit] = model.scores[at[hit]], model.sure[at[hit]]
    score = score[which]
    again = np.zeros(len(which), bool)
    again[1:] = which[1:] == which[:-1]
    again[first[:-1][np.diff(first) > 0]] = False  # a row's first word
    score[again] = 0.0
    return np.rint((np.clip(score, -CLIP, CLIP) - DRIFT) * UNIT) / UNIT


def best_segment(score: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The greatest sum of a run of tokens of each row (0 without a positive token)."""
    n_words = np.diff(first)
    out = np.zeros(len(n_words))
    if len(score) == 0:
        return out
    whole = np.rint(score * UNIT)
    exact = bool((whole == score * UNIT).all())
    own = whole.astype(np.int64) if exact else score
    total = np.cumsum(own)
    before = total - own
    # a step down at each row's start keeps the running minimum inside the row
    row = np.repeat(np.arange(len(n_words)), n_words)
    gap = np.abs(own).sum() + 1
    low = np.minimum.accumulate(before - row * gap) + row * gap
    run = total - low
    full = np.flatnonzero(n_words)
    out[full] = np.maximum(np.maximum.reduceat(run, first[full]), 0)
    return out / UNIT if exact else out


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, last token, sum) in one pass over the tokens.

    Each segment on the list knows the nearest one before it whose left sum is smaller, so a
    step that passes over others never meets them again and the pass is linear.
    """
    left: list = []
    right: list = []
    start: list[int] = []
    stop: list[int] = []
    lower: list[int] = []
    total = np.concatenate([[0], np.cumsum(score)])
    up = np.flatnonzero(score > 0)
    for i, low, high in zip(up.tolist(), total[up].tolist(), total[up + 1].tolist()):
        begin = i
        j = len(left) - 1
        while j >= 0 and left[j] >= low:
            j = lower[j]
        while j >= 0 and right[j] < high:
            low, begin, before = left[j], start[j], lower[j]
            del left[j:], right[j:], start[j:], stop[j:], lower[j:]
            j = before
        left.append(low), right.append(high), start.append(begin), stop.append(i), lower.append(j)
    return [(a, b, float(r - l)) for l, r, a, b in zip(left, right, start, stop)]


def _features(model: Model, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """(words, -ln E of the best segment or 0, sum over significant segments, segments)."""
    keys, which, first = tokens(part)
    score = token_scores(model, keys, which, first)
    n_words = np.diff(first)
    top = best_segment(score, first)
    with np.errstate(divide="ignore"):
        edge = np.log(np.maximum(model.k * np.maximum(n_words, 1), 1e-300))
    best = np.where(top > 0, np.maximum(model.lam * top - edge, 0.0), 0.0)
    total, segments = np.zeros(len(n_words)), [[] for _ in range(len(n_words))]
    need = -np.log(MAX_E)
    for i in np.flatnonzero(best >= need).tolist():
        for a, b, s in maximal_segments(score[first[i] : first[i + 1]]):
            if (bits := model.lam * s - edge[i]) >= need:
                total[i] += bits
                segments[i].append({"first_word": a, "last_word": b, "score": s})
    return n_words, best, total, segments


def _lambda(score: np.ndarray) -> float:
    """The positive root of mean(exp(lambda * score)) = 1 under the clean token distribution."""
    if not (score > 0).any() or score.mean() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while np.exp(high * score).mean() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if np.exp(mid * score).mean() < 1 else (low, mid)
    return (low + high) / 2


def _histogram(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            keys, which, first = tokens(part)
            s, n = np.unique(np.round(token_scores(model, keys, which, first) * 64).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_pydict({"bin": s, "n": n})

    return run


def _peaks(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            keys, which, first = tokens(part)
            top = best_segment(token_scores(model, keys, which, first), first)
            n = np.diff(first)
            yield pa.RecordBatch.from_pydict({"v": np.rint(np.maximum(n, 1) * np.exp(-model.lam * top) * UNIT).astype(np.int64)})

    return run


def _calibrate(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            _, best, total, _ = _features(model, part)
            yield pa.RecordBatch.from_pydict({"toxic": part.column("toxic"), "best": best, "total": total})

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 1e-3 * len(y) * np.array([0, *w[1:]]) * 1e-2
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-5 * len(y) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def squash(best: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(best), np.log1p(total)])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """The model from a bounded, hash-chosen sample of the labelled rows."""
    rest = F.crc32(F.col("doc_id").cast("string")) % 5
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("long").alias("toxic")).dropna()
    known = known.filter(rest != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = durable(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    own = only(docs, id_col, text_col).join(F.broadcast(known), "doc_id")  # max_train narrow rows at most
    counts = own.filter(rest < 4).mapInArrow(_count, TOKEN_SCHEMA).groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    found = log_odds(durable(counts)).toPandas()
    h = found["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    model = Model(h[order], found["delta"].to_numpy(float)[order], (found["delta"].abs() * (1 - 2 / found["z"].abs())).to_numpy(float)[order])
    held = own.filter(rest == 4)
    clean = held.filter("toxic = 0")
    bins = clean.mapInArrow(_histogram(model), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()  # 64 bins a unit of score, within +-CLIP
    if bins.empty:
        return model
    lam = _lambda(np.repeat(bins["bin"].to_numpy() / 64, np.maximum(1, bins["n"].to_numpy() * 1_000_000 // bins["n"].sum())))
    model = Model(model.hashes, model.scores, model.sure, lam)
    v = clean.mapInArrow(_peaks(model), "v long").agg(F.sum("v").alias("total"), F.count("v").alias("n")).first()
    mean = v.total / v.n / UNIT
    model = Model(model.hashes, model.scores, model.sure, lam, 1.0 / max(mean, 1e-12))
    seen = held.mapInArrow(_calibrate(model), "toxic long, best double, total double").toPandas()  # max_train rows at most
    seen = seen.sort_values(["toxic", "best", "total"])  # sums of floats depend on the order
    if seen["toxic"].nunique() < 2:
        return model
    return Model(model.hashes, model.scores, model.sure, lam, model.k, _logistic(squash(seen["best"].to_numpy(), seen["total"].to_numpy()), seen["toxic"].to_numpy(float)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted, segments; map-only."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for part in slices(batches, "text"):
            n_words, best, total, segments = _features(own, part)
            p = 1 / (1 + np.exp(-np.clip(own.weights[0] + squash(best, total) @ np.array(own.weights[1:]), -30, 30)))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": p, "predicted": (p >= 0.5).astype(np.int32), "n_words": n_words,
                    "n_segments": pa.array([len(x) for x in segments], pa.int64()), "best": best, "segments": pa.array(segments, _SEGMENTS),
                }
            )

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    return only(docs, id_col, text_col).select("doc_id", "text", held_out).mapInArrow(run, SCORE_SCHEMA)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text the model does not reject; map-only."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def rejected(texts: pd.Series) -> pd.Series:
        own, out = sent.value, []
        column = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
        for part in slices(iter([column]), "text"):
            _, best, total, _ = _features(own, part)
            out.append(own.weights[0] + squash(best, total) @ np.array(own.weights[1:]) >= 0)
        return pd.Series(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.filter(~rejected(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, fit(docs, labels))
