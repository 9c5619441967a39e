"""Operator 2 - mixing sources to target weights by soft membership.

1. A classifier is fitted on labelled rows (at most ``MAX_TRAIN``, chosen by hash): a
   multinomial naive Bayes over ``BUCKETS`` hashed words.  The domains are the classes of
   the label columns.  Each document gets a posterior over domains; the evidence of long
   texts is scaled to that of ``EVIDENCE`` words, so that membership stays soft.
2. A rate r_d >= ``least`` is found for every document, such that the expected tokens of
   each domain, sum_d r_d n_d p_dk, come as near as they can, in least squares relative to
   the domain's tokens S_k, to the target T_k.  First the nearest point to the targets that
   any rates reach is found (``_nearest``): expected tokens are least S plus a point of the
   cone of the posteriors, onto which the targets are projected; a pass over the documents
   gives the posterior that a better point needs most, and the duality gap ends the search.
   Then Newton's method finds the rates nearest to 1 (in the metric n_d) that reach this
   point (``_multipliers``): r_d = max(least, 1 + sum_k p_dk mu_k), one number mu_k a domain.
   Each pass is one aggregation to a few sums a domain over the narrow table of memberships;
   no rates are moved.  Expected tokens end within ``CLOSE`` of all tokens of the nearest
   point; where that misses the targets by more, ``solve`` warns, and ``Rates.missed`` tells.
3. A rate becomes copies: its whole part, and one more with the fraction as chance, by a
   hash of the id and a seed.

Everything is DataFrame functions; texts are never shuffled.  Defined results: null and
empty texts have no tokens and the prior as posterior; null labels make no labelled row,
of several labels of one id the least by value counts; repeated rows are judged one by
one and get the same copies; a null id counts as id 0 in the hash; without labelled rows
there is one domain "all" and the rates meet the total; domains without a target have
target 0, and where no named target is a domain the targets are the shares at hand; an
empty table gives an empty result; extra columns are ignored, ``resample`` keeps them.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftscope.llm.common import durable, only, table

#: Bound of the labelled sample that the classifier is fitted on.
MAX_TRAIN = 50_000
BUCKETS = 4096
EVIDENCE = 64
SMOOTH = 1.0
#: Distance from the best expected tokens, as a share of all tokens, that ends the solver.
CLOSE = 1e-4
#: Target shares of tokens by domain.
TARGETS = {"quality=1,toxic=0": 0.85, "quality=0,toxic=0": 0.10, "quality=1,toxic=1": 0.05}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _buckets(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.pmod(F.hash(w), F.lit(BUCKETS)))


@dataclass
class Classifier:
    """Domains, log priors and log-odds of each bucket against the first domain."""

    domains: list[str]
    prior: list[float]
    odds: list[list[float]] = field(default_factory=list)

    def membership(self, df: DataFrame, text_col: str, n_col: str, p_col: str) -> DataFrame:
        """Adds the number of words and the posterior array of a text column.

        Each step is a projection of its own, so that none is computed twice.
        """
        if len(self.domains) == 1:
            return df.withColumn(n_col, F.size(words(F.col(text_col))).cast("long")).withColumn(p_col, F.array(F.lit(1.0)))
        own = df.withColumn("_buckets", _buckets(F.col(text_col))).withColumn(n_col, F.size("_buckets").cast("long"))
        own = own.withColumn("_scale", F.least(F.lit(1.0), F.lit(float(EVIDENCE)) / F.greatest(F.col(n_col), F.lit(1))))
        logits = [F.lit(self.prior[0])]
        for prior, odds in zip(self.prior[1:], self.odds):
            held = F.expr(f"array({','.join(f'{x!r}D' for x in odds)})")  # folded to one constant
            logits.append(F.lit(prior) + F.col("_scale") * F.aggregate("_buckets", F.lit(0.0), lambda a, b: a + F.get(held, b)))
        own = own.withColumn("_logits", F.array(*logits)).withColumn("_top", F.array_max("_logits"))
        own = own.withColumn("_odds", F.transform("_logits", lambda x: F.exp(x - F.col("_top"))))
        own = own.withColumn("_sum", F.aggregate("_odds", F.lit(0.0), lambda a, x: a + x))
        return own.withColumn(p_col, F.transform("_odds", lambda x: x / F.col("_sum"))).drop("_buckets", "_scale", "_logits", "_top", "_odds", "_sum")


def fit(docs: DataFrame, labels: DataFrame, label_cols: tuple[str, ...] = ("quality", "toxic"), id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> Classifier:
    name = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.col(f"`{c}`").cast("string")) for c in label_cols])
    known = labels.dropna(subset=[id_col, *label_cols]).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), name.alias("domain"))
    known = known.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    known = durable(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    own = only(docs, id_col, text_col).join(F.broadcast(known), "doc_id")  # max_train narrow rows at most
    sizes = {r.domain: r.n for r in own.groupBy("domain").agg(F.count("*").alias("n")).collect()}  # a row a class
    domains = sorted(sizes, key=lambda d: (-sizes[d], d))
    if len(domains) < 2:
        return Classifier(["all"], [0.0])
    total = sum(sizes.values())
    prior = F.create_map(*[F.lit(x) for d in domains for x in (d, domains.index(d))])
    counts = own.select(F.element_at(prior, F.col("domain")).alias("k"), F.explode(_buckets(F.col("text"))).alias("b"))
    found = counts.groupBy("k", "b").agg(F.count("*").alias("n")).collect()  # BUCKETS rows a class at most
    table_ = [[SMOOTH] * BUCKETS for _ in domains]
    for r in found:
        table_[r.k][r.b] += r.n


    sums = [sum(t) for t in table_]
    odds = [[round(math.log(x / sums[k]) - math.log(y / sums[0]), 6) for x, y in zip(table_[k], table_[0])] for k in range(1, len(domains))]
    return Classifier(domains, [math.log(sizes[d] / total) for d in domains], odds)


def _dot(posterior: Column, weights: list[float]) -> Column:
    held = F.expr(f"array({','.join(f'{float(x)!r}D' for x in weights)})")
    return F.aggregate(F.zip_with(posterior, held, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)


@dataclass
class Rates:
    """A document's rate from its posterior: max(least, start + sum_k p_k mu_k)."""

    domains: list[str]
    least: float
    mu: list[float]
    expected: dict[str, float]
    target: dict[str, float]

    def rate(self, posterior: Column) -> Column:
        """The rate of a document with this posterior."""
        return F.greatest(F.lit(float(self.least)), F.lit(max(1.0, float(self.least))) + _dot(posterior, self.mu))

    @property
    def missed(self) -> dict[str, float]:
        """Expected less target tokens of each domain."""
        return {d: self.expected[d] - self.target[d] for d in self.domains}


def _nonnegative(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares a w = b with w >= 0 (Lawson and Hanson)."""
    w, on = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    while True:
        grad = a.T @ (b - a @ w)
        grad[on] = -np.inf
        if on.all() or grad.max() <= 1e-13 * np.linalg.norm(b):
            return w
        on[grad.argmax()] = True
        newest = int(grad.argmax())
        while True:
            z = np.zeros(len(w))
            z[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if z[newest] <= 0 and w[newest] == 0:  # rounding: no way down
                return w
            if (z[on] > 0).all():
                break
            out = on & (z <= 0)
            t = (w[out] / (w[out] - z[out])).min()
            w = np.where(on, w + t * (z - w), 0.0)
            on &= w > 1e-15 * w.max()
            w[~on] = 0.0
        w = z


def _nearest(sizes: np.ndarray, goal: np.ndarray, least: float, worst: Callable[[np.ndarray], tuple[float, np.ndarray]]) -> np.ndarray:
    """The expected tokens nearest to the goal that rates >= least reach.

    ``worst(x)``: the least p.x of all documents with tokens, and its p.
    """
    tokens, root = sizes.sum(), np.sqrt(sizes)
    excess = goal - least * sizes
    near, points = CLOSE / 4 * tokens, np.zeros((len(sizes), 0))
    reached = np.zeros(len(sizes))
    while np.abs(reached - excess).max() > near:
        slope = (reached - excess) / sizes
        low, point = worst(slope)
        low = max(0.0, -low)
        # a bound of the loss above the least; as the loss is strongly convex, of the distance too
        if low * reached.sum() + low * low * tokens / 2 <= near * near / (2 * sizes.max()):
            break
        points = np.column_stack([points, point])
        w = _nonnegative(points / root[:, None], excess / root)
        better = points @ w
        if ((better - excess) ** 2 / sizes).sum() >= ((reached - excess) ** 2 / sizes).sum() * (1 - 1e-12):  # rounding
            break
        reached, points = better, points[:, w > 0]
    return reached + least * sizes


def _multipliers(sizes: np.ndarray, reach: np.ndarray, sums: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]]) -> np.ndarray:
    """mu of the rates nearest to 1 that reach these expected tokens.

    ``sums(mu)``: the sums over documents of n times the integral of the rate over p.mu, of
    expected tokens, and of n p p' where the rate is above the least.  The dual is convex; it
    is solved with a penalty whose weight grows until the tokens are reached.
    """
    near = CLOSE / 2 * sizes.sum()
    mu, weight = np.zeros(len(sizes)), 100.0
    value, tokens, curve = sums(mu)
    while np.abs(tokens - reach).max() > near:
        slope = tokens - reach + sizes * mu / weight
        if np.abs(slope).max() <= near / 2:
            weight *= 100
            if weight > 1e16:  # rounding; the caller compares
                return mu
            continue
        step = -np.linalg.solve(curve + np.diag(sizes / weight), slope)
        now, length = value - reach @ mu + (sizes * mu * mu).sum() / weight / 2, 1.0
        while True:
            to = mu + length * step
            value, tokens, curve = sums(to)
            if value - reach @ to + (sizes * to * to).sum() / weight / 2 <= now + 1e-4 * length * (slope @ step) + 1e-13 * abs(now):
                break
            length /= 2
            if length < 1e-12:
                return mu
        mu = to
    # a step without the penalty, mostly exact
    to = mu - np.linalg.lstsq(curve, tokens - reach, rcond=1e-9)[0]
    return to if np.abs(sums(to)[1] - reach).max() < np.abs(tokens - reach).max() else mu


def solve(members: DataFrame, domains: list[str], targets: dict[str, float], total: float | str = 1.0, least: float = 0.0) -> Rates:
    """Least squares over (n, p) rows.

    ``total``: expected tokens as a multiple of those at hand, or "cover": the least
    multiple at which no domain has to shrink.
    """
    k = range(len(domains))
    have = members.agg(*[F.coalesce(F.sum(F.col("n") * F.get("p", F.lit(i))), F.lit(0.0)).alias(f"s{i}") for i in k]).first()
    sizes = [float(have[i]) for i in k]
    tokens = sum(sizes)
    weight = [max(0.0, targets.get(d, 0.0)) for d in domains]
    if sum(weight) <= 0:
        weight = sizes if tokens else [1.0] * len(domains)
    share = [w / sum(weight) for w in weight]
    scale = max([sizes[i] / (tokens * share[i]) for i in k if share[i] > 0], default=1.0) if total == "cover" and tokens else 1.0 if total == "cover" else float(total)
    goal = [scale * tokens * x for x in share]
    found = Rates(list(domains), least, [0.0] * len(domains), dict(zip(domains, sizes)), dict(zip(domains, goal)))
    if not tokens:
        return found
    held = [i for i in k if sizes[i] > 0]  # a domain without tokens gets none
    start, own = max(1.0, float(least)), members.where("n > 0")

    def spread(x: np.ndarray) -> list[float]:
        out = [0.0] * len(domains)
        for i, v in zip(held, x.tolist()):
            out[i] = v
        return out

    def worst(x: np.ndarray) -> tuple[float, np.ndarray]:
        row = own.select("p", _dot(F.col("p"), spread(x)).alias("x")).agg(F.min("x").alias("x"), F.min_by("p", "x").alias("p")).first()
        return float(row.x), np.array(row.p)[held]

    def sums(mu: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        n, x = F.col("n"), F.col("x")
        over = x > least - start
        area = F.when(over, start * x + x * x / 2).otherwise(least * x - (start - least) ** 2 / 2)
        narrow = own.select("n", _dot(F.col("p"), spread(mu)).alias("x"), *[F.get("p", F.lit(i)).alias(f"p{i}") for i in held])
        pairs = [(i, j) for i in held for j in held if i <= j]
        row = narrow.agg(
            F.sum(n * area), *[F.sum(n * F.greatest(F.lit(float(least)), start + x) * F.col(f"p{i}")) for i in held],
            *[F.sum(F.when(over, n * F.col(f"p{i}") * F.col(f"p{j}")).otherwise(0.0)) for i, j in pairs],
        ).first()
        curve = np.zeros((len(held), len(held)))
        for (i, j), v in zip(pairs, row[1 + len(held) :]):
            curve[held.index(i), held.index(j)] = curve[held.index(j), held.index(i)] = v
        return float(row[0]), np.array(row[1 : 1 + len(held)], float), curve

    size = np.array(sizes)[held]
    reach = _nearest(size, np.array(goal)[held], float(least), worst)
    found.mu = spread(_multipliers(size, reach, sums))
    last = members.select("n", "p", found.rate(F.col("p")).alias("r")).agg(*[F.sum(F.col("n") * F.col("r") * F.get("p", F.lit(i))) for i in k]).first()
    found.expected = dict(zip(domains, map(float, last)))
    if max(map(abs, found.missed.values())) > CLOSE * tokens:
        nearest = dict(zip(domains, spread(reach)))
        warnings.warn(f"mixing misses its targets: expected {found.expected}, nearest that rates >= {least} reach {nearest}, target {found.target}", stacklevel=2)
    return found


def copies(rate: Column, doc_id: Column, seed: int = 7) -> Column:
    chance = F.pmod(F.xxhash64(F.coalesce(doc_id.cast("long"), F.lit(0).cast("long")), F.lit(seed)), F.lit(1 << 30).cast("long")) / float(1 << 30)
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def members(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return durable(model.membership(only(docs, id_col, text_col), "text", "n", "p").select("doc_id", "n", "p"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, total: float | str = 1.0, least: float = 0.0, label_cols: tuple[str, ...] = ("quality", "toxic"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, domain (the likeliest), posterior (by domain), rate, copies."""
    model = fit(docs, labels, label_cols, id_col, text_col)
    own = members(docs, model, id_col, text_col)
    rates = solve(own, model.domains, targets, total, least)
    own = own.withColumn("rate", rates.rate(F.col("p")))
    names = F.array(*[F.lit(d) for d in model.domains])
    return own.select(
        "doc_id", F.col("n").alias("n_tokens"), F.get(names, (F.array_position("p", F.array_max("p")) - 1).cast("int")).alias("domain"),
        F.map_from_arrays(names, F.col("p")).alias("posterior"), "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"),
    )


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, total: float | str = 1.0, least: float = 0.0, label_cols: tuple[str, ...] = ("quality", "toxic"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, each as often as its copies; a text is read again rather than moved."""
    model = fit(docs, labels, label_cols, id_col, text_col)
    rates = solve(members(docs, model, id_col, text_col), model.domains, targets, total, least)
    names = docs.columns
    flat = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("row"), F.col(f"`{id_col}`").alias("own_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("own_text"))
    flat = model.membership(flat, "own_text", "n", "p").withColumn("rate", rates.rate(F.col("p")))
    flat = flat.withColumn("copies", copies(F.col("rate"), F.col("own_id")).cast("int"))
    flat = flat.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("time"))
    return flat.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
