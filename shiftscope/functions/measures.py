"""Distance measures between two aligned distributions, as column expressions.

A measure works on rows (pa, pb), the shares of one item in two periods.  ``score``
aggregates the rows of a pair, ``part`` is one item's contribution, written over windows
of the pair where it needs sums.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Measure:
    """name and label, ``score(pa, pb)`` (an aggregate) and ``part(pa, pb, window)`` (a row expression)."""

    name: str
    label: str
    score: Callable[[Column, Column], Column]
    part: Callable[[Column, Column, Window], Column]

    @property
    def weighted_name(self) -> str:
        return f"weighted_{self.name}"


def _entropy_term(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)


def _jsd_part(pa: Column, pb: Column, window=None) -> Column:
    m = (pa + pb) / 2
    return 0.5 * (_entropy_term(pa, m) + _entropy_term(pb, m))


def _tvd_part(pa: Column, pb: Column, window=None) -> Column:
    return 0.5 * F.abs(pa - pb)


def _cosine(pa: Column, pb: Column) -> Column:
    norm = F.sqrt(F.sum(pa * pa) * F.sum(pb * pb))
    return F.when(norm > 0, 1 - F.sum(pa * pb) / norm)


def _cosine_part(pa: Column, pb: Column, window) -> Column:
    norm = F.sqrt(F.sum(pa * pa).over(window) * F.sum(pb * pb).over(window))
    return 1 / F.count(F.lit(1)).over(window) - pa * pb / norm


MEASURES = {
    "jsd": Measure("jsd", "Jensen-Shannon divergence", lambda a, b: F.greatest(F.sum(_jsd_part(a, b)), F.lit(0.0)), _jsd_part),
    "tvd": Measure("tvd", "Total variation distance", lambda a, b: F.sum(_tvd_part(a, b)), _tvd_part),
    "cosine": Measure("cosine", "Cosine distance", _cosine, _cosine_part),
}


def measure(which: str | Measure) -> Measure:
    """A registered measure by name (in any case) or a measure itself."""
    if isinstance(which, Measure):
        return which
    found = MEASURES.get(str(which).strip().lower())
    if found is None:
        raise ValueError(f"unknown measure {which!r}; known: {', '.join(sorted(MEASURES))}")
    return found


def register(new: Measure) -> None:
    MEASURES[new.name.lower()] = new


def direction(pa: Column, pb: Column) -> Column:
    """bo (born), lo (lost), '' (neutral), in (increase), de (decrease)."""
    return F.when((pa == 0) & (pb > 0), "bo").when((pa > 0) & (pb == 0), "lo").when(pa == pb, "").when(pb > pa, "in").otherwise("de")


def labelled(way: Column, item: Column) -> Column:
    return F.when(way == "", item).otherwise(F.concat_ws("_", way, item))
