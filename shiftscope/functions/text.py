"""Scalar functions of the parsed-corpus model, as column expressions."""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("token", "lemma", "token/pos", "lemma/pos", "token/deprel", "lemma/deprel")


def filler(fmt: str = "lemma", form="form", lemma="lemma", pos="pos", deprel="deprel") -> Column:
    """A token shown in one of the six filler formats."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown filler format {fmt!r}; known: {', '.join(FORMATS)}")
    head, _, tail = fmt.partition("/")
    first = F.col(form) if head == "token" else F.col(lemma)
    if not tail:
        return first
    return F.concat_ws("/", first, F.col(pos) if tail == "pos" else F.col(deprel))


def anchor_filler(fmt: str = "lemma") -> Column:
    """An anchor has no relation of its own, so a deprel format shows its part of speech."""
    return filler(fmt.replace("/deprel", "/pos"))


def bare_relation(label: Column) -> Column:
    return F.regexp_replace(label, "^(chi_|pa_)", "")


def feature_types(feats: Column) -> Column:
    """Types of ``A=x|B=y``; empty spellings and parts without = have none; an empty value still has a type."""
    parts = F.filter(F.split(feats, r"\|"), lambda x: F.contains(x, F.lit("=")))
    return F.coalesce(F.transform(parts, lambda x: F.split_part(x, F.lit("="), F.lit(1))), F.array().cast("array<string>"))


def feature_values(feats: Column) -> Column:
    """(type, value) structs; a part without a value is dropped, repeats stay."""
    parts = F.filter(F.split(feats, r"\|"), lambda x: F.contains(x, F.lit("=")))
    pairs = F.transform(parts, lambda x: F.struct(F.substring_index(x, "=", 1).alias("type"), F.substr(x, F.locate("=", x) + 1).alias("value")))
    return F.filter(pairs, lambda p: (p["type"] != "") & (p["value"] != ""))


def trimmed(slots: Column, excluded: list[str]) -> Column:
    """Each path cut before its first excluded relation; emptied paths go. Paths are ``> a > b`` strings."""
    bad = F.array(*[F.lit(x) for x in excluded]) if excluded else F.array().cast("array<string>")

    def cut(path: Column) -> Column:
        steps = F.filter(F.transform(F.split(path, ">"), lambda x: F.trim(x)), lambda s: s != "")
        kept = F.aggregate(steps, F.struct(F.array().cast("array<string>").alias("a"), F.lit(True).alias("on")), lambda acc, s: F.struct(F.when(acc["on"] & ~F.array_contains(bad, s), F.concat(acc["a"], F.array(s))).otherwise(acc["a"]).alias("a"), (acc["on"] & ~F.array_contains(bad, s)).alias("on")))
        return F.when(F.size(kept["a"]) > 0, F.concat(F.lit("> "), F.array_join(kept["a"], " > "))).otherwise("")

    return F.filter(F.transform(slots, cut), lambda s: s != "")


def first_level(slot: Column) -> Column:
    return F.trim(F.split_part(F.regexp_replace(F.trim(slot), "^>+", ""), F.lit(">"), F.lit(1)))


def construction(slots: Column) -> Column:
    """The canonical name of a set of slots."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(slots, lambda s: s.isNotNull() & (s != "")))), " & ")


def transition(a: str = "period_1", b: str = "period_2") -> Column:
    return F.concat_ws(" vs ", a, b)


def parse_cell(text: str | None) -> list[list[str]]:
    """Filler items of a written cell: Python literals, with None, NaN, '' and scalars tolerated."""
    if text is None or text.strip() in ("", "[]", "nan", "NaN", "None", "<NA>"):
        return []
    try:
        value = ast.literal_eval(text)
    except (ValueError, SyntaxError):
        value = text
    if isinstance(value, tuple):
        value = [value]
    if not isinstance(value, list):
        value = [value]
    return [[str(x) for x in v] if isinstance(v, (list, tuple)) else [str(v)] for v in value]


def show_cell(items: list[list[str]] | None) -> str:
    return repr([tuple(x) for x in items or []])


@F.udf(T.ArrayType(T.ArrayType(T.StringType())), useArrow=True)
def cell_items(text):
    return parse_cell(text)


@F.udf(T.StringType(), useArrow=True)
def cell_text(items):
    return show_cell([list(x) for x in items] if items is not None else None)


def slot_value(item: Column) -> Column:
    """The only element of an item without its last /suffix; longer items are an error."""
    one = F.when(F.size(item) == 1, F.get(item, 0)).otherwise(F.raise_error(F.lit("a slot value must have one element")).cast("string"))
    return F.regexp_replace(one, "/[^/]*$", "")


def unit(vec: Column) -> Column:
    """A vector at length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(vec, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def marker_size(count: Column, window, small: float = 6.0, large: float = 24.0) -> Column:
    """Min-max scale of counts for plots; a constant is halfway."""
    low, high = F.min(count).over(window), F.max(count).over(window)
    return F.when(high > low, small + (count - low) / (high - low) * (large - small)).otherwise((small + large) / 2)
