"""The two template languages, parsed once on the driver.

Relations: ``> (rel, [POS, ...]) > (rel, []) & > (rel, [])`` - required paths joined by &,
each a chain of steps; an empty list allows any part of speech.  Constructions:
``(POS) & > (rel, [...]) & ...`` - an anchor and at least one path.  Slot columns:
``[a][b > c][d | e]``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_STEP = re.compile(r"\(\s*([^\s,()\[\]]+)\s*,\s*\[([^\[\]()]*)\]\s*\)")
_ANCHOR = re.compile(r"\(\s*([^\s,()\[\]]+)\s*\)")


@dataclass(frozen=True)
class Step:
    relation: str
    pos: tuple[str, ...] | None


@dataclass(frozen=True)
class Template:
    paths: tuple[tuple[Step, ...], ...]
    anchor: str | None = None


def _path(text: str) -> tuple[Step, ...]:
    text = text.strip()
    if not text.startswith(">"):
        raise ValueError(f"a path starts with '>': {text!r}")
    steps = []
    for part in text[1:].split(">"):
        m = _STEP.fullmatch(part.strip())
        if m is None:
            raise ValueError(f"a step is (relation, [POS, ...]): {part.strip()!r}")
        pos = tuple(p.strip() for p in m[2].split(",") if p.strip())
        steps.append(Step(m[1], pos or None))
    return tuple(steps)


def relation_template(text: str) -> Template:
    parts = [p for p in text.split("&")]
    if not text.strip() or any(not p.strip() for p in parts):
        raise ValueError("an empty template or path")
    return Template(tuple(_path(p) for p in parts))


def construction_template(text: str) -> Template:
    first, *rest = text.split("&")
    m = _ANCHOR.fullmatch(first.strip())
    if m is None:
        raise ValueError(f"a construction starts with (POS): {first.strip()!r}")
    if not rest:
        raise ValueError("a construction needs a path")
    return Template(tuple(_path(p) for p in rest), m[1])


def slot_columns(text: str) -> list[tuple[str, list[list[str]]]]:
    """``[a][b > c][d | e]`` as (name, alternative chains of relations)."""
    found = re.findall(r"\[([^\[\]]*)\]", text)
    if not found or re.sub(r"\[[^\[\]]*\]", "", text).strip():
        raise ValueError(f"slots are written [a][b > c]: {text!r}")
    out = []
    for name in found:
        chains = [[s.strip() for s in alt.split(">") if s.strip()] for alt in name.split("|")]
        if any(not c for c in chains):
            raise ValueError(f"an empty slot in {name!r}")
        out.append((name.strip(), chains))
    return out
