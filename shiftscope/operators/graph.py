"""Dependency graphs as edges, and the walks over them.

A sentence is keyed by (period, file, sent_seq).  Edges run both ways: ``chi_<rel>`` from
head to dependent, ``pa_<rel>`` back.  Searches walk inside packed sentences (see
``operators.packed``) and shuffle no edges.  Where edges are given as a relation, a walk joins
its rows with them on (sentence, node), once for each step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftscope.operators.packed import SENT, Search, packed, search
from shiftscope.plans.templates import Step, Template

TARGET = [*SENT, "target"]


def edges(tokens: DataFrame) -> DataFrame:
    """(sentence, src, dst, label, dst_pos); a head 0 adds none. The part of speech is known where a step goes to the dependent."""
    own = tokens.where((F.col("head") != "0") & F.col("head").isNotNull())
    down = F.struct(F.col("head").alias("src"), F.col("id").alias("dst"), F.concat(F.lit("chi_"), "deprel").alias("label"), F.col("pos").alias("dst_pos"))
    up = F.struct(F.col("id").alias("src"), F.col("head").alias("dst"), F.concat(F.lit("pa_"), "deprel").alias("label"), F.lit(None).cast("string").alias("dst_pos"))
    return own.select(*SENT, F.explode(F.array(down, up)).alias("e")).select(*SENT, "e.*")


def dangling(tokens: DataFrame) -> DataFrame:
    """Tokens whose head is no token of the sentence (they take part in no join)."""
    heads = tokens.select(*SENT, F.col("id").alias("head"))
    return tokens.where("head <> '0'").join(heads, [*SENT, "head"], "left_anti")


def targets(tokens: DataFrame, lemma: str | None = None, pos: str | None = None) -> DataFrame:
    own = tokens
    if lemma is not None:
        own = own.where(F.col("lemma") == lemma)
    if pos is not None:
        own = own.where(F.col("pos") == pos)
    return own.select(*SENT, F.col("id").alias("target"))


def near(tokens: DataFrame, which: DataFrame) -> DataFrame:
    """Tokens of the sentences that hold a target: the search space of every walk."""
    return tokens.join(which.select(*SENT).distinct(), SENT, "left_semi")


def walks(which: DataFrame, links: DataFrame, depth: int, prefixes: bool = False) -> DataFrame:
    """(target, seen, labels) of the walks of depth steps and of shorter ones that cannot go on, or of all of 1..depth steps."""
    out = links.select(*SENT, F.col("src").alias("node"), "dst", "label")
    rows = which.select(*TARGET, F.col("target").alias("node"), F.array("target").alias("seen"), F.array().cast("array<string>").alias("labels"), F.lit(True).alias("open"))
    for i in range(depth):
        on = [rows[c] == out[c] for c in [*SENT, "node"]] + [rows["open"], ~F.array_contains(rows["seen"], out["dst"])]
        met = rows.join(out, on, "left").select(*[rows[c] for c in TARGET], rows["node"], "seen", "labels", "open", "dst", "label")
        went = F.col("dst").isNotNull()
        if prefixes:
            met = met.where(went | ~F.col("open"))
        rows = met.select(
            *TARGET, F.coalesce("dst", "node").alias("node"), F.when(went, F.concat("seen", F.array("dst"))).otherwise(F.col("seen")).alias("seen"),
            F.when(went, F.concat("labels", F.array("label"))).otherwise(F.col("labels")).alias("labels"), went.alias("open"),
        )
        if prefixes and i + 1 < depth:  # what a step reached is a result, and goes on
            both = F.when(F.col("open"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
            rows = rows.select(*TARGET, "node", "seen", "labels", F.explode(both).alias("open"))
    return rows.select(*TARGET, "seen", "labels").where(F.size("labels") > 0)


def _named(frame: DataFrame) -> DataFrame:
    return frame.withColumn("path", F.concat(F.lit("> "), F.array_join("labels", " > ")))


def prefix_paths(which: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """Every path of 1..depth steps from a target, each occurrence a row."""
    return _named(walks(which, links, depth, prefixes=True))


def terminal_paths(which: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """Paths of depth steps, and shorter ones that cannot go on."""
    return _named(walks(which, links, depth))


def follow(which: DataFrame, links: DataFrame, labels: list[str]) -> DataFrame:
    """Nodes of the label sequence; steps may return to nodes already seen."""
    found = along(which, links, [[Step(x, None) for x in labels]], visited=False)
    return found.select(*TARGET, F.element_at("seen", -1).alias("node"), "seen", "labels")


def along(which: DataFrame, links: DataFrame, chains: list, visited: bool = True) -> DataFrame:
    """(target, path_ix, seen, labels) of the walks along chains of steps, all in one.

    A step's part of speech is tested where the edge tells it.
    """
    names = sorted({s.relation for c in chains for s in c})
    out = links.where(F.col("label").isin(names)).select(*SENT, F.col("src").alias("node"), F.col("label").alias("rel"), "dst", "dst_pos")
    step = lambda s: F.struct(F.lit(s.relation).alias("rel"), (F.array(*[F.lit(p) for p in s.pos]) if s.pos else F.lit(None).cast("array<string>")).alias("fit"))
    listed = F.array(*[F.struct(F.lit(i).alias("path_ix"), F.array(*[step(s) for s in c]).alias("steps")) for i, c in enumerate(chains)])
    none = F.array().cast("array<string>")
    rows = which.select(*TARGET, F.explode(listed).alias("c")).select(*TARGET, F.col("target").alias("node"), "c.path_ix", "c.steps", F.array("target").alias("seen"), none.alias("labels"))
    for i in range(max(len(c) for c in chains)):
        # a row at its end asks for a relation that no edge has
        rows = rows.withColumn("rel", F.coalesce(F.get("steps", i)["rel"], F.lit("")))
        on = [rows[c] == out[c] for c in [*SENT, "node", "rel"]]
        fit = F.get(rows["steps"], i)["fit"]
        on.append(fit.isNull() | out["dst_pos"].isNull() | F.array_contains(fit, out["dst_pos"]))
        if visited:
            on.append(~F.array_contains(rows["seen"], out["dst"]))
        alike = len({len(c) for c in chains}) == 1
        met = rows.join(out, on, "inner" if alike else "left").select(*[rows[c] for c in TARGET], rows["node"], "path_ix", "steps", "seen", "labels", rows["rel"], "dst")
        met = met if alike else met.where(F.col("dst").isNotNull() | (F.col("rel") == ""))
        went = F.col("dst").isNotNull()
        rows = met.select(
            *TARGET, F.coalesce("dst", "node").alias("node"), "path_ix", "steps", F.when(went, F.concat("seen", F.array("dst"))).otherwise(F.col("seen")).alias("seen"),
            F.when(went, F.concat("labels", F.array("rel"))).otherwise(F.col("labels")).alias("labels"),
        )
    return rows.select(*TARGET, "path_ix", "seen", "labels")


def matched(which: DataFrame, tokens: DataFrame, template: Template, mode: str = "open") -> DataFrame:
    """(target, path_ix, seen, labels), distinct, of the targets that fit the template.

    open: every path has a match; closeh: besides, the target's own relations are exactly the
    first steps; close: some choice of one match a path explains every relation of every
    node in it, and only the matches of such choices count.
    """
    listed = which.groupBy(*SENT).agg(F.collect_set("target").alias("targets"))
    own = packed(tokens).join(listed, SENT)
    found = search(own, Search(listed=True, chains=template.paths, mode=_mode(mode)))
    return found.select(*TARGET, F.explode("found").alias("x")).select(*TARGET, "x.path_ix", "x.seen", "x.labels").distinct()


def _mode(mode: str) -> str:
    if mode not in ("open", "closeh", "close"):
        raise ValueError("mode must be open, closeh or close")
    return mode


def paths(tokens: DataFrame, lemma: str | None = None, pos: str | None = None, depth: int = 2, prefixes: bool = False) -> DataFrame:
    """(target, paths) of each target: names of its terminal paths, or of all of 1..depth steps, each occurrence one."""
    return search(tokens, Search(lemma, pos, depth=depth, prefixes=prefixes))


def sentences(tokens: DataFrame) -> DataFrame:
    place = F.col("id").cast("int")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("i"), "form"))), lambda x: x["form"]), " ")
    return tokens.groupBy(*SENT).agg(F.min("sent_id").alias("sentence_id") if "sent_id" in tokens.columns else F.lit(None).cast("string").alias("sentence_id"), text.alias("sentence"))


def _reached(found: DataFrame) -> DataFrame:
    """A row for each node of each distinct match, with its filler and the path to it."""
    node = lambda m: F.transform(m["shown"], lambda w, i: F.struct(F.get(m["seen"], i + 1).alias("id"), w.alias("sfillers"), F.concat(F.lit("> "), F.array_join(F.slice(m["labels"], F.lit(1), i + 1), " > ")).alias("path")))
    own = F.array_distinct(F.transform("found", lambda m: F.struct(m["seen"], m["labels"], m["shown"])))
    return found.withColumn("nodes", F.flatten(F.transform(own, node)))


def relation_search(tokens: DataFrame, template: Template, lemma: str, pos: str | None = None, mode: str = "open", fmt: str = "lemma") -> DataFrame:
    """(sentence, target, id, sfillers, path) of each node reached; one path is always open. Tokens, or sentences packed."""
    mode = "open" if len(template.paths) == 1 else _mode(mode)
    rows = _reached(search(tokens, Search(lemma, pos, chains=template.paths, mode=mode, fmt=fmt)))
    return rows.select(*TARGET, F.explode("nodes").alias("x")).select(*TARGET, "x.id", "x.sfillers", "x.path").where("sfillers IS NOT NULL")


def construction_search(tokens: DataFrame, template: Template, mode: str = "open", fmt: str = "lemma") -> DataFrame:
    """The same around an anchor of the template's part of speech, with a row for the anchor."""
    rows = _reached(search(tokens, Search(pos=template.anchor, chains=template.paths, mode=_mode(mode), fmt=fmt)))
    anchor = F.struct(F.col("target").alias("id"), F.col("anchor").alias("sfillers"), F.lit(template.anchor).alias("path"))
    return rows.select(*TARGET, F.explode(F.concat(F.array(anchor), "nodes")).alias("x")).select(*TARGET, "x.id", "x.sfillers", "x.path").where("sfillers IS NOT NULL")


def with_sentences(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    return rows.join(sentences(tokens), SENT)
