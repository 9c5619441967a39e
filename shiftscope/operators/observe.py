"""Builders of the long observation relation and of construction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftscope.functions.text import construction, feature_types, feature_values, first_level, trimmed
from shiftscope.operators import graph
from shiftscope.operators.graph import SENT, TARGET
from shiftscope.operators.packed import Search, search
from shiftscope.plans.templates import Step, slot_columns


def from_table(frame: DataFrame, period, slots: dict[str, str], id_col: str, target: str = "") -> DataFrame:
    """Categorical columns of any table as observations: each column is a slot."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("slot"), F.col(c).cast("string").alias("item")) for n, c in slots.items()])).alias("x")
    return frame.select(F.col(id_col).cast("string").alias("id"), period.cast("string").alias("period"), F.lit(target).alias("target"), each).select("id", "period", "target", "x.slot", "x.item")


def path_counts(tokens: DataFrame, lemma: str, pos: str | None = None, depth: int = 2) -> DataFrame:
    """(period, slot, count) of every path of up to depth steps from the target."""
    each = graph.paths(tokens, lemma, pos, depth, prefixes=True).select("period", F.explode("paths").alias("slot"))
    return each.groupBy("period", "slot").agg(F.count("*").alias("count"))


def path_combos(tokens: DataFrame, lemma: str, pos: str | None = None, depth: int = 1, excluded: list[str] | None = None) -> DataFrame:
    """(period, target, slots, frequency): sets of terminal paths of each occurrence.

    With exclusions an occurrence whose set is emptied goes; without, one with no path counts.
    """
    own = graph.paths(tokens, lemma, pos, depth).select("period", F.array_sort(F.array_distinct("paths")).alias("slots"))
    if excluded is not None:
        own = own.withColumn("slots", F.array_sort(F.array_distinct(trimmed(F.col("slots"), excluded)))).where(F.size("slots") > 0)
    return own.groupBy("period", F.lit(lemma).alias("target"), "slots").agg(F.count("*").alias("frequency"))


def slot_fillers(tokens: DataFrame, slots: str, lemma: str, pos: str | None = None, fmt: str = "lemma", filtered_pos: list[str] | None = None) -> DataFrame:
    """(id, period, target, slot, item): item is the fillers along one chain; a filtered part of speech leaves the chain, an empty chain goes."""
    listed = [(name, chain) for name, chains in slot_columns(slots) for chain in chains]
    chains = tuple(tuple(Step(x, None) for x in chain) for _, chain in listed)
    found = search(tokens, Search(lemma, pos, chains=chains, visited=False, fmt=fmt, filtered_pos=tuple(filtered_pos or ())))
    own = F.array_distinct(F.transform("found", lambda m: F.struct(m["path_ix"], m["seen"], F.filter(m["shown"], lambda x: x.isNotNull()).alias("item"))))
    rows = found.select(*TARGET, F.explode(own).alias("x")).select(*TARGET, "x.path_ix", "x.item").where(F.size("item") > 0)
    slot = F.get(F.array(*[F.lit(name) for name, _ in listed]), F.col("path_ix"))
    return rows.select(F.concat_ws("/", F.lit(lemma), "file", "sent_seq", "target").alias("id"), "period", F.lit(lemma).alias("target"), slot.alias("slot"), "item")


def wide(obs: DataFrame, slots: list[str] | None = None) -> DataFrame:
    """A row an id, a column a slot, each cell the list of items."""
    return obs.groupBy("id", "period", "target").pivot("slot", slots).agg(F.array_sort(F.collect_list("item")))


def long(frame: DataFrame, keys: tuple[str, ...] = ("id", "period", "target")) -> DataFrame:
    """The wide form back to one item a row."""
    slots = [c for c in frame.columns if c not in keys]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("slot"), F.col(f"`{c}`").alias("items")) for c in slots])).alias("x")
    return frame.select(*keys, each).select(*keys, F.col("x.slot").alias("slot"), F.explode("x.items").alias("item"))


def type_rows(counts: DataFrame, target: str, exclude: list[str] | None = None, expand: bool = False) -> DataFrame:
    """Counts (period, slot, count) as observations of the slot 'type', weighted or one row an occurrence."""
    own = counts.where(~F.col("slot").isin(exclude)) if exclude else counts
    obs = own.select("period", F.lit(target).alias("target"), F.lit("type").alias("slot"), F.col("slot").alias("item"), F.col("count").cast("long").alias("weight"))
    if not expand:
        return obs
    rows = obs.select("period", "target", "slot", "item", F.explode(F.expr("sequence(1, cast(weight as int))")).alias("_k"))
    n = F.row_number().over(Window.partitionBy("period").orderBy("item", "_k"))
    return rows.withColumn("id", F.concat_ws("_", "period", n)).drop("_k")


def construction_rows(combos: DataFrame) -> DataFrame:
    """Combos as weighted observations of the slot 'construction'; a negative or missing frequency is an error."""
    ok = F.when(F.col("frequency") >= 0, F.col("frequency")).otherwise(F.raise_error(F.lit("frequencies must be whole numbers from 0")).cast("long"))
    return combos.select("period", "target", F.lit("construction").alias("slot"), construction(F.col("slots")).alias("item"), ok.cast("long").alias("weight"))


def trim(combos: DataFrame, excluded: list[str]) -> DataFrame:
    return combos.withColumn("slots", trimmed(F.col("slots"), excluded))


def merge(combos: DataFrame) -> DataFrame:
    """Frequencies summed over equal sets of slots; emptied sets go."""
    own = combos.withColumn("slots", F.array_sort(F.array_distinct(F.filter("slots", lambda s: s != "")))).where(F.size("slots") > 0)
    return own.groupBy("period", "target", "slots").agg(F.sum("frequency").alias("frequency"))


def trim_and_merge(combos: DataFrame, excluded: list[str]) -> DataFrame:
    return merge(trim(combos, excluded))


def specialisations(combos: DataFrame) -> DataFrame:
    """(period, group_id, slot_combs, frequency, specialisations): combos by their set of first-level slots.

    Groups are numbered within a period, and their members listed, in the order in which the
    combos table has them: falling frequency, target, slots.  Combos without slots are in no group.
    """
    require(combos, "period", "frequency", "target", "slots")
    key = F.array_sort(F.array_distinct(F.transform("slots", first_level)))
    own = combos.where(F.size("slots") > 0).withColumn("slot_combs", key)
    member = F.struct((-F.col("frequency")).alias("k"), "target", F.col("slots").alias("specialisation"), "frequency")
    out = own.groupBy("period", "slot_combs").agg(F.sum("frequency").alias("frequency"), F.array_sort(F.collect_list(member)).alias("members"))
    first = F.get("members", 0)
    place = F.row_number().over(Window.partitionBy("period").orderBy(first["k"], first["target"], first["specialisation"]))
    members = F.transform("members", lambda m: F.struct(m["specialisation"].alias("specialisation"), m["frequency"].alias("frequency")))
    return out.withColumn("group_id", place).select("period", "group_id", "slot_combs", "frequency", members.alias("specialisations"))


def require(frame: DataFrame, *columns: str) -> None:
    """A table without one of the columns is an error."""
    missing = [c for c in columns if c not in frame.columns]
    if missing:
        raise ValueError(f"the table lacks the columns {missing}")


def feature_counts(tokens: DataFrame, lemma: str | None = None, pos: str | None = None) -> DataFrame:
    """(period, slot, count) of the target's feature types."""
    own = tokens.where(F.col("lemma") == lemma) if lemma is not None else tokens
    own = own.where(F.col("pos") == pos) if pos is not None else own
    return own.select("period", F.explode(feature_types(F.col("feats"))).alias("slot")).groupBy("period", "slot").agg(F.count("*").alias("count"))


def features(tokens: DataFrame, lemma: str | None = None, pos: str | None = None) -> DataFrame:
    """(id, period, target, slot, item): one row for each feature of each occurrence."""
    own = tokens.where(F.col("lemma") == lemma) if lemma is not None else tokens
    own = own.where(F.col("pos") == pos) if pos is not None else own
    each = own.select(F.concat_ws("/", "lemma", "file", "sent_seq", "id").alias("id"), "period", F.col("lemma").alias("target"), F.explode(feature_values(F.col("feats"))).alias("x"))
    return each.select("id", "period", "target", F.col("x.type").alias("slot"), F.col("x.value").alias("item"))


def formula_of(formula) -> dict[str, list[str]]:
    """A merge formula in any of its forms: {new: old or [old, ...]}, pairs (new, olds), or records with
    output / new_column / target and columns / source_columns / sources."""
    if isinstance(formula, dict):
        pairs = list(formula.items())
    else:
        pairs = []
        for spec in formula:
            if isinstance(spec, dict):
                new = next((spec[k] for k in ("output", "new_column", "target") if spec.get(k)), None)
                olds = next((spec[k] for k in ("columns", "source_columns", "sources") if spec.get(k)), None)
                if new is None or olds is None:
                    raise ValueError("a record of a merge formula needs a name for the result and its sources")
                pairs.append((new, olds))
            else:
                new, olds = spec
                pairs.append((new, olds))
    out: dict[str, list[str]] = {}
    for new, olds in pairs:
        out.setdefault(new, []).extend([olds] if isinstance(olds, str) else list(olds))
    return out


def merged_slots(obs: DataFrame, formula, dedupe: bool = False, keep_sources: bool = False) -> DataFrame:
    """Observations with slots renamed by a formula (see ``formula_of``): one pass, a slot that goes into several is repeated."""
    into: dict[str, list[str]] = {}
    for new, olds in formula_of(formula).items():
        for old in olds:
            into.setdefault(old, []).append(new)
    name = F.col("slot")
    row = lambda slot, moved: F.struct(slot.alias("slot"), F.lit(moved).alias("moved"))
    each = F.when(~F.coalesce(name.isin(list(into)), F.lit(False)), F.array(row(name, False)))
    for old, names in into.items():
        each = each.when(name == old, F.array(*[row(F.lit(x), True) for x in names], *([row(name, False)] if keep_sources else [])))
    own = obs.withColumn("_to", F.explode(each)).withColumn("slot", F.col("_to.slot"))
    if dedupe:  # of the renamed rows only: the others have a number each
        own = own.withColumn("_row", F.when(~F.col("_to.moved"), F.monotonically_increasing_id())).dropDuplicates(["id", "slot", "item", "_row"])
    return own.select(*obs.columns)


def missing_slots(obs: DataFrame, formula) -> list[str]:
    """The old slots of a formula that no row has."""
    olds = {old for olds in formula_of(formula).values() for old in olds}
    return sorted(olds - {r.slot for r in obs.where(F.col("slot").isin(list(olds))).select("slot").distinct().collect()})  # names of the formula


def merge_slots(obs: DataFrame, formula, dedupe: bool = False, keep_sources: bool = False) -> tuple[DataFrame, list[str]]:
    """``merged_slots`` and ``missing_slots``; the second reads the observations."""
    return merged_slots(obs, formula, dedupe, keep_sources), missing_slots(obs, formula)


def pick_slots(obs: DataFrame, slots: list[str]) -> DataFrame:
    return obs.where(F.col("slot").isin(slots))


def cell_sizes(wide_table: DataFrame, keys: tuple[str, ...] = ("id", "period", "target")) -> DataFrame:
    """The wide form with the number of items of each cell in place of the cell."""
    return wide_table.select(*keys, *[F.coalesce(F.size(F.col(f"`{c}`")), F.lit(0)).alias(c) for c in wide_table.columns if c not in keys])


def non_empty(wide_table: DataFrame, slots: list[str]) -> DataFrame:
    """Rows of the wide form with an item in any of the slots."""
    has = [F.coalesce(F.size(F.col(f"`{c}`")) > 0, F.lit(False)) for c in slots]
    cond = has[0]
    for h in has[1:]:
        cond = cond | h
    return wide_table.where(cond)


def empty_ids(tokens_ids: DataFrame, obs: DataFrame) -> DataFrame:
    """Ids without any observation."""
    return tokens_ids.join(obs.select("id").distinct(), "id", "left_anti")


def contexts(tokens: DataFrame, which: DataFrame, mark: str = "<TAR>") -> DataFrame:
    """(sentence, target, context) with the target's form between marks."""
    space = tokens.join(which, SENT)
    shown = F.when(F.col("id") == F.col("target"), F.concat_ws(" ", F.lit(mark), "form", F.lit(mark))).otherwise(F.col("form"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("id").cast("int").alias("i"), shown.alias("w")))), lambda x: x["w"]), " ")
    return space.groupBy(*TARGET).agg(line.alias("context"))


def sentence_lines(tokens: DataFrame, column: str = "lemma", drop_punct: bool = True) -> DataFrame:
    """(period, file, sent_seq, line): one column of each sentence, for training word vectors.

    Of packed sentences, whose arrays are in the order of tokens, each line is built in its row.
    """
    if dict(tokens.dtypes)["id"].startswith("array"):
        words = F.transform(F.filter(F.arrays_zip(F.col(column).alias("w"), F.col("pos").alias("pos")), lambda x: x["pos"] != "PUNCT"), lambda x: x["w"]) if drop_punct else F.col(column)
        return tokens.select(*SENT, F.explode(F.array(words)).alias("w")).where(F.size("w") > 0).select(*SENT, F.array_join("w", " ").alias("line"))
    own = tokens.where(F.col("pos") != "PUNCT") if drop_punct else tokens
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("id").cast("int").alias("i"), F.col(column).alias("w")))), lambda x: x["w"]), " ")
    return own.groupBy(*SENT).agg(line.alias("line"))
