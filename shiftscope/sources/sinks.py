"""Written forms of the results; each goes through Spark's commit protocol and clobbers nothing unless asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftscope.functions.text import cell_text
from shiftscope.sources.folders import kept


def period_json(counts: DataFrame) -> DataFrame:
    """(period, json): a period's counts as an object, greatest first."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), "slot", "count")))
    entry = lambda x: F.concat(F.to_json(F.array(x["slot"])), F.lit(":"), x["count"].cast("string"))
    body = F.array_join(F.transform(ordered, lambda x: F.regexp_replace(entry(x), r"^\[|\](?=:)", "")), ",")
    return counts.groupBy("period").agg(F.concat(F.lit("{"), body, F.lit("}")).alias("json"))


def write_period_counts(counts: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON document {period: {slot: count}}; a report's table, so one row holds it."""
    rows = period_json(counts).select(F.struct("period", F.concat(F.regexp_replace(F.to_json(F.array("period")), r"^\[|\]$", ""), F.lit(":"), F.col("json")).alias("entry")).alias("x"))
    whole = rows.agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["entry"]), ","), F.lit("}")).alias("value"))
    whole.coalesce(1).write.mode(mode).text(path)


GROUPS = "map<string,array<struct<id:string,slot_combs:array<string>,frequency:bigint,specialisations:array<struct<specialisation:array<string>,frequency:bigint>>>>>"


def write_groups(groups: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON document {period: [{id, slot_combs, frequency, specialisations}]}, groups by their ids."""
    node = F.struct(F.concat_ws("_node_", "period", F.col("group_id").cast("string")).alias("id"), "slot_combs", F.col("frequency").cast("long").alias("frequency"), "specialisations")
    nodes = F.transform(F.array_sort(F.collect_list(F.struct(F.col("group_id").alias("k"), node.alias("node")))), lambda x: x["node"])
    whole = groups.groupBy("period").agg(nodes.alias("nodes")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("period", "nodes"))))).alias("value"))
    whole.coalesce(1).write.mode(mode).text(path)


def combos_csv(combos: DataFrame, width: int = 5) -> DataFrame:
    """The columns of the &-separated table in its order; ``width`` slots, or as many as the largest combination has."""
    width = max(width, combos.agg(F.max(F.size("slots"))).first()[0] or 0)
    cells = [F.coalesce(F.get("slots", i), F.lit("")).alias(f"slot{i + 1}") for i in range(width)]
    return combos.orderBy("period", F.desc("frequency"), "target", "slots").select(F.col("period").alias("subfolder"), "frequency", "target", *cells)


def write_combos(combos: DataFrame, path: str, width: int = 5, mode: str = "error") -> None:
    combos_csv(kept(combos), width).write.mode(mode).option("sep", "&").option("header", True).csv(path)


def fillers_csv(wide: DataFrame) -> DataFrame:
    keys = ("id", "period", "target")
    return wide.select("id", F.col("period").alias("subfolder"), "target", *[cell_text(F.col(f"`{c}`")).alias(c) for c in wide.columns if c not in keys])


def write_fillers(wide: DataFrame, path: str, mode: str = "error") -> None:
    fillers_csv(wide).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_vocabulary(vocab: DataFrame, path: str, mode: str = "error") -> None:
    vocab.write.mode(mode).partitionBy("period").option("header", True).csv(path)


def sentence_blocks(tokens: DataFrame) -> DataFrame:
    """(period, file, sent_seq, block): tokens back in their written form. Of packed sentences each is built in its row."""
    fields = ("form", "lemma", "pos", "id", "head", "deprel", "feats")
    if dict(tokens.dtypes)["id"].startswith("array"):
        text = F.transform(F.arrays_zip(*[F.col(c) for c in fields]), lambda x: F.concat_ws("\t", *[x[c].cast("string") for c in fields]))
        return tokens.select("period", "file", "sent_seq", F.concat(F.lit("<s id="), F.col("sent_id"), F.lit(">\n"), F.array_join(text, "\n"), F.lit("\n</s>")).alias("block"))
    line = F.concat_ws("\t", *fields)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("file_line").alias("i"), line.alias("l")))), lambda x: x["l"]), "\n")
    return tokens.groupBy("period", "file", "sent_seq").agg(F.concat(F.lit("<s id="), F.first("sent_id"), F.lit(">\n"), body, F.lit("\n</s>")).alias("block"))


def write_corpus(tokens: DataFrame, path: str, skip_existing: bool = False, per_file: int = 1000, compression: str = "none") -> None:
    """Parsed sentences (tokens, or sentences packed) as text, a folder for each period and ``per_file`` sentences a file.

    Spark's commit protocol makes files appear whole or not at all; ``skip_existing`` leaves a
    corpus that is there as it is. ``compression``: none, or gzip, which the reader knows by the name.
    """
    blocks = sentence_blocks(tokens).select("period", F.col("block").alias("value"))
    blocks.write.mode("ignore" if skip_existing else "error").option("maxRecordsPerFile", per_file).option("compression", compression).partitionBy("period").text(path)


def write_sentences(lines: DataFrame, path: str, mode: str = "error") -> None:
    """Sentence lines, a folder for each period."""
    lines.select("period", F.col("line").alias("value")).write.mode(mode).partitionBy("period").text(path)


def write_merged(lines: DataFrame, path: str, mode: str = "error") -> None:
    """One text for each period, in the order of files and sentences: a file, or parts of one in the order of their names.

    Lines are dealt by ranges of (period, file, sentence), so a long period is many tasks' work; they are
    worked out once, as the ranges are found in a pass of their own.
    """
    dealt = kept(lines).repartitionByRange("period", "file", "sent_seq").sortWithinPartitions("period", "file", "sent_seq")
    dealt.select("period", F.col("line").alias("value")).write.mode(mode).partitionBy("period").text(path)
