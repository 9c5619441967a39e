"""Parsed corpora: ``root/<period>/<file>.{txt,conllu}`` with ``<s id=...>`` blocks.

A token line has seven tab-separated fields: form, lemma, part of speech, id, head,
relation, features.  A file is read whole, since line numbers count from its start; files
are the unit of parallelism.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = ("form", "lemma", "pos", "id", "head", "deprel", "feats")
#: Files of a corpus, plain or pressed.
TEXTS = "*.{txt,conllu,txt.gz,conllu.gz}"
#: Seven fields without tabs.
TOKEN = r"^([^\t]+)\t([^\t]+)\t([^\t]+)\t([^\t]+)\t([^\t]+)\t([^\t]+)\t([^\t]+)$"


def whole_files(spark: SparkSession, root: str, glob: str = TEXTS, recursive: bool = False) -> DataFrame:
    """(period, file, value): a row a file; files directly under the root are no part of the corpus.

    A period is a folder's name, or ``period=<name>`` as the writers of this library call it.
    """
    path = f"{root.rstrip('/')}/*/" + ("" if recursive else "*")
    reader = spark.read.option("pathGlobFilter", glob)
    files = (reader.option("recursiveFileLookup", True).text(root, wholetext=True) if recursive else reader.text(path, wholetext=True)).select("value", F.col("_metadata.file_path").alias("p"))
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    tail = F.regexp_replace(F.substring_index(F.url_decode(F.replace("p", F.lit("+"), F.lit("%2B"))), base, -1), "^/+", "")
    own = files.withColumn("tail", tail).where(F.contains("tail", F.lit("/")))
    return own.select(F.regexp_replace(F.split_part("tail", F.lit("/"), F.lit(1)), "^period=", "").alias("period"), F.regexp_replace("tail", "^[^/]*/", "").alias("file"), "value")


def raw_lines(spark: SparkSession, root: str, glob: str = TEXTS, recursive: bool = False) -> DataFrame:
    """(period, file, file_line, line) of ``whole_files``."""
    lines = whole_files(spark, root, glob, recursive).select("period", "file", F.posexplode(F.split("value", "\n")).alias("i", "line"))
    return lines.select("period", "file", (F.col("i") + 1).alias("file_line"), F.regexp_replace("line", "\r$", "").alias("line"))


def tokens_of(lines: DataFrame, pattern: str = TOKEN, keep_unclosed: bool = False) -> DataFrame:
    """Lines to tokens with their sentence; a last sentence without an end mark counts only if asked for."""
    w = Window.partitionBy("period", "file").orderBy("file_line")
    start, end = F.startswith("line", F.lit("<s ")) | F.startswith("line", F.lit("<s>")), F.startswith("line", F.lit("</s"))
    own = lines.withColumn("sent_seq", F.sum(F.when(start, 1).otherwise(0)).over(w))
    # end marks from a line on: all of the file less those before (running sums; a frame to the file's end would be summed anew for each line)
    ended = F.when(end, 1).otherwise(0)
    own = own.withColumn("ends", F.sum(ended).over(Window.partitionBy("period", "file")) - F.sum(ended).over(w) + ended)
    sent_id = F.when(start, F.regexp_extract("line", r"<s\s+id=[\"']?([^\"'>\s]+)", 1))
    own = own.withColumn("sent_id", F.last(sent_id, ignorenulls=True).over(w)).where(F.col("sent_seq") > 0)
    if not keep_unclosed:
        own = own.where(F.col("ends") > 0)
    hit = own.where(F.regexp_like("line", F.lit(pattern)) & ~start & ~end)
    return hit.select("period", "file", "file_line", "sent_seq", "sent_id", *[F.regexp_extract("line", pattern, i + 1).alias(n) for i, n in enumerate(FIELDS)])


def sentence_lines(files: DataFrame, keep_unclosed: bool = False) -> DataFrame:
    """(period, file, begin, last, sent_seq, sent_id, lines) of whole files: a row a sentence, cut where it was read.

    ``begin`` is the number of the sentence's first line, its start mark, and ``last`` that of the file's last
    end mark (of its last line with ``keep_unclosed``), after which no line counts. Nothing is shuffled.
    """
    lines = F.split("value", "\n")
    number = lambda is_it: F.filter(F.transform(lines, lambda x, i: F.when(is_it(x), i + 1)), lambda i: i.isNotNull())
    starts = number(lambda x: F.startswith(x, F.lit("<s ")) | F.startswith(x, F.lit("<s>")))
    last = F.size(lines) if keep_unclosed else F.coalesce(F.array_max(number(lambda x: F.startswith(x, F.lit("</s")))), F.lit(0))
    # what is before the first start mark is in no sentence; a slice for each sentence would copy the file each time
    texts = F.split(F.concat(F.lit("\n"), "value"), r"\n(?=<s[ >])")
    pairs = F.arrays_zip(starts.alias("begin"), F.slice(texts, F.lit(2), F.greatest(F.size(texts) - 1, F.lit(0))).alias("text"))
    each = files.select("period", "file", last.alias("last"), F.posexplode(pairs).alias("k", "x")).where(F.col("x.begin") <= F.col("last"))
    sent_id = F.regexp_extract(F.substring_index("x.text", "\n", 1), r"<s\s+id=[\"']?([^\"'>\s]+)", 1)
    return each.select("period", "file", "x.begin", "last", (F.col("k") + 1).cast("long").alias("sent_seq"), sent_id.alias("sent_id"), F.split("x.text", "\n").alias("lines"))


def read_tokens(spark: SparkSession, root: str, pattern: str = TOKEN, keep_unclosed: bool = False) -> DataFrame:
    """The tokens of a corpus, a row each; files are the unit of parallelism and nothing is shuffled."""
    own = sentence_lines(whole_files(spark, root), keep_unclosed).select("period", "file", "begin", "last", "sent_seq", "sent_id", F.posexplode("lines").alias("i", "line")).where(F.col("begin") + F.col("i") <= F.col("last"))
    own = own.select("period", "file", (F.col("begin") + F.col("i")).cast("int").alias("file_line"), "sent_seq", "sent_id", F.regexp_replace("line", "\r$", "").alias("line"))
    marks = F.startswith("line", F.lit("<s ")) | F.startswith("line", F.lit("<s>")) | F.startswith("line", F.lit("</s"))
    keys = ("period", "file", "file_line", "sent_seq", "sent_id")
    if pattern != TOKEN:
        return own.where(F.regexp_like("line", F.lit(pattern)) & ~marks).select(*keys, *[F.regexp_extract("line", pattern, i + 1).alias(n) for i, n in enumerate(FIELDS)])
    hit = own.where(~marks).select(*keys, F.explode(F.array(F.split("line", "\t"))).alias("f")).where((F.size("f") == len(FIELDS)) & ~F.array_contains("f", ""))
    return hit.select(*keys, *[F.get("f", i).alias(n) for i, n in enumerate(FIELDS)])


def read_sentences(spark: SparkSession, root: str) -> DataFrame:
    """Raw text: one sentence a line, empty lines skipped, with line numbers."""
    return raw_lines(spark, root, "*.{txt,txt.gz}").where(F.trim("line") != "")


def read_period_counts(spark: SparkSession, path: str) -> DataFrame:
    """``{period: {slot: count}}`` as (period, slot, count)."""
    whole = spark.read.text(path, wholetext=True)
    outer = whole.select(F.explode(F.from_json("value", "map<string,map<string,bigint>>")).alias("period", "m"))
    return outer.select("period", F.explode("m").alias("slot", "count"))


def read_combos(spark: SparkSession, path: str) -> DataFrame:
    """&-separated combos: subfolder, frequency, target, then slot columns."""
    raw = spark.read.option("sep", "&").option("header", True).csv(path)
    slots = [c for c in raw.columns if c not in ("subfolder", "frequency", "target")]
    cells = F.filter(F.array(*[F.trim(F.col(f"`{c}`")) for c in slots]), lambda x: x.isNotNull() & (x != ""))
    return raw.select(F.trim("subfolder").alias("period"), F.trim("target").alias("target"), cells.alias("slots"), F.col("frequency").cast("long").alias("frequency"))


def read_fillers(spark: SparkSession, path: str) -> DataFrame:
    """A written slot-filler table (id, subfolder, target, slots...) as observations."""
    from shiftscope.functions.text import cell_items
    from shiftscope.operators.observe import long

    raw = spark.read.option("header", True).option("escape", '"').csv(path).withColumnRenamed("subfolder", "period")
    slots = [c for c in raw.columns if c not in ("id", "period", "target")]
    return long(raw.select("id", "period", "target", *[cell_items(F.col(f"`{c}`")).alias(c) for c in slots]))


def parse_with(sentences: DataFrame, parser, batch: int = 128) -> DataFrame:
    """Raw sentences through a pluggable parser: ``parser(list of texts)`` gives, for each, tuples of the seven fields."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                rows = [(r.period, r.file, r.file_line, i + 1, *map(str, t)) for r, found in zip(part.itertuples(), parser(part["line"].tolist())) for i, t in enumerate(found)]
                yield pd.DataFrame(rows, columns=["period", "file", "file_line", "place", *FIELDS])

    return sentences.mapInPandas(run, "period string, file string, file_line int, place int, " + ", ".join(f"{f} string" for f in FIELDS))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(period, id, slot_combs, frequency, specialisations) of a grouped JSON document."""
    from shiftscope.sources.sinks import GROUPS

    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", GROUPS)).alias("period", "nodes"))
    return whole.select("period", F.explode("nodes").alias("x")).select("period", "x.*")


def files(spark: SparkSession, root: str, glob: str = TEXTS) -> DataFrame:
    """(period, file, bytes) of the corpus' files at any depth below a period, each once: the tasks of a run."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root).select("path", "length").distinct()
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    tail = F.regexp_replace(F.substring_index("path", base, -1), "^/+", "")
    own = found.withColumn("tail", tail).where(F.contains("tail", F.lit("/")))
    return own.select(F.regexp_replace(F.split_part("tail", F.lit("/"), F.lit(1)), "^period=", "").alias("period"), F.regexp_replace("tail", "^[^/]*/", "").alias("file"), F.col("length").alias("bytes"))
