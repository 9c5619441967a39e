"""Operator 8 - exact deduplication by two-pass Bloom filtering.

Pass 1 puts the 64-bit hash of every normalised text into a counting Bloom filter
with two states per cell (set once, set more than once).  Pass 2 asks for each row
whether all of its cells were set more than once.  Where one was not, no other row
has the hash: the row passes straight through.  Only the others are shuffled, and
there the groups are formed on the SHA-256 of the whole normalised text, so the
filter's false positives cost a few extra rows and never a wrong result.

The filter has ``CELLS_PER_ROW`` cells a row at every size.  It is cut by the hash into
slices of at most ``SLICE_CELLS`` cells; a row's cells are in one slice.  Pass 1 fills a
slice at a time from the column of hashes, which is written by slice, and pass 2 sends
``SLICES_AT_ONCE`` slices to the executors and reads the rows of these slices.

Texts are equal when identical after replacing each run of ``[\\x20\\x09-\\x0D]`` by
one space.  Defined results:

* null text counts as empty; empty texts equal each other;
* rows that repeat both the id and the text are one document (one row comes out; which
  one, where ``dedup`` carries other columns that differ, is not defined);
* rows with one id and different texts are different documents;
* the smallest id of a group stays; a null id is larger than any id;
* an empty table gives an empty result;
* extra columns, whatever their names, are carried by ``dedup`` and ignored by ``groups``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftscope.llm.common import durable, new_folder, only, table

#: Cells per row and probes per row.
CELLS_PER_ROW, PROBES = 16, 4
#: Cells of a slice (2**28 are 32 MiB) and slices that are broadcast together: bounds of memory, not of the filter.
SLICE_CELLS, SLICES_AT_ONCE = 1 << 28, 4
#: Cells of a part, in which a task's share of a slice travels.
PART_CELLS = 1 << 19


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def _probes(h: np.ndarray, m: int) -> np.ndarray:
    """The cells of each hash in its slice, a row each, sorted; m is a power of two. Double hashing with an odd step."""
    h = h.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    cells = np.stack([(h + np.uint64(i) * step) & np.uint64(m - 1) for i in range(PROBES)], axis=1).astype(np.int64)
    cells.sort(axis=1)
    return cells


def _slice(h: Column, slices: int) -> Column:
    """The slice of a hash, by its highest bits."""
    return F.expr("0") if slices == 1 else ((F.shiftrightunsigned(h, 33) * slices) / (1 << 31)).cast("int")


def _fill(m: int):
    """Pass 1 in one task: which cells of a slice were set once, and which more than once, a bit each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros(m // 8, np.uint8), np.zeros(m // 8, np.uint8)
        for b in batches:
            probes = _probes(b.column(0).to_numpy(zero_copy_only=False), m)
            fresh = np.ones(probes.shape, bool)
            fresh[:, 1:] = probes[:, 1:] != probes[:, :-1]
            cells, n = np.unique(probes[fresh], return_counts=True)
            if not len(cells):
                continue
            at, bit = cells >> 3, (0x80 >> (cells & 7)).astype(np.uint8)
            head = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            two[at[head]] |= np.bitwise_or.reduceat(np.where((n > 1) | (one[at] & bit > 0), bit, 0).astype(np.uint8), head)
            one[at[head]] |= np.bitwise_or.reduceat(bit, head)
        press, size = zstandard.ZstdCompressor(level=1), min(m, PART_CELLS) // 8
        for k in range(len(one) // size):
            part = slice(k * size, (k + 1) * size)
            if one[part].any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "one": [press.compress(one[part].tobytes())], "two": [press.compress(two[part].tobytes())]})

    return run


def _merge(key: tuple, pieces: pa.Table) -> pa.Table:
    """One part of a slice from all tasks; a piece at a time is unpressed."""
    open_ = lambda x: np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), np.uint8)
    one = two = None
    for o, t in zip(pieces.column("one"), pieces.column("two")):
        o, t = open_(o), open_(t)
        one, two = (o, t) if one is None else (one | o, two | t | (one & o))
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "two": [two.tobytes()]})


class Repeats:
    """Both passes over a written column of hashes ``h`` with its ``slice``: tells which may be repeated."""

    def __init__(self, hashed: DataFrame, n: int):
        self.hashed, self.slices = hashed, slices_for(n)
        self.cells = min(SLICE_CELLS, max(1 << 16, 1 << (max(1, -(-n * CELLS_PER_ROW // self.slices)) - 1).bit_length()))
        self.passes = [self._pass(list(range(k, min(k + SLICES_AT_ONCE, self.slices)))) for k in range(0, self.slices, SLICES_AT_ONCE)]

    def _bits(self, k: int) -> np.ndarray:
        """Pass 1 of a slice."""
        tasks = int(self.hashed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        own = self.hashed.where(F.col("slice") == k).select("h").coalesce(tasks)
        merged = own.mapInArrow(_fill(self.cells), "part int, one binary, two binary").groupBy("part").applyInArrow(_merge, "part int, two binary").collect()  # a slice: SLICE_CELLS / 8 bytes at most
        bits, size = np.zeros(self.cells // 8, np.uint8), min(self.cells, PART_CELLS) // 8
        for r in merged:
            bits[r.part * size : (r.part + 1) * size] = np.frombuffer(r.two, np.uint8)
        return bits

    def _pass(self, which: list[int]) -> tuple[list[int], Column]:
        """Slices, and pass 2 for their rows: a boolean column over h and slice."""
        sent, m, at = self.hashed.sparkSession.sparkContext.broadcast(np.stack([self._bits(k) for k in which])), self.cells, which[0]  # SLICES_AT_ONCE slices

        @F.pandas_udf("boolean")
        def seen(h: pd.Series, k: pd.Series) -> pd.Series:
            cells = _probes(h.to_numpy(), m)
            own = (k.to_numpy(np.int64) - at)[:, None]
            return pd.Series(((sent.value[own, cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).all(axis=1))

        return which, seen(F.col("h"), F.col("slice"))

    def mark(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with h and slice) and the column ``maybe``, true for every repeated h."""
        out = None
        for which, maybe in self.passes:
            own = (rows if self.slices == 1 else rows.where(F.col("slice").isin(which))).withColumn("maybe", maybe)
            out = own if out is None else out.unionByName(own)
        return out


def slices_for(n: int) -> int:
    return max(1, -(-n * CELLS_PER_ROW // SLICE_CELLS))


def _by_slice(df: DataFrame, n: int) -> DataFrame:
    """Written to the shared folder, a folder a slice, so that a slice's rows are read alone."""
    own = df.withColumn("slice", _slice(F.col("h"), slices_for(n)))
    path = new_folder(df.sparkSession)
    (own.write if slices_for(n) == 1 else own.write.partitionBy("slice")).parquet(path)
    return df.sparkSession.read.schema(own.schema).parquet(path)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256."""
    own, n = only(docs, id_col, text_col), docs.count()
    hashed = _by_slice(own.select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256")).withColumn("h", F.xxhash64("text_sha256")), n)
    flagged = durable(Repeats(hashed, n).mark(hashed).select("doc_id", "text_sha256", "maybe"))
    alone = flagged.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = flagged.filter("maybe").select("doc_id", "text_sha256").distinct()
    # written, so that both sides of the join are dealt anew and a hot group can be split
    size = durable(maybe.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    met = durable(maybe).join(size, "text_sha256")
    met = met.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return alone.unionByName(met)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; unrepeated rows are not shuffled.

    The filter is built once, and the keepers are found in the narrow table of hashes.
    """
    names, n = docs.columns, docs.count()
    sha = F.sha2(normalised(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))), 256)
    flat = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{id_col}`").cast("long").alias("own_id"), sha.alias("sha"))
    flat = flat.withColumn("h", F.xxhash64("sha")).withColumn("slice", _slice(F.col("h"), slices_for(n)))
    hashed = _by_slice(flat.select("own_id", "sha", "h"), n)
    found = Repeats(hashed, n)
    keep = durable(found.mark(hashed).filter("maybe").groupBy("sha").agg(F.min("own_id").alias("keep_id")))
    marked = found.mark(flat)
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    alone = marked.filter(~F.col("maybe")).select(*back)
    met = marked.filter("maybe").alias("a").join(keep.alias("b"), F.col("a.own_id").eqNullSafe(F.col("b.keep_id")) & (F.col("a.sha") == F.col("b.sha")), "left_semi")
    return alone.unionByName(met.dropDuplicates(["own_id", "sha"]).select(*back))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH t AS (SELECT DISTINCT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""
