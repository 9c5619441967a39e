"""Shared plumbing of the training-data operators: tables, durable cuts of lineage, Arrow slices."""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; bounds the temporaries of a Python worker.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's ``spark.checkpoint.dir``.

    Where it is unset, a local master (tests, a laptop) gets a temporary folder, which is made
    and set; on any other master that is an error, since executors would write to their own disks.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), f"shiftscope-{uuid.uuid4().hex}")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


#: Folders that this process wrote for its own intermediate tables.
_WRITTEN: list[str] = []


def new_folder(spark: SparkSession, kind: str = "shiftscope") -> str:
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes all intermediate tables that this process wrote; results that are not yet
    written read them, so call it after the last action. Returns their number."""
    n = 0
    while _WRITTEN:
        n += delete(spark, _WRITTEN.pop())
    return n


def delete(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost
    executor costs a re-read, not a recomputation."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def only(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under fixed names that extra columns can't clash with."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut at row borders into zero-copy parts of about ``limit`` bytes of ``column``.

    A row longer than the limit is a part of its own: texts are never cut.
    """
    import pyarrow.compute as pc

    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin, total = 0, 0
        for i, n in enumerate(size.tolist()):
            if total and total + n > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < batch.num_rows:
            yield batch.slice(begin)


def pack(*arrays) -> bytes:
    """Arrays in one pressed run of bytes, for rows that travel between two steps of one job."""
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, 5))


def unpack(packed: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(packed))


def six_bytes(values: np.ndarray) -> np.ndarray:
    """The low 48 bits of uint64 values, six bytes each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def from_six(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data), 8), np.uint8)
    out[:, :6] = data
    return out.view("<u8").ravel()
