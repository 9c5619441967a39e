"""Word-vector slices: text and binary word2vec files, and numpy slices with a pickled vocabulary."""

from __future__ import annotations

import io
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File names of a period's model, first match first.
CANDIDATES = ("{p}.model", "{p}.kv", "{p}_vectors.bin", "{p}.bin", "{p}_vectors.txt", "{p}.txt", "{p}.vec")
SCHEMA = "period string, word string, vec array<float>"


class _Strings(pickle.Unpickler):
    """Only lists of strings: no name is looked up."""

    def find_class(self, module, name):
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed in a vocabulary")


def read_text(spark: SparkSession, path: str, period: str) -> DataFrame:
    """``word x1 x2 ...`` lines; a header of two numbers is left out."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("f")).where(F.size("f") > 2)
    return lines.select(F.lit(period).alias("period"), F.get("f", 0).alias("word"), F.slice("f", F.lit(2), F.size("f")).cast("array<float>").alias("vec"))


def decode_binary(data: bytes) -> tuple[list[str], np.ndarray]:
    head, _, rest = data.partition(b"\n")
    n, dim = map(int, head.split())
    words, rows, at = [], np.empty((n, dim), np.float32), 0
    for i in range(n):
        end = rest.index(b" ", at)
        words.append(rest[at:end].lstrip(b"\n").decode("utf-8"))
        rows[i] = np.frombuffer(rest, "<f4", dim, end + 1)
        at = end + 1 + 4 * dim
    return words, rows


def encode_binary(words: list[str], rows: np.ndarray) -> bytes:
    return f"{len(words)} {rows.shape[1]}\n".encode() + b"".join(w.encode() + b" " + r.astype("<f4").tobytes() + b"\n" for w, r in zip(words, rows))


def read_binary(spark: SparkSession, path: str, period: str) -> DataFrame:
    """A file is decoded where it is read; a model is one file."""

    def run(frames):
        for frame in frames:
            for data in frame["content"]:
                words, rows = decode_binary(bytes(data))
                yield pd.DataFrame({"period": period, "word": words, "vec": list(rows)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)


def read_numpy(spark: SparkSession, matrix: str, vocabulary: str, period: str) -> DataFrame:
    """``-w.npy`` rows and a pickled list of words; rows are brought to length 1."""
    both = spark.read.format("binaryFile").load([matrix, vocabulary]).select(F.col("path").endswith(".npy").alias("m"), "content", F.lit(1).alias("k"))

    def run(key, frame):
        data = {bool(m): bytes(c) for m, c in zip(frame["m"], frame["content"])}
        rows = np.load(io.BytesIO(data[True]), allow_pickle=False).astype(np.float32)
        words = _Strings(io.BytesIO(data[False]), encoding="latin-1").load()
        norm = np.linalg.norm(rows, axis=1, keepdims=True)
        return pd.DataFrame({"period": period, "word": [str(w) for w in words], "vec": list(rows / np.where(norm > 0, norm, 1))})

    return both.groupBy("k").applyInPandas(run, SCHEMA)


def read_series(spark: SparkSession, root: str, periods: list[str]) -> DataFrame:
    """The models of several periods, each the first of its candidate files that is there."""
    names = {r.name for r in spark.read.format("binaryFile").load(root).select(F.substring_index("path", "/", -1).alias("name")).collect()}  # file names of one folder
    out = None
    for p in periods:
        name = next((c.format(p=p) for c in CANDIDATES if c.format(p=p) in names), None)
        if name is None:
            raise FileNotFoundError(f"no word-vector file for period {p} in {root}")
        if name.endswith((".model", ".kv")):
            raise NotImplementedError(f"{name}: this model format needs its own library; save it as word2vec text or binary")
        one = (read_binary if name.endswith(".bin") else read_text)(spark, f"{root.rstrip('/')}/{name}", p)
        out = one if out is None else out.unionByName(one)
    return out


def training_lines(spark: SparkSession, root: str, lowercase: bool = False) -> DataFrame:
    """(period, line) of one text for each period folder, a file or the parts of one writing; several texts of a period are an error."""
    raw = spark.read.text(f"{root.rstrip('/')}/*/*.txt").select("value", F.col("_metadata.file_path").alias("file"))
    own = raw.withColumn("period", F.regexp_replace(F.url_decode(F.element_at(F.split("file", "/"), -2)), "^period=", ""))
    # parts of one writing bear its number: part-<place>-<number>.c<place>.txt
    text = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"^part-\d+-([0-9a-f-]{36})\S*$", "$1")
    many = own.groupBy("period", "file").agg(F.first(text).alias("text")).groupBy("period").agg(F.count_distinct("text").alias("n")).where("n <> 1").limit(1).collect()
    if many:
        raise ValueError(f"period {many[0].period} has {many[0].n} text files; one is needed")
    text = F.lower("value") if lowercase else F.col("value")
    return own.select("period", F.array_join(F.split(F.trim(text), r"\s+"), " ").alias("line")).where("line <> ''")


def write_text(vectors: DataFrame, path: str) -> None:
    """word2vec text without a header, a part for each partition."""
    vectors.select(F.concat_ws(" ", "word", F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")).alias("value")).write.text(path)
