"""Operator 10 - byte-level BPE by a distinct-word table.

1. Split: each slice of texts (about ``SLICE`` bytes of one task's rows) is split into
   the tokenizer's words; a slice yields its distinct words and, for every text, the
   positions' word numbers.
2. Encode: the word table is dealt by the words' hash, so that each distinct word of all
   slices is in one place and is encoded once.  Words travel packed, a row for each slice
   and part of the table.
3. Join back: a word's ids return to the slices that hold it, by its number there, and
   are written out by position beside the slice's position lists.  A frequent word goes
   to a slice once, however often it stands there, so no key is hot.
4. Decode: ids are joined with the id-to-piece table, whose size is the vocabulary's (bounded,
   so it is broadcast): ``decode`` explodes and joins in Spark; the digests join each slice's
   distinct ids with it, since pieces of all positions would move the texts once more.

Slices are named by a hash of their ids and texts.  The split runs once for the words and
once for the positions, which saves writing the position lists; were a slice ever cut
differently the second time, its name would have no words and the job would fail rather
than give wrong ids.

Defined results: null and empty texts have no tokens, and the digests of the empty string;
the vocabulary's added tokens are recognised inside texts as the library does by default; a
tokenizer file that asks for more than byte-level BPE (see ``check_file``) raises an error;
repeated rows come out one by one; an empty table gives an empty result; extra columns are
ignored by ``encode_digest`` and dropped by ``encode``.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftscope.llm.common import durable, only, slices, table

SLICE = 8 << 20
#: Positions of a row that are put together in one group when it is decoded.
RUN = 4096
#: Splits text before the merges; a fixed value of byte-level tokenizer files. White space is Unicode's White_Space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""


def vocabulary(path: str | None = None) -> str:
    """The text of the tokenizer file (a few MB, fixed by the vocabulary); read on the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    check_file(json.loads(spec))
    return spec


def check_file(data: dict) -> None:
    """Raises unless the file is byte-level BPE as this module splits and encodes it."""
    model, pre, post = data.get("model") or {}, data.get("pre_tokenizer") or {}, data.get("decoder") or {}
    wrong = []
    if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "fuse_unk")):
        wrong.append("model")
    if data.get("normalizer"):
        wrong.append("normalizer")
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space", True) or not pre.get("use_regex", True):
        wrong.append("pre_tokenizer")
    if post.get("type") != "ByteLevel":
        wrong.append("decoder")
    if any(t.get(k) for t in data.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
        wrong.append("added_tokens")
    if wrong:
        raise ValueError(f"not a plain byte-level BPE file: {', '.join(wrong)}")


def pieces_of(data: dict) -> pa.Table:
    """The id-to-piece table: (id, piece bytes)."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    held = {i: bytes(byte_of[c] for c in word) for word, i in data["model"]["vocab"].items()}
    held |= {t["id"]: t["content"].encode() for t in data["added_tokens"]}
    return pa.table({"id": pa.array(list(held), pa.int64()), "piece": pa.array(list(held.values()), pa.binary())})


def joined(ids: np.ndarray, pieces: pa.Table) -> dict[int, bytes]:
    """Distinct ids with their pieces; an id without a piece is an error."""
    own = pa.table({"id": pa.array(np.unique(ids).astype(np.int64))})
    met = own.join(pieces, "id")
    if met.column("piece").null_count:
        raise ValueError("an id outside the vocabulary")
    return dict(zip(met.column("id").to_pylist(), met.column("piece").to_pylist()))


@lru_cache(maxsize=2)
def _tools(spec: str):
    """(tokenizer, splitter of added tokens or None, id of each added token, id-to-piece table) in a worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    data = json.loads(spec)
    added = {t["content"]: t["id"] for t in data["added_tokens"]}
    cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, cut, added, pieces_of(data)


def split(text: str, cut, added: dict[str, int], find) -> list[str]:
    """The words of a text; added tokens are words of their own."""
    if cut is None or not cut.search(text):
        return find(text)
    out: list[str] = []
    for part in cut.split(text):
        out += [part] if part in added else find(part)
    return out


def _parts(spec: str, batches: Iterator[pa.RecordBatch], lists: bool):
    """(slice name, doc ids, words, texts' sizes in words, word numbers) of each slice."""
    _, cut, added, _ = _tools(spec)
    find = regex.compile(PATTERN).findall
    for part in slices(batches, "text", SLICE):
        # words are numbered as they are first met, in either pass
        number: dict[str, int] = defaultdict()
        number.default_factory = number.__len__
        name, sizes, flat = xxhash.xxh3_64(), [], []
        ids = part.column("doc_id")
        name.update(repr((part.num_rows, ids[0].as_py())).encode())
        for text in part.column("text"):
            text = text.as_py()
            name.update(text.encode())
            name.update(b"\xff")
            own = split(text, cut, added, find)
            sizes.append(len(own))
            if lists:
                flat.append(np.fromiter(map(number.__getitem__, own), np.uint32, len(own)))
            else:
                number.update(dict.fromkeys(own, 0))
        yield name.intdigest() - (1 << 63), ids, list(number), np.array(sizes, np.int64), np.concatenate(flat) if lists and flat else None


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays of uint32 (and one run of bytes at the end) as pressed bytes."""
    head = np.array([len(arrays), *(len(a) for a in arrays)], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(a if isinstance(a, bytes) else a.astype("<u4").tobytes() for a in arrays))


def _unpack(packed: bytes) -> list:
    """uint32 arrays; the last as bytes."""
    data = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    sizes, at, out = np.frombuffer(data, "<u4", n, 4).tolist(), 4 + 4 * n, []
    for size in sizes[:-1]:
        out.append(np.frombuffer(data, "<u4", size, at))
        at += 4 * size
    return [*out, data[at:]]


def _words(spec, parts: int):
    """The distinct words of each slice with their numbers, packed by part of the word table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, words, _, _ in _parts(spec.value, batches, False):
            own = [word.encode() for word in words]
            size = np.fromiter(map(len, own), np.uint32, len(own))
            part_of = np.fromiter(map(zlib.crc32, own), np.uint32, len(own)) % parts
            order = np.array(sorted(range(len(own)), key=own.__getitem__), np.int64)  # like words side by side press better
            order = order[np.argsort(part_of[order], kind="stable")]
            ends = np.cumsum(np.bincount(part_of, minlength=parts))
            for part, at in enumerate(np.split(order, ends[:-1])):
                if len(at):
                    packed = _pack(at, size[at], b"".join([own[n] for n in at.tolist()]))
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "slice": pa.array([name], pa.int64()), "words": [packed]})

    return run


def _positions(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for name, ids, _, sizes, flat in _parts(spec.value, batches, True):
            # bytes of one significance side by side press better
            plane = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T).tobytes()
            yield pa.RecordBatch.from_pydict({"slice": pa.array([name], pa.int64()), "ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.list_(pa.int64())), "at": [press.compress(plane)]})

    return run


def runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``first``, one run after the other."""
    size = size.astype(np.int64)
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def _encode(spec):
    """One part of the word table: encodes each distinct word once; ids go to the slices that hold it."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        tokenizer = _tools(spec.value)[0]
        index: dict[bytes, int] = defaultdict()
        index.default_factory = index.__len__
        held = []
        for packed in rows.column("words").to_pylist():
            numbers, sizes, data = _unpack(packed)
            ends = np.cumsum(sizes).tolist()
            held.append((numbers, np.fromiter((index[data[a:b]] for a, b in zip([0, *ends[:-1]], ends)), np.int64, len(ends))))
        words, ids = [w.decode() for w in index], []
        for k in range(0, len(words), 4096):
            ids += [e.ids for e in tokenizer.encode_batch_fast(words[k : k + 4096], add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.uint32, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        first = np.cumsum(size, dtype=np.int64) - size
        sent = [_pack(numbers, size[at], flat[runs(first[at], size[at])].tobytes()) for numbers, at in held]
        return pa.table({"slice": rows.column("slice"), "coded": pa.array(sent, pa.binary())})

    return run


class Coded(NamedTuple):
    """The ids of a slice's words, one word after the other, and each word's number of ids."""

    ids: np.ndarray
    size: np.ndarray


def _gather(spec, emit, schema: pa.Schema):
    """A slice's words with their ids beside its position lists."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        pieces = _tools(spec.value)[3]
        held = [_unpack(packed) for packed in right.column("coded").to_pylist()] or [(np.zeros(0, "<u4"), np.zeros(0, "<u4"), b"")]
        numbers, size = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]).astype(np.int64)
        numbers, order = np.unique(numbers, return_index=True)  # equal slices share their words
        if not np.array_equal(numbers, np.arange(len(numbers))):
            raise RuntimeError("a slice of texts was cut differently in two passes")
        ids, first = np.frombuffer(b"".join(x[2] for x in held), "<u4"), np.cumsum(size) - size
        own, out = Coded(ids[runs(first[order], size[order])], size[order]), []
        for row in left.to_pylist():
            plane = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["at"]), np.uint8)
            flat = np.ascontiguousarray(plane.reshape(4, -1).T).view(np.uint32).ravel()
            if len(flat) and flat.max() >= len(own.size):
                raise RuntimeError("a slice of texts was cut differently in two passes")
            out.append(emit(row["ids"], np.array(row["sizes"], np.int64), flat, own, pieces))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def _digest(doc_ids, sizes, flat, words: Coded, pieces) -> pa.Table:
    met = joined(words.ids, pieces)
    nums = words.ids.tolist()
    shown, plain = [str(i).encode() for i in nums], [met[i] for i in nums]
    ends = np.cumsum(words.size).tolist()
    cuts = list(zip([0, *ends[:-1]], ends))
    ids_of, text_of = np.empty(len(cuts), object), np.empty(len(cuts), object)
    ids_of[:] = [b",".join(shown[a:b]) for a, b in cuts]
    text_of[:] = [b"".join(plain[a:b]) for a, b in cuts]
    n_tokens, first, second, at = [], [], [], 0
    for n in sizes.tolist():
        own = flat[at : at + n]
        at += n
        n_tokens.append(int(words.size[own].sum()))
        first.append(hashlib.sha256(b",".join(ids_of[own].tolist())).hexdigest())
        text = b"".join(text_of[own].tolist()).decode("utf-8", "replace")
        second.append(hashlib.sha256(text.encode()).hexdigest())
    return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64()), "ids_sha256": pa.array(first, pa.string()), "decoded_sha256": pa.array(second, pa.string())})


def _lists(doc_ids, sizes, flat, words: Coded, pieces) -> pa.Table:
    begin, own, at = np.cumsum(words.size) - words.size, [], 0
    for n in sizes.tolist():
        at_words = flat[at : at + n]
        own.append(words.ids[runs(begin[at_words], words.size[at_words])].astype(np.int32))
        at += n
    return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array(own, pa.list_(pa.int32()))})


def _run(docs: DataFrame, id_col: str, text_col: str, path: str | None, emit, ddl: str, schema: pa.Schema) -> DataFrame:
    own = only(docs, id_col, text_col)
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = own.mapInArrow(_words(spec, parts), "part int, slice long, words binary")
    coded = words.groupBy("part").applyInArrow(_encode(spec), "slice long, coded binary")
    places = own.mapInArrow(_positions(spec), "slice long, ids array<long>, sizes array<long>, at binary")
    return places.groupBy("slice").cogroup(coded.groupBy("slice")).applyInArrow(_gather(spec, emit, schema), ddl)


def encode_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 (of the text that the ids decode to)."""
    schema = pa.schema({"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()})
    return _run(docs, id_col, text_col, path, _digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", schema)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row: doc_id, ids."""
    schema = pa.schema({"doc_id": pa.int64(), "ids": pa.list_(pa.int32())})
    return _run(docs, id_col, text_col, path, _lists, "doc_id long, ids array<int>", schema)


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Per row: doc_id, text; each id is joined with its piece. Ids outside the vocabulary raise an error.

    A row's ids travel with their pieces in runs, so that a long row is no long group; broken
    UTF-8 becomes U+FFFD as the library has it.
    """
    spark = coded.sparkSession
    table_ = pieces_of(json.loads(vocabulary(path)))
    pieces = spark.createDataFrame(list(zip(table_.column("id").to_pylist(), table_.column("piece").to_pylist())), "id long, piece binary")
    own = coded.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{ids_col}`").cast("array<long>"), F.array().cast("array<long>")).alias("ids"))
    own = durable(own)  # the row numbers
    at = own.select("row", F.posexplode("ids").alias("at", "id"))
    met = at.join(F.broadcast(pieces), "id", "left")  # the vocabulary's size
    piece = F.when(F.col("piece").isNull(), F.raise_error(F.concat(F.lit("no piece for id "), F.col("id").cast("string"))).cast("binary")).otherwise(F.col("piece"))
    whole = lambda c: F.unhex(F.array_join(F.transform(F.array_sort(c), lambda x: F.hex(x["b"])), ""))
    runs = met.select("row", F.expr(f"at div {RUN}").alias("run"), "at", piece.alias("b")).groupBy("row", "run").agg(whole(F.collect_list(F.struct("at", "b"))).alias("b"))
    texts = runs.groupBy("row").agg(whole(F.collect_list(F.struct("run", "b"))).alias("b"))

    @F.pandas_udf("string")
    def shown(data: pd.Series) -> pd.Series:
        return data.map(lambda b: bytes(b or b"").decode("utf-8", "replace"))

    return own.select("row", "doc_id").join(texts, "row", "left").select("doc_id", shown("b").alias("text"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(table(spark, sf_dir, "documents"))
