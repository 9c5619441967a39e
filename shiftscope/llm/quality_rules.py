"""Operator 4 - quality rules with compression bands.

Every text is compressed with zstandard as a whole and in fixed chunks; where its length
is no multiple of the chunk's, a last chunk ends at the text's end and overlaps the one
before, and a text shorter than a chunk is one chunk with the limits of its length.  A ratio
(bytes before / bytes after) above the upper limit of the text's length band means
repetition, one below the lower limit means noise (keys, encoded data, random
characters).  Limits depend on length because short inputs cannot reach the ratios of
long ones.  The method's verdict rejects a text whose whole ratio is outside its band,
or of whose chunks more than ``MAX_BAD_CHUNKS`` are outside the chunk band.

The base rules count words ``[^\\x20\\x09-\\x0D]+`` (see ``measure``); a text that fails
them is rejected whatever its ratios.  All counts and ratios use the whole text.

Defined results: null and empty texts have no words, fail the base rules and get ratio
null; repeated rows are judged one by one; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from shiftscope.llm import textkernel as tk
from shiftscope.llm.common import only, slices, table

LEVEL = 3
CHUNK_BYTES = 2048
#: Share of a text's chunks that may be outside the chunk band.
MAX_BAD_CHUNKS = 0.2
#: (bytes from, least ratio, greatest ratio); 0 and inf: no limit at that length.
WHOLE_BANDS = [
    (0, 0.0, float("inf")),
    (128, 0.0, 3.0),
    (256, 1.10, 3.0),
    (512, 1.20, 3.5),
    (1024, 1.35, 4.0),
    (4096, 1.45, 5.0),
    (16384, 1.50, 6.0),
    (65536, 1.50, 8.0),
]
CHUNK_BAND = (1.40, 5.0)

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
WINDOW = 5

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, whole_ratio double, n_chunks long, n_bad_chunks long, kept boolean"


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a 0/1 array over each row's bytes."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _dup_lines(raw: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same row."""
    n_rows = len(offsets) - 1
    breaks = np.flatnonzero(raw == 10)
    full = np.flatnonzero(np.diff(offsets) > 0)
    start = np.sort(np.concatenate([offsets[:-1][full], breaks + 1]))
    row = np.searchsorted(offsets, start, side="right") - 1
    # a break at the very end of a row starts an empty line there, which has no word
    ok = start < len(raw)
    start, row = start[ok], row[ok]
    nxt = np.searchsorted(breaks, start)
    end = np.minimum(np.append(breaks, len(raw))[nxt], offsets[row + 1])
    words = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(word, out=words[1:])
    has = (end > start) & (words[end] > words[start])
    start, end, row = start[has], end[has], row[has]
    first = np.unique(start, return_index=True)[1]  # a row that begins at another's final break
    start, end, row = start[first], end[first], row[first]
    h = tk.span_hashes(raw, start, end)
    _, kept_row = tk.distinct_in_rows(h, row)
    return np.bincount(row, minlength=n_rows) - np.bincount(kept_row, minlength=n_rows)


def _repeat_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words inside windows of five that occur twice or more in their row."""
    n_words = np.diff(first)
    row_of = np.repeat(np.arange(len(n_words)), n_words)
    m = max(len(hashes) - WINDOW + 1, 0)
    mult = tk.multipliers(WINDOW)
    total = np.zeros(m, np.uint64)
    for j in range(WINDOW):
        total += hashes[j : j + m] * mult[j]
    at = np.flatnonzero(row_of[:m] == row_of[WINDOW - 1 : WINDOW - 1 + m])
    key = tk.mix(total[at] + row_of[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    key, pos = key[order], at[order]
    same = key[1:] == key[:-1]
    again = np.zeros(len(key), bool)
    again[1:] |= same
    again[:-1] |= same
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, pos[again], 1)
    np.add.at(cover, pos[again] + WINDOW, -1)
    return _per_row(np.cumsum(cover[:-1]) > 0, first)


def _ratios(texts: list[bytes]) -> tuple[list, list, list, list]:
    press = zstandard.ZstdCompressor(level=LEVEL).compress
    edges = [b for b, _, _ in WHOLE_BANDS]
    whole, n_chunks, n_bad, good = [], [], [], []
    for t in texts:
        size = len(t)
        if not size:
            whole.append(None), n_chunks.append(0), n_bad.append(0), good.append(False)
            continue
        ratio = size / len(press(t))
        _, low, high = WHOLE_BANDS[np.searchsorted(edges, size, side="right") - 1]
        inside = low <= ratio <= high
        if size < CHUNK_BYTES:
            starts, bad = [0], int(not inside)
        else:
            starts = [*range(0, size - CHUNK_BYTES, CHUNK_BYTES), size - CHUNK_BYTES]
            bad = sum(not CHUNK_BAND[0] <= CHUNK_BYTES / len(press(t[k : k + CHUNK_BYTES])) <= CHUNK_BAND[1] for k in starts)
        whole.append(ratio), n_chunks.append(len(starts)), n_bad.append(bad)
        good.append(inside and bad <= MAX_BAD_CHUNKS * len(starts))
    return whole, n_chunks, n_bad, good


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        raw, offsets = tk.buffer_of(part.column("text"))
        start, end, first = tk.spans(raw, offsets)
        n_words = np.diff(first)
        word = ~tk.IS_SPACE[raw]
        repeat = _repeat_words(tk.span_hashes(raw, start, end), first)
        data = raw.tobytes()
        whole, n_chunks, n_bad, good = _ratios([data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
        failed = (n_words < 10) | (100 * repeat > 20 * n_words)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": part.column("doc_id"),
                "n_words": n_words,
                "word_chars": _per_row(word & ((raw & 0xC0) != 0x80), offsets),
                "n_symbols": _per_row(SYMBOL[raw], offsets),
                "n_dup_lines": _dup_lines(raw, offsets, word),
                "n_repeat_words": repeat,
                "base_failed": failed,
                "whole_ratio": pa.array(whole, pa.float64()),
                "n_chunks": pa.array(n_chunks, pa.int64()),
                "n_bad_chunks": pa.array(n_bad, pa.int64()),
                "kept": ~failed & np.array(good, bool),
            }
        )


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts, ratios and verdict of each row; map-only."""
    return only(docs, id_col, text_col).mapInArrow(measure, SCHEMA)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
