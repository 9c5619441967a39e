"""Operator 7 - repeated passages by two-stage suffix sorting.

Texts are UTF-8 bytes.  A byte goes if a 50-byte string that covers it also starts in a
document with a smaller id; strings are judged on the input.  Matches never cross documents.

1. Anchors.  Each 50-byte window has an anchor, the leftmost place in it with the least
   hash of ``GRAM`` bytes, so equal windows have equal anchors at one offset.  Runs of
   windows with one anchor are dealt by the anchor's hash to fragments, and a fragment
   tells which anchors stand in two rows.  Copies of whole texts are sorted like all else.
2. Passages.  Only the bytes of windows with a repeated anchor travel, to the anchor's
   fragment; equal passages of a batch go once.
3. Suffix sort.  In a fragment the suffixes that begin at windows are sorted in two
   stages (Itoh and Tanaka 1999): those smaller than their successors directly, the rest
   induced by scanning the buckets of first bytes in order.  The lengths of common prefixes
   of adjacent suffixes are computed, to the 50 bytes that a window has; where it is 50 the
   windows are equal, and the smallest id of such a group decides.
4. The windows that go return to their batch, are united, and the kept bytes are hashed.

The texts are read again for steps 2 and 4 in the same plan.  Batches are named by their
content; were one cut differently in another pass, the job would fail.

Defined results: null and empty texts have no bytes, nothing is removed from them and
from texts under 50 bytes; a null id is larger than any id; rows with equal ids remove
nothing from each other; each row comes out; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftscope.llm import textkernel as tk
from shiftscope.llm.common import from_six, only, pack, six_bytes, slices, table, unpack

LENGTH = 50
GRAM = 24
WINDOW = LENGTH - GRAM + 1
BATCH = 8 << 20
#: Fragments for each shuffle partition; a worker holds one fragment at a time.
SPREAD = 4
#: Bytes whose windows are looked at together; bounds the temporaries.
STEP = 2 << 20
LAST = np.iinfo(np.int64).max
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _words_at(raw: np.ndarray) -> np.ndarray:
    """The eight bytes at each place, first byte highest; zeros follow the end."""
    padded = np.concatenate([raw, np.zeros(LENGTH + 16, np.uint8)])
    return np.ndarray((len(raw) + LENGTH + 8,), ">u8", padded.data, 0, (1,))


def _anchors_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor place, hash) of every window of some bytes."""
    n = len(raw) - LENGTH + 1
    at = _words_at(raw)
    m = len(raw) - GRAM + 1
    h = np.full(m, _ODD, np.uint64)
    for k in range(0, GRAM, 8):
        h = (h ^ at[k : k + m].astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    value, place, span = h, np.arange(m, dtype=np.int32), 1
    while span < WINDOW:
        step = min(span, WINDOW - span)
        size = len(value) - step
        right = value[step : step + size] < value[:size]  # strictly: the leftmost of equals stays
        value = np.where(right, value[step : step + size], value[:size])
        place = np.where(right, place[step : step + size], place[:size])
        span += step
    return place[:n], value[:n]


def runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (row, first window, past the last window, anchor hash), windows never crossing rows."""
    row, begin, end, value = [], [], [], []
    n_rows = len(offsets) - 1
    i = 0
    while i < n_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STEP, side="right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo >= LENGTH:
            place, h = _anchors_of(raw[lo:hi])
            own = offsets[i : j + 1] - lo
            room = np.maximum(np.diff(own) - LENGTH + 1, 0)
            full = np.flatnonzero(room)
            inside = np.repeat(own[:-1][full] - np.concatenate([[0], np.cumsum(room[full])[:-1]]), room[full]) + np.arange(room.sum())
            which = np.repeat(full, room[full])
            p = place[inside]
            new = np.ones(len(p), bool)
            new[1:] = (p[1:] != p[:-1]) | (which[1:] != which[:-1])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(p))
            row.append(which[head] + i), begin.append(inside[head] + lo), end.append(inside[tail - 1] + lo + 1 if len(head) else inside[head]), value.append(h[inside[head]])
        i = j
    if not row:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    return np.concatenate(row), np.concatenate(begin), np.concatenate(end), np.concatenate(value)


def _fragment(value: np.ndarray, parts: int) -> np.ndarray:
    # anchors are small hashes, so their high bits are dealt after another mix
    return ((tk.mix(value) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class Batch:
    """Rows of one task that travel together."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, offsets: np.ndarray):
        self.ids, self.raw, self.offsets = ids, raw, offsets
        name = xxhash.xxh3_64(ids.tobytes())
        name.update(offsets.tobytes())
        name.update(np.ascontiguousarray(raw))
        self.name = name.intdigest() - (1 << 63)

    def dealt(self, parts: int):
        """Runs in the order of fragments, and the border of each fragment."""
        row, begin, end, value = runs(self.raw, self.offsets)
        frag = _fragment(value, parts)
        order = np.argsort(frag, kind="stable")
        return row[order], begin[order], end[order], value[order], np.searchsorted(frag[order], np.arange(parts + 1))


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(LAST).to_numpy(zero_copy_only=False)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[Batch]:
    for part in slices(batches, "text", BATCH):
        yield Batch(_ids(part.column("doc_id")), *tk.buffer_of(part.column("text")))


ANCHORS = "frag long, batch long, data binary"


def _deal(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            row, _, _, value, border = b.dealt(parts)
            for f in np.flatnonzero(np.diff(border)).tolist():
                lo, hi = border[f], border[f + 1]
                used, count = np.unique(row[lo:hi], return_counts=True)
                data = pack(six_bytes(value[lo:hi]), count.astype(np.uint32), used.astype(np.uint32))
                yield pa.RecordBatch.from_pydict({"frag": pa.array([f], pa.int64()), "batch": pa.array([b.name], pa.int64()), "data": [data]})

    return run


def _repeated(key: tuple, rows: pa.Table) -> pa.Table:
    """In one fragment: anchors that stand in two rows."""
    datas = [unpack(x) for x in rows.column("data").to_pylist()]
    value = np.concatenate([from_six(d[0]) for d in datas])
    base = np.cumsum([0, *(len(d[2]) for d in datas)])
    who = np.concatenate([np.repeat(np.arange(len(d[2])) + k, d[1]) for d, k in zip(datas, base)])
    order = np.argsort(value, kind="stable")
    v, w = value[order], who[order]
    head = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    many = np.minimum.reduceat(w, head) != np.maximum.reduceat(w, head)
    flag = np.zeros(len(v), bool)
    flag[order] = np.repeat(many, np.diff(np.append(head, len(v))))
    out, i = [], 0
    for d in datas:
        out.append(pack(np.packbits(flag[i : i + len(d[0])])))
        i += len(d[0])
    return pa.table({"frag": rows.column("frag"), "batch": rows.column("batch"), "flags": pa.array(out, pa.binary())})


TEXTS = "batch long, body binary"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _batches(batches):
        yield pa.RecordBatch.from_pydict({"batch": pa.array([b.name], pa.int64()), "body": [pack(b.ids, b.raw, b.offsets)]})


def _differs() -> RuntimeError:
    return RuntimeError("a batch of texts was cut differently in two passes")


PASSAGES = "frag long, batch long, data binary"


def _passages(parts: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The bytes of windows with a repeated anchor, equal ones of a batch once."""
        if not left.num_rows:
            raise _differs()
        flags = {f: unpack(x)[0] for f, x in zip(right.column("frag").to_pylist(), right.column("flags").to_pylist())}
        frags, datas = [], []
        b = Batch(*unpack(left.column("body")[0].as_py()))  # equal batches have equal passages
        row, begin, end, _, border = b.dealt(parts)
        for f in np.flatnonzero(np.diff(border)).tolist():
            if f not in flags:
                raise _differs()
            lo, hi = border[f], border[f + 1]
            at = np.flatnonzero(np.unpackbits(flags[f])[: hi - lo]) + lo
            if not len(at):
                continue
            size = end[at] - begin[at] + LENGTH - 1
            h = tk.span_hashes(b.raw, begin[at], begin[at] + size)
            _, first, which = np.unique(h, return_index=True, return_inverse=True)
            one = at[first]
            flat = np.repeat(begin[one] - np.concatenate([[0], np.cumsum(size[first])[:-1]]), size[first]) + np.arange(size[first].sum())
            frags.append(f)
            datas.append(pack(b.raw[flat], size[first].astype(np.uint32), which.astype(np.uint32), b.ids[row[at]], row[at].astype(np.uint32), (begin[at] - b.offsets[row[at]]).astype(np.int64)))
        return pa.table({"frag": pa.array(frags, pa.int64()), "batch": pa.array([key[0].as_py()] * len(frags), pa.int64()), "data": pa.array(datas, pa.binary())})

    return run


def suffix_order(text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted places of ``text`` in the order of their suffixes, exact to LENGTH bytes.

    ``text`` ends, as does each of its parts, with the byte 0xFF, which UTF-8 lacks.
    """
    n = len(text)
    step = np.zeros(n, np.int8)  # 1: smaller than the successor, by the first byte that differs
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    known = np.where(step != 0, np.arange(n), n - 1)
    known = np.minimum.accumulate(known[::-1])[::-1]
    small = step[known] >= 0
    # the wanted suffixes and, after each, those up to the first that is sorted directly
    need = np.zeros(n, bool)
    need[wanted] = True
    edge = np.flatnonzero(need & ~small)
    while len(edge):
        edge = edge[~need[edge + 1]] + 1
        need[edge] = True
        edge = edge[~small[edge]]
    direct = np.flatnonzero(need & small)
    order = _sorted_directly(text, direct)
    border = np.searchsorted(text[order], np.arange(257))  # by first byte
    rest = need & ~small
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in np.flatnonzero(np.bincount(text[need], minlength=256)).tolist():
        level = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        bucket = []
        while len(level):  # runs of one byte: shorter runs come first
            bucket.append(level)
            level = level[level > 0] - 1
            level = level[rest[level] & (text[level] == c)]
        bucket.append(order[border[c] : border[c + 1]])
        done = np.concatenate(bucket)
        out.append(done)
        back = done[done > 0] - 1
        back = back[rest[back] & (text[back] > c)]
        if len(back):
            first = text[back]
            by = np.argsort(first, kind="stable")
            back, first = back[by], first[by]
            cut = np.flatnonzero(np.diff(first)) + 1
            for part, b in zip(np.split(back, cut), first[np.concatenate([[0], cut])].tolist()):
                waiting[b].append(part)
        waiting[c] = []
    order = np.concatenate(out)
    mark = np.zeros(n, bool)
    mark[wanted] = True
    return order[mark[order]]


def _sorted_directly(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Places by their next LENGTH bytes, eight at a time; only ties are looked at again."""
    at = _words_at(text)
    order = places[np.argsort(at[places].astype(np.uint64), kind="stable")]
    word = at[order].astype(np.uint64)
    group = np.zeros(len(order), np.int64)
    group[1:] = np.cumsum(word[1:] != word[:-1])
    for k in range(8, LENGTH, 8):
        tie = np.zeros(len(order), bool)
        same = group[1:] == group[:-1]
        tie[1:] |= same
        tie[:-1] |= same
        open_ = np.flatnonzero(tie)
        if not len(open_):
            break
        # a suffix that met its part's end is told from others by it already
        word = at[order[open_] + k].astype(np.uint64)
        if k + 8 > LENGTH:
            word &= np.uint64(((1 << 64) - 1) ^ ((1 << (8 * (k + 8 - LENGTH))) - 1))
        by = np.lexsort((word, group[open_]))
        order[open_], word = order[open_][by], word[by]
        new = np.zeros(len(order), bool)
        new[1:] = group[1:] != group[:-1]
        new[open_[1:]] |= (word[1:] != word[:-1]) & (group[open_][1:] == group[open_][:-1])
        group = np.cumsum(new)
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The length of the common prefix of each suffix in order and the one before, to LENGTH bytes; 0 for the first."""
    at = _words_at(text)
    length = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for k in range(0, LENGTH, 8):
        differ = at[order[live] + k].astype(np.uint64) ^ at[order[live - 1] + k].astype(np.uint64)
        alike = differ == 0
        # whole bytes before the highest bit that differs
        bits = np.frexp((differ[~alike] >> np.uint64(32)).astype(np.float64))[1]
        low = bits == 0
        bits[~low] += 32
        bits[low] = np.frexp((differ[~alike][low]).astype(np.float64))[1]
        length[live[~alike]] = k + (64 - bits) // 8
        live = live[alike]
    length[live] = LENGTH
    return np.minimum(length, LENGTH)


def equal_windows(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether each suffix in order shares LENGTH bytes with the one before."""
    return common_prefixes(text, order) >= LENGTH


def _sort(key: tuple, rows: pa.Table) -> pa.Table:
    """In one fragment: the windows of passages that a smaller id has too."""
    datas = [unpack(x) for x in rows.column("data").to_pylist()]
    # passages that several batches have are sorted once
    number: dict[bytes, int] = {}
    mine = []
    for d in datas:
        data, cut = d[0].tobytes(), np.cumsum(d[1]).tolist()
        mine.append(np.array([number.setdefault(data[a:b], len(number)) for a, b in zip([0, *cut[:-1]], cut)], np.int64))
    text = np.frombuffer(b"\xff".join(number) + b"\xff", np.uint8)
    size = np.array([len(x) for x in number], np.int64)
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    which = np.concatenate([m[d[2]] for m, d in zip(mine, datas)])
    ids = np.concatenate([d[3] for d in datas])
    least = np.full(len(number), LAST, np.int64)
    np.minimum.at(least, which, ids)
    windows = size - LENGTH + 1
    first = np.concatenate([[0], np.cumsum(windows)])
    owner = np.repeat(np.arange(len(number), dtype=np.int32), windows)
    wanted = start[owner] + np.arange(len(owner)) - first[owner]
    order = suffix_order(text, wanted)
    head = np.flatnonzero(~equal_windows(text, order))
    place = np.empty(len(text), np.int32 if len(text) < 1 << 31 else np.int64)
    place[wanted] = np.arange(len(wanted))
    at = place[order]
    del place, wanted, order
    low = np.repeat(np.minimum.reduceat(least[owner[at]], head), np.diff(np.append(head, len(at))))
    gone = np.zeros(len(owner), bool)
    gone[at] = low < least[owner[at]]
    # runs of windows that go where the passage's smallest id has them
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    split = first[1:-1][gone[first[1:-1] - 1] & gone[first[1:-1]]] if len(gone) else np.zeros(0, np.int64)
    up = np.union1d(np.flatnonzero(edge == 1), split)
    down = np.union1d(np.flatnonzero(edge == -1), split)
    run_of = owner[up] if len(up) else np.zeros(0, np.int64)
    run_first = np.searchsorted(run_of, np.arange(len(number) + 1))
    out, k = [], 0
    for d in datas:
        n = len(d[2])
        w, doc, row, begin = which[k : k + n], d[3], d[4].astype(np.int64), d[5]
        k += n
        later = doc > least[w]
        r, a, z = [row[later]], [begin[later]], [begin[later] + size[w[later]]]
        own = np.flatnonzero(~later)
        count = run_first[w[own] + 1] - run_first[w[own]]
        rep = np.repeat(own, count)
        runs_at = np.repeat(run_first[w[own]] - np.concatenate([[0], np.cumsum(count)[:-1]]) if len(own) else np.zeros(0, np.int64), count) + np.arange(count.sum())
        r.append(row[rep]), a.append(begin[rep] + up[runs_at] - first[w[rep]]), z.append(begin[rep] + down[runs_at] - first[w[rep]] + LENGTH - 1)
        out.append(pack(np.concatenate(r), np.concatenate(a), np.concatenate(z)))
    return pa.table({"batch": rows.column("batch"), "gone": pa.array(out, pa.binary())})


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:bigint,past:bigint>>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))


def _finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
    if not left.num_rows:
        raise _differs()
    found = [unpack(x) for x in right.column("gone").to_pylist() if x is not None]
    row, a, z = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
    for body in left.column("body").to_pylist():
        ids, raw, offsets = unpack(body)
        edge = np.zeros(len(raw) + 1, np.int32)
        np.add.at(edge, offsets[row] + a, 1)
        np.add.at(edge, offsets[row] + z, -1)
        gone = np.cumsum(edge[:-1]) > 0
        for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            own = gone[lo:hi]
            turn = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
            out["doc_id"].append(None if ids[i] == LAST else int(ids[i]))
            out["n_bytes"].append(hi - lo)
            out["n_removed"].append(int(own.sum()))
            out["n_spans"].append(len(turn) // 2)
            out["kept_sha256"].append(hashlib.sha256(raw[lo:hi][~own].tobytes() if len(turn) else raw[lo:hi].tobytes()).hexdigest())
            out["spans"].append([{"first": x, "past": y} for x, y in turn.reshape(-1, 2).tolist()])
    return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), **{k: pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")}, "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "spans": pa.array(out["spans"], _SPANS)})


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (bytes)."""
    parts = SPREAD * max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = only(docs, id_col, text_col)
    flags = own.mapInArrow(_deal(parts), ANCHORS).groupBy("frag").applyInArrow(_repeated, "frag long, batch long, flags binary")
    texts = own.mapInArrow(_texts, TEXTS)
    passages = texts.groupBy("batch").cogroup(flags.groupBy("batch")).applyInArrow(_passages(parts), PASSAGES)
    gone = passages.groupBy("frag").applyInArrow(_sort, "batch long, gone binary")
    return texts.groupBy("batch").cogroup(gone.groupBy("batch")).applyInArrow(_finish, RESULT)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_spans(table(spark, sf_dir, "documents")).drop("spans")
