"""Operator 5 - n-gram Jaccard join by vertical partitioning.

Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a document's set is its distinct
five-word shingles (a text with fewer words: the whole sequence as one), as 64-bit
hashes.  Two documents link when 100 * |intersection| >= 80 * |union|.

1. The global order of shingles (by hash) is cut into fragments.  Each fragment counts,
   apart from the others, which of its shingles stand in two or more documents; partial
   counts are summed per document.  A document with more than 20 % of shingles of its
   own can have no link and is settled here.
2. Documents with equal sets become one class with one representative.
3. The representatives' shingles are put in the order rarest first, again by fragments.
   A linked pair shares a shingle among the first n - ceil(0.8 n) + 1 of each (prefix
   filter) at places that leave room for the overlap needed (positional filter), and the
   parity signatures of its sets differ in no more bits than the sets may (bitmap filter).
4. Candidates are first the pairs with one member of each shingle's list, a number linear
   in the lists; those that link are merged.  Then all other pairs of a list that pass the
   filters and whose members are still in different components follow, so that no link
   between components is lost and a group of near copies never expands into all its pairs.
   Lists are held by size, so that only sets whose sizes allow a link meet; a list with very
   many such pairs is cut into blocks, and the pairs of blocks are dealt over tasks.
5. Candidates are verified by vertical fragments: partial overlaps of each fragment of
   the order are counted separately and summed per pair.

There is no cap on lists, candidates or partners.  Defined results: null and empty texts
have no shingles and link with nothing; rows that repeat an id and its set are one
document for the links and each come out; an empty table gives an empty result; extra
columns are ignored.  Null ids get a null component unless their class has another id.
Sets are compared by hashes: a shingle by 48 bits within its fragment, equal sets by their sizes
and two sums of 64 bits; each is wrong with a chance of under one in a million at 10^9 texts
for a pair that is looked at, and is not checked against the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftscope.llm import textkernel as tk
from shiftscope.llm.common import durable, from_six, only, pack, six_bytes, slices, table, unpack
from shiftscope.llm.components import components

WIDTH = 5
#: Bytes of a batch of texts or sets; bounds the temporaries.
BATCH = 4 << 20
PERCENT = 80
#: Pairs that are looked at together; pairs of a list beyond which its blocks of ``BLOCK`` sets go to tasks of their own.
STEP, LONG, BLOCK = 1_000_000, 20_000_000, 4096
#: Vertical fragments that a candidate pair is verified in.
SEGMENTS = 8
#: Words of 64 bits of a parity signature.
SIGNATURE = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)
FAMILIES = 4


def _fragment(value: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of the order, numbered."""
    return ((value >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _name(*arrays: np.ndarray) -> int:
    """A batch's name, by its content."""
    h = xxhash.xxh3_64()
    for a in arrays:
        h.update(np.ascontiguousarray(a))
    return h.intdigest() - (1 << 63)


def _deal(ids: pa.Array, sizes: np.ndarray, value: np.ndarray, row: np.ndarray, batch: int, parts: int) -> Iterator[pa.RecordBatch]:
    """A batch's sets cut into fragments; rows ascend. The batch's ids travel with one of them, and with the number of fragments.

    A task that is run again with its rows in another order makes batches of other names; one
    whose fragments come only in part fails the job.
    """
    frag = _fragment(value, parts)
    order = np.argsort(frag.astype(np.uint16) if parts <= 65536 else frag, kind="stable")
    value, row, frag = value[order], row[order], frag[order]
    border = np.searchsorted(frag, np.arange(parts + 1))
    home = batch % parts
    sent = len(np.union1d(np.flatnonzero(np.diff(border)), [home]))
    for f in range(parts):
        lo, hi = border[f], border[f + 1]
        if lo == hi and f != home:
            continue
        counts = np.bincount(row[lo:hi], minlength=len(ids)).astype(np.uint32)
        own = pack(ids.to_numpy(zero_copy_only=False), sizes.astype(np.uint32), sent) if f == home else None
        yield pa.RecordBatch.from_pydict({"frag": pa.array([f], pa.int64()), "batch": pa.array([batch], pa.int64()), "data": [pack(counts, six_bytes(value[lo:hi]))], "own": pa.array([own], pa.binary())})


DEALT = "frag long, batch long, data binary, own binary"


def _split(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", BATCH):
            raw, offsets = tk.buffer_of(part.column("text"))
            raw = tk.lower_ascii(raw)
            start, end, first = tk.spans(raw, offsets)
            value, row = tk.distinct_in_rows(*tk.shingles(tk.span_hashes(raw, start, end), first, WIDTH))
            ids = part.column("doc_id")
            yield from _deal(ids, np.bincount(row, minlength=part.num_rows), value, row, _name(ids.fill_null(0).to_numpy(), offsets, raw), parts)

    return run


def _shared(key: tuple, rows: pa.Table) -> pa.Table:
    """In one fragment: which shingles are in two or more sets, and in how many."""
    datas = [unpack(x) for x in rows.column("data").to_pylist()]
    values = [from_six(d) for _, d in datas]
    every = np.sort(np.concatenate(values))
    again = every[1:] == every[:-1]
    found = np.unique(every[1:][again])
    df = np.searchsorted(every, found, side="right") - np.searchsorted(every, found)
    out = []
    for (counts, data), value in zip(datas, values):
        at = np.minimum(np.searchsorted(found, value), max(len(found) - 1, 0))
        hit = found[at] == value if len(found) else np.zeros(len(value), bool)
        row = np.repeat(np.arange(len(counts)), counts)[hit]
        out.append(pack(np.bincount(row, minlength=len(counts)).astype(np.uint32), data[hit], df[at[hit]].astype(np.uint32)))
    return pa.table({"frag": rows.column("frag"), "batch": rows.column("batch"), "data": pa.array(out, pa.binary()), "own": rows.column("own")})


def _joined(rows: pa.Table):
    """A batch's fragments together again: (ids, sizes, key, row, df, how many equal batches there were), fragments in order."""
    key, row, df, own, seen = [], [], [], None, {}
    for f, data, mine in zip(rows.column("frag").to_pylist(), rows.column("data").to_pylist(), rows.column("own").to_pylist()):
        seen[f] = seen.get(f, 0) + 1
        own = mine or own
        if seen[f] > 1:
            continue
        counts, six, freq = unpack(data)
        # a fragment's number and the 48 bits kept name a shingle
        key.append(tk.mix(from_six(six) + np.array([f + 1], np.uint64) * _ODD))
        row.append(np.repeat(np.arange(len(counts)), counts))
        df.append(freq)
    ids, sizes, sent = unpack(own) if own else (None, None, None)
    if sent != len(key) or len(set(seen.values())) > 1:
        raise RuntimeError("a batch of texts was cut differently in two runs of a task")
    return ids, sizes.astype(np.int64), np.concatenate(key), np.concatenate(row), np.concatenate(df), next(iter(seen.values()))


def _room(sizes: np.ndarray) -> np.ndarray:
    """Most shingles of a set that a linked set may lack."""
    return sizes - (PERCENT * sizes + 99) // 100


def _kept(key: tuple, rows: pa.Table) -> pa.Table:
    """Each document of a batch: its size, and where it can have links, its shared shingles."""
    ids, sizes, value, row, _, times = _joined(rows)
    shared = np.bincount(row, minlength=len(ids))
    live = (sizes > 0) & (sizes - shared <= _room(sizes))
    take = live[row]
    value, row = tk.distinct_in_rows(value[take], row[take])
    first = np.searchsorted(row, np.arange(len(ids) + 1))
    second = tk.mix(value ^ _ODD)
    total = lambda v: np.array([v[a:b].sum(dtype=np.uint64) for a, b in zip(first[:-1], first[1:])], np.uint64).view(np.int64)
    out = pa.table(
        {
            "doc_id": pa.array(ids, pa.int64(), from_pandas=True), "n": pa.array(sizes, pa.int64()), "h1": total(value), "h2": total(second),
            # a set with a shingle of its own equals no other
            "own": pa.array((sizes - shared).astype(np.int64)), "keys": pa.array([value[a:b].tobytes() if ok else None for ok, a, b in zip(live, first[:-1], first[1:])], pa.binary()),
        }
    )
    return pa.concat_tables([out] * times)


KEPT = "doc_id long, n long, h1 long, h2 long, own long, keys binary"


def _resplit(parts: int):
    """Representatives' shingles, dealt to fragments of their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "keys", BATCH):
            sets = [np.frombuffer(x, np.uint64) for x in part.column("keys").to_pylist()]
            row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            ids, flat = part.column("doc_id"), np.concatenate(sets)
            yield from _deal(ids, part.column("n").to_numpy(), flat, row, _name(ids.to_numpy(), row, flat), parts)

    return run


def _ordered(key: tuple, rows: pa.Table) -> pa.Table:
    """Each representative that can have links: its shared shingles rarest first, the length of its prefix, its signature."""
    ids, sizes, value, row, df, times = _joined(rows)
    order = np.lexsort((value, df, row))
    value, row = value[order], row[order]
    first = np.searchsorted(row, np.arange(len(ids) + 1))
    alone = sizes - np.diff(first)
    live = np.flatnonzero(alone <= _room(sizes))
    prefix = np.minimum(_room(sizes) + 1 - alone, np.diff(first))
    out = pa.table(
        {
            "rep": pa.array(ids[live].astype(np.int64)), "n": pa.array(sizes[live]), "alone": pa.array(alone[live]), "prefix": pa.array(prefix[live]),
            "keys": pa.array([value[first[i] : first[i + 1]].tobytes() for i in live], pa.binary()),
        }
    )
    return pa.concat_tables([out] * times)


ORDERED = "rep long, n long, alone long, prefix long, keys binary"


def _signature(keys: np.ndarray) -> np.ndarray:
    """Parity of the keys that fall on each bit; two signatures differ in no more bits than the sets in members."""
    bit = keys % np.uint64(64 * SIGNATURE)
    odd = np.bincount(bit.astype(np.int64), minlength=64 * SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _postings(parts: int):
    """The prefixes, dealt to fragments of the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "keys", BATCH):
            reps, n, comp = (part.column(c).to_numpy() for c in ("rep", "n", "component"))
            alone, prefix = part.column("alone").to_numpy(), part.column("prefix").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in part.column("keys").to_pylist()]
            if not sets:
                continue
            row = np.repeat(np.arange(len(sets)), prefix)
            value = np.concatenate([s[:p] for s, p in zip(sets, prefix)])
            place = np.concatenate([np.arange(p) for p in prefix]) + alone[row]
            sign = np.stack([_signature(s) for s in sets])
            frag = _fragment(value, parts)
            order = np.argsort(frag, kind="stable")
            value, row, place, frag = value[order], row[order], place[order], frag[order]
            border = np.searchsorted(frag, np.arange(parts + 1))
            for f in np.flatnonzero(np.diff(border)).tolist():
                at = slice(border[f], border[f + 1])
                used, back = np.unique(row[at], return_inverse=True)
                yield pa.RecordBatch.from_pydict({"frag": pa.array([f], pa.int64()), "data": [pack(value[at], back.astype(np.uint32), place[at].astype(np.uint32), reps[used], n[used], alone[used], comp[used], sign[used])]})

    return run


def _need(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least overlap of linked sets of these sizes."""
    return (PERCENT * (a + b) + 99 + PERCENT) // (100 + PERCENT)


@dataclass
class Postings:
    """Places of sets in lists: whose (an index of the sets' arrays), and where in the set's order."""

    who: np.ndarray
    place: np.ndarray
    reps: np.ndarray
    n: np.ndarray
    alone: np.ndarray
    comp: np.ndarray
    sign: np.ndarray

    def passing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of pairs of postings in one list, the pairs of sets that the filters let pass, each once."""
        n, alone = self.n, self.alone
        a, b = self.who[i], self.who[j]
        ok = self.comp[a] != self.comp[b]
        i, j, a, b = i[ok], j[ok], a[ok], b[ok]
        need = _need(n[a], n[b])
        ok = (np.minimum(n[a] - self.place[i], n[b] - self.place[j]) >= need) & (np.minimum(n[a] - alone[a], n[b] - alone[b]) >= need)
        a, b, need = a[ok], b[ok], need[ok]
        # shingles of one set alone are outside the signatures and are known to differ
        differ = np.bitwise_count(self.sign[a] ^ self.sign[b]).sum(axis=1, dtype=np.int64) + alone[a] + alone[b]
        ok = n[a] + n[b] - differ >= 2 * need
        a, b = self.reps[a[ok]], self.reps[b[ok]]
        return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)

    def packed(self, at: np.ndarray) -> bytes:
        used, back = np.unique(self.who[at], return_inverse=True)
        return pack(back, self.place[at], self.reps[used], self.n[used], self.alone[used], self.comp[used], self.sign[used])


def _both(parts: list[Postings]) -> Postings:
    base = np.cumsum([0, *(len(p.reps) for p in parts)])
    return Postings(np.concatenate([p.who.astype(np.int64) + k for p, k in zip(parts, base)]), np.concatenate([p.place.astype(np.int64) for p in parts]), *(np.concatenate([getattr(p, f) for p in parts]) for f in ("reps", "n", "alone", "comp", "sign")))


def _across(post: Postings, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[np.ndarray]:
    """Passing pairs of left[k] with right[low[k]:high[k]], about ``STEP`` pairs at a time."""
    count = np.maximum(high - low, 0)
    ends = np.cumsum(count)
    k = 0
    while k < len(left):
        to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + STEP, side="right")))
        n = count[k:to]
        at = np.repeat(low[k:to] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        yield post.passing(np.repeat(left[k:to], n), right[at])
        k = to


def _reach(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sets by rising size: the range of sets whose sizes allow a link."""
    return np.searchsorted(sizes, (PERCENT * sizes + 99) // 100), np.searchsorted(sizes, 100 * sizes // PERCENT, side="right")


def _pairs(star: bool, long: int, block: int):
    """Candidates of one fragment's lists, each pair once; long lists' blocks, to be paired by other tasks."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        datas = [unpack(x) for x in rows.column("data").to_pylist()]
        post = _both([Postings(*d[1:]) for d in datas])
        value, n, comp = np.concatenate([d[0] for d in datas]), post.n, post.comp
        order = np.lexsort((n[post.who], value))
        value, post.who, post.place = value[order], post.who[order], post.place[order]
        head = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        tail = np.r_[head[1:], len(value)]
        found, blocks = [np.zeros((0, 2), np.int64)], []
        many = np.flatnonzero(tail - head > 1)
        if star:
            size = (tail - head)[many]
            list_of = np.repeat(np.arange(len(many)), size)
            at = np.concatenate([np.arange(h, t) for h, t in zip(head[many], tail[many])]) if len(many) else np.zeros(0, np.int64)
            rank = tk.mix((post.reps[post.who[at]].astype(np.uint64) + np.uint64(1)) * _ODD * (np.uint64(2) * (value[at] % np.uint64(FAMILIES)) + np.uint64(1)))
            order = np.lexsort((rank, list_of))
            lead = at[order][np.searchsorted(list_of[order], np.arange(len(many)))]
            found.append(post.passing(at, lead[list_of]))
        else:
            short = tail - head
            for size in np.unique(short[many]).tolist():
                lists = head[many][short[many] == size]
                if size <= 64:  # lists of one length together
                    x, y = np.triu_indices(size, 1)
                    step = max(1, STEP // len(x))
                    for k in range(0, len(lists), step):
                        own = lists[k : k + step]
                        found.append(post.passing((own[:, None] + x).ravel(), (own[:, None] + y).ravel()))
                    continue
                for h in lists.tolist():
                    own = np.arange(h, h + size)
                    kinds, of, count = np.unique(comp[post.who[own]], return_inverse=True, return_counts=True)
                    # pairs inside the list's largest component need no look
                    odd = np.flatnonzero(of != count.argmax())
                    low, high = _reach(n[post.who[own]])
                    if (high - low)[odd].sum() <= long:
                        found += _across(post, own[odd], own, low[odd], high[odd])
                        continue
                    cut = [*range(0, size, block), size]
                    own_odd = [bool((of[a:b] != count.argmax()).any()) for a, b in zip(cut[:-1], cut[1:])]
                    for x in range(len(own_odd)):
                        near = [y for y in range(len(own_odd)) if (own_odd[x] or own_odd[y]) and low[cut[max(x, y)]] < cut[min(x, y) + 1] and high[cut[min(x, y) + 1] - 1] > cut[max(x, y)]]
                        if near:
                            blocks.append((int(value[h].view(np.int64)), x, [min(x, y) << 32 | max(x, y) for y in near], post.packed(own[cut[x] : cut[x + 1]])))
        pairs = np.unique(np.concatenate(found), axis=0)
        none = [None] * len(pairs)
        return pa.table(
            {
                "a": pa.array([*pairs[:, 0].tolist(), *(None for _ in blocks)], pa.int64()), "b": pa.array([*pairs[:, 1].tolist(), *(None for _ in blocks)], pa.int64()),
                "list": pa.array([*none, *(x[0] for x in blocks)], pa.int64()), "block": pa.array([*none, *(x[1] for x in blocks)], pa.int64()),
                "meets": pa.array([*none, *(x[2] for x in blocks)], pa.list_(pa.int64())), "data": pa.array([*none, *(x[3] for x in blocks)], pa.binary()),
            }
        )

    return run


PAIRS = "a long, b long, list long, block long, meets array<long>, data binary"


def _block_pairs(key: tuple, rows: pa.Table) -> pa.Table:
    """Two blocks of a long list, or one with itself."""
    rows = rows.sort_by("block")
    parts = [Postings(*unpack(x)) for x in rows.column("data").to_pylist()]
    post = _both(parts)
    size = [len(p.who) for p in parts]
    right = np.arange(size[0], sum(size)) if len(size) > 1 else np.arange(size[0])
    left = np.arange(size[0])
    sizes, own = post.n[post.who[right]], post.n[post.who[left]]
    low = np.searchsorted(sizes, (PERCENT * own + 99) // 100) if len(size) > 1 else left + 1
    high = np.searchsorted(sizes, 100 * own // PERCENT, side="right")
    pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *_across(post, left, right, low, high)]), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Representatives' sets cut into vertical segments of the order of hashes."""
    for part in slices(batches, "keys", BATCH):
        rep, seg, keys = [], [], []
        for r, x in zip(part.column("rep").to_pylist(), part.column("keys").to_pylist()):
            own = np.sort(np.frombuffer(x, np.uint64))
            border = np.searchsorted(_fragment(own, SEGMENTS), np.arange(SEGMENTS + 1))
            for f in range(SEGMENTS):
                if border[f] < border[f + 1]:
                    rep.append(r), seg.append(f), keys.append(own[border[f] : border[f + 1]].tobytes())
        yield pa.RecordBatch.from_pydict({"rep": pa.array(rep, pa.int64()), "seg": pa.array(seg, pa.int32()), "keys": pa.array(keys, pa.binary())})


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        both = zip(b.column("x").to_pylist(), b.column("y").to_pylist())
        count = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in both]
        yield pa.RecordBatch.from_pydict({"a": b.column("a"), "b": b.column("b"), "shared": pa.array(count, pa.int64())})


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that link: partial overlaps of each segment, summed per pair."""
    seg = durable(sets.select("rep", "keys").mapInArrow(_cut, "rep long, seg int, keys binary"))
    left = pairs.join(seg.select(F.col("rep").alias("a"), "seg", F.col("keys").alias("x")), "a")
    both = left.join(seg.select(F.col("rep").alias("b"), "seg", F.col("keys").alias("y")), ["b", "seg"]).select("a", "b", "x", "y")
    total = both.mapInArrow(_partial, "a long, b long, shared long").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    size = sets.select("rep", "n")
    total = total.join(size.select(F.col("rep").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("rep").alias("b"), F.col("n").alias("nb")), "b")
    return total.filter(100 * F.col("shared") >= PERCENT * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def _labelled(sets: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return sets.withColumn("component", F.col("rep"))
    return sets.join(labels, sets.rep == labels.node, "left").select(*sets.columns, F.coalesce("component", "rep").alias("component"))


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id that links reach)."""
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = only(docs, id_col, text_col).mapInArrow(_split(parts), DEALT)
    met = dealt.groupBy("frag").applyInArrow(_shared, DEALT)
    kept = durable(met.groupBy("batch").applyInArrow(_kept, KEPT))
    live = kept.filter("keys is not null")
    # the representative is the class's smallest id; a set with a shingle of its own is a class by itself
    alike = ["n", "h1", "h2", "own", F.when(F.col("own") > 0, F.col("doc_id")).alias("self")]
    classes = live.groupBy(*alike).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "keys")).alias("r")).select("n", "h1", "h2", "own", "self", F.col("r.doc_id").alias("rep"), F.col("r.keys").alias("keys"))
    classes = durable(classes)
    again = classes.filter("rep is not null").select(F.col("rep").alias("doc_id"), "n", "keys").mapInArrow(_resplit(parts), DEALT)
    sets = durable(again.groupBy("frag").applyInArrow(_shared, DEALT).groupBy("batch").applyInArrow(_ordered, ORDERED))

    def candidates(labels: DataFrame | None, star: bool) -> DataFrame:
        dealt = _labelled(sets, labels).mapInArrow(_postings(parts), "frag long, data binary")
        made = dealt.groupBy("frag").applyInArrow(_pairs(star, LONG, BLOCK), PAIRS)
        if star:
            return made.select("a", "b").distinct()
        made = durable(made)
        blocks = made.where("data is not null").select("list", F.explode("meets").alias("meet"), "block", "data")
        return made.where("a is not null").select("a", "b").union(blocks.groupBy("list", "meet").applyInArrow(_block_pairs, "a long, b long")).distinct()

    tried = durable(candidates(None, True))
    links = durable(verified(tried, sets))
    rest = candidates(durable(components(links)), False).join(tried, ["a", "b"], "left_anti")
    links = links.union(durable(verified(durable(rest), sets)))
    labels = durable(components(links))
    of = durable(classes.drop("keys").join(labels, F.col("rep") == F.col("node"), "left").select("n", "h1", "h2", "own", "self", F.coalesce("component", "rep").alias("component_id")))
    lone = kept.filter("keys is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    same = [F.col(f"k.{c}") == F.col(f"o.{c}") for c in ("n", "h1", "h2", "own")] + [F.when(F.col("k.own") > 0, F.col("k.doc_id")).eqNullSafe(F.col("o.self"))]
    on = same[0]
    for s in same[1:]:
        on = on & s
    named = live.drop("keys").alias("k").join(of.alias("o"), on).select("k.doc_id", F.col("k.n").alias("n_shingles"), "o.component_id")
    return lone.union(named)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that are the smallest id of their component.

    Only the ids that go are joined with the rows.  Rows with a null id stay unless a linked
    document has an id.  Rows that repeat an id stay or go together.
    """
    named = clusters(docs, id_col, text_col)
    gone = durable(named.filter(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone_id"), F.lit(True).alias("gone")).distinct())
    names = docs.columns
    flat = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{id_col}`").cast("long").alias("own_id"))
    kept = flat.join(gone, F.col("own_id").eqNullSafe(F.col("gone_id")), "left_anti")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "documents"))
