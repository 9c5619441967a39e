"""Walks inside packed sentences: a row a sentence, a token's fields at one place of its arrays.

A sentence's edges and walks never leave its row, so nothing but results is shuffled. The joins
of walks with edges run on whole Arrow batches in numpy: nodes are numbers, (sentence, id), and
edges are looked up in their sorted numbers.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENT = ["period", "file", "sent_seq"]
FIELDS = ("form", "lemma", "pos", "id", "head", "deprel")
#: Tokens that one pass works on; bounds the temporaries of a Python worker. Sentences are never cut.
TOKENS = 1 << 19


def packed(tokens: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(sentence, an array a field): tokens are brought together once by sentence, packed sentences stay as they are."""
    if dict(tokens.dtypes)["id"].startswith("array"):
        return tokens.select(*SENT, *fields)
    own = tokens.groupBy(*SENT).agg(F.collect_list(F.struct(*fields)).alias("t"))
    return own.select(*SENT, *[F.col(f"t.{c}").alias(c) for c in fields])


@dataclass(frozen=True)
class Search:
    """Targets by lemma and part of speech (or listed in a column ``targets``), and the walks from them:
    along ``chains`` of steps, or all of ``depth`` steps and those that end before, or all of 1..depth steps.

    ``mode`` open, closeh or close keeps targets by all chains (see ``graph.matched``), any those with some match.
    """

    lemma: str | None = None
    pos: str | None = None
    listed: bool = False
    chains: tuple = ()
    depth: int = 0
    prefixes: bool = False
    visited: bool = True
    mode: str = "any"
    fmt: str = "lemma"
    filtered_pos: tuple = ()

    @property
    def fields(self) -> tuple[str, ...]:
        first, _, tail = self.fmt.partition("/")
        need = {"id", "head", "deprel"}
        if self.lemma is not None:
            need.add("lemma")
        if self.pos is not None or self.filtered_pos or any(s.pos for c in self.chains for s in c):
            need.add("pos")
        if self.chains:
            need |= {"form" if first == "token" else "lemma", *([tail] if tail else [])} | ({"pos"} if tail else set())
        return tuple(c for c in FIELDS if c in need)


def search(tokens: DataFrame, how: Search) -> DataFrame:
    """A row a target: (sentence, target, paths) of walks of a depth, (sentence, target, anchor, found) of chains,
    found being structs (path_ix, seen, labels, shown); shown is null where no token is shown."""
    own = packed(tokens, how.fields + (("targets",) if how.listed else ()))
    if how.lemma is not None:
        own = own.where(F.array_contains("lemma", how.lemma))
    if how.pos is not None:
        own = own.where(F.array_contains("pos", how.pos))
    kind = own.schema["sent_seq"].dataType.simpleString()
    what = "anchor string, found array<struct<path_ix:int,seen:array<string>,labels:array<string>,shown:array<string>>>" if how.chains else "paths array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                yield _Part(part, how).result()

    return own.mapInArrow(run, f"period string, file string, sent_seq {kind}, target string, {what}")


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch cut between sentences into parts of about TOKENS tokens."""
    size = pc.fill_null(pc.list_value_length(batch.column("id")), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if total and total + n > TOKENS:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


class _Edges:
    """Edges in the order of their first node."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, label: np.ndarray, token: np.ndarray):
        order = np.argsort(src, kind="stable")
        self.src, self.dst, self.label, self.token = src[order], dst[order], label[order], token[order]

    def of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of nodes, and of their edges, of each pair that meets."""
        low, high = np.searchsorted(self.src, nodes), np.searchsorted(self.src, nodes, "right")
        n = high - low
        row = np.repeat(np.arange(len(nodes)), n)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n - low, n)


class _Part:
    def __init__(self, batch: pa.RecordBatch, how: Search):
        self.batch, self.how = batch, how
        size = pc.fill_null(pc.list_value_length(batch.column("id")), 0).to_numpy(zero_copy_only=False)
        self.row = np.repeat(np.arange(batch.num_rows, dtype=np.int64), size)
        ids, heads = self._flat("id"), self._flat("head")
        if pa.types.is_integer(ids.type):
            own, head = ids.to_numpy(zero_copy_only=False).astype(np.int64), pc.fill_null(heads, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            self.names, self.live = None, head != 0
        else:
            both = pa.concat_arrays([ids, heads]).dictionary_encode()
            self.names = both.dictionary
            codes = pc.fill_null(both.indices, len(self.names)).to_numpy(zero_copy_only=False).astype(np.int64)
            own, head = codes[: len(ids)], codes[len(ids) :]
            self.live = (head != len(self.names)) & (head != pc.index(self.names, "0").as_py())
        self.width = 1 + int(max(own.max(initial=0), head.max(initial=0)))
        self.id, self.head = self.row * self.width + own, self.row * self.width + head
        rel = self._flat("deprel").dictionary_encode()
        self.relations = rel.dictionary.to_pylist()
        self.rel = pc.fill_null(rel.indices, len(self.relations)).to_numpy(zero_copy_only=False).astype(np.int64)
        self.labels = [*("chi_" + str(x) for x in self.relations), None, *("pa_" + str(x) for x in self.relations), None]
        self._kept: dict = {}

    def _flat(self, name: str) -> pa.Array:
        return self.batch.column(name).flatten()

    def _once(self, key, make):
        if key not in self._kept:
            self._kept[key] = make()
        return self._kept[key]

    def _show(self, nodes: np.ndarray) -> pa.Array:
        """Nodes as ids."""
        own = nodes % self.width
        return pc.cast(pa.array(own), pa.string()) if self.names is None else self.names.take(pa.array(own))

    def edges(self, label: str | None = None) -> _Edges:
        def make() -> _Edges:
            up, down = label is None or label.startswith("pa_"), label is None or label.startswith("chi_")
            at = self.live
            if label is not None:
                name = label.split("_", 1)[-1]
                at = at & (self.rel == (self.relations.index(name) if name in self.relations else -1))
            at = np.flatnonzero(at)
            src = [self.id[at]] * up + [self.head[at]] * down
            dst = [self.head[at]] * up + [self.id[at]] * down
            code = [self.rel[at] + len(self.relations) + 1] * up + [self.rel[at]] * down
            none = [np.zeros(0, np.int64)]
            return _Edges(*(np.concatenate(x or none) for x in (src, dst, code, [at] * (up + down))))

        return self._once(("edges", label), make)

    def targets(self) -> np.ndarray:
        """Nodes of the targets."""
        how = self.how
        if how.listed:
            own = self.batch.column("targets")
            row = np.repeat(np.arange(len(own), dtype=np.int64), pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False))
            flat = own.flatten()
            if self.names is None:
                return row * self.width + flat.cast(pa.int64()).to_numpy(zero_copy_only=False)
            code = pc.index_in(flat, self.names)
            ok = pc.is_valid(code).to_numpy(zero_copy_only=False)
            return (row * self.width)[ok] + pc.drop_null(code).to_numpy(zero_copy_only=False)
        at = np.ones(len(self.row), bool)
        for name, want in (("lemma", how.lemma), ("pos", how.pos)):
            if want is not None:
                at &= pc.fill_null(pc.equal(self._flat(name), want), False).to_numpy(zero_copy_only=False)
        return self.id[at]

    def _of_pos(self, wanted: tuple) -> np.ndarray:
        return self._once(("pos", wanted), lambda: pc.is_in(self._flat("pos"), pa.array(list(wanted), pa.string())).to_numpy(zero_copy_only=False))

    def along(self, which: np.ndarray, chain: tuple) -> tuple[np.ndarray, np.ndarray]:
        """The places of targets, and the nodes seen, of the walks along a chain."""
        target, seen = np.arange(len(which)), which[:, None]
        for step in chain:
            links = self.edges(step.relation)
            row, edge = links.of(seen[:, -1])
            dst = links.dst[edge]
            ok = np.ones(len(row), bool)
            if step.pos and step.relation.startswith("chi_"):
                ok &= self._of_pos(step.pos)[links.token[edge]]
            elif step.pos:
                ok &= np.isin(dst, self.id[self._of_pos(step.pos)])
            if self.how.visited:
                ok &= ~(seen[row] == dst[:, None]).any(axis=1)
            row, dst = row[ok], dst[ok]
            target, seen = target[row], np.column_stack([seen[row], dst])
        return target, seen

    def everywhere(self, which: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places of targets, labels) of the walks of each length that count."""
        links, out = self.edges(), []
        target, seen, labels = np.arange(len(which)), which[:, None], np.zeros((len(which), 0), np.int64)
        for _ in range(self.how.depth):
            row, edge = links.of(seen[:, -1])
            ok = ~(seen[row] == links.dst[edge][:, None]).any(axis=1)
            row, edge = row[ok], edge[ok]
            if not self.how.prefixes:
                stuck = np.ones(len(target), bool)
                stuck[row] = False
                out.append((target[stuck], labels[stuck]))
            target, seen, labels = target[row], np.column_stack([seen[row], links.dst[edge]]), np.column_stack([labels[row], links.label[edge]])
            if self.how.prefixes:
                out.append((target, labels))
        return (out if self.how.prefixes else [*out, (target, labels)])

    def result(self) -> pa.RecordBatch:
        which = self.targets()
        own = self._chains(which) if self.how.chains else (which, {"paths": self._paths(which)})
        which, columns = own
        row = pa.array(which // self.width)
        keys = {c: self.batch.column(c).take(row) for c in SENT}
        return pa.RecordBatch.from_pydict({**keys, "target": self._show(which), **columns})

    def _paths(self, which: np.ndarray) -> pa.Array:
        texts, target, code = [], [], []
        for at, labels in self.everywhere(which):
            if labels.shape[1] and len(labels):
                kind, own = np.unique(labels @ len(self.labels) ** np.arange(labels.shape[1]), return_inverse=True)
                _, first = np.unique(own, return_index=True)
                code.append(own + len(texts))
                # a relation that is not known leaves no name of its path but the others'
                texts += ["> " + " > ".join(self.labels[x] for x in labels[i] if self.labels[x] is not None) for i in first]
                target.append(at)
        target, code = np.concatenate(target or [np.zeros(0, np.int64)]), np.concatenate(code or [np.zeros(0, np.int64)])
        order = np.argsort(target, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(target, minlength=len(which)))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(texts, pa.string()).take(pa.array(code[order])))

    def _chains(self, which: np.ndarray) -> tuple[np.ndarray, dict]:
        how, chains = self.how, self.how.chains
        wide = 1 + max(len(c) for c in chains)
        if how.mode in ("closeh", "close"):  # in both the target's own relations are exactly the first steps
            row, edge = self.edges().of(which)
            label = self.edges().label[edge]
            fit = np.ones(len(which), bool)
            firsts = {c[0].relation for c in chains}
            fit[row[~np.isin(label, [i for i, x in enumerate(self.labels) if x in firsts])]] = False
            for name in firsts:
                has = np.zeros(len(which), bool)
                has[row[np.isin(label, [i for i, x in enumerate(self.labels) if x == name])]] = True
                fit &= has
            which = which[fit]
        found = [self.along(which, c) for c in chains]
        target = np.concatenate([t for t, _ in found])
        path = np.repeat(np.arange(len(chains)), [len(t) for t, _ in found])
        seen = np.concatenate([np.pad(s, ((0, 0), (0, wide - s.shape[1])), constant_values=-1) for _, s in found])
        has = np.zeros((len(which), len(chains)), bool)
        has[target, path] = True
        keep = has.any(axis=1) if how.mode == "any" else has.all(axis=1)
        good = keep[target]
        order = np.flatnonzero(good)[np.argsort(target[good], kind="stable")]
        target, path, seen = target[order], path[order], seen[order]
        if how.mode == "close":
            good = self._closed(target, path, seen)
            target, path, seen = target[good], path[good], seen[good]
            keep = np.bincount(target, minlength=len(which)) > 0
        n = np.bincount(target, minlength=len(which))[keep]
        which = which[keep]
        length = np.array([len(c) for c in chains])[path]
        to = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)]), pa.int32())
        later = seen[:, 1:]
        names = [s.relation for c in chains for s in c]
        begin = np.concatenate([[0], np.cumsum([len(c) for c in chains])[:-1]])
        steps = (begin[path][:, None] + np.arange(wide - 1))[np.arange(wide - 1) < length[:, None]]
        struct = pa.StructArray.from_arrays(
            [
                pa.array(path, pa.int32()), pa.ListArray.from_arrays(to(length + 1), self._show(seen[seen >= 0])),
                pa.ListArray.from_arrays(to(length), pa.array(names, pa.string()).take(pa.array(steps))), pa.ListArray.from_arrays(to(length), self._shown(later[later >= 0], how.fmt, how.filtered_pos)),
            ], ["path_ix", "seen", "labels", "shown"],
        )
        return which, {"anchor": self._shown(which, how.fmt.replace("/deprel", "/pos")), "found": pa.ListArray.from_arrays(to(n), struct)}

    def _shown(self, nodes: np.ndarray, fmt: str, filtered_pos: tuple = ()) -> pa.Array:
        """The fillers of nodes, null for one that is no token or of a part of speech left out."""
        order, own = self._once("tokens", lambda: (lambda o: (o, self.id[o]))(np.argsort(self.id, kind="stable")))
        place = np.minimum(np.searchsorted(own, nodes), max(len(own) - 1, 0))
        there = own[place] == nodes if len(own) else np.zeros(len(nodes), bool)
        token = order[place] if len(own) else place
        if filtered_pos:
            pos = self._flat("pos")
            there = there & (pc.is_valid(pos).to_numpy(zero_copy_only=False) & ~self._of_pos(filtered_pos))[token]
        first, _, tail = fmt.partition("/")
        at = pa.array(token, mask=~there)
        text = self._flat("form" if first == "token" else first).take(at)
        if not tail:
            return text
        more = self._flat(tail).take(at)
        both = pc.is_valid(text).to_numpy(zero_copy_only=False) & pc.is_valid(more).to_numpy(zero_copy_only=False)
        one = pc.coalesce(text, more, pa.scalar("", pa.string()))
        joined = pc.if_else(pa.array(both), pc.binary_join_element_wise(pc.fill_null(text, ""), pc.fill_null(more, ""), "/"), one)
        return pc.if_else(pa.array(there), joined, pa.scalar(None, pa.string()))

    def _closed(self, target: np.ndarray, path: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """The places of the matches in choices of one match a path that explain every relation of every node in them."""
        links, chains = self.edges(), self.how.chains
        row, edge = links.of(seen.ravel())
        own: dict[int, set] = {}
        for node, label, dst in zip(seen.ravel()[row].tolist(), links.label[edge].tolist(), links.dst[edge].tolist()):
            own.setdefault(node, set()).add((self.labels[label], dst))
        good, rows = [], seen.tolist()
        for _, group in itertools.groupby(range(len(target)), lambda i: target[i]):
            options: list[list[int]] = [[] for _ in chains]
            for i in group:
                options[path[i]].append(i)
            for choice in itertools.product(*options):
                allowed, before = {}, {}
                for i in choice:
                    chain, nodes = chains[path[i]], rows[i]
                    for j in range(len(chain) + 1):
                        allowed.setdefault(nodes[j], set()).update([chain[j].relation] if j < len(chain) else [])
                        if j:
                            before.setdefault(nodes[j], set()).add(nodes[j - 1])
                last = {n: next(iter(b)) if len(b) == 1 else max(b, key=lambda x: self._show(np.array([x]))[0].as_py()) for n, b in before.items()}
                if all({x for x, dst in own.get(n, ()) if dst != last.get(n)} == a for n, a in allowed.items()):
                    good.extend(choice)
        return np.unique(np.array(good, np.int64))
