import hashlib
import random

import numpy as np
from shiftscope.llm.suffix_dedup import LENGTH, common_prefixes, equal_windows, removed_spans, suffix_order


def brute(rows):
    least = {}
    data = [(i if i is not None else 1 << 62, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - LENGTH + 1):
            s = b[k : k + LENGTH]
            least[s] = min(i, least.get(s, i))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - LENGTH + 1):
            if least[b[k : k + LENGTH]] < i:
                gone[k : k + LENGTH] = True
        keep = bytes(c for c, g in zip(b, gone) if not g)
        turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((i, len(b), int(gone.sum()), len(turn) // 2, hashlib.sha256(keep).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((r.doc_id if r.doc_id is not None else 1 << 62, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in removed_spans(df).collect())


def test_suffix_order_is_exact():
    rng = random.Random(2)
    for alphabet in ("ab", "aab", "abcdefgh", "a"):
        parts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(LENGTH, 160))) for _ in range(12)]
        text = np.frombuffer(b"\xff".join(p.encode() for p in parts) + b"\xff", np.uint8)
        start = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])[:-1]])
        wanted = np.concatenate([s + np.arange(len(p) - LENGTH + 1) for s, p in zip(start, parts)])
        order = suffix_order(text, wanted)
        assert sorted(order.tolist()) == sorted(wanted.tolist())
        keys = [text[p : p + LENGTH].tobytes() for p in order]
        assert keys == sorted(keys)
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), LENGTH)
        assert common_prefixes(text, order).tolist() == [0] + [common(a, b) for a, b in zip(keys, keys[1:])]
        assert equal_windows(text, order).tolist() == [False] + [a == b for a, b in zip(keys, keys[1:])]


def test_generated(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeéß ") for _ in range(rng.randint(2, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(8)]
    rows = [(0, None), (1, ""), (2, "short"), (3, "a" * 49), (4, "a" * 50), (5, "a" * 300), (6, "ab" * 200), (7, "b" + "ab" * 30), (8, "x" * 51 + "ab" * 30)]
    for i in range(60):
        text = " ".join(rng.choice(passages) if rng.random() < 0.3 else word() for _ in range(rng.randint(1, 40)))
        rows.append((10 + i * 13 % 97, text))
    rows += [(500 + i, rows[20][1]) for i in range(5)] + [(600, rows[20][1] + "!"), (10, passages[0] + passages[1]), (None, passages[2]), (None, passages[2] + "z"), (601, "y" * 3_000_000 + passages[3])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, batch int")
    assert got(df.repartition(4)) == brute(rows)
    assert got(df.coalesce(1)) == brute(rows)


def test_real_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(docs) == want
    assert sum(r[2] for r in want) > 1000
    assert got(docs.limit(0)) == []
