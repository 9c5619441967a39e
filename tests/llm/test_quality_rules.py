import re

import pytest

from shiftscope.llm.quality_rules import judge

TEXTS = [
    None, "", "   \n\t ", "one two", "a b c d e a b c d e x y z", "x\n\nx\nx \n x\nä ö ü #|<> ß\r\nq", "# * $ % & | < > ok\n" * 30,
    " ".join(f"w{i * 7919 % 4093}" for i in range(4000)), "longword" * 5000, "\n", "line\n", "a\x0bb\x0cc", "dup\ndup", "b b b b b b b b b b b b",
    " ".join("the cat sat on a mat near hut".split() * 2 + [str(i) for i in range(40)]),
]


def brute(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, cover = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cover |= {i + j for i in at for j in range(5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), n < 10 or 100 * len(cover) > 20 * n


def test_counts_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, "again", "y")], "doc_id long, text string, kept string").coalesce(1)
    got = {}
    for r in judge(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[0]) == 2
    for i, t in enumerate(TEXTS[1:], 1):
        r = got[i][0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t[:50]
        assert not (r.base_failed and r.kept)


def test_bands(spark):
    import random

    rng = random.Random(1)
    plain = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 7))) for _ in range(1500))
    noise = " ".join("".join(chr(rng.randint(33, 126)) for _ in range(40)) for _ in range(200))
    other = " ".join(f"{w} {w}" for w in plain.split()[:5]) + " " + "zz" * 3000 + " " + " ".join(plain.split()[:60])
    rows = judge(spark.createDataFrame([(1, plain), (2, noise), (3, other)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.kept for r in rows} == {1: True, 2: False, 3: False}


def test_noise_at_the_end_of_a_text(spark):
    import base64
    import random

    rng = random.Random(2)
    plain = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 7))) for _ in range(1500))
    noise = base64.b64encode(rng.randbytes(1500)).decode()[:1900]
    texts = [plain[:2048] + noise, plain[:2048] + plain[:1900][::-1], plain[:4096], plain[:1000]]
    rows = judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_chunks, r.n_bad_chunks, r.kept) for r in rows} == {0: (2, 1, False), 1: (2, 0, True), 2: (2, 0, True), 3: (1, 0, True)}


def test_empty_table(spark):
    assert judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("name", ["documents"])
def test_no_nulls_in_real_table(spark, name):
    docs = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    for r, t in zip(judge(docs.orderBy("doc_id")).orderBy("doc_id").collect(), docs.orderBy("doc_id").collect()):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t.text)
