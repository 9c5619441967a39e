import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftscope.functions.text import parse_cell, show_cell
from shiftscope.operators import freq
from shiftscope.sources import corpus, sinks, vectors

BLOCK = "<s id=a_1>\nThe\tthe\tDET\t1\t2\tdet\t_\nbroken line\ndog\tdog\tNOUN\t2\t0\troot\tNumber=Sing\n</s>\n<s id=a_2>\nbarks\tbark\tVERB\t1\t0\troot\t_\n</s>\n"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("my corpus")
    for period, name, text in [("1990", "one.txt", BLOCK), ("1991", "two.conllu", BLOCK + "<s id=a_3>\nlast\tlast\tX\t1\t0\troot\t_\n"), ("1991", "skip.json", BLOCK)]:
        (base / period).mkdir(exist_ok=True)
        (base / period / name).write_text(text)
    (base / "loose.txt").write_text(BLOCK)
    return str(base)


def test_tokens(spark, root):
    got = corpus.read_tokens(spark, root).orderBy("period", "file_line").collect()
    assert [(r.period, r.file, r.file_line, r.sent_seq, r.sent_id, r.form) for r in got] == [
        (p, f, line, seq, sid, form) for p, f in (("1990", "one.txt"), ("1991", "two.conllu")) for line, seq, sid, form in ((2, 1, "a_1", "The"), (4, 1, "a_1", "dog"), (7, 2, "a_2", "barks"))
    ]
    assert corpus.read_tokens(spark, root, keep_unclosed=True).count() == 7
    assert {r.period: r.total for r in freq.token_counts(corpus.read_tokens(spark, root)).collect()} == {"1990": 3, "1991": 3}
    blocks = sorted(r.block for r in sinks.sentence_blocks(corpus.read_tokens(spark, root).where("period = '1990'")).collect())
    assert blocks[1] == "<s id=a_2>\nbarks\tbark\tVERB\t1\t0\troot\t_\n</s>"


def test_pluggable_parser(spark, root):
    lines = corpus.read_sentences(spark, root).where("period = '1990' AND line LIKE 'dog%'")
    rows = corpus.parse_with(lines, lambda texts: [[(w, w, "X", i + 1, 0, "root", "_") for i, w in enumerate(t.split()[:2])] for t in texts]).collect()
    assert [r.form for r in rows] == ["dog", "dog"]


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": {"x y": 2, "q\\"": 3}, "b": {"x y": 1}}')
    counts = corpus.read_period_counts(spark, str(tmp_path / "c.json"))
    assert sorted(map(tuple, counts.collect())) == [("a", 'q"', 3), ("a", "x y", 2), ("b", "x y", 1)]
    assert {r.period: r.json for r in sinks.period_json(counts).collect()} == {"a": '{"q\\"":3,"x y":2}', "b": '{"x y":1}'}
    (tmp_path / "combos.csv").write_text("subfolder&frequency&target&slot1&slot2\np&3&t&> a > b&> c\np&1&t&> c&\n")
    combos = corpus.read_combos(spark, str(tmp_path / "combos.csv"))
    assert sorted((r.frequency, tuple(r.slots)) for r in combos.collect()) == [(1, ("> c",)), (3, ("> a > b", "> c"))]
    sinks.write_combos(combos, str(tmp_path / "out"), 2)
    assert sorted(map(str, corpus.read_combos(spark, str(tmp_path / "out")).collect())) == sorted(map(str, combos.collect()))
    (tmp_path / "f.csv").write_text("id,subfolder,target,s1\n1,p,t,\"[('a', 'b'), ('c',)]\"\n2,p,t,[]\n")
    assert sorted(tuple(r.item) for r in corpus.read_fillers(spark, str(tmp_path / "f.csv")).collect()) == [("a", "b"), ("c",)]


def test_combos_of_any_size(spark, tmp_path):
    slots = [f"> s{i}" for i in range(7)]
    combos = spark.createDataFrame([("p", "t", slots, 2), ("p", "t", slots[:5], 3), ("p", "t", slots[:6], 1), ("q", "t", [], 4)], "period string, target string, slots array<string>, frequency long")
    sinks.write_combos(combos, str(tmp_path / "out"))
    assert sorted(map(str, corpus.read_combos(spark, str(tmp_path / "out")).collect())) == sorted(map(str, combos.collect()))
    assert len(sinks.combos_csv(combos.limit(0)).columns) == 3 + 5


def test_cells():
    assert parse_cell("[('on',), ('in',)]") == [["on"], ["in"]]
    assert parse_cell('["legacy","flat"]') == [["legacy"], ["flat"]]
    assert [parse_cell(x) for x in ("200", None, "", "nan", "[]", "<NA>", "('a','b')", "it's")] == [[["200"]], [], [], [], [], [], [["a", "b"]], [["it's"]]]
    assert parse_cell(show_cell([["a", "b"], ["c"]])) == [["a", "b"], ["c"]]


def test_vectors(spark, tmp_path):
    words, rows = ["a", "é b".replace(" ", "_"), "c"], np.arange(12, dtype=np.float32).reshape(3, 4)
    (tmp_path / "p.bin").write_bytes(vectors.encode_binary(words, rows))
    got = {r.word: list(r.vec) for r in vectors.read_binary(spark, str(tmp_path / "p.bin"), "p").collect()}
    assert got == {w: list(map(float, r)) for w, r in zip(words, rows)}
    (tmp_path / "p.txt").write_text("3 4\n" + "\n".join(w + " " + " ".join(map(str, r)) for w, r in zip(words, rows)))
    assert {r.word: list(r.vec) for r in vectors.read_text(spark, str(tmp_path / "p.txt"), "p").collect()} == got
    np.save(tmp_path / "p-w.npy", rows)
    (tmp_path / "p-vocab.pkl").write_bytes(pickle.dumps(words))
    unit = {r.word: r.vec for r in vectors.read_numpy(spark, str(tmp_path / "p-w.npy"), str(tmp_path / "p-vocab.pkl"), "p").collect()}
    assert np.allclose(np.linalg.norm(unit["c"]), 1)
    with pytest.raises(pickle.UnpicklingError):
        vectors._Strings(__import__("io").BytesIO(pickle.dumps(np.zeros(2)))).load()


def test_written_corpus_is_left_alone_if_asked(spark, tmp_path):
    columns = "period string, file string, sent_seq int, file_line int, sent_id string, form string, lemma string, pos string, id string, head string, deprel string, feats string"
    one = spark.createDataFrame([("p a", "f", 1, 2, "s1", "Dogs", "dog", "NOUN", "1", "0", "root", "_")], columns)
    path = f"file://{tmp_path}/c"
    sinks.write_corpus(one, path)
    sinks.write_corpus(one.withColumn("lemma", F.lit("cat")), path, skip_existing=True)
    assert [(r.period, r.lemma) for r in corpus.read_tokens(spark, path).collect()] == [("p a", "dog")]
    assert [r.period for r in corpus.files(spark, path).collect()] == ["p a"]
    with pytest.raises(Exception, match="already exists"):
        sinks.write_corpus(one, path)


def test_a_corpus_is_read_and_written_without_a_shuffle(spark, root, tmp_path):
    plan = lambda f: f._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Exchange" not in plan(corpus.read_tokens(spark, root))
    for keep in (False, True):
        want = corpus.tokens_of(corpus.raw_lines(spark, root), keep_unclosed=keep)
        got = corpus.read_tokens(spark, root, keep_unclosed=keep).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    fields = [*corpus.FIELDS]
    packed = corpus.read_tokens(spark, root).groupBy("period", "file", "sent_seq", "sent_id").agg(F.array_sort(F.collect_list(F.struct("file_line", *fields))).alias("t")).select("period", "file", "sent_seq", "sent_id", *[F.col(f"t.{c}").alias(c) for c in fields])
    blocks = lambda f: sorted((r.period, r.block) for r in f.collect())
    assert blocks(sinks.sentence_blocks(packed)) == blocks(sinks.sentence_blocks(corpus.read_tokens(spark, root)))
    path = f"file://{tmp_path}/pressed"
    sinks.write_corpus(packed, path, compression="gzip")
    rows = lambda f: sorted((r.period, r.sent_id, r.form, r.feats) for r in f.collect())
    assert rows(corpus.read_tokens(spark, path)) == rows(corpus.read_tokens(spark, root)) and corpus.files(spark, path).count()


def test_a_long_period_is_written_by_many_tasks(spark, tmp_path):
    lines = spark.range(20000).select(F.when(F.col("id") < 19000, "a").otherwise("b").alias("period"), F.format_string("f%05d", (F.col("id") % 4999).cast("int")).alias("file"), F.col("id").alias("sent_seq"), F.concat_ws(" ", "id", F.repeat(F.lit("x"), 9)).alias("line"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_merged(lines, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "out" / "period=a").glob("*.txt"))
    assert len(parts) > 4 and max(p.stat().st_size for p in parts) < sum(p.stat().st_size for p in parts) / 3
    want = [r.line for r in lines.where("period = 'a'").orderBy("file", "sent_seq").collect()]
    assert [x for p in parts for x in p.read_text().splitlines()] == want
    assert vectors.training_lines(spark, str(tmp_path / "out")).count() == 20000
    (tmp_path / "out" / "period=a" / "other.txt").write_text("one more\n")
    with pytest.raises(ValueError, match="2 text files"):
        vectors.training_lines(spark, str(tmp_path / "out"))
