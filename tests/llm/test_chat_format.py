from shiftscope.llm.chat_format import PART, format_chat, plain_parts, read_back
from pyspark.sql import functions as F

NASTY = ["", None, "</s>", "<s>user\nx</s>", "\\", "\\\\</s>\\", "<\\/s>", "[INST][[INST]] [/INST", "<<SYS>> a <</SYS>>", "<image_1> <audio_x>", "a\nb\n", "é\U0001f600</s>é", "<</s>>", "\\<s>"]


def test_round_trip(spark):
    rows = [(i // 3, i % 3, ["user", "assistant", "system"][i % 3] if i != 7 else None, t) for i, t in enumerate(NASTY)] + [(None, None, "odd role\nname", "x"), (None, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in read_back(format_chat(df.withColumn("parts", plain_parts(F.col("text"))))).collect()}
    for c in {r[0] for r in rows}:
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))]
        assert [(t.role, t.text) for t in got[c].turns] == want
        assert got[c].loss_text == "".join(t for r, t in want if r == "assistant")


def test_parts(spark):
    img = lambda ref, w=280, h=56: ("image", None, ref, w, h, None, None)
    txt = lambda t: ("text", t, None, None, None, None, None)
    rows = [
        (1, 0, "user", [txt("see <image_1> "), img("a.png"), txt(" and "), ("audio", None, "b.wav", None, None, 1.5, None)]),
        (1, 1, "assistant", [txt("ok")]),
        (1, 2, "user", [("document", None, "c.pdf", None, None, None, 3), ("video", None, "no", None, None, None, None), img(None, None, None)]),
        (2, 0, "user", None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{PART}>")
    got = {r.conv_id: r for r in format_chat(df).collect()}
    assert got[1].formatted == "<s>user\nsee <\\image_1> <image_1> and <audio_2></s><s>assistant\nok</s><s>user\n<document_3><image_4></s>"
    assert [(a.number, a.type, a.ref, a.turn, a.tokens) for a in got[1].attachments] == [(1, "image", "a.png", 0, 20), (2, "audio", "b.wav", 0, 38), (3, "document", "c.pdf", 2, 1536), (4, "image", None, 2, 1)]
    assert got[1].attachment_tokens == 1595
    s = got[1].loss_spans[0]
    assert got[1].formatted[s.start : s.start + s.length] == "ok"
    assert got[2].formatted == "<s>user\n</s>"


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b")], "conv_id long, turn long, role string, text string").withColumn("parts", plain_parts(F.col("text")))
    assert [(t.role, t.text) for t in read_back(format_chat(df)).first().turns] == [("assistant", "b"), ("user", "a"), ("user", "a")]
    assert format_chat(df.limit(0)).count() == 0
