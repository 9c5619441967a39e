"""Operator 6 - chat formatting with typed content parts.

A turn's content is an array of typed parts (text, image, audio, document).  The visitor
flattens them in order: a text part gives its escaped text, any other part a numbered
placeholder such as ``<image_2>``; its reference and the number of tokens it expands to
are recorded beside the text.  Each turn becomes ``<s>role\\ncontent</s>``.  The loss mask
is the spans of assistant content in the formatted text.

Escaping is reversible: backslashes are doubled, and a control string inside a text gets a
backslash after its first character, so no control string is left in an escaped text and
``read_back`` can cut the turns at the real ones.

Everything is DataFrame functions; there is one shuffle, by conversation.

Defined results: a null text is empty, null parts are no parts, a part of unknown type is
left out, a null role is the empty role; turns are ordered by turn number, then role, then
content, so ties and repeated rows have a fixed place and all stay; rows with a null
conversation id are one conversation; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftscope.llm.common import table

OPEN, CLOSE = "<s>", "</s>"
#: Control strings: turn marks, instruction marks and placeholders.
CONTROL = r"<(?=/?s>|<SYS>>|</SYS>>|(?:image|audio|document)_[0-9]+>)|\[(?=/?INST\])"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens that an attachment expands to: a patch, a second, a page.
PATCH, TOKENS_A_SECOND, TOKENS_A_PAGE = 28, 25, 512
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _expanded(part: Column) -> Column:
    """Tokens an attachment takes in a model's input; missing sizes count one unit."""
    image = F.ceil(F.coalesce(part["width"], F.lit(1)) / PATCH) * F.ceil(F.coalesce(part["height"], F.lit(1)) / PATCH)
    audio = F.ceil(F.coalesce(part["seconds"], F.lit(1.0)) * TOKENS_A_SECOND)
    pages = F.coalesce(part["pages"], F.lit(1)) * TOKENS_A_PAGE
    return F.when(part["type"] == "image", image).when(part["type"] == "audio", audio).otherwise(pages).cast("long")


def _known(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("")).isin("text", "image", "audio", "document")


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """Per conversation: conv_id, formatted, loss_spans (start, length in code points),
    attachments (number, type, ref, turn, tokens) and attachment_tokens.
    """
    parts = F.filter(F.coalesce(F.col(f"`{parts_col}`").cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")), _known)
    own = turns.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.struct(F.col(f"`{turn_col}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"), parts.alias("parts")).alias("t"),
    )
    conv = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # the visitor: parts in order, attachments numbered through the conversation
    flat = F.flatten(F.transform("turns", lambda t: F.filter(F.transform(t["parts"], lambda p: F.struct(t["turn"].alias("turn"), p.alias("part"))), lambda x: x["part"]["type"] != "text")))
    attachments = F.transform(flat, lambda x, i: F.struct((i + 1).alias("number"), x["part"]["type"].alias("type"), x["part"]["ref"].alias("ref"), x["turn"].alias("turn"), _expanded(x["part"]).alias("tokens")))
    others = lambda t: F.size(F.filter(t["parts"], lambda p: p["type"] != "text"))
    before = F.transform("turns", lambda t, i: F.aggregate(F.slice("turns", F.lit(1), i), F.lit(0), lambda a, u: a + others(u)))
    conv = conv.withColumn("attachments", attachments)
    conv = conv.withColumn("before", F.when(F.size("attachments") > 0, before).otherwise(F.transform("turns", lambda t: F.lit(0))))

    def content(t: Column, n: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            number = n + F.size(F.filter(F.slice(t["parts"], F.lit(1), i + 1), lambda q: q["type"] != "text"))
            return F.when(p["type"] == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<"), p["type"], F.lit("_"), number.cast("string"), F.lit(">")))

        return F.array_join(F.transform(t["parts"], one), "")

    said = F.zip_with("turns", "before", lambda t, n: F.struct(t["role"].alias("role"), F.concat(F.lit(OPEN), F.url_encode(t["role"]), F.lit("\n")).alias("head"), content(t, n).alias("text")))
    conv = conv.withColumn("said", said)
    formatted = F.array_join(F.transform("said", lambda x: F.concat(x["head"], x["text"], F.lit(CLOSE))), "")
    # one pass over the turns carries the place reached and the spans found
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(a: Column, x: Column) -> Column:
        head, size = F.char_length(x["head"]).cast("long"), F.char_length(x["text"]).cast("long")
        span = F.array(F.struct((a["at"] + head).alias("start"), size.alias("length")))
        return F.struct((a["at"] + head + size + len(CLOSE)).alias("at"), F.when(x["role"] == LOSS_ROLE, F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    spans = F.aggregate("said", start, step, lambda a: a["spans"])
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return conv.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"), "attachments", tokens.alias("attachment_tokens"))


def read_back(chats: DataFrame) -> DataFrame:
    """Adds turns (role, text) and loss_text, read from ``formatted`` and ``loss_spans`` alone."""
    cut = F.filter(F.split("formatted", CLOSE), lambda x: x != "")
    body = lambda x: F.substr(x, F.lit(len(OPEN) + 1))
    turns = F.transform(cut, lambda x: F.struct(F.url_decode(F.substring_index(body(x), "\n", 1)).alias("role"), unescape(F.substr(x, F.locate("\n", x) + 1)).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return chats.withColumn("turns", turns).withColumn("loss_text", loss)


def plain_parts(text: Column) -> Column:
    """A text column as a content array of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))


CONTROL_CASE = "</s>[INST] ok [/INST]"


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    case = spark.sql(f"SELECT -1L AS conv_id, i AS turn, if(i = 0, 'user', 'assistant') AS role, '{CONTROL_CASE}' AS text FROM (SELECT explode(array(0L, 1L)) AS i)")
    chats = read_back(format_chat(rows.unionByName(case).withColumn("parts", plain_parts(F.col("text")))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM (VALUES (0), (1)) v(i)),
e AS (SELECT *, length(text) + (length(text) - length(replace(text, '\', '')))
  + len(regexp_extract_all(text, '</?s>|<</?SYS>>|<(?:image|audio|document)_[0-9]+>|\[/?INST\]')) AS size FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + length(role) + size) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
