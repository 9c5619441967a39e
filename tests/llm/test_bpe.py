import hashlib
import json
import random

import numpy as np
import pytest

from shiftscope.llm import bpe

ODD = [
    None, "", " ", "\n\n  \n", "a", "it's we'll  I'VE 12abc 3.14  x y\u0085z", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>c  <|endof", "tab\tand\x1c\x1f\x0b end ", "你好 \U0001f600\U0001f468‍\U0001f469 é กำ",
    "x" * 20000, " " * 300, "the the the the", "᠎​﻿　q", "!!! ??  --- $$$###",
]


def reference(texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [(e.ids, t.decode(e.ids, skip_special_tokens=False)) for e in (t.encode(x or "", add_special_tokens=False) for x in texts)]


def test_matches_library(spark):
    rng = random.Random(3)
    pool = "ab Z9'\n\t.,-éß你  \U0001f600\x1c\x85"
    texts = ODD + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r for r in bpe.encode_digest(docs.repartition(3)).collect()}
    ids = {r.doc_id: r.ids for r in bpe.encode(docs).collect()}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    for i, (want, text) in enumerate(reference(texts)):
        assert ids[i] == want, texts[i]
        assert got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert back[i] == text


def test_other_files_are_refused():
    data = json.loads(bpe.vocabulary())
    bpe.check_file(data)
    others = [
        {"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": data["pre_tokenizer"] | {"add_prefix_space": True}}, {"decoder": None},
        {"model": data["model"] | {"byte_fallback": True}}, {"model": {"type": "WordPiece"}}, {"added_tokens": [data["added_tokens"][0] | {"rstrip": True}]},
    ]
    for other in others:
        with pytest.raises(ValueError):
            bpe.check_file(data | other)


def test_truncation_and_padding_of_a_file_are_unused(spark, tmp_path):
    data = json.loads(bpe.vocabulary())
    data["truncation"] = {"direction": "Right", "max_length": 2, "strategy": "LongestFirst", "stride": 0}
    data["padding"] = {"strategy": {"Fixed": 9}, "direction": "Right", "pad_to_multiple_of": None, "pad_id": 0, "pad_type_id": 0, "pad_token": "!"}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(data))
    docs = spark.createDataFrame([(1, "antidisestablishmentarianism of words")], "doc_id long, text string")
    assert bpe.encode(docs, path=str(path)).collect() == bpe.encode(docs).collect()


def test_decode_joins_every_id(spark):
    coded = spark.createDataFrame([(1, [10, 20]), (1, []), (2, None), (None, list(range(9000)))], "doc_id long, ids array<int>")
    got = sorted(((r.doc_id or 0, r.text) for r in bpe.decode(coded).collect()))
    pieces = bpe.joined(np.arange(9000), bpe.pieces_of(json.loads(bpe.vocabulary())))
    whole = b"".join(pieces[i] for i in range(9000)).decode("utf-8", "replace")
    assert got == [(0, whole), (1, ""), (1, (pieces[10] + pieces[20]).decode()), (2, "")]
    with pytest.raises(Exception, match="no piece for id 99999999"):
        bpe.decode(spark.createDataFrame([(1, [99999999])], "doc_id long, ids array<int>")).collect()


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, None)], "doc_id long, text string")
    assert bpe.encode_digest(docs).count() == 3
    assert bpe.encode_digest(docs.limit(0)).count() == 0
