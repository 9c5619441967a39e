import re
import shutil

import pytest

import corpus_pipeline as cp
from shiftscope.llm import bpe, toxicity
from tests_llm_helpers import components


@pytest.fixture(scope="module")
def staged(spark):
    """The rows after each stage at a small size."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.collect()]
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        out.append(rows)
    return sf, out


def test_toxic_go_and_clean_stay(spark, staged):
    sf, out = staged
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect() if not r.predicted}
    assert {r.doc_id for r in out[1]} == want


def test_exact_copies_go(staged):
    _, out = staged
    least = {}
    for r in out[1]:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text)
        least[key] = min(r.doc_id, least.get(key, r.doc_id))
    assert sorted(r.doc_id for r in out[2]) == sorted(least.values())


def test_near_copies_go(staged):
    _, out = staged
    want = {c for _, c in components([(r.doc_id, r.text) for r in out[2]]).values()}
    assert {r.doc_id for r in out[3]} == want


def test_mixing_keeps_every_document(staged):
    _, out = staged
    assert {r.doc_id for r in out[4]} == {r.doc_id for r in out[3]}
    assert len(out[4]) >= len(out[3])


def test_run(spark, staged):
    sf, out = staged
    got = cp.run(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in out[4])
    assert got[0].asDict().keys() == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert bpe.encode_digest(spark.createDataFrame(out[4])).select("ids_sha256").collect()
