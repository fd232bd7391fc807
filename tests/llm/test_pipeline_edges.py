"""The pipeline's stages with extra columns that bear the names they use themselves, nulls, repeats and empty tables."""

import corpus_pipeline
import pytest
from compare import DATA
from pyspark.sql import functions as F

STAGE = dict(corpus_pipeline.STAGES)
CLASH = {"quality_score": 0.0, "Score": "x", "secret_spans": 1, "spans": "y", "epoch": 0, "n_tokens": -1, "ids": "z", "h": 2, "copy": 3}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def clashing(docs):
    return docs.withColumns({n: F.lit(v) for n, v in CLASH.items()})


def keyed(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "", r["source"] or "") for r in df.select("doc_id", "text", "source").collect())


@pytest.mark.parametrize("name", ["quality", "near_dedup", "secrets", "mixing"])
def test_clashing_columns_change_nothing(spark, docs, name):
    plain = STAGE[name](spark, docs, DATA)
    extra = STAGE[name](spark, clashing(docs), DATA)
    assert extra.columns == [*docs.columns, *CLASH] and plain.schema == docs.schema
    assert keyed(extra) == keyed(plain) and plain.count() > 0
    assert [tuple(r) for r in extra.select(*CLASH).distinct().collect()] == [(0.0, "x", 1, "y", 0, -1, "z", 2, 3)]


def test_last_stage_with_clashing_columns(spark, docs):
    plain, extra = STAGE["bpe"](spark, docs, DATA), STAGE["bpe"](spark, clashing(docs), DATA)
    assert plain.columns == extra.columns == ["doc_id", "source", "n_tokens", "ids"]
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, extra.collect()), key=repr)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_nulls_repeats_and_no_rows(spark, docs, name):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (2, "word " * 20_000, "en", "s", 100_000), (2, "word " * 20_000, "en", "s", 100_000), (3, "a plain text of some words. " * 9, None, "s", 5)], docs.schema)
    got = STAGE[name](spark, odd, DATA)
    if name in ("secrets", "bpe"):
        assert got.count() == 5
    elif name == "near_dedup":
        assert got.filter("doc_id = 2").count() == 1 and got.filter("doc_id = 3").count() == 1
    else:
        assert got.count() <= 20
    assert STAGE[name](spark, docs.limit(0), DATA).count() == 0
