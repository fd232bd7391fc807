"""The training-data pipeline over documents: five stages, each one operator of tidemark.llm.

Every stage gets what the stage before it kept, and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, quality, secrets, simhash
from tidemark.llm.common import written
from tidemark.session import ship


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of 0.3 or more), all rows of them.

    A null or empty text gets the score of a text without words. Extra columns stay, whatever their names."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model, out="quality_score")
    return scored.filter(F.col(scored.columns[-1]) >= quality.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more): the one with the smallest doc_id.

    Null texts are copies of each other, and so are empty ones; null keys come last, of repeated rows one stays. Extra columns stay."""
    return simhash.drop_near_copies(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark and its n_chars counted anew. Null texts stay null, repeated rows stay; so do extra columns, whatever their names."""
    found = secrets.scan(docs, spans="secret_spans")
    clean = found.withColumn("text", secrets.redacted(F.col("text"), F.col(found.columns[-1])))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents at their sources' target weights; a row appears once for each pass that takes it.

    A null source is one of its own, rows without words cost nothing, equal rows go together. Extra columns stay."""
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the number of tokens and token ids of every document of the mix, in as many rows. Null texts have no ids; extra columns go."""
    import public_tokenizers

    coded = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id", "source"])
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The classifier's boosting and the components have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
