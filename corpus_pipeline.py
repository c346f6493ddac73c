"""The corpus pipeline: stages that each call one operator on what the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, in
the columns of documents; ``run`` writes each stage to the shared folder and
reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, jaccard_join, packing, pii, shared, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on this stage's labelled input, rejects go; each row by itself, with or without an id."""
    model = toxicity.train(*toxicity.training_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.kept_documents(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id stays."""
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, one stays in each component."""
    return jaccard_join.kept_documents(docs)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets get surrogates; n_chars follows the new text."""
    out = pii.replace(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, bin_id, bin_offset, n_tokens of every piece of every document."""
    import public_tokenizers

    return packing.pack_documents(docs, tokenizer=public_tokenizers.path(packing.TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", hide_private),
    ("best_fit_packing", pack),
]

#: A trained model and keyed surrogates decide which rows remain: no SQL gives them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
