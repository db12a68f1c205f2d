"""The corpus pipeline: documents to packed training sequences.

toxicity -> exact dedup -> SimHash near-dedup -> personal data -> packing. Each stage takes what
its predecessor kept; what it decides takes effect for all that follow.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import exact_dedup, packing, pseudonyms, simhash, toxicity
from blockloom.llm.common import shared_path, table, unused


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold stay. The model is fitted on the labelled rows. A null text is
    scored as an empty one; other columns may have any names; an empty table stays empty."""
    model, score = toxicity.train(docs, table(spark, sf_dir, "labels")), unused(docs, "score")
    return toxicity.score(docs, model, score_col=score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays, once. Null and empty texts are equal; an empty table stays empty."""
    return exact_dedup.exact_dedup(docs).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest id stays. Blank texts are one group; an empty table stays empty."""
    return simhash.near_dedup(docs).select(*docs.columns)


def private_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and mailboxes become pseudonyms; n_chars, if there, follows the text. Null texts
    stay null; an empty table stays empty."""
    out = pseudonyms.pseudonymise(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is packed into sequences; a null or empty text is its end token; an empty table has no rows."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("pseudonyms", private_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the classifier, the fingerprints or the tokenizer; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
