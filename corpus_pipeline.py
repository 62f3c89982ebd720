"""A corpus pipeline of five of the training-data operators.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the stage before
kept, and returns the columns of ``documents``; the last returns token ids. A
stage's result is written as Parquet to the shared folder and read again.

Defined results
    null, empty or wordless texts are not toxic, in no group of near copies, hold
    no benchmark window and no secret; they pass all filters and have no tokens.
    A null text stays null up to the last stage.
    rows that agree in id and text: one stays (near-dedup). A null ``doc_id`` comes
    last where a group's smallest id stays.
    texts of any length are worked on whole. Extra columns, of any names, stay with
    their rows up to the last stage. Empty documents: no rows, the same columns.
    Without labels the toxicity grammar's fixed lexicon is used; without benchmark
    items nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwood.llm import bpe, decontaminate, minhash, secrets, toxicity
from boxwood.llm.common import stash, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the toxicity grammar, learned from ``labels``, rejects go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (5 words, 0.8)."""
    return minhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold a window of any benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found becomes a mark; ``n_chars`` follows the text."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether decoding them gives the text back."""
    return bpe.round_trip(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontaminate", drop_benchmark), ("secrets", redact_secrets), ("bpe", encode)]

#: Learned scores and MinHash groups are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
