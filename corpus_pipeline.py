"""Training-data pipeline over ``documents``: each stage is written as Parquet and reread as the next one's input.

Stages take and, but for the last, return the columns of ``documents`` (doc_id, text, lang, source, n_chars),
which must be there and may be null; further columns are dropped.  A null text is an empty one to every
stage and stays null; a null source is a source of its own; repeated rows are rows of their own; an empty
table passes through as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import stage_folder

TOXIC = 0.7
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field scores as toxic go; it is trained on labelled documents among these.

    Null and empty texts have no toxic token and stay.  Without labels of both kinds every score is the share of toxic labels (0 without labels).
    """
    from tessera.llm.toxicity import tagged, train

    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.withColumn("_toxic", tagged(model, F.col("text"))["score"] >= TOXIC).where(~F.col("_toxic")).select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, that of the largest id; null ids rank below all others.

    Null and empty texts are one group; of rows that repeat id and text one stays.
    """
    from tessera.llm.exact_dedup import dedup

    return dedup(docs, carry=COLUMNS).where("kept").select("carried.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id; null ids rank above all others.

    Texts without words are in no group and stay.
    """
    from tessera.llm.near_dedup import near_groups

    return near_groups(docs, carry=COLUMNS).where("stays").select("carried.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to twice; one that is not drawn goes."""
    from tessera.llm.mixing import mix

    return mix(docs, carry=COLUMNS).where("copies > 0").select("carried.*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of ids and decoded bytes; a null or empty text has no ids."""
    import public_tokenizers

    from tessera.llm.bpe import encode

    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]

#: SQL cannot express the stages that are trained or hashed; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, stage tables in the session's shared folder, where they stay until its owner drops them."""
    folder = f"{stage_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
