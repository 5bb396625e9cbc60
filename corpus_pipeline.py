"""From raw documents to a training schedule: each stage works on what its predecessor kept.

Each function of STAGES takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of docs.

Defined cases: documents of null or empty text go in the first stage; a null doc_id is a document like others, of which near copies aren't sought and all
credentials are blotted out; repeated rows of one doc_id stay or go together; texts of any length are worked on whole; ties are settled as the
operators say; an empty table goes through all stages and gives an empty schedule; further columns, whatever their names, pass through all
stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from leafgrid.llm import common, decontaminate, jaccard, mixture, quality, secrets


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; p_good equal to the threshold stays."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the smallest doc_id; rows without words or doc_id are in no group and stay."""
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go; texts without words hold none."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are blotted out of the texts; all documents stay."""
    return secrets.redact(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The schedule: which piece of which document is in which slot; a null source is one of its own."""
    return mixture.schedule(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mixture_stage),
]

#: SQL cannot express the classifier and the tiling; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = common.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # the last stage's rows are read by the caller
            common.remove(spark, f"{folder}/{k - 1}")
    return docs
