"""Training-corpus pipeline: quality, near duplicates, secrets, mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.llm import mixing, ngram_join, packing, quality, secrets


def quality_stage(spark, docs, sf_dir) -> DataFrame:
    """Documents that the classifier does not reject: the top grade is at least as likely as not."""
    model = quality.fit(docs, quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.kept(docs, model)


def near_duplicate_stage(spark, docs, sf_dir) -> DataFrame:
    """One document of each group linked by five-word shingles with a Jaccard similarity of 0.8 or more."""
    return ngram_join.drop_near_duplicates(docs, words=5, num=8, den=10)


def secret_stage(spark, docs, sf_dir) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redact(docs)


def mixing_stage(spark, docs, sf_dir) -> DataFrame:
    """Each document as often as the mix takes any of its words, never, once or twice (a second pass), in the order of the schedule."""
    return mixing.mixed_documents(docs)


def packing_stage(spark, docs, sf_dir) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: A fitted classifier and a packing have no SQL; tests/llm/test_pipeline.py compares each stage and the run with plain Python.
ORACLE_SQL = None


def run(spark, sf_dir) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    from subtide.llm.common import shared_folder

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
