"""A training-corpus pipeline: quality, near-duplicates, benchmark passages, secrets, mixture.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return
the columns of documents; the last adds mix_size, mix_source_size, mix_target and mix_copies, how often the
mixture takes the document, and drops documents that it doesn't take.

Defined results of all stages: null texts are empty texts; null ids and sources are values of their own; very long
texts are handled whole; further columns of documents, whatever their names, pass every stage; an empty table stays
empty. Repeated rows and ties: the stages say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrigraph.llm import decontaminate, mixing, quality, secrets, simhash
from metrigraph.storage import fresh, keep


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.5; learnt from the documents' labels. Empty texts get the model's bias.

    Repeated rows get equal scores. Without labels of both classes nothing goes, but where all are 0.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = fresh(docs, "_score")
    return quality.score(docs, model, out_col=score).where(F.col(score) >= 0.5).drop(score)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): that of the smallest id.

    All texts without words are one group. Of repeated rows one stays, and of a tie that of the smaller text key.
    """
    return simhash.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Repeated rows stay or go together; null and empty items match nothing."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; n_chars follows where a text changed. Repeated rows change alike."""
    return secrets.redact(docs, chars_col="n_chars")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, with how often it takes them. Rows of equal id and text are taken alike."""
    return mixing.apply(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontaminate_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]

#: SQL can't express trained classifiers and similarity; tests/llm/test_pipeline.py runs each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs
