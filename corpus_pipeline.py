"""A training corpus from raw documents: quality rules, near duplicates, secrets, mixing, packing.

Each stage works on all that its predecessor kept and is a function (spark, docs, sf_dir) -> DataFrame; all
but the last return the columns of documents. run() writes each stage's result to the shared folder and
reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, mixing, packing, quality_rules, secret_scans
from tessera.llm.common import read_documents, staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules and the base rules keep.

    Null and empty texts fail the base rule and go; repeated rows are each judged, and stay or go together; an empty
    table gives no rows; extra columns pass through, whatever their names.
    """
    rules = quality_rules.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.kept_documents(docs, rules)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five-word shingles, Jaccard 0.8) the document with the smallest id.

    Rows with a null id and texts without words stay; rows that share an id are one document and stay or go
    together; an empty table gives no rows; extra columns pass through, whatever their names.
    """
    return jaccard_join.distinct_documents(docs, length=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by [SECRET] and n_chars counted anew.

    Null and empty texts stay as they are (n_chars of a null text too); repeated rows and null ids are each cleaned;
    an empty table gives no rows; extra columns pass through, whatever their names.
    """
    cleaned = secret_scans.redacted_documents(docs)
    return cleaned.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned by their rates, so that domains' expected tokens match mixing.TARGETS.

    Null and empty texts have the prior's posteriors; rows that share id and text stay or go together; an empty table
    gives no rows; without usable labels all rows stay; extra columns pass through, whatever their names.
    """
    labels = mixing.domain_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mixed_documents(docs, labels, mixing.TARGETS, anchor="good")


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces in sequences of 2048 tokens.

    A null or empty text is its closing token alone; repeated rows and null ids stay rows of their own; an empty table
    gives no rows; extra columns are not read.
    """
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
    ("packing", packs),
]

#: SQL can express neither the learned rules nor the components, memberships and packs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of a data folder."""
    docs = read_documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs)
    return docs
