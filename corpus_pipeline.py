"""A corpus pipeline from the operators in ``causeway.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import exact_dedup, jaccard, packing, quality, substring_dedup
from causeway.llm.common import scratch, table
from causeway.runtime import READ, WRITE

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.  The classifier is fitted on
    labelled rows of this stage's own documents."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    good = quality.keep_good(docs, model)
    return good.select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, with the smallest id."""
    return exact_dedup.exact_dedup(docs, single=True).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents one row, with the smallest id."""
    return jaccard.near_dedup(docs, single=True).select(*COLUMNS)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that occur elsewhere too; documents of
    which nothing is left go."""
    return substring_dedup.without_repeats(docs).select(*COLUMNS)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place in the padded batches."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", drop_repeated_strings),
    ("packing", pack_batches),
]

#: The classifier and the packing's dynamic programme can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.options(**WRITE).parquet(path)
        docs = spark.read.options(**READ).parquet(path)
    return docs
