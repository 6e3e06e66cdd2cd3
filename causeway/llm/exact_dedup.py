"""Exact deduplication: group by a 128-bit content hash, keep the smallest
stable id, and compare bytes inside groups to exclude collisions.

Native: DataFrame functions only.  Texts are grouped by (hash, text), which
compares their bytes; Spark combines equal texts within a map task, so a text
that a third of all rows share reaches the shuffle once for each task.  Only
ids and hashes are then joined with the groups.  That join is an ordinary
equi-join of small rows, so adaptive execution splits a hot hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, materialise, normalised, text_of


def content_hash(text: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(text))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after :func:`normalised`.  A null text is
    empty, so nulls and empty texts form one group.  Rows that repeat an id
    with the same text are all reported and ``kept`` is true on each of them; a
    null id counts in ``group_size``, is kept only in a group without other
    ids, and ``keep_id`` is then null.  Other columns are ignored, whatever
    their names.  An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(text_of(text_col)).alias("norm"))
    texts = texts.select("doc_id", "norm", hash_of(F.col("norm")).alias("h"))
    by_text = texts.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # One row per hash; texts that share a hash are counted in n_texts.
    groups = materialise(
        by_text.groupBy("h").agg(
            F.count(F.lit(1)).alias("n_texts"), F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
        ),
        "exact-groups",
    )
    ids = texts.select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha"))
    sound = ids.join(groups.filter("n_texts = 1").select("h", "keep_id", "group_size"), "h")
    out = sound.select("doc_id", "keep_id", "group_size", "sha")
    if not groups.filter("n_texts > 1").isEmpty():
        # Collisions: within these hashes the texts themselves decide.
        hashes = groups.filter("n_texts > 1").select("h")
        clash = texts.join(hashes, "h", "left_semi").join(by_text.join(hashes, "h", "left_semi"), ["h", "norm"])
        out = out.unionByName(clash.select("doc_id", "keep_id", "group_size", F.unhex(F.sha2("norm", 256)).alias("sha")))
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", single: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts
    the row with the smallest id.  Rows that repeat an id are judged by their own
    texts.  Of rows that repeat both id and text all stay, or with ``single`` one."""
    kept = exact_groups(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("kept_id"), F.unhex("text_sha256").alias("mark"))
    return keep_rows(docs, F.col(id_col), F.unhex(F.sha2(normalised(text_of(text_col)), 256)), kept, single)


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
