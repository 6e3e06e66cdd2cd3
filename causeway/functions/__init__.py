"""Set functions on arrays and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def members(column: str) -> Column:
    """Aggregate: the distinct values in ascending order."""
    return F.array_sort(F.collect_set(column))


def powerset(column: Column | str) -> Column:
    """All subsets of an array of up to 20 elements, as an array of arrays: the k-th
    holds the elements at the set bits of k."""
    column = F.col(column) if isinstance(column, str) else column
    pick = lambda k: F.filter(column, lambda _, i: F.call_function("getbit", k, i) == 1)
    subsets = F.transform(F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), F.size(column)) - 1), pick)
    return F.when(F.size(column) <= 20, subsets).otherwise(F.raise_error(F.lit("powerset of more than 20 elements")))


def subsets_upto(candidates: DataFrame, questions: DataFrame, most: int) -> DataFrame:
    """``qid, members`` for every subset of up to ``most`` of ``candidates(qid, node)``,
    each generated once in ascending order: no set beyond the limit is formed."""
    level = questions.select("qid").distinct().withColumn("members", F.array().cast("array<long>"))
    out = level
    for _ in range(most):
        level = level.join(candidates, "qid").filter(F.coalesce(F.col("node") > F.try_element_at("members", F.lit(-1)), F.lit(True)))
        level = level.select("qid", F.concat("members", F.array("node")).alias("members"))
        out = out.unionByName(level)
    return out
