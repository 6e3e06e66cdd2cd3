"""Checks of graphs and of node indices."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .closure import closure

NOT_A_DAG = "Graph must be a directed acyclic graph (DAG)"


#: A graph of at most so many edges is peeled in one task.
PEELED_EDGES = 200_000


def _peel(key: tuple, edges: pa.Table) -> pa.Table:
    """The graph's id if it has a cycle: nodes without incoming edges go, one by one,
    until none is left to go."""
    ahead: dict = {}
    incoming: Counter = Counter()
    for src, dst in zip(edges.column("src").to_pylist(), edges.column("dst").to_pylist()):
        ahead.setdefault(src, []).append(dst)
        incoming[dst] += 1
    free = [node for node in ahead if node not in incoming]
    left = edges.num_rows
    while free:
        for dst in ahead.get(free.pop(), ()):
            left -= 1
            incoming[dst] -= 1
            if not incoming[dst]:
                free.append(dst)
    return edges.select(["graph_id"]).slice(0, 1 if left else 0)


def is_dag(edges: DataFrame, graphs: DataFrame) -> DataFrame:
    """``graph_id, is_dag`` for every row of ``graphs(graph_id)``; a graph without
    edges is one.  Graphs of up to ``PEELED_EDGES`` edges are peeled, each in one
    task; in larger ones, a node that reaches itself speaks against it."""
    edges = edges.select("graph_id", "src", "dst").filter("src is not null and dst is not null")
    large = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PEELED_EDGES).select("graph_id")
    small, loops = edges, None
    if not large.isEmpty():
        small = edges.join(large, "graph_id", "left_anti")
        loops = closure(edges.join(large, "graph_id", "left_semi"), ["graph_id"]).filter("src = dst").select("graph_id").distinct()
    kind = edges.select("graph_id").schema
    cyclic = small.groupBy("graph_id").applyInArrow(_peel, kind)
    cyclic = cyclic if loops is None else cyclic.unionByName(loops)
    cyclic = cyclic.withColumn("loop", F.lit(True))
    return graphs.select("graph_id").distinct().join(cyclic, "graph_id", "left").select("graph_id", F.col("loop").isNull().alias("is_dag"))


def require_dag(edges: DataFrame, graphs: DataFrame) -> None:
    if not is_dag(edges, graphs).filter("not is_dag").isEmpty():
        raise ValueError(NOT_A_DAG)


def require_nodes(n: int, *indices: int) -> None:
    for i in indices:
        if isinstance(i, bool) or not isinstance(i, int) or not 1 <= i <= n:
            raise ValueError(f"Node indices must be in range [1, {n}], got {i!r}")
