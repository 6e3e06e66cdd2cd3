"""Reading and writing graphs, and building them from edge lists and tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread

EDGES = "src long, dst long"


def edge_pairs(edges: Iterable[tuple[int, int]] | Mapping[int, Iterable[int]]) -> list[tuple[int, int]]:
    """Pairs from a list of pairs or an adjacency mapping."""
    if isinstance(edges, Mapping):
        return [(int(a), int(b)) for a, bs in edges.items() for b in bs]
    return [(int(a), int(b)) for a, b in edges]


def edge_table(spark: SparkSession, edges) -> DataFrame:
    """``src, dst`` without repeats; pairs with a node below 1 are dropped."""
    pairs = [(a, b) for a, b in edge_pairs(edges) if a >= 1 and b >= 1]
    return spark.createDataFrame(pairs, EDGES).distinct()


def edges_of_adjacency(adjacency: DataFrame) -> DataFrame:
    """``graph_id, src, dst`` from ``graph_id, adjacency map<long, array<long>>``."""
    pairs = adjacency.select("graph_id", F.explode("adjacency").alias("src", "dsts"))
    return pairs.select("graph_id", "src", F.explode("dsts").alias("dst")).filter("src >= 1 and dst >= 1").distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    """``graph_id, node``: 1 to the greatest node that an edge names."""
    most = edges.groupBy("graph_id").agg(F.max(F.greatest("src", "dst")).alias("n"))
    return most.select("graph_id", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("node"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes that :func:`write_graph` wrote."""
    return spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/nodes")


def write_graph(edges: DataFrame, nodes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    edges.write.mode(mode).parquet(f"{path}/edges")
    nodes.write.mode(mode).parquet(f"{path}/nodes")


#: Node ids of the graph over the business tables: kind * KIND + key.
KIND = 10**12


def entity_edges(spark: SparkSession, sf_dir: str, into: Iterable[int] = range(2, 7)) -> DataFrame:
    """``graph_id, src, dst`` of the acyclic graph region > nation > customer >
    order > part and nation > supplier > part, from foreign keys.

    ``into``: the kinds of nodes whose incoming edges are wanted, for questions that
    no other edge can answer."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    node = lambda kind, c: (F.lit(kind * KIND) + F.col(c).cast("long"))
    link = lambda t, a, x, b, y: read(t).select(node(a, x).alias("src"), node(b, y).alias("dst"))
    links = [
        (2, lambda: link("nation", 1, "n_regionkey", 2, "n_nationkey")),
        (3, lambda: link("customer", 2, "c_nationkey", 3, "c_custkey")),
        (4, lambda: link("orders", 3, "o_custkey", 4, "o_orderkey")),
        (5, lambda: link("supplier", 2, "s_nationkey", 5, "s_suppkey")),
        (6, lambda: spread(link("lineitem", 4, "l_orderkey", 6, "l_partkey"), "src", "dst").distinct()),
        (6, lambda: spread(link("lineitem", 5, "l_suppkey", 6, "l_partkey"), "src", "dst").distinct()),
    ]
    out = reduce(DataFrame.unionByName, [table() for kind, table in links if kind in into])
    return out.select(F.lit("fk").alias("graph_id"), "src", "dst")
