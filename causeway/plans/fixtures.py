"""Small acyclic graphs with known answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Number of nodes and edges of each test graph.
GRAPHS: dict[str, tuple[int, list[tuple[int, int]]]] = {
    "triangle": (3, [(1, 2), (1, 3), (2, 3)]),
    "fork_z": (3, [(1, 2), (1, 3)]),
    "chain3": (3, [(1, 2), (2, 3)]),
    "fork_b": (3, [(2, 1), (2, 3)]),
    "collider": (3, [(1, 2), (3, 2)]),
    "sprinkler": (4, [(1, 2), (1, 3), (2, 4), (3, 4)]),
    "two_conf": (4, [(1, 2), (3, 2), (1, 4), (3, 4), (2, 4)]),
    "isolated": (3, [(1, 2)]),
    "spouses": (5, [(1, 3), (2, 3), (3, 4), (3, 5), (1, 4), (2, 5)]),
    "single": (1, []),
    "disconnected": (4, [(1, 2), (3, 4)]),
    "direct": (2, [(1, 2)]),
    "frontdoor": (4, [(1, 2), (1, 4), (2, 3), (3, 4)]),
    "bad_frontdoor": (5, [(1, 2), (1, 4), (2, 3), (3, 4), (1, 3)]),
    "iv": (4, [(1, 2), (2, 3), (4, 2), (4, 3)]),
    "bad_iv": (4, [(1, 2), (2, 3), (4, 2), (4, 3), (1, 3)]),
    "no_effect": (3, [(2, 3)]),
    "mb6": (6, [(1, 2), (1, 3), (2, 4), (2, 3), (4, 3), (5, 6)]),
    "chain4": (4, [(1, 2), (2, 3), (3, 4)]),
    "iv_collider": (4, [(1, 2), (2, 3), (1, 4), (3, 4)]),
    "reversed": (2, [(2, 1)]),
    "mbias": (5, [(1, 2), (1, 4), (3, 4), (3, 5), (2, 5)]),
}
CYCLE = (3, [(1, 2), (2, 3), (3, 1)])


def edges(spark: SparkSession, extra: dict | None = None) -> DataFrame:
    rows = [(g, a, b) for g, (_, e) in {**GRAPHS, **(extra or {})}.items() for a, b in e]
    return spark.createDataFrame(rows, "graph_id string, src long, dst long")


def nodes(spark: SparkSession, extra: dict | None = None) -> DataFrame:
    rows = [(g, i) for g, (n, _) in {**GRAPHS, **(extra or {})}.items() for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "graph_id string, node long")


def all_pairs(spark: SparkSession, names: list[str] | None = None, diagonal: bool = False) -> DataFrame:
    """A question ``(qid, graph_id, x, y)`` for every two nodes of each graph."""
    rows = []
    for g, (n, _) in GRAPHS.items():
        if names is None or g in names:
            rows += [(f"{g}:{x}:{y}", g, x, y) for x in range(1, n + 1) for y in range(1, n + 1) if diagonal or x != y]
    return spark.createDataFrame(rows, "qid string, graph_id string, x long, y long")
