"""Hypergraphs: groups of vertices beside a pairwise graph."""

from __future__ import annotations

import copy
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import DiGraph
from .runtime import partitions

#: Slices of hyperedges in a partition of cooccurrence, so that partitions come out even.
SLICES = 16
SCHEMA = "he_id long, vertices array<long>"


@dataclass(frozen=True)
class HyperedgeData:
    id: int
    vertices: frozenset[int]


def incidence(hyperedges: DataFrame) -> DataFrame:
    """The inverted index ``he_id, vertex``."""
    return hyperedges.select("he_id", F.explode("vertices").alias("vertex"))


def cooccurrence(hyperedges: DataFrame) -> DataFrame:
    """``a, b, n``: in how many hyperedges two vertices a < b meet.

    Large inputs are counted by slices of hyperedges first, so that pairs which meet
    often are dealt out as few rows, and in partitions that grow in number only."""
    n = partitions(hyperedges)
    if n:
        hyperedges = hyperedges.withColumn("slice", F.pmod(F.xxhash64("he_id"), F.lit(SLICES * n))).repartition(n, "slice")
    kept = ["slice"] if n else []
    pairs = hyperedges.select(*kept, F.explode("vertices").alias("a"), "vertices").select(*kept, "a", F.explode(F.filter("vertices", lambda v: v > F.col("a"))).alias("b"))
    counts = pairs.groupBy(*kept, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return counts.repartition(n, "a", "b").groupBy("a", "b").agg(F.sum("n").alias("n")) if n else counts


class Hypergraph:
    """Never changes: what would alter it returns a new one.  Ids count from 1 and
    aren't used again."""

    def __init__(self, spark: SparkSession, n: int | DiGraph = 0) -> None:
        self.spark = spark
        self.graph = n if isinstance(n, DiGraph) else DiGraph(spark, n)
        self.hyperedges = spark.createDataFrame([], SCHEMA)
        self.next_id = 1

    def _with(self, **changes) -> Hypergraph:
        h = copy.copy(self)
        h.__dict__.update(changes)
        return h

    def add_hyperedge(self, vertices: Iterable[int]) -> tuple[Hypergraph, int]:
        members = sorted({int(v) for v in vertices})
        self.graph.check(*members)
        row = self.spark.createDataFrame([(self.next_id, members)], SCHEMA)
        return self._with(hyperedges=self.hyperedges.unionByName(row), next_id=self.next_id + 1), self.next_id

    def rem_hyperedge(self, he_id: int) -> Hypergraph:
        """Without it; a missing id changes nothing."""
        return self._with(hyperedges=self.hyperedges.filter(F.col("he_id") != he_id))

    def hyperedge_vertices(self, he_id: int) -> set[int]:
        row = self.hyperedges.filter(F.col("he_id") == he_id).first()
        if row is None:
            raise KeyError(he_id)
        return set(row["vertices"])

    def incident_hyperedges(self, v: int) -> set[int]:
        self.graph.check(v)
        return {r["he_id"] for r in self.hyperedges.filter(F.array_contains("vertices", v)).collect()}

    def num_vertices(self) -> int:
        return self.graph.nv()

    def num_hyperedges(self) -> int:
        return self.hyperedges.count()

    def hyperedge_list(self) -> list[HyperedgeData]:
        return [HyperedgeData(r["he_id"], frozenset(r["vertices"])) for r in self.hyperedges.orderBy("he_id").collect()]

    def to_simple_graph(self) -> DiGraph:
        """The pairwise graph; hyperedges aren't expanded."""
        return self.graph

    # The pairwise graph's own operations
    def nv(self) -> int:
        return self.graph.nv()

    def ne(self) -> int:
        return self.graph.ne()

    def vertices(self) -> list[int]:
        return self.graph.vertices()

    def edge_list(self) -> list[tuple[int, int]]:
        return self.graph.edge_list()

    def inneighbors(self, v: int) -> list[int]:
        return self.graph.inneighbors(v)

    def outneighbors(self, v: int) -> list[int]:
        return self.graph.outneighbors(v)

    def has_edge(self, src: int, dst: int) -> bool:
        return self.graph.has_edge(src, dst)

    def add_edge(self, src: int, dst: int) -> Hypergraph:
        return self._with(graph=self.graph.add_edge(src, dst))

    def add_vertex(self) -> Hypergraph:
        return self._with(graph=self.graph.add_vertex())

    def add_vertices(self, n: int) -> Hypergraph:
        return self._with(graph=self.graph.add_vertices(n))

    def __repr__(self) -> str:
        return f"Hypergraph(vertices={self.nv()}, edges={self.ne()}, hyperedges={self.num_hyperedges()})"

    def describe(self) -> str:
        """With the members of each hyperedge where there are one to ten."""
        listed = self.hyperedge_list()
        if not 1 <= len(listed) <= 10:
            return repr(self)
        return "\n".join([repr(self), *[f"  {h.id}: {sorted(h.vertices)}" for h in listed]])
