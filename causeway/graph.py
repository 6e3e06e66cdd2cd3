"""Graphs as values: a plain directed graph and a property graph.

Both hold DataFrames and never change: what would alter a graph returns a new
one.  Single questions are batches of one row, answered by the operators.
"""

from __future__ import annotations

import copy
import json
import warnings
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import closure, dsep, identify, paths, validate
from .sources import edge_pairs, edge_table

_NO_PROPS = "cast(map() as map<string,string>)"


def _listed(nodes) -> list[int]:
    return [int(nodes)] if isinstance(nodes, int) else [int(x) for x in nodes]


class DiGraph:
    """Nodes 1..n (or any ids) and edges without repeats, as DataFrames."""

    def __init__(self, spark: SparkSession, n: int = 0, edges=()) -> None:
        if n < 0:
            raise ValueError("number of nodes must not be negative")
        pairs = [(a, b) for a, b in edge_pairs(edges) if 1 <= a <= n and 1 <= b <= n]
        self.spark, self.edges = spark, edge_table(spark, pairs)
        self.nodes = spark.createDataFrame([(i,) for i in range(1, n + 1)], "node long")

    @classmethod
    def of(cls, edges: DataFrame, nodes: DataFrame) -> DiGraph:
        """From tables ``src, dst`` and ``node``."""
        g = cls.__new__(cls)
        g.spark, g.edges, g.nodes = edges.sparkSession, edges.select("src", "dst").distinct(), nodes.select("node").distinct()
        g._fresh()
        return g

    def _fresh(self) -> None:
        pass

    def _with(self, **changes) -> DiGraph:
        g = copy.copy(self)
        g.__dict__.update(changes)
        return g

    # Tables for the operators
    def e(self) -> DataFrame:
        return self.edges.select(F.lit("g").alias("graph_id"), "src", "dst")

    def v(self) -> DataFrame:
        return self.nodes.select(F.lit("g").alias("graph_id"), "node")

    def ask(self, schema: str, *values) -> DataFrame:
        return self.spark.createDataFrame([(1, "g", *values)], f"qid long, graph_id string, {schema}")

    def seeds(self, nodes) -> DataFrame:
        return self.spark.createDataFrame([(1, "g", x) for x in _listed(nodes)], "qid long, graph_id string, node long")

    # What a graph library offers
    def nv(self) -> int:
        return self.nodes.count()

    def ne(self) -> int:
        return self.edges.count()

    def __len__(self) -> int:
        return self.nv()

    def vertices(self) -> list[int]:
        return sorted(r["node"] for r in self.nodes.collect())

    def __iter__(self):
        return iter(self.vertices())

    def edge_list(self) -> list[tuple[int, int]]:
        return sorted((r["src"], r["dst"]) for r in self.edges.collect())

    def has_vertex(self, v: int) -> bool:
        return not self.nodes.filter(F.col("node") == v).isEmpty()

    def has_edge(self, src: int, dst: int) -> bool:
        return not self.edges.filter((F.col("src") == src) & (F.col("dst") == dst)).isEmpty()

    def is_directed(self) -> bool:
        return True

    def inneighbors(self, v: int) -> list[int]:
        return sorted(r["src"] for r in self.edges.filter(F.col("dst") == v).collect())

    def outneighbors(self, v: int) -> list[int]:
        return sorted(r["dst"] for r in self.edges.filter(F.col("src") == v).collect())

    def all_neighbors(self, v: int) -> list[int]:
        return sorted({*self.inneighbors(v), *self.outneighbors(v)})

    def zero(self) -> DiGraph:
        return type(self)(self.spark, 0)

    def one(self) -> DiGraph:
        """The graph of a single node."""
        return type(self)(self.spark, 1)

    @property
    def eltype(self) -> type:
        """Type of the nodes."""
        return int

    @staticmethod
    def src(edge: tuple[int, int]) -> int:
        return edge[0]

    @staticmethod
    def dst(edge: tuple[int, int]) -> int:
        return edge[1]

    def add_vertex(self) -> DiGraph:
        top = self.nodes.agg(F.coalesce(F.max("node"), F.lit(0)).alias("m")).first()["m"]
        return self._with(nodes=self.nodes.unionByName(self._node_rows([top + 1])))

    def add_vertices(self, n: int) -> DiGraph:
        g = self
        for _ in range(n):
            g = g.add_vertex()
        return g

    def _node_rows(self, ids: list[int]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "node long")

    def _edge_rows(self, pairs) -> DataFrame:
        return self.spark.createDataFrame(pairs, "src long, dst long")

    def add_edge(self, src: int, dst: int) -> DiGraph:
        """With the edge; unchanged if it is there or an end is missing."""
        if self.has_edge(src, dst) or not (self.has_vertex(src) and self.has_vertex(dst)):
            return self
        return self._with(edges=self.edges.unionByName(self._edge_rows([(src, dst)])))

    def rem_edge(self, src: int, dst: int) -> DiGraph:
        return self._with(edges=self.edges.filter((F.col("src") != src) | (F.col("dst") != dst)))

    def rem_vertex(self, v: int) -> DiGraph:
        """Without the node and its edges; other nodes keep their ids."""
        return self._with(nodes=self.nodes.filter(F.col("node") != v), edges=self.edges.filter((F.col("src") != v) & (F.col("dst") != v)))

    def check(self, *indices: int) -> None:
        """Indices must be nodes; those of a graph that lost nodes need not be 1..n."""
        whole = [i for i in indices if isinstance(i, int) and not isinstance(i, bool)]
        found = {r["node"] for r in self.nodes.filter(F.col("node").isin(whole)).collect()}
        if len(whole) != len(indices) or not found.issuperset(whole):
            validate.require_nodes(self.nv(), *indices)
            raise ValueError(f"Node indices must be nodes of the graph, got {sorted(set(whole) - found)}")


SimpleDiGraph = DiGraph


class CausalGraph(DiGraph):
    """A directed graph with properties of nodes, edges and the graph, and data."""

    def __init__(self, spark: SparkSession, edges=0, node_names: Mapping[int, str] | None = None, data=None, **props) -> None:
        """``edges``: a number of nodes, pairs, an adjacency mapping or a DiGraph."""
        if isinstance(edges, int) and not isinstance(edges, bool):
            super().__init__(spark, edges)
        elif isinstance(edges, DiGraph):
            self.spark, self.edges, self.nodes = spark, edges.edges.select("src", "dst"), edges.nodes.select("node")
        else:
            g = create_causal_graph(spark, edges)
            self.spark, self.edges, self.nodes = spark, g.edges, g.nodes
        self._fresh()
        self.graph_props.update(props)
        if data is not None:
            self.graph_props["data"] = data
        if node_names:
            rows = [(int(k), {"name": json.dumps(str(v))}) for k, v in node_names.items()]
            names = spark.createDataFrame(rows, "node long, named map<string,string>")
            self.nodes = self.nodes.join(names, "node", "left").select("node", F.coalesce("named", "props").alias("props"))

    def _fresh(self) -> None:
        self.edges = self.edges.select("src", "dst", F.expr(_NO_PROPS).alias("props"))
        self.nodes = self.nodes.select("node", F.expr(_NO_PROPS).alias("props"))
        self.graph_props: dict[str, Any] = {}

    def _node_rows(self, ids):
        return super()._node_rows(ids).withColumn("props", F.expr(_NO_PROPS))

    def _edge_rows(self, pairs):
        return super()._edge_rows(pairs).withColumn("props", F.expr(_NO_PROPS))

    def digraph(self) -> DiGraph:
        return DiGraph.of(self.edges, self.nodes)

    # Properties of the graph
    def set_prop(self, key: str, value) -> CausalGraph:
        return self._with(graph_props={**self.graph_props, key: value})

    def get_prop(self, key: str, default=None):
        return self.graph_props.get(key, default)

    def has_prop(self, key: str) -> bool:
        return key in self.graph_props

    def delete_prop(self, key: str) -> CausalGraph:
        return self._with(graph_props={k: v for k, v in self.graph_props.items() if k != key})

    # Properties of nodes and edges: values as JSON text in a map column
    @staticmethod
    def _put(table: DataFrame, where, key: str, value) -> DataFrame:
        rest = F.map_filter("props", lambda k, _: k != key)
        return table.withColumn("props", F.when(where, F.map_concat(rest, F.create_map(F.lit(key), F.lit(json.dumps(value))))).otherwise(F.col("props")))

    @staticmethod
    def _drop(table: DataFrame, where, key: str) -> DataFrame:
        return table.withColumn("props", F.when(where, F.map_filter("props", lambda k, _: k != key)).otherwise(F.col("props")))

    @staticmethod
    def _get(table: DataFrame, where, key: str) -> str | None:
        row = table.filter(where).select(F.try_element_at("props", F.lit(key)).alias("v")).first()
        return row["v"] if row else None

    def set_node_prop(self, node: int, key: str, value) -> CausalGraph:
        self.check(node)
        return self._with(nodes=self._put(self.nodes, F.col("node") == node, key, value))

    def get_node_prop(self, node: int, key: str, default=None):
        found = self._get(self.nodes, F.col("node") == node, key)
        return default if found is None else json.loads(found)

    def has_node_prop(self, node: int, key: str) -> bool:
        return self._get(self.nodes, F.col("node") == node, key) is not None

    def delete_node_prop(self, node: int, key: str) -> CausalGraph:
        return self._with(nodes=self._drop(self.nodes, F.col("node") == node, key))

    @staticmethod
    def _edge(src: int, dst: int):
        return (F.col("src") == src) & (F.col("dst") == dst)

    def set_edge_prop(self, src: int, dst: int, key: str, value) -> CausalGraph:
        if not self.has_edge(src, dst):
            raise ValueError(f"edge ({src}, {dst}) does not exist")
        return self._with(edges=self._put(self.edges, self._edge(src, dst), key, value))

    def get_edge_prop(self, src: int, dst: int, key: str, default=None):
        found = self._get(self.edges, self._edge(src, dst), key)
        return default if found is None else json.loads(found)

    def has_edge_prop(self, src: int, dst: int, key: str) -> bool:
        return self._get(self.edges, self._edge(src, dst), key) is not None

    def delete_edge_prop(self, src: int, dst: int, key: str) -> CausalGraph:
        return self._with(edges=self._drop(self.edges, self._edge(src, dst), key))

    def get_node_names(self) -> dict[int, str]:
        """Names that are strings."""
        rows = self.nodes.select("node", F.try_element_at("props", F.lit("name")).alias("v")).filter("v is not null").collect()
        return {r["node"]: json.loads(r["v"]) for r in rows if isinstance(json.loads(r["v"]), str)}

    def get_node_name(self, node: int, default=None):
        return self.get_node_prop(node, "name", default)

    # Data
    def attach_data(self, data, node_names: Mapping[int, str] | None = None, check_columns: bool = True) -> CausalGraph:
        names = dict(node_names or self.get_node_names())
        columns = list(data.columns) if hasattr(data, "columns") else list(data)
        if check_columns:
            missing = sorted(set(names.values()) - set(columns))
            if missing:
                warnings.warn(f"data has no columns for nodes {missing}", stacklevel=2)
        g = self.set_prop("data", data)
        return g.set_prop("node_names", names) if names else g

    def get_data(self):
        return self.graph_props.get("data")

    def has_data(self) -> bool:
        return "data" in self.graph_props


def create_causal_graph(spark: SparkSession, edges) -> DiGraph:
    """A checked acyclic graph with as many nodes as the greatest index."""
    pairs = edge_pairs(edges)
    g = DiGraph(spark, max((max(p) for p in pairs), default=0), pairs)
    validate_causal_graph(g)
    return g


def is_dag(g: DiGraph) -> bool:
    graphs = g.spark.createDataFrame([("g",)], "graph_id string")
    return validate.is_dag(g.e(), graphs).first()["is_dag"]


def validate_causal_graph(g: DiGraph) -> bool:
    if not is_dag(g):
        raise ValueError(validate.NOT_A_DAG)
    return True


def _set(df: DataFrame) -> set[int]:
    return {r["node"] for r in df.select("node").collect()}


def get_ancestors(g: DiGraph, nodes: int | Iterable[int]) -> set[int]:
    return _set(closure.ancestors(g.e(), g.seeds(nodes)))


def get_descendants(g: DiGraph, nodes: int | Iterable[int]) -> set[int]:
    return _set(closure.descendants(g.e(), g.seeds(nodes)))


def get_parents(g: DiGraph, nodes: int | Iterable[int]) -> set[int]:
    return _set(closure.parents(g.e(), g.seeds(nodes)))


def get_children(g: DiGraph, nodes: int | Iterable[int]) -> set[int]:
    return _set(closure.children(g.e(), g.seeds(nodes)))


def markov_boundary(g: DiGraph, y: int) -> set[int]:
    g.check(y)
    return _set(closure.markov_boundary(g.e(), g.seeds(y)))


def d_separated(g: DiGraph, x, y, z=()) -> bool:
    q = g.ask("x array<long>, y array<long>, z array<long>", _listed(x), _listed(y), _listed(z))
    return dsep.d_separated(g.e(), q).first()["separated"]


def find_directed_paths(g: DiGraph, x: int, y: int, semantics: str = "reference") -> list[list[int]]:
    g.check(x, y)
    return sorted(r["path"] for r in paths.directed_paths(g.e(), g.ask("x long, y long", x, y), semantics).collect())


def find_backdoor_paths(g: DiGraph, x: int, y: int, semantics: str = "reference") -> list[list[int]]:
    g.check(x, y)
    return sorted(r["path"] for r in paths.backdoor_paths(g.e(), g.ask("x long, y long", x, y), semantics).collect())


def has_path(g: DiGraph, s: int, t: int, semantics: str = "reference") -> bool:
    """Weakly connected in mode ``reference``; t below s in mode ``pearl``."""
    g.check(s, t)
    paths.check_mode(semantics)
    if semantics == "pearl":
        return t in get_descendants(g, s)
    labels = identify.weak_labels(g.e(), g.v()).filter(F.col("node").isin(s, t))
    return labels.select("label").distinct().count() == 1


def backdoor_adjustment_set(g: DiGraph, x: int, y: int, semantics: str = "reference") -> set[int] | None:
    validate_causal_graph(g)
    g.check(x, y)
    found = identify.backdoor_sets(g.e(), g.v(), g.ask("x long, y long", x, y), semantics).first()["members"]
    return None if found is None else set(found)


def is_backdoor_adjustable(g: DiGraph, x: int, y: int, semantics: str = "reference") -> bool:
    validate_causal_graph(g)
    g.check(x, y)
    return identify.backdoor_adjustable(g.e(), g.v(), g.ask("x long, y long", x, y), semantics).first()["adjustable"]


def frontdoor_adjustment_set(g: DiGraph, x: int, y: int, m, semantics: str = "reference") -> bool:
    validate_causal_graph(g)
    g.check(x, y, *_listed(m))
    return identify.frontdoor(g.e(), g.v(), g.ask("x long, y long, m array<long>", x, y, _listed(m)), semantics).first()["frontdoor"]


def find_frontdoor_mediators(g: DiGraph, x: int, y: int, semantics: str = "reference") -> list[set[int]]:
    validate_causal_graph(g)
    g.check(x, y)
    return [{v} for v in sorted(_set(identify.frontdoor_mediators(g.e(), g.v(), g.ask("x long, y long", x, y), semantics)))]


def is_valid_instrument(g: DiGraph, z: int, x: int, y: int, semantics: str = "reference") -> bool:
    g.check(z, x, y)
    return identify.valid_instrument(g.e(), g.v(), g.ask("z long, x long, y long", z, x, y), semantics).first()["valid"]


def find_instruments(g: DiGraph, x: int, y: int, semantics: str = "reference") -> list[int]:
    validate_causal_graph(g)
    g.check(x, y)
    return sorted(_set(identify.instruments(g.e(), g.v(), g.ask("x long, y long", x, y), semantics)))


def is_valid_adjustment_set(g: DiGraph, x: int, y: int, z, semantics: str = "reference") -> bool:
    g.check(x, y)
    return identify.valid_adjustment(g.e(), g.v(), g.ask("x long, y long, z array<long>", x, y, _listed(z)), semantics).first()["valid"]


def find_all_adjustment_sets(g: DiGraph, x: int, y: int, semantics: str = "reference") -> list[set[int]]:
    validate_causal_graph(g)
    g.check(x, y)
    rows = identify.adjustment_sets(g.e(), g.v(), g.ask("x long, y long", x, y), semantics).collect()
    return [set(m) for m in sorted((r["members"] for r in rows), key=lambda m: (len(m), m))]


def minimal_adjustment_set(g: DiGraph, x: int, y: int, semantics: str = "reference") -> set[int] | None:
    validate_causal_graph(g)
    g.check(x, y)
    found = identify.minimal_adjustment_set(g.e(), g.v(), g.ask("x long, y long", x, y), semantics).first()["members"]
    return None if found is None else set(found)


is_identifiable, identify_formula = identify.is_identifiable, identify.identify_formula
