"""Plots as style tables and DOT text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import DiGraph, find_backdoor_paths


@dataclass(frozen=True)
class Plot:
    """``nodes(node, label, color)`` and ``edges(src, dst, color, width)``."""

    nodes: DataFrame
    edges: DataFrame

    def dot(self) -> str:
        lines = ["digraph {"]
        for r in self.nodes.orderBy("node").collect():
            label = r["label"].replace("\\", "\\\\").replace('"', '\\"')
            lines.append(f'  {r["node"]} [label="{label}" style=filled fillcolor={r["color"]}];')
        for r in self.edges.orderBy("src", "dst").collect():
            lines.append(f'  {r["src"]} -> {r["dst"]} [color={r["color"]} penwidth={r["width"]}];')
        return "\n".join([*lines, "}"])


def plot_causal_graph(g: DiGraph, node_labels: Mapping[int, str] | None = None, highlight_nodes: Iterable[int] = (), highlight_edges: Iterable[tuple[int, int]] = ()) -> Plot:
    """Highlighted nodes are red, others light blue; highlighted edges, in either
    direction, red and wide."""
    spark = g.spark
    labels = spark.createDataFrame([(int(k), str(v)) for k, v in (node_labels or {}).items()], "node long, label string")
    marked = spark.createDataFrame([(int(v), "red") for v in set(highlight_nodes)], "node long, mark string")
    nodes = g.nodes.select("node").join(labels, "node", "left").join(marked, "node", "left")
    nodes = nodes.select("node", F.coalesce("label", F.col("node").cast("string")).alias("label"), F.coalesce("mark", F.lit("lightblue")).alias("color"))
    both = {p for a, b in highlight_edges for p in ((int(a), int(b)), (int(b), int(a)))}
    wide = spark.createDataFrame([(a, b, True) for a, b in both], "src long, dst long, wide boolean")
    edges = g.edges.select("src", "dst").join(wide, ["src", "dst"], "left")
    edges = edges.select("src", "dst", F.when(F.col("wide"), "red").otherwise("black").alias("color"), F.when(F.col("wide"), 3.0).otherwise(1.0).alias("width"))
    return Plot(nodes, edges)


def plot_with_adjustment_set(g: DiGraph, x: int, y: int, z: Iterable[int], node_labels: Mapping[int, str] | None = None) -> Plot:
    z = set(z)
    return plot_causal_graph(g, node_labels, {x, y} | z, [(a, b) for a in z for b in (x, y)])


def plot_backdoor_paths(g: DiGraph, x: int, y: int, node_labels: Mapping[int, str] | None = None, semantics: str = "reference") -> Plot:
    found = find_backdoor_paths(g, x, y, semantics)
    return plot_causal_graph(g, node_labels, {v for p in found for v in p}, {e for p in found for e in zip(p, p[1:])})
