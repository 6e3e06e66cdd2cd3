"""Structural causal models and interventions."""

from __future__ import annotations

from abc import ABC
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import DiGraph


class AbstractSCM(ABC):
    """What all models are."""


@dataclass(frozen=True)
class GraphSCM(AbstractSCM):
    """A graph with an equation for nodes, each a builder of a Column."""

    graph: DiGraph
    equations: dict[int, Callable[..., Column]] = field(default_factory=dict)
    exogenous: frozenset[int] = frozenset()


@dataclass(frozen=True)
class SymbolicSCM(AbstractSCM):
    """A graph with a system of named SQL expressions."""

    graph: DiGraph
    system: Any = None
    exogenous: frozenset[str] = frozenset()


@dataclass(frozen=True)
class DoIntervention:
    variable: int | str
    value: Any


def do_intervention(variable: int | str, value: Any) -> DoIntervention:
    return DoIntervention(variable, value)


def apply_intervention(scm: AbstractSCM, intervention: DoIntervention):
    raise NotImplementedError("apply_intervention is not implemented; see intervened")


def counterfactual_graph(scm: AbstractSCM, intervention: DoIntervention):
    raise NotImplementedError("counterfactual_graph is not implemented")


def create_symbolic_scm(graph: DiGraph, equations):
    raise NotImplementedError("create_symbolic_scm is not implemented")


def intervened(scm: GraphSCM, intervention: DoIntervention) -> GraphSCM:
    """The model after do(variable = value): no edge leads into the variable, and
    its equation is the value."""
    v = int(intervention.variable)
    scm.graph.check(v)
    cut = DiGraph.of(scm.graph.edges.filter(F.col("dst") != v), scm.graph.nodes)
    return GraphSCM(cut, {**scm.equations, v: lambda *_: F.lit(intervention.value)}, scm.exogenous)


def simulate(scm: GraphSCM, noise: DataFrame, names: dict[int, str]) -> DataFrame:
    """``noise`` with a column for each node, in topological order.  An equation
    gets its parents' columns in order of their ids."""
    edges = scm.graph.edge_list()
    parents = {v: sorted(a for a, b in edges if b == v) for v in scm.graph.vertices()}
    out, done = noise, set()
    while len(done) < len(parents):
        ready = [v for v in parents if v not in done and done.issuperset(parents[v])]
        if not ready:
            raise ValueError("the graph has a cycle")
        for v in ready:
            if v in scm.equations:
                out = out.withColumn(names[v], scm.equations[v](*[F.col(names[p]) for p in parents[v]]))
            done.add(v)
    return out
