"""The scalar interface, property graphs, hypergraphs, models and plots."""

import warnings

import pytest

import causeway as C
from causeway.plans.fixtures import CYCLE, GRAPHS


def graph(spark, name):
    n, edges = GRAPHS[name]
    return C.DiGraph(spark, n, edges)


def test_edge_lists(spark):
    make = lambda e: C.create_causal_graph(spark, e)
    assert make([(1, 2), (2, 3), (1, 3)]).nv() == 3 and make([]).nv() == 0 and make([(1, 2)]).nv() == 2
    assert make({1: [2, 3], 2: [3]}).edge_list() == [(1, 2), (1, 3), (2, 3)]
    assert make([(1, 2), (1, 2)]).ne() == 1 and make([(1, 0)]).ne() == 0
    with pytest.raises(ValueError, match="acyclic"):
        make(CYCLE[1])
    with pytest.raises(ValueError):
        C.DiGraph(spark, -1)


def test_sets_and_paths(spark):
    t, s = graph(spark, "triangle"), graph(spark, "spouses")
    assert C.get_ancestors(t, [2, 3]) == {1, 2} and C.get_ancestors(t, 3) == {1, 2}
    assert C.get_descendants(t, 1) == {2, 3} and C.get_parents(t, 3) == {1, 2} and C.get_children(t, {1}) == {2, 3}
    assert C.markov_boundary(s, 3) == {1, 2, 4, 5}
    assert C.find_directed_paths(t, 2, 3) == [[2, 1, 3], [2, 3]] and C.find_directed_paths(t, 2, 3, "pearl") == [[2, 3]]
    assert C.find_backdoor_paths(t, 2, 3) == [[2, 1, 2, 3], [2, 1, 3]]
    assert not C.d_separated(t, 2, 3, [1]) and C.d_separated(graph(spark, "fork_z"), [2], 3, 1)
    assert C.has_path(t, 3, 1) and not C.has_path(t, 3, 1, "pearl") and C.has_path(t, 2, 2)


def test_identification(spark):
    f, iv = graph(spark, "frontdoor"), graph(spark, "iv")
    assert C.backdoor_adjustment_set(f, 2, 4) == {1} and C.is_backdoor_adjustable(f, 2, 4)
    assert not C.frontdoor_adjustment_set(f, 2, 4, [3]) and C.frontdoor_adjustment_set(f, 2, 4, 3, "pearl")
    assert C.find_frontdoor_mediators(f, 2, 4) == [] and C.find_frontdoor_mediators(f, 2, 4, "pearl") == [{3}]
    assert C.find_instruments(iv, 2, 3) == [1] and C.is_valid_instrument(iv, 1, 2, 3)
    assert C.find_all_adjustment_sets(iv, 2, 3) == [{1, 4}] and C.minimal_adjustment_set(iv, 2, 3, "pearl") == {4}
    assert C.is_valid_adjustment_set(iv, 2, 3, {1, 4}) and C.minimal_adjustment_set(graph(spark, "reversed"), 1, 2) is None
    assert C.backdoor_adjustment_set(graph(spark, "reversed"), 1, 2, "pearl") is None


def test_long_chain(spark):
    g = C.create_causal_graph(spark, [(i, i + 1) for i in range(1, 100)])
    assert C.get_ancestors(g, 50) == set(range(1, 50))
    assert C.d_separated(g, 1, 100, [50]) and not C.d_separated(g, 1, 100)
    assert C.backdoor_adjustment_set(g, 50, 100) == {49}


def test_errors(spark):
    t = graph(spark, "triangle")
    for call in (C.backdoor_adjustment_set, C.find_backdoor_paths, C.find_instruments, C.find_all_adjustment_sets, C.prepare_for_tmle):
        with pytest.raises(ValueError, match="Node indices"):
            call(t, 0, 4)
    with pytest.raises(ValueError, match="Node indices"):
        C.frontdoor_adjustment_set(t, 1, 2, [9])
    with pytest.raises(ValueError, match="acyclic"):
        C.backdoor_adjustment_set(C.DiGraph(spark, *CYCLE), 1, 2)
    with pytest.raises(ValueError, match="semantics"):
        C.find_directed_paths(t, 1, 2, "other")
    for stub in (C.is_identifiable, C.identify_formula, C.apply_intervention, C.counterfactual_graph, C.create_symbolic_scm):
        with pytest.raises(NotImplementedError):
            stub(t, None)


def test_property_graph(spark):
    g = C.CausalGraph(spark, [(1, 2), (1, 3), (2, 3)], node_names={1: "Z", 2: "X"}, title="t")
    assert g.get_node_names() == {1: "Z", 2: "X"} and g.get_node_name(3, "?") == "?" and g.get_prop("title") == "t"
    h = g.set_node_prop(3, "name", "Y").set_node_prop(3, "level", [1, {"a": None}]).set_edge_prop(1, 2, "w", 0.5)
    assert h.get_node_prop(3, "level") == [1, {"a": None}] and h.has_node_prop(3, "name") and not g.has_node_prop(3, "name")
    assert h.get_edge_prop(1, 2, "w") == 0.5 and h.get_edge_prop(2, 3, "w", 7) == 7 and h.has_edge_prop(1, 2, "w")
    assert not h.delete_edge_prop(1, 2, "w").has_edge_prop(1, 2, "w") and not h.delete_node_prop(3, "name").has_node_prop(3, "name")
    assert h.set_prop("k", 1).has_prop("k") and not h.set_prop("k", 1).delete_prop("k").has_prop("k") and not h.delete_prop("none").has_prop("none")
    with pytest.raises(ValueError):
        g.set_node_prop(4, "a", 1)
    with pytest.raises(ValueError):
        g.set_edge_prop(3, 1, "a", 1)
    more = h.add_vertex().add_edge(3, 4)
    assert more.nv() == 4 and more.has_edge(3, 4) and more.get_node_name(3) == "Y" and more.add_edge(3, 9).ne() == 4
    less = h.rem_vertex(1)
    assert less.vertices() == [2, 3] and less.edge_list() == [(2, 3)] and h.rem_edge(1, 2).ne() == 2
    assert h.inneighbors(3) == [1, 2] and h.outneighbors(1) == [2, 3] and h.all_neighbors(2) == [1, 3]
    assert list(h) == [1, 2, 3] and len(h) == 3 and h.is_directed() and h.digraph().ne() == 3 and h.zero().nv() == 0
    assert C.CausalGraph(spark, 2).nv() == 2 and C.CausalGraph(spark, graph(spark, "triangle")).ne() == 3


def test_data_and_estimates(spark):
    rows = [(z, x, float(2 * x + 3 * z + (i % 3))) for z in (0, 1) for x in (0, 1) for i in range(6 + 6 * (x == z))]
    data = spark.createDataFrame(rows, "Z int, X int, Y double")
    g = C.CausalGraph(spark, [(1, 2), (1, 3), (2, 3)], node_names={1: "Z", 2: "X", 3: "Y"})
    with pytest.raises(RuntimeError, match="no data"):
        C.estimate_effect(g, 2, 3)
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        g.attach_data(data.drop("Z"))
    assert any("columns" in str(w.message) for w in seen)
    g = g.attach_data(data)
    assert g.has_data() and abs(C.estimate_effect(g, 2, 3).estimate - 2) < 1e-9
    assert abs(C.estimate_effect(g, 2, 3, discrete=False).estimate - 2) < 1e-6
    with pytest.raises(RuntimeError, match="method"):
        C.estimate_effect(g, data, 2, 3, method="other")
    with pytest.warns(UserWarning, match="no confounders"):
        C.estimate_effect(graph(spark, "direct"), data, 1, 2, node_names={1: "X", 2: "Y"})
    assert C.prepare_for_tmle(g, 2, 3) == (["Z"], True) and C.get_tmle_confounders(g.digraph(), 2, 3) == [1]
    with pytest.raises(KeyError):
        C.prepare_for_tmle(g.digraph(), 2, 3, {2: "X"})
    spec = C.prepare_for_turing(g, 2, 3)
    assert (spec.treatment, spec.outcome, spec.confounders, spec.is_identifiable) == ("X", "Y", ["Z"], True) and spec.data is data
    assert C.get_data_for_ppl(g) is data and len(C.get_data_for_ppl(g, "dict")["X"]) == len(rows)
    assert C.get_data_for_ppl(g, "namedtuple").Y == C.get_data_for_ppl(g, "dict")["Y"]
    with pytest.raises(ValueError):
        C.get_data_for_ppl(g, "other")


def test_hypergraph(spark):
    h = C.Hypergraph(spark, C.DiGraph(spark, 5, [(1, 2), (2, 3)]))
    h, a = h.add_hyperedge([1, 2, 3])
    h, b = h.add_hyperedge({2, 4, 5})
    assert (a, b) == (1, 2) and h.incident_hyperedges(2) == {1, 2} and h.incident_hyperedges(1) == {1} and h.num_hyperedges() == 2
    assert h.hyperedge_vertices(2) == {2, 4, 5} and repr(h) == "Hypergraph(vertices=5, edges=2, hyperedges=2)" and "1: [1, 2, 3]" in h.describe()
    less = h.rem_hyperedge(1).rem_hyperedge(99)
    assert less.incident_hyperedges(2) == {2} and less.num_hyperedges() == 1 and less.add_hyperedge((1,))[1] == 3
    with pytest.raises(ValueError):
        h.add_hyperedge([1, 6])
    with pytest.raises(KeyError):
        h.hyperedge_vertices(99)
    assert h.to_simple_graph().ne() == 2 and h.add_vertices(2).num_vertices() == 7 and h.add_edge(3, 4).has_edge(3, 4)


def test_models_and_plots(spark):
    from pyspark.sql import functions as F

    from causeway.scm import intervened, simulate

    g = graph(spark, "chain3")
    scm = C.GraphSCM(g, {2: lambda a: a * 2, 3: lambda b: b + F.col("e")}, frozenset({1}))
    noise = spark.createDataFrame([(1.0, 0.5), (2.0, 0.25)], "a double, e double")
    names = {1: "a", 2: "b", 3: "c"}
    assert sorted(r["c"] for r in simulate(scm, noise, names).collect()) == [2.5, 4.25]
    done = intervened(scm, C.do_intervention(2, 10.0))
    assert done.graph.edge_list() == [(2, 3)] and sorted(r["c"] for r in simulate(done, noise, names).collect()) == [10.25, 10.5]
    plot = C.plot_backdoor_paths(graph(spark, "triangle"), 2, 3, {1: 'Z"'}, "pearl")
    assert {r["node"]: r["color"] for r in plot.nodes.collect()} == {1: "red", 2: "red", 3: "red"}
    assert {(r["src"], r["dst"]): r["width"] for r in plot.edges.collect()} == {(1, 2): 3.0, (1, 3): 3.0, (2, 3): 1.0}
    assert '1 [label="Z\\""' in plot.dot() and "2 -> 3 [color=black" in plot.dot()


def test_streaming_closure(spark, tmp_path):
    from causeway.sources import read_graph, write_graph
    from causeway.streaming import edge_log, maintain_closure

    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    batch = lambda rows: spark.createDataFrame(rows, "graph_id string, src long, dst long").selectExpr("*", "timestamp'2024-01-01' as at")
    for rows in ([("g", 1, 2)], [("g", 2, 3), ("g", 1, 2)]):
        batch(rows).write.mode("append").parquet(log)
        maintain_closure(edge_log(spark, log), out, str(tmp_path / "cp")).awaitTermination()
    assert {(r["src"], r["dst"]) for r in spark.read.parquet(f"{out}/closure").collect()} == {(1, 2), (2, 3), (1, 3)}
    g = graph(spark, "triangle")
    write_graph(g.e(), g.v(), str(tmp_path / "graph"))
    edges, nodes = read_graph(spark, str(tmp_path / "graph"))
    assert edges.count() == 3 and nodes.count() == 3


def test_nodes_after_a_removal(spark):
    g = C.CausalGraph(spark, [(1, 2), (2, 3)]).rem_vertex(1)
    assert g.vertices() == [2, 3] and C.markov_boundary(g, 3) == {2}
    with pytest.raises(ValueError):
        C.markov_boundary(g, 1)
    with pytest.raises(ValueError):
        C.markov_boundary(g, 4)
    assert (g.src((2, 3)), g.dst((2, 3)), g.eltype, g.one().vertices()) == (2, 3, int, [1])


def test_cluster_needs_a_shared_folder():
    """Only local mode makes a folder of its own."""
    from types import SimpleNamespace

    from causeway.runtime import shared_dir

    conf = SimpleNamespace(get=lambda key, default=None: default)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: conf, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=context))


def test_long_chains_are_checked(spark, monkeypatch):
    """A chain of 100,000 edges, with and without a way back; large graphs take the other way."""
    from pyspark.sql import functions as F

    from causeway.operators import validate

    chain = spark.range(100_000).select(F.lit("chain").alias("graph_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    back = chain.withColumn("graph_id", F.lit("ring")).union(spark.createDataFrame([("ring", 100_000, 0), ("self", 1, 1), ("twice", 1, 2), ("twice", 1, 2)], "graph_id string, src long, dst long"))
    graphs = spark.createDataFrame([(g,) for g in ("chain", "ring", "self", "twice", "none")], "graph_id string")
    found = {r["graph_id"]: r["is_dag"] for r in validate.is_dag(chain.union(back), graphs).collect()}
    assert found == {"chain": True, "ring": False, "self": False, "twice": True, "none": True}
    monkeypatch.setattr(validate, "PEELED_EDGES", 1)
    few = back.filter("graph_id in ('self', 'twice')")
    found = {r["graph_id"]: r["is_dag"] for r in validate.is_dag(few, graphs.filter("graph_id in ('self', 'twice')")).collect()}
    assert found == {"self": False, "twice": True}
