"""The registered queries: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..estimate import effect_table
from ..functions import members, powerset
from ..hypergraph import cooccurrence, incidence
from ..operators import closure, dsep, identify, paths, validate
from ..runtime import spread
from ..sources import KIND, edges_of_adjacency, entity_edges, nodes_of
from . import fixtures
from .oracles import DSEP, FRONTDOORS, INSTRUMENTS, NAMES, VALID

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _seeds(spark: SparkSession) -> DataFrame:
    """A question for each node of each fixture graph."""
    nodes = fixtures.nodes(spark)
    return nodes.select(F.concat_ws(":", "graph_id", "node").alias("qid"), "graph_id", "node")


def _node_query(name: str, operator) -> None:
    QUERIES[name] = lambda spark, sf_dir: operator(fixtures.edges(spark), _seeds(spark)).select("qid", "node")


for _name, _operator in (
    ("fix_parents", closure.parents),
    ("fix_children", closure.children),
    ("fix_ancestors", closure.ancestors),
    ("fix_descendants", closure.descendants),
    ("fix_markov", closure.markov_boundary),
):
    _node_query(_name, _operator)


@_query
def fix_is_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = {"cycle": fixtures.CYCLE}
    return validate.is_dag(fixtures.edges(spark, extra), fixtures.nodes(spark, extra).select("graph_id"))


@_query
def fix_create_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from an adjacency mapping: repeats and nodes below 1 are dropped."""
    rows = [("g", {1: [2, 3, 3, 0], 2: [3]})]
    return edges_of_adjacency(spark.createDataFrame(rows, "graph_id string, adjacency map<long, array<long>>"))


@_query
def fix_weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify.weak_labels(fixtures.edges(spark), fixtures.nodes(spark)).select("graph_id", "node", "label")


@_query
def fix_dsep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(f"{g}:{x}:{y}:{z}", g, [x], [y], list(z)) for g, x, y, z in DSEP]
    questions = spark.createDataFrame(rows, "qid string, graph_id string, x array<long>, y array<long>, z array<long>")
    return dsep.d_separated(fixtures.edges(spark), questions)


@_query
def fix_powerset(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = fixtures.nodes(spark).groupBy("graph_id").agg(members("node").alias("members"))
    sets = nodes.select("graph_id", F.explode(powerset("members")).alias("subset"))
    return sets.select("graph_id", F.array_join(F.col("subset").cast("array<string>"), ",").alias("subset"))


def _joined(column: str, by: str = ",") -> F.Column:
    return F.array_join(F.col(column).cast("array<string>"), by).alias(column)


def _both_modes(name: str, build: Callable[[SparkSession, str], DataFrame]) -> None:
    for mode in paths.MODES:
        QUERIES[f"{name}_{mode}"] = lambda spark, sf_dir, m=mode: build(spark, m)


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return fixtures.edges(spark), fixtures.nodes(spark)


_both_modes("fix_directed_paths", lambda s, m: paths.directed_paths(fixtures.edges(s), fixtures.all_pairs(s), m).select("qid", _joined("path", ">")))
_both_modes("fix_backdoor_paths", lambda s, m: paths.backdoor_paths(fixtures.edges(s), fixtures.all_pairs(s), m).select("qid", _joined("path", ">")))
_both_modes("fix_backdoor_set", lambda s, m: identify.backdoor_sets(*_tables(s), fixtures.all_pairs(s), m).select("qid", _joined("members")))
_both_modes("fix_adjustable", lambda s, m: identify.backdoor_adjustable(*_tables(s), fixtures.all_pairs(s), m))
_both_modes("fix_all_adjustment", lambda s, m: identify.adjustment_sets(*_tables(s), fixtures.all_pairs(s), m).select("qid", _joined("members")))
_both_modes("fix_minimal", lambda s, m: identify.minimal_adjustment_set(*_tables(s), fixtures.all_pairs(s), m).select("qid", _joined("members")))
_both_modes("fix_mediators", lambda s, m: identify.frontdoor_mediators(*_tables(s), fixtures.all_pairs(s), m))
_both_modes("fix_instruments", lambda s, m: identify.instruments(*_tables(s), fixtures.all_pairs(s), m).join(fixtures.all_pairs(s), "qid").filter("node <> y").select("qid", "node"))


def _valid(spark: SparkSession, mode: str) -> DataFrame:
    rows = [(f"{g}:{x}:{y}:{z}", g, x, y, list(z)) for g, x, y, z in VALID]
    return identify.valid_adjustment(*_tables(spark), spark.createDataFrame(rows, "qid string, graph_id string, x long, y long, z array<long>"), mode)


def _frontdoor(spark: SparkSession, mode: str) -> DataFrame:
    rows = [(f"{g}:{x}:{y}:{m}", g, x, y, [m]) for g, x, y, m in FRONTDOORS]
    return identify.frontdoor(*_tables(spark), spark.createDataFrame(rows, "qid string, graph_id string, x long, y long, m array<long>"), mode)


def _instrument(spark: SparkSession, mode: str) -> DataFrame:
    rows = [(f"{g}:{z}:{x}:{y}", g, z, x, y) for g, z, x, y in INSTRUMENTS]
    return identify.valid_instrument(*_tables(spark), spark.createDataFrame(rows, "qid string, graph_id string, z long, x long, y long"), mode)


_both_modes("fix_valid_adjustment", _valid)
_both_modes("fix_frontdoor", _frontdoor)
_both_modes("fix_valid_instrument", _instrument)


# Graph drawn from the business tables
@_query
def fk_descendant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descendants of each region."""
    edges = entity_edges(spark, sf_dir)
    seeds = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("long").alias("qid"), F.lit("fk").alias("graph_id"), (KIND + F.col("r_regionkey")).cast("long").alias("node"))
    return closure.descendants(edges, seeds).groupBy("qid").agg(F.count(F.lit(1)).alias("n_descendants"))


@_query
def fk_ancestors_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors of every order."""
    seeds = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("qid"), F.lit("fk").alias("graph_id"), (4 * KIND + F.col("o_orderkey")).alias("node"))
    return closure.ancestors(entity_edges(spark, sf_dir, into=[2, 3, 4]), seeds)


@_query
def fk_children_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes of a kind have how many children."""
    fan = spread(entity_edges(spark, sf_dir), "src").groupBy("src").agg(F.count(F.lit(1)).alias("n_children"))
    return fan.select(F.floor(F.col("src") / KIND).cast("long").alias("kind"), "n_children").groupBy("kind", "n_children").agg(F.count(F.lit(1)).alias("n_nodes"))


@_query
def fk_parents_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of every part by kind."""
    seeds = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("qid"), F.lit("fk").alias("graph_id"), (6 * KIND + F.col("p_partkey")).alias("node"))
    up = closure.parents(entity_edges(spark, sf_dir, into=[6]), seeds)
    return up.groupBy("qid", F.floor(F.col("node") / KIND).cast("long").alias("kind")).agg(F.count(F.lit(1)).alias("n_parents"))


@_query
def fk_markov_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each customer's Markov boundary."""
    seeds = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("qid"), F.lit("fk").alias("graph_id"), (3 * KIND + F.col("c_custkey")).alias("node"))
    return closure.markov_boundary(entity_edges(spark, sf_dir, into=[3, 4]), seeds).groupBy("qid").agg(F.count(F.lit(1)).alias("n_boundary"))


@_query
def fk_weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the customers and orders alone."""
    edges = entity_edges(spark, sf_dir, into=[4]).filter((F.col("src") >= 3 * KIND) & (F.col("dst") < 5 * KIND))
    nodes = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    labels = identify.weak_labels(edges, nodes)
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_nodes"))


# Hyperedges: the parts of an order
def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    return spread(lines, "l_orderkey").groupBy(F.col("l_orderkey").alias("he_id")).agg(members("l_partkey").alias("vertices"))


@_query
def hyper_incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidence(_baskets(spark, sf_dir)).groupBy("vertex").agg(F.count(F.lit(1)).alias("n_hyperedges"))


@_query
def hyper_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence(_baskets(spark, sf_dir)).select("a", "b", "n")


# Properties
def _named(spark: SparkSession) -> DataFrame:
    rows = [(i, {"name": json.dumps(v), "kind": json.dumps("node")}) for i, v in NAMES.items()]
    return spark.createDataFrame(rows, "node long, props map<string,string>")


@_query
def prop_node_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark).select("node", F.from_json(F.concat(F.lit('{"v":'), F.try_element_at("props", F.lit("name")), F.lit("}")), "v string")["v"].alias("name"))


@_query
def prop_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set one node's property, delete another's, and list all."""
    from ..graph import CausalGraph

    t = CausalGraph._put(_named(spark), F.col("node") == 2, "kind", "treatment")
    t = CausalGraph._drop(t, F.col("node") == 3, "kind")
    return t.select("node", F.explode("props").alias("key", "value"))


# Effects
def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select("l_returnflag", "l_linestatus", (F.col("l_discount") >= 0.05).cast("int").alias("discounted"), "l_quantity")


def flag_graph(spark: SparkSession) -> list[str]:
    """Confounders of the flagship question from its graph: return flag and line
    status point to both discount (3) and quantity (4)."""
    names = {1: "l_returnflag", 2: "l_linestatus", 3: "discounted", 4: "l_quantity"}
    edges = spark.createDataFrame([("g", 1, 3), ("g", 1, 4), ("g", 2, 3), ("g", 2, 4), ("g", 3, 4)], "graph_id string, src long, dst long")
    question = spark.createDataFrame([(1, "g", 3, 4)], "qid long, graph_id string, x long, y long")
    found = identify.backdoor_sets(edges, nodes_of(edges), question).first()["members"]
    return [names[v] for v in found]


@_query
def ate_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect of a discount of 5 % or more on quantity, adjusted for what the graph says."""
    return _rounded(effect_table(_lines(spark, sf_dir), "discounted", "l_quantity", flag_graph(spark)), "estimate", "std_error")


@_query
def ate_no_confounder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(effect_table(_lines(spark, sf_dir), "discounted", "l_quantity", []), "estimate", "std_error")


@_query
def ate_labels_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect of toxicity on quality, by language."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    data = read("labels").join(read("documents").select("doc_id", "lang"), "doc_id").select("lang", "toxic", "quality")
    return _rounded(effect_table(data, "toxic", "quality", ["lang"]), "estimate", "std_error")


@_query
def ate_orders_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect of an urgent priority on an order's price, by market segment."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    orders = read("orders").select("o_custkey", F.col("o_orderpriority").startswith("1").cast("int").alias("urgent"), "o_totalprice")
    data = orders.join(read("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return _rounded(effect_table(data, "urgent", "o_totalprice", ["c_mktsegment"]), "estimate", "std_error")


@_query
def ppl_confounders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named confounders of treatment 2 and outcome 4 in the graph with two of them."""
    question = spark.createDataFrame([(1, "two_conf", 2, 4)], "qid long, graph_id string, x long, y long")
    found = identify.backdoor_sets(*_tables(spark), question).select(F.explode("members").alias("node"))
    names = spark.createDataFrame([(k, v) for k, v in NAMES.items()], "node long, name string")
    return found.join(names, "node").select("node", "name", F.lit(True).alias("is_identifiable"))


@_query
def viz_backdoor_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge styles of the plot of a frontdoor graph's adjustment set."""
    from ..graph import DiGraph
    from ..viz import plot_with_adjustment_set

    n, edges = fixtures.GRAPHS["frontdoor"]
    return plot_with_adjustment_set(DiGraph(spark, n, edges), 2, 4, {1}).edges
