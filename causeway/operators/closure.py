"""Parents, children, ancestors, descendants, Markov boundaries, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, spread, spread_to_join

#: Up to so many edges the closure is doubled; beyond, seeds are followed level by level.
DOUBLING_EDGES = 20_000


def closure(edges: DataFrame, key: list[str]) -> DataFrame:
    """``key, src, dst`` of every directed path of one edge or more.

    Each round joins the pairs with themselves, so paths of length L need
    log2(L) rounds.  Meant for graphs whose closure is affordable."""
    pairs = cut(edges.select(*key, "src", "dst").distinct())
    size = pairs.count()
    while True:
        step = pairs.withColumnRenamed("dst", "mid").join(pairs.withColumnRenamed("src", "mid"), [*key, "mid"])
        pairs = cut(pairs.unionByName(step.select(*key, "src", "dst")).distinct())
        grown = pairs.count()
        if grown == size:
            return pairs
        size = grown


def reach(edges: DataFrame, seeds: DataFrame, key: list[str]) -> DataFrame:
    """``seeds`` and every node that a directed path reaches from them.

    ``edges(key, src, dst)``, ``seeds(key, ..., node)``: further columns of
    ``seeds`` name the walker, and the result keeps them.  Where all walkers stand on
    few nodes, the few edges from there go to the walkers, not both to each other."""
    walker = [c for c in seeds.columns if c != "node"]
    edges = cut(edges.select(*key, "src", "dst"))  # each level reads them again
    if edges.limit(DOUBLING_EDGES + 1).count() <= DOUBLING_EDGES:
        step = seeds.join(closure(edges, key).withColumnRenamed("src", "node"), [*key, "node"])
        return seeds.unionByName(step.select(*walker, F.col("dst").alias("node"))).distinct()
    edges = edges.withColumnRenamed("src", "node")
    found = cut(spread(seeds, *walker, "node").distinct())
    front = found
    while True:
        out, met = edges, found
        if front.agg(F.approx_count_distinct(F.struct(*key, "node"))).first()[0] <= DOUBLING_EDGES:
            out = cut(edges.join(F.broadcast(front.select(*key, "node").distinct()), [*key, "node"], "left_semi"))
            size = out.count()
            if not size:
                return found
            if size <= DOUBLING_EDGES:
                met = found.join(F.broadcast(out.select(*key, F.col("dst").alias("node")).distinct()), [*key, "node"], "left_semi")
                out = F.broadcast(out)
        ahead = front.join(spread_to_join(out, front, *key, "node") if out is edges else out, [*key, "node"]).select(*walker, F.col("dst").alias("node"))
        ahead = spread(ahead, *walker, "node", beside=(met,)).distinct()
        front = cut(ahead.join(met, [*walker, "node"], "left_anti"))
        if front.isEmpty():
            return found
        found = found.unionByName(front)


def reverse(edges: DataFrame) -> DataFrame:
    swap = {"src": "dst", "dst": "src"}
    return edges.select(*[F.col(c).alias(swap.get(c, c)) for c in edges.columns])


def parents(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``qid, node``: sources of edges into the seeds ``(qid, graph_id, node)``."""
    up = spread_to_join(edges.withColumnRenamed("dst", "node"), seeds, "node")
    return spread(seeds.join(up, ["graph_id", "node"]).select("qid", F.col("src").alias("node")), "qid", "node").distinct()


def children(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return parents(reverse(edges), seeds)


def descendants(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``qid, node`` over the seeds ``(qid, graph_id, node)``.  A seed is left out of
    its own descendants only, so in 1->2 the descendants of {1, 2} are {2}."""
    found = reach(edges, seeds.withColumn("seed", F.col("node")), ["graph_id"])
    return spread(found.filter("node <> seed").select("qid", "node"), "qid", "node").distinct()


def ancestors(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return descendants(reverse(edges), seeds)


def markov_boundary(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``qid, node``: parents, children and the children's other parents."""
    kids = seeds.withColumnRenamed("node", "src").join(spread_to_join(edges, seeds, "src"), ["graph_id", "src"]).select("qid", "graph_id", F.col("dst").alias("node"))
    around = parents(edges, seeds).unionByName(kids.select("qid", "node")).unionByName(parents(edges, kids.distinct()))
    return spread(around, "qid", "node").distinct().join(seeds.select("qid", "node"), ["qid", "node"], "left_anti")


def skeleton(edges: DataFrame) -> DataFrame:
    """Edges in both directions."""
    return edges.unionByName(reverse(edges).select(*edges.columns)).distinct()


def components(links: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """``key, node, label``: the smallest node of the node's connected component.

    ``links(key, a, b)``, ``nodes(key, node)``.  Every round takes the smallest
    label around and then that label's label, so chains halve."""
    both = cut(links.select(*key, "a", "b").unionByName(links.select(*key, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(nodes.select(*key, "node").distinct().withColumn("label", F.col("node")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), [*key, "b"]).groupBy(*key, F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, [*key, "node"], "left").withColumn("m", F.least("label", F.coalesce("near", "label")))
        ahead = labels.select(*key, F.col("node").alias("m"), F.col("label").alias("next"))
        moved = cut(step.join(ahead, [*key, "m"]).select(*key, "node", "label", F.least("m", "next").alias("new")))
        labels = moved.select(*key, "node", F.col("new").alias("label"))
        if moved.filter("label <> new").isEmpty():
            return labels
