"""d-separation of many pairs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .closure import components, reach, reverse


def separated_pairs(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pid, separated`` for ``pairs(pid, graph_id, x, y, z array, without)``.

    Edges out of the node ``without`` (null: none) are left out of a pair's
    graph.  A pair is separated when, in the moral graph of the ancestors of x,
    y and z, no path links x and y beside z.  Membership of x or y in z only
    adds to the ancestors, as the ends of a path are never tested."""
    pairs = cut(pairs.select("pid", "graph_id", "x", "y", "z", "without"))
    own = pairs.select("pid", "graph_id", "without").join(edges, "graph_id")
    own = cut(own.filter(F.col("without").isNull() | (F.col("src") != F.col("without"))).select("pid", "src", "dst"))
    seeds = pairs.select("pid", F.explode(F.concat(F.array("x", "y"), "z")).alias("node")).distinct()
    above = cut(reach(reverse(own), seeds, ["pid"]))
    inside = own.join(above.withColumnRenamed("node", "dst"), ["pid", "dst"])
    married = inside.select("pid", "dst", F.col("src").alias("a")).join(inside.select("pid", "dst", F.col("src").alias("b")), ["pid", "dst"]).filter("a < b")
    moral = inside.select("pid", F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(married.select("pid", "a", "b")).distinct()
    shut = pairs.select("pid", F.explode(F.array_except("z", F.array("x", "y"))).alias("node")).distinct()
    moral = moral.join(shut.withColumnRenamed("node", "a"), ["pid", "a"], "left_anti").join(shut.withColumnRenamed("node", "b"), ["pid", "b"], "left_anti")
    labels = components(moral, above.join(shut, ["pid", "node"], "left_anti"), ["pid"])
    of = lambda c: labels.select("pid", F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    return pairs.join(of("x"), ["pid", "x"], "left").join(of("y"), ["pid", "y"], "left").select("pid", F.coalesce(F.col("x_label") != F.col("y_label"), F.lit(True)).alias("separated"))


def d_separated(edges: DataFrame, questions: DataFrame) -> DataFrame:
    """``qid, separated`` for ``questions(qid, graph_id, x array, y array, z array)``:
    every pair of different nodes from x and y is separated by z."""
    pairs = questions.select("qid", "graph_id", F.explode("x").alias("x"), "y", "z").select("qid", "graph_id", "x", F.explode("y").alias("y"), "z")
    pairs = pairs.filter("x <> y").distinct().withColumn("pid", F.struct("qid", "x", "y")).withColumn("without", F.lit(None).cast("long"))
    answers = separated_pairs(edges, pairs).groupBy(F.col("pid.qid").alias("qid")).agg(F.bool_and("separated").alias("separated"))
    return questions.select("qid").join(answers, "qid", "left").select("qid", F.coalesce("separated", F.lit(True)).alias("separated"))


def active_reach(edges: DataFrame, starts: DataFrame, z: DataFrame, active: DataFrame) -> DataFrame:
    """``pid, node`` that an active walk from ``starts(pid, node)`` reaches.

    States are nodes with the direction of arrival.  ``edges(pid, src, dst)`` may
    lack edges of the graph that ``active(pid, node)``, z and its ancestors,
    was taken from: that is how a path can be confined and still be opened by a
    collider's descendants anywhere."""
    z = z.select("pid", "node", F.lit(True).alias("in_z")).distinct()
    active = active.select("pid", "node", F.lit(True).alias("open")).distinct()
    state = lambda node, way: F.struct(F.col(node).alias("node"), F.lit(way).alias("way"))
    at = edges.select("pid", "src", "dst")
    leave = at.join(z.withColumnRenamed("node", "src"), ["pid", "src"], "left").filter("in_z is null").select("pid", "src", "dst")
    back = at.join(z.withColumnRenamed("node", "dst"), ["pid", "dst"], "left").filter("in_z is null").select("pid", "src", "dst")
    through = at.join(active.withColumnRenamed("node", "dst"), ["pid", "dst"]).select("pid", "src", "dst")
    moves = (
        leave.select("pid", state("src", "up").alias("a"), state("dst", "down").alias("b"))
        .unionByName(leave.select("pid", state("src", "down").alias("a"), state("dst", "down").alias("b")))
        .unionByName(back.select("pid", state("dst", "up").alias("a"), state("src", "up").alias("b")))
        .unionByName(through.select("pid", state("dst", "down").alias("a"), state("src", "up").alias("b")))
    )
    moves = cut(moves.distinct().withColumnsRenamed({"a": "src", "b": "dst"}))
    seeds = starts.select("pid", state("node", "up").alias("node"))
    return reach(moves, seeds, ["pid"]).select("pid", F.col("node.node").alias("node")).distinct()
