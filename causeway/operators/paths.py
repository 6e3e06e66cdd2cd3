"""Path enumeration and the blocking rule on a path.

Only the two operators that return paths, the plot of backdoor paths and the
tests enumerate; every other operator uses a closed form of polynomial size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .closure import skeleton

MODES = ("reference", "pearl")
#: More paths than this raise an error instead of filling the cluster.
MAX_PATHS = 1_000_000


def check_mode(semantics: str) -> None:
    if semantics not in MODES:
        raise ValueError(f"semantics must be one of {MODES}, got {semantics!r}")


def simple_paths(steps: DataFrame, ends: DataFrame, max_paths: int = MAX_PATHS) -> DataFrame:
    """``ends`` with a column ``path`` for every simple path from ``s`` to ``t``.

    ``steps(graph_id, src, dst)``, ``ends(..., graph_id, s, t)``.  A path stops
    at its target; from a node to itself there is the path of that node."""
    front = cut(ends.distinct().withColumn("path", F.array("s")))
    done = front.filter("s = t")
    front = front.filter("s <> t")
    total = 0
    while True:
        total += front.count()
        if total > max_paths:
            raise RuntimeError(f"more than {max_paths} partial paths; raise max_paths or use a smaller graph")
        grown = front.withColumn("src", F.element_at("path", -1)).join(steps, ["graph_id", "src"])
        grown = grown.filter(~F.array_contains("path", F.col("dst"))).withColumn("path", F.concat("path", F.array("dst")))
        grown = cut(grown.select(*front.columns))
        done = done.unionByName(grown.filter(F.element_at("path", -1) == F.col("t")))
        front = grown.filter(F.element_at("path", -1) != F.col("t"))
        if front.isEmpty():
            return done


def directed_paths(edges: DataFrame, questions: DataFrame, semantics: str = "reference", max_paths: int = MAX_PATHS) -> DataFrame:
    """``qid, path`` for ``questions(qid, graph_id, x, y)``.  In mode ``reference``
    paths walk edges both ways, in mode ``pearl`` along them only."""
    check_mode(semantics)
    steps = skeleton(edges) if semantics == "reference" else edges
    ends = questions.select("qid", "graph_id", F.col("x").alias("s"), F.col("y").alias("t"))
    return simple_paths(steps, ends, max_paths).select("qid", "path")


def backdoor_paths(edges: DataFrame, questions: DataFrame, semantics: str = "reference", max_paths: int = MAX_PATHS) -> DataFrame:
    """``qid, path``: from x to one of its parents and on to y.  In mode
    ``reference`` the rest of a path may come back to x, in mode ``pearl`` not."""
    check_mode(semantics)
    starts = questions.join(edges.withColumnRenamed("dst", "x"), ["graph_id", "x"])
    found = simple_paths(skeleton(edges), starts.select("qid", "graph_id", "x", F.col("src").alias("s"), F.col("y").alias("t")), max_paths)
    if semantics == "pearl":
        found = found.filter(~F.array_contains("path", F.col("x")))
    return found.select("qid", F.concat(F.array("x"), "path").alias("path"))


def blocked(edges: DataFrame, paths: DataFrame, z: DataFrame, active: DataFrame) -> DataFrame:
    """``paths(qid, graph_id, path)`` with a column ``blocked``.

    An inner node with both arrows towards it blocks unless it is in ``active(qid,
    node)``, z and its ancestors; another inner node blocks when in ``z(qid,
    node)``.  Paths of fewer than two nodes are blocked."""
    inner = paths.select("qid", "graph_id", "path", F.posexplode("path").alias("i", "node")).filter("i > 0 and i < size(path) - 1")
    inner = inner.withColumn("a", F.get("path", F.col("i") - 1)).withColumn("b", F.get("path", F.col("i") + 1))
    into = lambda c: edges.select("graph_id", F.col("src").alias(c), F.col("dst").alias("node"), F.lit(True).alias(f"{c}_in"))
    inner = inner.join(into("a"), ["graph_id", "a", "node"], "left").join(into("b"), ["graph_id", "b", "node"], "left")
    inner = inner.join(z.select("qid", "node", F.lit(True).alias("in_z")).distinct(), ["qid", "node"], "left")
    inner = inner.join(active.select("qid", "node", F.lit(True).alias("is_active")).distinct(), ["qid", "node"], "left")
    collider = F.coalesce("a_in", F.lit(False)) & F.coalesce("b_in", F.lit(False))
    stops = F.when(collider, F.col("is_active").isNull()).otherwise(F.col("in_z").isNotNull())
    stopped = inner.filter(stops).select("qid", "path").distinct().withColumn("stopped", F.lit(True))
    return paths.join(stopped, ["qid", "path"], "left").withColumn("blocked", F.col("stopped").isNotNull() | (F.size("path") < 2)).drop("stopped")
