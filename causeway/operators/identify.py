"""Identification: backdoor, frontdoor, instruments, adjustment sets.

All operators take ``edges``, ``nodes`` and a table of questions ``(qid,
graph_id, x, y, ...)`` on acyclic graphs.  ``semantics="reference"`` follows
paths that ignore arrows where "directed" is meant and that may come back to
the treatment; ``semantics="pearl"`` is the textbook's reading.  Neither
enumerates paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import members, subsets_upto
from ..runtime import cut
from .closure import ancestors, components, descendants, reach, reverse
from .dsep import active_reach, separated_pairs
from .paths import check_mode

MOST_MEMBERS = 5
def _none() -> Column:
    return F.lit(None).cast("long")


def weak_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    links = edges.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    return components(links, nodes, ["graph_id"])


def _same_component(questions: DataFrame, labels: DataFrame, a: str, b: str) -> DataFrame:
    """``questions`` whose nodes in columns ``a`` and ``b`` are weakly connected."""
    of = lambda c, name: labels.select("graph_id", F.col("node").alias(c), F.col("label").alias(name))
    if a == b:
        return questions
    return questions.join(of(a, "la"), ["graph_id", a]).join(of(b, "lb"), ["graph_id", b]).filter("la = lb").drop("la", "lb")


def labels_without(edges: DataFrame, nodes: DataFrame, removed: DataFrame, key: list[str]) -> DataFrame:
    """``key, node, label``: components of each row's graph without its node ``gone``.
    ``removed(key, graph_id, gone)``."""
    links = removed.join(edges, "graph_id").filter("src <> gone and dst <> gone").select(*key, F.col("src").alias("a"), F.col("dst").alias("b"))
    left = removed.join(nodes, "graph_id").filter("node <> gone").select(*key, "node")
    return components(links, left, key)


def _parents_of(questions: DataFrame, edges: DataFrame, column: str) -> DataFrame:
    """``questions`` by parent ``p`` of the node in ``column``."""
    return questions.join(edges.select("graph_id", F.col("dst").alias(column), F.col("src").alias("p")), ["graph_id", column])


def _parent_avoids(edges: DataFrame, nodes: DataFrame, questions: DataFrame, column: str) -> DataFrame:
    """``qid`` where a parent of the node in ``column`` has a skeleton path to y that
    avoids that node."""
    labels = labels_without(edges, nodes, questions.select("qid", "graph_id", F.col(column).alias("gone")), ["qid"])
    own = _parents_of(questions, edges, column).join(labels.select("qid", F.col("node").alias("p"), F.col("label").alias("lp")), ["qid", "p"])
    target = labels.select("qid", F.col("node").alias("y"), F.col("label").alias("ly"))
    return own.join(target, ["qid", "y"]).filter("lp = ly").select("qid").distinct()


def _flag(questions: DataFrame, yes: DataFrame, name: str) -> DataFrame:
    """``questions`` with a column that is true for the qids in ``yes``."""
    marks = yes.select("qid").distinct().withColumn(name, F.lit(True))
    return questions.join(marks, "qid", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def valid_adjustment(edges: DataFrame, nodes: DataFrame, questions: DataFrame, semantics: str = "reference") -> DataFrame:
    """``qid, valid`` for ``questions(qid, graph_id, x, y, z array)``."""
    check_mode(semantics)
    questions = cut(questions.select("qid", "graph_id", "x", "y", "z"))
    below = descendants(edges, questions.select(F.struct("graph_id", "x").alias("qid"), "graph_id", F.col("x").alias("node")).distinct())
    below = below.select("qid.graph_id", "qid.x", "node")
    in_z = questions.select("qid", "graph_id", "x", "y", F.explode("z").alias("node"))
    bad = in_z.filter("node = x or node = y").select("qid").unionByName(in_z.join(below, ["graph_id", "x", "node"]).select("qid"))
    if semantics == "reference":
        up = _parents_of(questions, edges, "x")
        bad = bad.unionByName(up.filter("p = y").select("qid"))
        open_up = up.filter(~F.array_contains("z", F.col("p")) & (F.col("p") != F.col("y")))
        pairs = open_up.select(F.struct("qid", "p").alias("pid"), "graph_id", F.col("p").alias("x"), "y", "z", _none().alias("without"))
    else:
        pairs = questions.filter("x <> y").select(F.struct("qid", F.col("x").alias("p")).alias("pid"), "graph_id", "x", "y", "z", F.col("x").alias("without"))
    joined = separated_pairs(edges, pairs).filter("not separated").select(F.col("pid.qid").alias("qid"))
    return _flag(questions, bad.unionByName(joined), "bad").select("qid", (~F.col("bad")).alias("valid"))


def backdoor_sets(edges: DataFrame, nodes: DataFrame, questions: DataFrame, semantics: str = "reference") -> DataFrame:
    """``qid, members`` for ``questions(qid, graph_id, x, y)``: x's parents, or nothing
    where no backdoor path exists; in mode ``pearl`` null where parents don't do."""
    check_mode(semantics)
    questions = cut(questions.select("qid", "graph_id", "x", "y"))
    up = _parents_of(questions, edges, "x").groupBy("qid").agg(members("p").alias("up"))
    if semantics == "reference":
        needed = _same_component(questions, weak_labels(edges, nodes), "x", "y")
    else:
        needed = _parent_avoids(edges, nodes, questions.filter("x <> y"), "x")
    out = _flag(questions, needed, "needed").join(up, "qid", "left").withColumn("up", F.coalesce("up", F.array().cast("array<long>")))
    none = F.array().cast("array<long>")
    out = out.withColumn("members", F.when(F.col("needed"), F.col("up")).otherwise(none))
    if semantics == "pearl":
        valid = valid_adjustment(edges, nodes, out.select("qid", "graph_id", "x", "y", F.col("members").alias("z")), semantics)
        out = out.join(valid, "qid").withColumn("members", F.when(F.col("valid") | ~F.col("needed"), F.col("members")))
    return out.select("qid", "members")


def backdoor_adjustable(edges: DataFrame, nodes: DataFrame, questions: DataFrame, semantics: str = "reference") -> DataFrame:
    """``qid, adjustable``.  In mode ``reference`` it always holds: there is a set of
    parents or no path to block.  In mode ``pearl`` y must not be x's parent."""
    check_mode(semantics)
    if semantics == "reference":
        return questions.select("qid", F.lit(True).alias("adjustable"))
    wrong = _parents_of(questions, edges, "x").filter("p = y")
    return _flag(questions, wrong, "wrong").select("qid", (~F.col("wrong")).alias("adjustable"))


def frontdoor(edges: DataFrame, nodes: DataFrame, questions: DataFrame, semantics: str = "reference") -> DataFrame:
    """``qid, frontdoor`` for ``questions(qid, graph_id, x, y, m array)``."""
    check_mode(semantics)
    questions = cut(questions.select("qid", "graph_id", "x", "y", "m"))
    each = questions.withColumn("one", F.explode("m"))
    # Paths from x to y that avoid the mediators.
    asked = questions.filter(~F.array_contains("m", F.col("x")) & ~F.array_contains("m", F.col("y")) & (F.col("x") != F.col("y")))
    own = asked.select(F.col("qid").alias("pid"), "graph_id", "m").join(edges, "graph_id")
    beside = own.filter(~F.array_contains("m", F.col("src")) & ~F.array_contains("m", F.col("dst"))).select("pid", "src", "dst")
    starts = asked.select(F.col("qid").alias("pid"), F.col("x").alias("node"))
    if semantics == "reference":
        z = asked.select(F.col("qid").alias("pid"), F.explode("m").alias("node"))
        around = reach(reverse(own.select("pid", "src", "dst")), z, ["pid"])
        found = active_reach(beside, starts, z, around)
    else:
        found = reach(beside, starts, ["pid"])
    past = found.join(asked.select(F.col("qid").alias("pid"), F.col("y").alias("node")), ["pid", "node"]).select(F.col("pid").alias("qid"))
    if semantics == "reference":
        confounded = _same_component(_parents_of(each, edges, "x"), weak_labels(edges, nodes), "x", "one").select("qid")
        up = _parents_of(each, edges, "one")
        pairs = up.filter("p <> y and p <> x").select(F.struct("qid", "one", "p").alias("pid"), "graph_id", F.col("p").alias("x"), "y", F.array("x").alias("z"), _none().alias("without"))
        second = up.filter("p = y").select("qid").unionByName(separated_pairs(edges, pairs).filter("not separated").select("pid.qid"))
    else:
        pairs = each.filter("x <> one").select(F.struct("qid", "one").alias("pid"), "graph_id", "x", F.col("one").alias("y"), F.array().cast("array<long>").alias("z"), F.col("x").alias("without"))
        confounded = separated_pairs(edges, pairs).filter("not separated").select("pid.qid")
        rest = each.filter("one <> y").select(F.struct("qid", "one").alias("pid"), "graph_id", "one", "x", "y")
        full = rest.select("pid", "graph_id", "one").join(edges, "graph_id")
        z = rest.select("pid", F.col("x").alias("node"))
        above = reach(reverse(full.select("pid", "src", "dst")), z, ["pid"])
        shut = rest.filter("x <> one and x <> y").select("pid", F.col("x").alias("node"))
        reached = active_reach(full.filter("src <> one").select("pid", "src", "dst"), rest.select("pid", F.col("one").alias("node")), shut, above)
        second = reached.join(rest.select("pid", F.col("y").alias("node")), ["pid", "node"]).select("pid.qid")
    bad = past.unionByName(confounded).unionByName(second)
    return _flag(questions, bad, "bad").select("qid", (~F.col("bad")).alias("frontdoor"))


def frontdoor_mediators(edges: DataFrame, nodes: DataFrame, questions: DataFrame, semantics: str = "reference") -> DataFrame:
    """``qid, node``: single mediators for ``questions(qid, graph_id, x, y)``, of the
    nodes on paths between x and y."""
    check_mode(semantics)
    questions = cut(questions.select("qid", "graph_id", "x", "y"))
    if semantics == "reference":
        # A node lies on a simple path between x and y unless some other node
        # cuts it off from what is left of the two.
        asked = questions.filter("x <> y").join(edges.select("graph_id", F.col("dst").alias("x")).distinct(), ["graph_id", "x"], "left_anti")
        removed = asked.join(nodes.withColumnRenamed("node", "gone"), "graph_id")
        labels = labels_without(edges, nodes, removed.select("qid", "gone", "graph_id"), ["qid", "gone"])
        ends = asked.select("qid", F.explode(F.array("x", "y")).alias("node")).join(labels, ["qid", "node"]).select("qid", "gone", "label").distinct()
        cut_off = labels.join(ends, ["qid", "gone", "label"], "left_anti").select("qid", "node").distinct()
        candidates = asked.join(nodes, "graph_id").filter("node <> x and node <> y").join(cut_off, ["qid", "node"], "left_anti")
    else:
        below = descendants(edges, questions.select("qid", "graph_id", F.col("x").alias("node")))
        above = ancestors(edges, questions.select("qid", "graph_id", F.col("y").alias("node")))
        candidates = questions.join(below.join(above, ["qid", "node"]), "qid").filter("node <> x and node <> y")
    batch = candidates.select(F.struct("qid", "node").alias("qid"), "graph_id", "x", "y", F.array("node").alias("m"))
    return frontdoor(edges, nodes, batch, semantics).filter("frontdoor").select("qid.qid", "qid.node")


def valid_instrument(edges: DataFrame, nodes: DataFrame, questions: DataFrame, semantics: str = "reference") -> DataFrame:
    """``qid, valid`` for ``questions(qid, graph_id, z, x, y)`` with one node z each."""
    check_mode(semantics)
    questions = cut(questions.select("qid", "graph_id", "z", "x", "y"))
    if semantics == "reference":
        labels = cut(weak_labels(edges, nodes))
        related = _same_component(questions, labels, "z", "x").select("qid")
        apart = labels_without(edges, nodes, questions.filter("z <> x and y <> x").select("qid", "graph_id", F.col("x").alias("gone")), ["qid"])
        of = lambda c: apart.select("qid", F.col("node").alias(c), F.col("label").alias(f"l{c}"))
        direct = questions.join(of("z"), ["qid", "z"]).join(of("y"), ["qid", "y"]).filter("lz = ly").select("qid")
        confounded = _same_component(_parents_of(questions, edges, "z"), labels, "z", "y").select("qid")
    else:
        below = descendants(edges, questions.select("qid", "graph_id", F.col("z").alias("node")))
        related = questions.join(below.withColumnRenamed("node", "x"), ["qid", "x"]).select("qid")
        beside = questions.select("qid", "graph_id", "x").join(edges, "graph_id").filter("src <> x and dst <> x").select("qid", "src", "dst")
        found = reach(beside, questions.filter("z <> x").select("qid", F.col("z").alias("node")), ["qid"])
        direct = found.join(questions.filter("z <> y").select("qid", F.col("y").alias("node")), ["qid", "node"]).select("qid")
        confounded = _parent_avoids(edges, nodes, questions, "z")
    out = _flag(_flag(questions, related, "related"), direct.unionByName(confounded), "bad")
    return out.select("qid", (F.col("related") & ~F.col("bad")).alias("valid"))


def instruments(edges: DataFrame, nodes: DataFrame, questions: DataFrame, semantics: str = "reference") -> DataFrame:
    """``qid, node``: valid instruments among x's ancestors."""
    above = ancestors(edges, questions.select("qid", "graph_id", F.col("x").alias("node")))
    batch = questions.join(above, "qid").select(F.struct("qid", "node").alias("qid"), "graph_id", F.col("node").alias("z"), "x", "y")
    return valid_instrument(edges, nodes, batch, semantics).filter("valid").select("qid.qid", "qid.node")


def adjustment_sets(edges: DataFrame, nodes: DataFrame, questions: DataFrame, semantics: str = "reference", most: int = MOST_MEMBERS) -> DataFrame:
    """``qid, members`` of every valid adjustment set of up to ``most`` nodes."""
    check_mode(semantics)
    questions = cut(questions.select("qid", "graph_id", "x", "y"))
    below = descendants(edges, questions.select("qid", "graph_id", F.col("x").alias("node")))
    free = questions.join(nodes, "graph_id").filter("node <> x and node <> y").join(below, ["qid", "node"], "left_anti").select("qid", "node")
    sets = cut(subsets_upto(cut(free), questions, most))
    batch = sets.join(questions, "qid").select(F.struct("qid", "members").alias("qid"), "graph_id", "x", "y", F.col("members").alias("z"))
    return valid_adjustment(edges, nodes, batch, semantics).filter("valid").select("qid.qid", "qid.members")


def minimal_adjustment_set(edges: DataFrame, nodes: DataFrame, questions: DataFrame, semantics: str = "reference") -> DataFrame:
    """``qid, members`` of the smallest valid set, the first in order of its nodes;
    null where there is none."""
    order = Window.partitionBy("qid").orderBy(F.size("members"), "members")
    best = adjustment_sets(edges, nodes, questions, semantics).withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")
    return questions.select("qid").join(best, "qid", "left")


def is_identifiable(graph, query):
    """Not defined: kept so that callers get the error that they expect."""
    raise NotImplementedError("is_identifiable is not implemented")


def identify_formula(graph, query):
    """Not defined: kept so that callers get the error that they expect."""
    raise NotImplementedError("identify_formula is not implemented")
