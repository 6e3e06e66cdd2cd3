"""Partitions grow in number with the input, so that a task's memory does not."""

import random
import re

import duckdb
import pytest

from causeway import runtime
from causeway.hypergraph import cooccurrence
from causeway.operators import closure
from causeway.plans.oracles import SQL
from causeway.plans.queries import QUERIES
from causeway.sources import KIND, entity_edges

TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture
def many(monkeypatch):
    """Partitions so small that the smallest tables need more than Spark's own number."""
    monkeypatch.setattr(runtime, "PART_BYTES", 20_000)


def largest(df):
    """Rows in the fullest of the partitions."""
    return max(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())


def check(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    found = sorted(tuple(r[c] for c in names) for r in QUERIES[name](spark, sf_dir).collect())
    assert found == sorted(cursor.fetchall())


def test_parents_of_parts(spark, sf_dir, many):
    check(spark, sf_dir, "fk_parents_of_parts")
    edges = entity_edges(spark, sf_dir, into=[6])
    seeds = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey as qid", "'fk' as graph_id", f"p_partkey + {6 * KIND} as node")
    for df in (edges, closure.parents(edges, seeds)):
        assert largest(df) < 0.4 * df.count()  # of two partitions, one has half at least


def test_parents_without_broadcast(spark, sf_dir, many):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check(spark, sf_dir, "fk_parents_of_parts")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_small_tables_are_left_to_spark(spark, sf_dir):
    assert runtime.partitions(spark.read.parquet(f"{sf_dir}/nation.parquet")) == 0
    assert runtime.partitions(spark.createDataFrame([(1,)], "a long")) == 0


def test_children_fanout(spark, sf_dir, many):
    check(spark, sf_dir, "fk_children_fanout")
    plan = QUERIES["fk_children_fanout"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(src#\d+L, (\d+)\)", plan)]
    assert dealt and min(dealt) > 2


def test_ancestors_of_orders(spark, sf_dir, many, monkeypatch, tmp_path):
    """From tables that can hold ancestors alone: line items have none to give."""
    for t in ("nation", "customer", "orders"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    for t in ("supplier", "lineitem"):  # their rows would end the query
        (tmp_path / f"{t}.parquet").write_text("not a table")
    con = duckdb.connect()
    for t in ("nation", "customer", "orders"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    expected = sorted(con.execute(SQL["fk_ancestors_of_orders"]).fetchall())
    monkeypatch.setattr(closure, "DOUBLING_EDGES", 100)
    found = [tuple(r) for r in QUERIES["fk_ancestors_of_orders"](spark, str(tmp_path)).select("qid", "node").collect()]
    assert sorted(found) == expected


@pytest.mark.parametrize("few", [0, 6])
def test_reach_with_cycles(spark, many, monkeypatch, few):
    monkeypatch.setattr(closure, "DOUBLING_EDGES", few)
    draw = random.Random(few)
    edges = sorted({(g, draw.randrange(9), draw.randrange(9)) for g in "ab" for _ in range(11)})
    seeds = [(q, "ab"[q % 2], draw.randrange(9)) for q in range(8)]
    expected = set()
    for q, g, start in seeds:
        todo, seen = [start], {start}
        while todo:
            new = {d for h, s, d in edges if h == g and s in todo} - seen
            seen, todo = seen | new, list(new)
        expected |= {(q, g, v) for v in seen}
    e = spark.createDataFrame(edges, "graph_id string, src long, dst long")
    found = closure.reach(e, spark.createDataFrame(seeds, "qid long, graph_id string, node long"), ["graph_id"])
    rows = [(r["qid"], r["graph_id"], r["node"]) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected


def test_cooccurrence(spark, sf_dir, many):
    check(spark, sf_dir, "hyper_cooccurrence")
    check(spark, sf_dir, "hyper_incident")
    found = QUERIES["hyper_cooccurrence"](spark, sf_dir)
    assert largest(found) < 0.4 * found.count()


def test_frequent_pair_is_dealt_out_as_few_rows(spark, many, tmp_path):
    spark.range(20_000).selectExpr("id as he_id", "array(1L, 2L, id + 3) as vertices").write.parquet(f"{tmp_path}/edges")
    found = cooccurrence(spark.read.parquet(f"{tmp_path}/edges"))
    assert found.count() == 40_001 and found.filter("a = 1 and b = 2").first()["n"] == 20_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    before = plan[plan.index("hashpartitioning(a") :]
    assert "partial_count(1)" in before  # counted before dealt out by the pair
