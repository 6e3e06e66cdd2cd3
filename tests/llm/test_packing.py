import random
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from causeway.llm import packing, queries
from causeway.llm.packing import boundaries, pack


def padding(hist, edges):
    return sum(n * (min(e for e in edges if e >= x) - x) for x, n in hist)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 5))
def test_boundaries_are_optimal(hist, k):
    hist = sorted(hist.items())
    lengths = [x for x, _ in hist]
    edges = boundaries(np.array(lengths), np.array([n for _, n in hist]), k)
    best = min(padding(hist, (*c, lengths[-1])) for r in range(min(k, len(lengths))) for c in combinations(lengths[:-1], r))
    assert len(edges) <= k and edges == sorted(set(edges)) and padding(hist, edges) == best


def test_every_row_is_packed_once(spark, sf_dir, odd_docs, no_docs):
    assert pack(no_docs).collect() == []
    for docs in (odd_docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        rows = pack(docs, buckets=5, batch_tokens=6000).collect()
        expected = sorted((r["doc_id"], len((r["text"] or "").encode().split()) + 1) for r in docs.collect())
        assert sorted((r["doc_id"], r["n_tokens"]) for r in rows) == expected
        edges = dict(sorted({r["bucket"]: r["boundary"] for r in rows}.items()))
        assert list(edges) == list(range(len(edges))) and list(edges.values()) == sorted(edges.values())
        batches = {}
        for r in rows:
            assert r["n_tokens"] <= r["boundary"] and (r["bucket"] == 0 or r["n_tokens"] > edges[r["bucket"] - 1])
            batches.setdefault((r["bucket"], r["batch"]), []).append(r)
        for (bucket, batch), members in batches.items():
            fit = max(1, 6000 // edges[bucket])
            last = max(b for x, b in batches if x == bucket)
            assert sorted(r["slot"] for r in members) == list(range(len(members)))
            assert len(members) == fit or batch == last and len(members) < fit
            assert {r["n_in_batch"] for r in members} == {len(members)}


def by_all_pairs(hist, k):
    """Least padding with at most k boundaries, by trying each last boundary."""
    best = {0: [sum(n * (x - y) for y, n in hist[: j + 1]) for j, (x, _) in enumerate(hist)]}
    for level in range(1, k):
        before = best[level - 1]
        best[level] = [min([before[j], *(before[i] + sum(n * (x - y) for y, n in hist[i + 1 : j + 1]) for i in range(j))]) for j, (x, _) in enumerate(hist)]
    return best[k - 1][-1]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 10**6), st.integers(1, 10**4), min_size=1, max_size=30), st.integers(1, 8))
def test_envelope_finds_the_optimum_of_wide_histograms(hist, k):
    hist = sorted(hist.items())
    edges = boundaries(np.array([x for x, _ in hist]), np.array([n for _, n in hist]), k)
    assert len(edges) <= k and padding(hist, edges) == by_all_pairs(hist, k)


def test_long_lengths_are_exact(spark):
    rows = spark.range(3000).withColumn("n", F.col("id") * 37 + 1)
    out = pack(rows.select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), "n"), length=F.col("n")).collect()
    assert len(out) == 3000 and all(r["n_tokens"] <= r["boundary"] for r in out)
    assert max(r["boundary"] for r in out) == 2999 * 37 + 1
    few = spark.createDataFrame([(i, "x", n) for i, n in enumerate([1025, 1501, 9001, 20001] * 5)], "doc_id long, text string, n long")
    assert all(r["n_tokens"] == r["boundary"] for r in pack(few, length=F.col("n")).collect())


def brute(rows, buckets, batch_tokens):
    lengths = sorted({n for _, n in rows})
    edges = boundaries(np.array(lengths), np.array([sum(m == n for _, m in rows) for n in lengths]), buckets)
    out, held = [], {}
    for d, n in rows:
        held.setdefault(next(k for k, e in enumerate(edges) if e >= n), []).append((d is not None, d or 0, n))
    for k, members in held.items():
        fit = max(1, batch_tokens // edges[k])
        for place, (known, d, n) in enumerate(sorted(members)):
            first = place // fit * fit
            out.append((d if known else None, n, k, edges[k], place // fit, place - first, min(fit, len(members) - first)))
    return sorted(out, key=str)


def test_whole_result(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 3)
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(300)]), int(rng.paretovariate(1) * 5)) for _ in range(500)] + [(7, 11)] * 50
    df = spark.createDataFrame(rows, "doc_id long, n int").withColumn("text", F.lit(None).cast("string"))
    for k in (1, 4, 40):
        assert sorted(map(tuple, pack(df, F.col("n"), k, 60).collect()), key=str) == brute(rows, k, 60)


def test_query_and_its_sql(spark, sf_dir):
    import duckdb

    got = queries.QUERIES["op9_packing"](spark, sf_dir)
    names = sorted(got.columns)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op9_packing"])
    assert sorted(want.columns) == names and sorted(want.project(", ".join(names)).fetchall()) == sorted(tuple(r) for r in got.select(*names).collect())


def test_padded_batches(spark):
    tokens = spark.createDataFrame([(i, list(range(1, i % 7 + 2))) for i in range(40)], "doc_id long, ids array<int>")
    packed = pack(tokens, F.size("ids"), 3, 20)
    found = packing.padded_batches(packed, tokens, pad_id=-1).collect()
    assert sum(len(r["doc_ids"]) for r in found) == 40
    for r in found:
        assert r["doc_ids"] == sorted(r["doc_ids"]) and len(r["ids"]) * r["boundary"] <= 20
        for d, ids, n in zip(r["doc_ids"], r["ids"], r["lengths"]):
            assert ids == [*range(1, d % 7 + 2)] + [-1] * (r["boundary"] - n) and n == d % 7 + 1
