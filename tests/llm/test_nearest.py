import numpy as np
from pyspark.sql import functions as F

from causeway.llm import nearest as module
from causeway.llm.nearest import int8_product, nearest, search_cell

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int, qkey int"


def brute(rows, k, every=20):
    ok = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v]
    ok = [(i, v) for i, v in ok if np.isfinite(v).all() and v.any()]
    seen, out = set(), []
    for n, (q, x) in enumerate(ok):
        if q % every or (q, x.tobytes()) in seen:
            continue
        seen.add((q, x.tobytes()))
        near = sorted((-np.cumsum(x * y)[-1], i) for m, (i, y) in enumerate(ok) if m != n and len(y) == len(x))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near[:k])]
    return sorted(out)


def check(spark, rows, k):
    df = spark.createDataFrame([(i, v, 0, "a", 1, 2) for i, v in rows], SCHEMA)
    got = sorted(tuple(r) for r in nearest(df, F.col("id") % 20 == 0, k).collect())
    assert got == brute(rows, k)


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(70)]
    rows += [(80, [0.0] * 6), (100, None), (101, []), (102, [float("nan")] * 6), (103, [None] * 6), (104, [float("inf")] + [1.0] * 5)]
    rows += [(None, [1.0] * 6), (20, rows[5][1]), (40, rows[40][1]), (120, [1.0, 2.0]), (121, [1.0, 2.0])]
    rows += [(200 + i, rows[3][1]) for i in range(30)]  # ties
    check(spark, rows, 20)
    check(spark, rows[:3], 20)


def test_no_vectors(spark):
    check(spark, [], 20)
    check(spark, [(0, [1.0])], 20)


def test_real_vectors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = sorted(tuple(r) for r in nearest(df, F.col("id") % 20 == 0).collect())
    assert got == brute([(r["vec_id"], r["embedding"]) for r in df.collect()], 20)


def test_tiles_against_brute_force():
    rng = np.random.default_rng(2)
    q, c = rng.normal(size=(40, 16)), rng.normal(size=(9000, 16))
    found = search_cell(list(range(-40, 0)), q, np.arange(9000), c, 7)
    for x, near in zip(q, found):
        scores = np.cumsum(x * c, axis=1)[:, -1]
        assert [i for _, i in near] == np.lexsort((np.arange(9000), -scores))[:7].tolist()
    a = rng.integers(-127, 128, size=(3, 2500)).astype(np.int8)
    assert (int8_product(a, a) == a.astype(int) @ a.astype(int).T).all()


def test_extreme_components():
    """Bounds that vanish or overflow lose no neighbour."""
    rng = np.random.default_rng(6)
    c = rng.normal(size=(300, 4)) * 10.0 ** rng.choice([-322, -310, -200, -30, 0, 150, 153], size=(300, 1))
    c[::7] = 5e-324
    c[5] = [1e308, -1e308, 1e308, 1.0]
    with np.errstate(all="ignore"):
        for part in (c, c[:, :1]):
            found = search_cell(list(range(-300, 0)), part, np.arange(300), part, 9)
            for x, near in zip(part, found):
                scores = np.cumsum(x * part, axis=1)[:, -1]
                scores[np.isnan(scores)] = -np.inf
                assert [i for _, i in near] == np.lexsort((np.arange(300), -scores))[:9].tolist()


def test_small_cells(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(module, "CELL_BYTES", 20_000)
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = sorted(tuple(r) for r in nearest(df, F.col("id") % 20 == 0).collect())
    assert got == brute([(r["vec_id"], r["embedding"]) for r in df.collect()], 20)
