"""Nearest neighbours by inner product with a block matrix join.

Queries and candidates are dealt by a hash of their id into blocks; each pair
of a query block and a candidate block is a cell of the matrix and a group of
its own, of bounded size.  Inside a cell, vectors are quantised to int8 and
multiplied tile by tile.  The product of two quantised vectors differs from
the true one by at most |x - x'| |y| + |x'| |y - y'|, so a pair whose upper
bound lies under the k-th best lower bound can't be among the nearest.  The
other pairs are recomputed in double precision and merged by a heap for each
query.  Cells' heaps (k rows a query) are merged by rank.  Results are exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TILE_Q, TILE_C = 512, 4096
QUERY_BLOCK, LEAST_BLOCK, MOST_BLOCK = 8192, 4096, 65536
#: The least scale: smaller components are all error.
TINY = np.finfo(np.float64).tiny
#: Bytes of either side's vectors in a cell.
CELL_BYTES = 1 << 26


def norms(v: np.ndarray) -> np.ndarray:
    """Lengths of the rows; their squares neither overflow nor vanish."""
    top = np.maximum(np.abs(v).max(axis=1), TINY)
    return top * np.linalg.norm(v / top[:, None], axis=1)


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the quantised vectors, norms of the errors."""
    scale = np.maximum(np.abs(v).max(axis=1) / 127, TINY)
    codes = np.rint(v / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, norms(back), norms(v - back)


def int8_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows, as float64.  Float32 sums of at most
    1024 products of 7-bit numbers are exact, so wider vectors go in slices."""
    out = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], 1024):
        out += a[:, d : d + 1024].astype(np.float32) @ b[:, d : d + 1024].astype(np.float32).T
    return out


@np.errstate(over="ignore", invalid="ignore", under="ignore")
def search_cell(qid, queries, cid, candidates, k):
    """For each query the k nearest of the cell: lists of (score, id), where a
    candidate row with the query's id and vector is left out once.  A bound that
    overflows rules nothing out; a score that is no number comes after all others."""
    cq, sq, nq, eq = quantise(queries)
    cc, sc, nc, ec = quantise(candidates)
    norm_c = norms(candidates)
    heaps: list[list[tuple[float, int]]] = [[] for _ in qid]
    own_left = [True] * len(qid)
    for q0 in range(0, len(qid), TILE_Q):
        q1 = min(q0 + TILE_Q, len(qid))
        for c0 in range(0, len(cid), TILE_C):
            c1 = min(c0 + TILE_C, len(cid))
            near = int8_product(cq[q0:q1], cc[c0:c1]) * sq[q0:q1, None] * sc[None, c0:c1]
            slack = eq[q0:q1, None] * norm_c[None, c0:c1] + nq[q0:q1, None] * ec[None, c0:c1]
            slack += 1e-12 * (1 + np.abs(near))
            low = near - slack
            low[np.isnan(low)] = -np.inf
            floor = np.full(q1 - q0, -np.inf)
            if c1 - c0 > k:  # one more than k: the query's own row may be among them
                floor = np.partition(low, c1 - c0 - k - 1, axis=1)[:, c1 - c0 - k - 1]
            full = [h[0][0] if len(h) == k else -np.inf for h in heaps[q0:q1]]
            floor = np.maximum(floor, full)
            qi, ci = np.nonzero(~(near + slack < floor[:, None]))
            for s in range(0, len(qi), 65536):
                a, b = qi[s : s + 65536] + q0, ci[s : s + 65536] + c0
                scores = np.cumsum(queries[a] * candidates[b], axis=1)[:, -1]  # sums from left to right
                for i, j, score in zip(a.tolist(), b.tolist(), scores.tolist()):
                    other = int(cid[j])
                    if other == qid[i] and own_left[i] and np.array_equal(queries[i], candidates[j]):
                        own_left[i] = False
                        continue
                    heap, entry = heaps[i], (score if score == score else -np.inf, -other)
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
    return [[(s, -i) for s, i in sorted(h, reverse=True)] for h in heaps]


def _matrix(t: pa.Table) -> np.ndarray:
    column = t.column("v").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1) if len(t) else np.zeros((0, 1))


def _cell(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "qkey": [], "vec_id": [], "score": []}
        if len(queries) and len(candidates):
            ids, keys = queries.column("id").to_pylist(), queries.column("qkey").to_pylist()
            found = search_cell(ids, _matrix(queries), candidates.column("id").to_numpy(), _matrix(candidates), k)
            for q, key, near in zip(ids, keys, found):
                out["query_id"] += [q] * len(near)
                out["qkey"] += [key] * len(near)
                out["vec_id"] += [i for _, i in near]
                out["score"] += [s for s, _ in near]
        return pa.table({n: pa.array(v, pa.float64() if n == "score" else pa.int64()) for n, v in out.items()})

    return run


def usable_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` of the rows that take part: an id, and a vector without null
    or non-finite components that isn't empty or zero."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.filter(~bad & F.exists("v", lambda x: x != 0))


def nearest(rows: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` nearest rows.

    ``is_query`` is a condition on the column ``id``.  A query's own row is no
    candidate; other rows with its id are.  Query rows that repeat id and
    vector are one query, and its further copies are candidates.  Vectors are
    compared with those of equal length only.  Rows that
    :func:`usable_vectors` leaves out take no part.  Ties go to the smaller id.
    A product that overflows to no number counts as minus infinity.
    An empty table gives no rows; further columns are ignored.
    """
    spark = rows.sparkSession
    vectors = usable_vectors(rows, id_col, vector_col)
    counts = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q"), F.max(F.size("v")).alias("dim")).first()
    fit = max(1, CELL_BYTES // (8 * (counts["dim"] or 1)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = min(MOST_BLOCK, max(LEAST_BLOCK, counts["n"] // max(1, parts)))
    q_blocks, c_blocks = max(1, -(-counts["q"] // min(QUERY_BLOCK, fit))), max(1, -(-counts["n"] // min(size, fit)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = vectors.filter(is_query).distinct().select("id", "v", F.xxhash64("v").alias("qkey"), F.size("v").alias("dim"))
    queries = queries.withColumn("qb", block(q_blocks)).withColumn("cb", every(c_blocks))
    candidates = vectors.select("id", "v", F.size("v").alias("dim"), block(c_blocks).alias("cb")).withColumn("qb", every(q_blocks))
    keys = ["dim", "qb", "cb"]
    cells = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys))
    found = cells.applyInArrow(_cell(k), "query_id long, qkey long, vec_id long, score double")
    best = Window.partitionBy("query_id", "qkey").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, row_number() OVER () AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
), ok AS (
  SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, list_dot_product(q.e, c.e) AS score
  FROM ok q JOIN ok c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
), k AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20
"""
