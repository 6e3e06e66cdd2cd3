"""Packing into optimal length buckets.

Lengths are computed once and written.  Their global histogram, one row for
each distinct length, goes to the driver: a table can't have more distinct
lengths than its longest text has tokens, nor more than the square root of twice
all tokens.  Dynamic programming over it picks the bucket boundaries for which
padding every document to its bucket's boundary wastes the fewest tokens.  The
cost of a boundary is a line in the next boundary's length, so a lower envelope
of lines gives each step in time linear in the distinct lengths, and the
optimum is exact.

Inside a bucket, documents are numbered in order of their ids without gathering
them: rows are dealt by ranges of (bucket, id), numbered within a range, and a
running sum of the ranges' counts, one row for each bucket and range, gives each
range its offset.  Every ``batch_tokens // boundary`` numbers make a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import SPACE, materialise, shuffle_partitions, text_of, tidy

BUCKETS, BATCH_TOKENS = 16, 65_536
#: Copies of one row that are numbered at once.
COPIES = 4096


def _layer(best: list[int], lengths: list[int], n: list[int]) -> list[int]:
    """Least cost of covering lengths 0..j with one more bucket than ``best`` has.

    Closing the buckets before at i costs ``best[i] - lengths[j] * n[i]`` more than a constant
    of j: a line in lengths[j].  Slopes fall with i and lengths grow with j, so
    lines that leave the lower envelope never come back."""
    new, hull, at = best[:], [0], 0
    for j in range(1, len(best)):
        x = lengths[j]
        while at + 1 < len(hull) and best[hull[at + 1]] - x * n[hull[at + 1]] <= best[hull[at]] - x * n[hull[at]]:
            at += 1
        i = hull[at]
        new[j] = min(best[j], best[i] + x * (n[j] - n[i]))
        while len(hull) - at >= 2:
            a, b = hull[-2], hull[-1]
            # The last line goes where the new one passes it before it passes the one before.
            if (best[j] - best[a]) * (n[b] - n[a]) <= (best[b] - best[a]) * (n[j] - n[a]):
                hull.pop()
            else:
                break
        hull.append(j)
    return new


def boundaries(lengths: np.ndarray, counts: np.ndarray, k: int) -> list[int]:
    """At most ``k`` of the ascending ``lengths``, the last one among them, for
    which the sum of counts * (boundary - length) is least.  Of equally good
    choices, fewer boundaries; then, from the last one down, the smallest."""
    x = [int(v) for v in lengths]
    m = len(x)
    if m == 0:
        return []
    n = np.cumsum(np.asarray(counts, np.int64)).tolist()
    layers = [[a * b for a, b in zip(x, n)]]  # tokens with padding
    while len(layers) < min(k, m):
        layers.append(_layer(layers[-1], x, n))
    table, counted, size = [np.array(v, np.int64) for v in layers], np.array(n, np.int64), np.array(x, np.int64)
    fewest = lambda level, j: next(t for t in range(level + 1) if layers[t][j] == layers[level][j])
    out, j = [], m - 1
    level = fewest(len(layers) - 1, j)
    while True:
        out.append(x[j])
        if level == 0:
            return out[::-1]
        cost = table[level - 1][:j] + size[j] * (counted[j] - counted[:j])
        i = int(np.flatnonzero(cost == layers[level][j])[0])
        j, level = i, fewest(level - 1, i)


def word_count(text_col: str = "text") -> Column:
    """Words of a text, the default length."""
    text = text_of(text_col)
    return F.size(F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != ""))


@tidy
def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``at``: the rows, copies counted, of the same bucket before a row in its
    range; rows come sorted by bucket."""
    last, before = None, 0
    for batch in batches:
        if not len(batch):
            continue
        bucket, copies = batch.column("bucket").to_numpy(), batch.column("copies").to_numpy()
        ends = np.cumsum(copies)
        new = np.append(bucket[0] != last, bucket[1:] != bucket[:-1])
        # What the running sum held at each bucket's start.
        base = np.where(new, ends - copies, 0)
        if not new[0]:
            base[0] = -before
        at = ends - copies - base[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        last, before = bucket[-1], int(at[-1] + copies[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, "at"])


def pack(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, bucket, boundary, batch, slot, n_in_batch`` of every row.

    ``length`` is a whole number of tokens, null counting 0; by default words, each text with an
    end token, so an empty or null text counts 1 and a very long one as many words as it has.  ``bucket`` counts from 0 in
    order of ``boundary``; no row is cut or left out, as the last boundary is the
    greatest length.  A batch holds ``max(1, batch_tokens // boundary)`` rows of
    one bucket, in order of their ids; ``slot`` counts from 0 within it, and only
    the last batch of a bucket may hold fewer.  Ids may be null (first) or repeat:
    such rows are packed one by one, in order of length, and a repeated id with one length is
    counted before it is numbered.  An empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    length = F.coalesce(length, F.lit(0)) if length is not None else word_count(text_col) + 1
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), length.cast("long").alias("n_tokens")), "lengths")
    histogram = sorted((r["n_tokens"], r["n"]) for r in rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect())
    edges = boundaries(np.array([x for x, _ in histogram]), np.array([n for _, n in histogram]), buckets)

    edge_array = F.array(*[F.lit(e).cast("long") for e in edges or [0]])
    bucket = F.size(F.filter(edge_array, lambda e: e < F.col("n_tokens")))
    rows = rows.groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("copies")).withColumn("bucket", bucket)
    order = ["bucket", "doc_id", "n_tokens"]
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = T.StructType([*dealt.schema.fields, T.StructField("at", T.LongType())])
    dealt = materialise(dealt.mapInArrow(_number, schema), "numbered")
    # A row for each range, and one more where a bucket ends within a range.
    counts = dealt.groupBy("bucket", "part").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy("bucket")).alias("in_bucket"))
    placed = dealt.join(F.broadcast(offsets), ["bucket", "part"])
    # In two steps, so that no array grows with the number of copies.
    placed = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}"))))
    copy = F.sequence(F.col("block") * COPIES, F.least(F.col("copies"), (F.col("block") + 1) * COPIES) - 1)
    placed = placed.withColumn("copy", F.explode(copy)).withColumn("boundary", F.get(edge_array, F.col("bucket")))
    placed = placed.withColumn("fit", F.expr(f"greatest(1L, {int(batch_tokens)}L div greatest(boundary, 1L))"))
    placed = placed.withColumn("place", F.col("offset") + F.col("at") + F.col("copy")).withColumn("batch", F.expr("place div fit"))
    return placed.select("doc_id", "n_tokens", "bucket", "boundary", "batch", F.expr("place % fit").alias("slot"), F.least("fit", F.expr("in_bucket - batch * fit")).alias("n_in_batch"))


def padded_batches(packed: DataFrame, tokens: DataFrame, pad_id: int = 0) -> DataFrame:
    """``bucket, batch, boundary, doc_ids, ids, lengths``: the batches of :func:`pack`
    as matrices, each row of ``ids`` filled up with ``pad_id`` to ``boundary``;
    ``lengths`` are the masks.

    ``tokens`` has a row ``doc_id, ids`` for each packed row, ``n_tokens`` ids
    each, and no id twice; null ids are matched with each other.  A batch holds
    at most its budget of ids, or one row."""
    ids = tokens.select(F.col("doc_id").alias("token_id"), F.col("ids").cast("array<long>").alias("ids"))
    rows = packed.join(ids, F.col("doc_id").eqNullSafe(F.col("token_id")))
    filled = F.concat("ids", F.array_repeat(F.lit(pad_id).cast("long"), (F.col("boundary") - F.col("n_tokens")).cast("int")))
    rows = rows.select("bucket", "batch", "boundary", F.struct("slot", "doc_id", "n_tokens", filled.alias("ids")).alias("row"))
    found = rows.groupBy("bucket", "batch", "boundary").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return found.select("bucket", "batch", "boundary", F.col("rows.doc_id").alias("doc_ids"), F.col("rows.ids").alias("ids"), F.col("rows.n_tokens").alias("lengths"))


#: Layers of the dynamic programme over all pairs of lengths, then its way back.
ORACLE_SQL = rf"""
WITH RECURSIVE lens AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS BIGINT) AS n_tokens FROM documents
), h AS (
  SELECT n_tokens AS l, row_number() OVER (ORDER BY n_tokens) AS j, CAST(sum(count(*)) OVER (ORDER BY n_tokens) AS BIGINT) AS n FROM lens GROUP BY n_tokens
), dp(t, j, best) AS (
  SELECT 1, j, l * n FROM h
  UNION ALL
  SELECT p.t + 1, q.j, least(any_value(own.best), min(p.best + q.l * (q.n - i.n)))
  FROM dp p JOIN h i ON i.j = p.j JOIN h q ON q.j > p.j JOIN dp own ON own.j = q.j AND own.t = p.t WHERE p.t < {BUCKETS} GROUP BY p.t, q.j
), way(j, t) AS (
  SELECT j, min(t) FROM dp WHERE j = (SELECT max(j) FROM h) AND best = (SELECT min(best) FROM dp WHERE j = (SELECT max(j) FROM h)) GROUP BY j
  UNION ALL
  SELECT i, (SELECT min(d.t) FROM dp d WHERE d.j = i AND d.best = (SELECT min(e.best) FROM dp e WHERE e.j = i AND e.t <= was - 1)) FROM (
    SELECT min(p.j) AS i, w.t AS was FROM way w JOIN h q ON q.j = w.j JOIN dp c ON c.j = w.j AND c.t = w.t
    JOIN dp p ON p.t <= w.t - 1 AND p.j < w.j JOIN h k ON k.j = p.j WHERE p.best + q.l * (q.n - k.n) = c.best GROUP BY w.j, w.t)
), edges AS (
  SELECT h.l AS boundary, CAST(row_number() OVER (ORDER BY h.l) - 1 AS INTEGER) AS bucket FROM way JOIN h USING (j)
), placed AS (
  SELECT d.doc_id, d.n_tokens, e.bucket, e.boundary, greatest(1, {BATCH_TOKENS} // e.boundary) AS fit,
         row_number() OVER (PARTITION BY e.bucket ORDER BY d.doc_id) - 1 AS place, count(*) OVER (PARTITION BY e.bucket) AS in_bucket
  FROM lens d JOIN edges e ON e.bucket = (SELECT count(*) FROM edges x WHERE x.boundary < d.n_tokens)
)
SELECT doc_id, n_tokens, bucket, boundary, place // fit AS batch, place % fit AS slot, least(fit, in_bucket - (place // fit) * fit) AS n_in_batch FROM placed
"""
