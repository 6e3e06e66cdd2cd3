"""An edge log as a stream (beyond the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.closure import closure


def edge_log(spark: SparkSession, path: str) -> DataFrame:
    """Edges as they arrive: Parquet files with ``graph_id, src, dst, at``."""
    return spark.readStream.schema("graph_id string, src long, dst long, at timestamp").parquet(path)


def maintain_closure(log: DataFrame, out: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Keep ``out/closure`` equal to the closure of all edges so far.

    Edges that repeat within ``late`` are dropped by the stream; each batch adds
    its edges to ``out/edges/batch=<n>`` (rewritten if the batch is retried) and writes the
    closure of all of them anew."""

    def step(batch: DataFrame, n: int) -> None:
        batch.select("graph_id", "src", "dst").write.mode("overwrite").parquet(f"{out}/edges/batch={n}")
        edges = batch.sparkSession.read.parquet(f"{out}/edges").filter(F.col("batch") <= n)
        closure(edges, ["graph_id"]).write.mode("overwrite").parquet(f"{out}/closure")

    unique = log.withWatermark("at", late).dropDuplicatesWithinWatermark(["graph_id", "src", "dst"])
    return unique.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
