"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import READ, WRITE

#: Rows handed to a Python worker at once; texts may be long, so batches are small.
ARROW_ROWS = 512

#: ASCII white space as the query contracts define it.
SPACE = r"\x20\x09-\x0D"


def arrow_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows of an Arrow batch, so that workers hold few texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where unset in local mode (tests), one of
    our own.  A cluster without it is refused: its hosts share no temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='causeway-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/causeway/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and
    survives lost executors.  The columns and their order stay the same.

    Spark removes a job's shuffle files when the driver collects its plan as
    garbage; asking for that here frees the disk before the next step."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**WRITE, compression="zstd").parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.options(**READ).schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text as it counts everywhere here: null is empty."""
    return F.coalesce(F.col(column), F.lit(""))


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space.  The pattern skips single
    spaces, which would be replaced by themselves."""
    return F.regexp_replace(text, rf"[{SPACE}]{{2,}}|[\x09-\x0D]", " ")


def keep_rows(docs: DataFrame, id_: Column, mark: Column, kept: DataFrame, single: bool) -> DataFrame:
    """The rows of ``docs`` whose id and text's mark are in ``kept(kept_id, mark)``,
    which has a row for each of them; with ``single`` one of those that share both."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = kept.groupBy("kept_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    rows = docs.select(F.struct(*columns).alias("row"), id_.alias("own_id"), mark.alias("own_mark"))
    same = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_mark") == F.col("mark"))
    out = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    if not single:
        return rows.join(kept, same, "left_semi").select(*out)
    kept = materialise(kept, "kept-rows")
    repeated = kept.filter("n > 1")
    if repeated.isEmpty():
        return rows.join(kept, same, "left_semi").select(*out)
    # Written first, so that adaptive execution can split the join and that copies are combined before the shuffle.
    several = materialise(rows.join(repeated, same, "left_semi"), "repeated-rows")
    one = several.groupBy("own_id", "own_mark").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return rows.join(kept.filter("n = 1"), same, "left_semi").select(*out).unionByName(one.select(*out))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A batch function that gives freed memory back to the system when a task
    ends: Spark keeps Python workers for the next one."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library: it keeps the memory

    return tidied
