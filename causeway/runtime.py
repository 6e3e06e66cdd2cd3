"""What every operator needs from the session: durable cuts of lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where unset in local mode (tests), one of
    our own.  A cluster without it is refused: its hosts share no temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    where = where or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='causeway-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


#: Options of a write to the shared folder.  Hadoop's local file system, where its native
#: library is missing, runs ``chmod`` for each folder, file and checksum file.  Until such a
#: process has loaded its programme it shares all memory of the executor that began it, so
#: whoever adds up processes counts the executor twice.  The raw file system needs no
#: checksum files; reads check Parquet's own.  Other stores don't heed these options.
WRITE = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
READ = {"parquet.page.verify-checksum.enabled": "true"}


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: loops don't pile up plans, and a
    lost executor costs no more than the step at hand."""
    path = f"{shared_dir(df.sparkSession)}/causeway/step-{uuid.uuid4().hex}"
    df.write.options(**WRITE).parquet(path)
    return df.sparkSession.read.options(**READ).schema(df.schema).parquet(path)


#: Bytes of input files behind one partition of :func:`spread`.
PART_BYTES = 4 << 20


def partitions(*tables: DataFrame) -> int:
    """How many partitions the rows of ``tables`` are dealt out to, by the size of the
    files that they are read from; 0 where Spark's own number will do, and for tables
    that are not read from files."""
    size = 0
    for df in tables:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
        size += sum(x for x in sizes if x < 1 << 60)  # Spark's word for unknown is the greatest long
    n = -(-size // PART_BYTES)
    return n if n > int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")) else 0


def spread(df: DataFrame, *keys: str, beside: tuple[DataFrame, ...] = ()) -> DataFrame:
    """``df`` dealt out by ``keys``: with more input come more partitions, not larger
    ones.  Spark deals out to a fixed number, so that each task's memory would grow.
    ``beside``: further tables whose rows will come to the same partitions."""
    n = partitions(df, *beside)
    return df.repartition(n, *keys) if n else df


def spread_to_join(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` to be joined with ``other``, which Spark then deals
    out alike; unchanged where ``other`` is small enough for Spark to broadcast it."""
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    if int(other._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= conf.autoBroadcastJoinThreshold():
        return df
    return spread(df, *keys, beside=(other,))
