"""Tables in the shared folder."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from causeway import runtime
from causeway.llm import common


def folder(df):
    return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))


@pytest.mark.parametrize("write", [runtime.cut, lambda df: common.materialise(df, "table")])
def test_no_checksum_files(spark, write):
    """Each would cost a process that shares the executor's memory while it starts."""
    df = write(spark.range(0, 1000, 1, 5).withColumn("text", F.expr("repeat(string(id), 9)")))
    names = os.listdir(folder(df))
    assert len([n for n in names if n.startswith("part-")]) == 5 and not [n for n in names if n.endswith(".crc")]
    assert df.count() == 1000 and df.columns == ["id", "text"]


@pytest.mark.parametrize("write", [runtime.cut, lambda df: common.materialise(df, "table")])
def test_damage_is_noticed(spark, write):
    df = write(spark.range(0, 50_000, 1, 1).select(F.sha2(F.col("id").cast("string"), 256).alias("text")))
    [name] = [n for n in os.listdir(folder(df)) if n.startswith("part-")]
    with open(f"{folder(df)}/{name}", "r+b") as f:
        f.seek(os.path.getsize(f.name) // 2)
        byte = f.read(1)
        f.seek(-1, 1)
        f.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="(?i)checksum"):
        df.agg(F.sum(F.length("text"))).collect()


def test_pipeline_result_has_no_checksum_files(spark):
    assert not [n for n in os.listdir(folder(P.run(spark, "/root/testdata/sf0.001"))) if n.endswith(".crc")]
