"""Dealing rows before costly text work; what staged tables leave on disk."""

import os
import time

from pyspark.sql import functions as F

from ledgerloom.operators.resolve import packed, unpacked
from ledgerloom.session import spread, stage_table


def test_rows_of_one_row_group_are_dealt_though_there_are_many_splits(spark, tmp_path):
    path = str(tmp_path / "one")
    rows = spark.range(4000).withColumn("text", F.sha2(F.col("id").cast("string"), 256))
    rows.coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
        table = spark.read.parquet(path)
        assert table.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        dealt = spread(table)
        most = dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert most <= 4000 / spark.sparkContext.defaultParallelism
        assert dealt.exceptAll(table).isEmpty() and dealt.count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_staged_table_leaves_no_shuffle_files(spark):
    block_manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    roots = [d.getPath() for d in block_manager.localDirs()]

    def shuffles():
        return {f for r in roots for _, _, files in os.walk(r) for f in files if f.startswith("shuffle_")}

    before = shuffles()
    staged = stage_table(spark.range(10000).groupBy((F.col("id") % 100).alias("k")).count(), "cleaned")
    deadline = time.time() + 20
    while shuffles() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffles() - before
    assert staged.count() == 100


def test_packed_identities_come_back_as_they_were(spark):
    digest = "v1:" + "0a" * 32
    texts = [digest, digest + "+sms:1", digest + "\n", digest.upper(), "v0:12", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("p", packed(F.col("t")))
    found = rows.select("t", unpacked(F.col("p")).alias("back"), F.length("p").alias("n")).collect()
    assert all(r["t"] == r["back"] for r in found)
    assert found[0]["n"] == 33 and len({bytes(r["p"]) for r in rows.dropna().collect()}) == 6
