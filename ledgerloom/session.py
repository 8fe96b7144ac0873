"""Session defaults for tests and the benchmark; a cluster brings its own."""

from __future__ import annotations

import contextlib
import functools
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", app: str = "ledgerloom") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="ledgerloom-")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the folder the cluster shares for checkpoints.

    ``spark.checkpoint.dir`` names that folder. Only a local-mode session may fall
    back to a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root()
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex[:12]}")


#: Lets Spark delete a write's shuffle files when the write has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is written inside leaves no shuffle files: its result is on disk and read from there."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stage_table(df: DataFrame, purpose: str, compression: str = "zstd") -> DataFrame:
    """Write an intermediate result once to the shared folder and read it back.

    Jobs that use a result several times then read only the columns and roles they
    need, and losing an executor costs a re-read instead of a recomputation.
    """
    return _staged(df, shared_dir(df.sparkSession, purpose), compression)


def _staged(df: DataFrame, path: str, compression: str) -> DataFrame:
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Staged tables of one job that are deleted when nothing reads them any more.

    ``stage`` takes the place of ``stage_table``. What is not discarded before goes when the block ends,
    so the block's results must be on disk elsewhere by then; outside a ``with`` block only ``discard`` deletes.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[tuple[str, str]] = []

    def stage(self, df: DataFrame, purpose: str, compression: str = "zstd") -> DataFrame:
        path = shared_dir(self.spark, purpose)
        self.paths.append((purpose, path))
        return _staged(df, path, compression)

    def discard(self, *purposes: str) -> None:
        for _, path in (p for p in self.paths if p[0] in purposes):
            delete_folder(self.spark, path)
        self.paths = [p for p in self.paths if p[0] not in purposes]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.discard(*[purpose for purpose, _ in self.paths])


#: Rows that one pass may shuffle whole; more rows are dealt to several passes, one after another.
PASS_ROWS = 1 << 26


def passes_for(rows: int, most: int = PASS_ROWS) -> int:
    return max(1, -(-rows // most))


def in_pass(key: str, number: int, passes: int) -> Column:
    return F.pmod(F.hash(key), F.lit(passes)) == number


def staged_in_passes(
    df: DataFrame, purpose: str, key: str, passes: int, stage: Callable[[DataFrame, str], DataFrame] = stage_table
) -> DataFrame:
    """``stage`` by ranges of the key's hash, so the shuffle files of one pass are gone before the next begins.

    All rows are written, each once. The key should be one that filters reach the inputs by.
    """
    if passes == 1:
        return stage(df, purpose)
    written = [stage(df.filter(in_pass(key, i, passes)), purpose) for i in range(passes)]
    return functools.reduce(DataFrame.unionByName, written)


def growing(df: DataFrame) -> DataFrame:
    """A join side that grows with the input: it is never gathered on the driver.

    Spark judges a side by the size of its files. Few columns of a well compressed table look
    small enough to be broadcast while holding millions of rows, which the driver then has to hold.
    """
    return df.hint("merge")


#: Parts every split of a large input is dealt to.
PARTS_PER_SPLIT = 32


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows evenly before costly text work.

    Splits are cut by bytes, but all rows of a row group go to one of them: a file that is one
    row group gives many splits and a single task with rows. So the number of splits tells the
    input's size, not where its rows are. A split is at most 128 MB of file, a part a small
    share of that; an input of one split is dealt to all cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores if splits <= 1 else max(cores, splits * PARTS_PER_SPLIT))
