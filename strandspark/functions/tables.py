"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or, in a local session alone, a folder of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="strandspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Bytes of a table for each core below which its rows are dealt out anew: small files often come as one task.
SMALL = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt out over all cores; larger ones, which come in many tasks, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if cores > 1 and 1 << 20 < size < cores * SMALL else df


#: Bytes of a table, as its plan estimates them, that one task sorts.
PART = 3 << 20


def parts(df: DataFrame) -> int:
    """Into how many partitions to deal a table out: as the session says, or more for large tables, so that a task's share doesn't grow with them."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # beyond that the estimate is one of a join, which may be far too large
    return max(least, min(-(-size // PART), least * 128))


class Written:
    """Tables of one job: written once, read from there, removed together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def saved(self, df: DataFrame) -> DataFrame:
        """The rows, written and read again: later jobs don't compute them anew, and a lost executor costs nothing."""
        path = f"{shared_dir(self.spark)}/{uuid.uuid4().hex}.parquet"
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def discard(self, keep: int = 0) -> None:
        """Removes all but the last ``keep`` tables."""
        gone = self.paths[: len(self.paths) - keep]
        for path in gone:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = self.paths[len(gone) :]
