"""What the operators share: the folder for cut lineage, table reading, running sums without one-task windows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import shared_dir, spread

#: The bytes that part words, and the pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def boxed(df: DataFrame, **columns: Column) -> DataFrame:
    """Each row as a struct ``row`` beside other columns, whose names then clash with none of its own; ``row.*`` gives it back."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def id_key(id_: Column) -> dict[str, Column]:
    """An id as two columns that are never null, ``_id`` and ``_no`` (whether it is null)."""
    return {"_id": F.coalesce(id_.cast("long"), F.lit(0)), "_no": id_.isNull()}


#: Paths that ``saved`` has written and ``discard`` has not removed.
_WRITTEN: list[str] = []


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(spark: SparkSession, since: int = 0) -> None:
    """Removes what ``saved`` has written since a former ``written()``: for when nothing that reads it is left to run."""
    for path in _WRITTEN[since:]:
        remove(spark, path)
    del _WRITTEN[since:]


def forget(spark: SparkSession, at: int) -> None:
    """Removes one table, the first that ``saved`` has written since a former ``written()``."""
    remove(spark, _WRITTEN.pop(at))


def written() -> int:
    return len(_WRITTEN)


def saved(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read from there: later jobs don't compute them again,
    values made by a nondeterministic plan are fixed, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    return saved(df)


#: Rows that make a key hot, at least, and hot keys at most: a key is hot if it has more than 1 / HOT_KEYS of all rows.
HOT_ROWS, HOT_KEYS = 2_000, 50_000


def dealt_join(big: DataFrame, small: DataFrame, on: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, which has one row per key and in ``count`` the rows of big with it, of ``total`` at most.

    The rows of a hot key stay where they are and get theirs by broadcast (of HOT_KEYS rows
    at most, since that many keys have all rows); the others meet by shuffle.
    """
    bar = max(HOT_ROWS, total // HOT_KEYS)
    hot = small.filter(F.col(count) > bar)
    cold = big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(small.filter(F.col(count) <= bar), on, how)
    return big.join(F.broadcast(hot), on).unionByName(cold)


def unit_hash(*cols: Column | str, seed: int = 0) -> Column:
    """A number in (0, 1) from an MD5 of the columns: the same in every engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def running_before(df: DataFrame, part: list[str], block: Column, order: list, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` (not null) over the rows of the same ``part`` that come earlier by (block, order).

    The block must not fall as the order rises.  Only sums per block are put
    in one order per part; rows are sorted within their block, so a part that
    holds most of all rows is shared out over many tasks.
    """
    df = df.withColumn("_block", block)
    w = Window.partitionBy(*part).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*part, "_block").agg(F.sum(value).alias("_sum"))
    offsets = sums.select(*part, "_block", F.coalesce(F.sum("_sum").over(w), F.lit(0)).cast("long").alias("_offset"))
    inner = Window.partitionBy(*part, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(offsets, [*part, "_block"])
    return joined.withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(inner), F.lit(0)).cast("long")).drop("_block", "_offset")
