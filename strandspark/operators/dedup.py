"""Overlapping hits: chains by window functions, greedy picks inside chains by an Arrow kernel."""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import parts

#: Positions of a key that one task looks at.
BLOCK = 1 << 20


def priority(pvalue: Column | None = None, score: Column | None = None, *, by_size: bool = False, none: bool = False, negate: bool = False, start: Column | None = None, end: Column | None = None) -> Column:
    """-ln(p) of hits or the score of ranges; their sizes; 0 for all; negated on demand.  A p of 0 is an error."""
    if none:
        out = F.lit(0.0)
    elif by_size:
        out = (end - start).cast("double")
    elif pvalue is not None:
        out = F.when(pvalue > 0, -F.log(pvalue)).otherwise(F.raise_error(F.lit("a p-value is above 0")))
    else:
        out = score.cast("double")
    return -out if negate else out


def islands(df: DataFrame, keys: list[str], *, block: int = BLOCK) -> DataFrame:
    """Adds ``island``: rows of a key whose closed ranges overlap in a chain share it.  Order: start, arrival.

    A key's rows are shared out by blocks of starts; what a block needs of the
    earlier ones, their largest end and their number of islands, is summed up per
    block first, so that a key that holds most of all rows isn't left to one task.
    It stands in a row of its own before the block's, so that each of both passes
    is one exchange and one sort, in tasks whose number grows with the table.
    """
    spot, n = [*keys, "_block"], parts(df)
    rows = df.withColumns({"_block": F.coalesce(F.floor(F.col("start") / block), F.lit(-1)), "_mark": F.lit(1), "_new": F.lit(0).cast("long")})
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy(*spot).orderBy("_mark", "start", "arrival")

    def marked(x: DataFrame, marks: DataFrame) -> DataFrame:
        """The rows after their block's mark (``end``: the largest end before, ``_new``: the islands before), with ``_new``: whether a row starts one."""
        first = marks.withColumn("_mark", F.lit(0)).select(*[c if c in (*spot, "end", "_mark", "_new") else F.lit(None).cast(x.schema[c].dataType).alias(c) for c in x.columns])
        both = x.unionByName(first)
        both = both.repartition(n, *spot) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else both
        top = F.max("end").over(inner.rowsBetween(Window.unboundedPreceding, -1))
        return both.withColumn("_new", F.when(F.col("_mark") == 0, F.col("_new")).when(top.isNull() | (F.col("start") > top), 1).otherwise(0))

    tops = rows.groupBy(*spot).agg(F.max("end").alias("_top")).select(*spot, F.max("_top").over(earlier).alias("end"), F.lit(0).cast("long").alias("_new"))
    found = marked(rows.select(*spot, "start", "end", "arrival", "_mark", "_new"), tops).groupBy(*spot).agg(F.sum("_new").alias("_m"), F.max(F.when(F.col("_mark") == 0, F.col("end"))).alias("end"))
    found = found.select(*spot, "end", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).cast("long").alias("_new"))
    island = F.sum("_new").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    return marked(rows, found).withColumn("island", island.cast("long")).filter("_mark = 1").drop("_block", "_mark", "_new")


#: Kept ranges that stand in one list; longer ones are cut in two, so that a long chain costs no more a range than a short one.
_RUN = 1000


def greedy(ranges: Iterable[tuple[int, int]]) -> Iterator[int]:
    """The places of the closed ranges that overlap none kept before them."""
    firsts, runs = [], []  # kept ranges don't overlap, so starts and ends have one order
    for i, (s, e) in enumerate(ranges):
        c = max(0, bisect.bisect_right(firsts, s) - 1)
        if not runs:
            firsts, runs = [s], [([s], [e])]
            yield i
            continue
        starts, ends = runs[c]
        at = bisect.bisect_left(starts, s)
        after = starts[at] if at < len(starts) else runs[c + 1][0][0] if c + 1 < len(runs) else None
        if (at == 0 or ends[at - 1] < s) and (after is None or after > e):
            starts.insert(at, s)
            ends.insert(at, e)
            firsts[c] = starts[0]
            if len(starts) > _RUN:
                half = len(starts) // 2
                runs[c : c + 1] = [(starts[:half], ends[:half]), (starts[half:], ends[half:])]
                firsts[c : c + 1] = [starts[0], starts[half]]
            yield i


def _greedy_kernel(keys: list[str]):
    """All rows of one or more chains -> those kept: by priority, then arrival, unless they overlap a kept one."""

    def kernel(t: pa.Table) -> pa.Table:
        codes = [t.column(k).combine_chunks().dictionary_encode(null_encoding="encode") for k in keys]
        codes = [(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).indices.to_numpy(zero_copy_only=False) for c in codes]
        codes.append(t.column("island").to_numpy())
        by = np.lexsort((t.column("arrival").to_numpy(), -t.column("_priority").to_numpy().astype(np.float64), *codes))
        new = np.ones(len(by), bool)
        new[1:] = np.any([c[by[1:]] != c[by[:-1]] for c in codes], axis=0)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(by)))
        # of two that make a chain only the first stays
        keep, long = [first[size <= 2]], size > 2
        start, end = t.column("start").to_numpy()[by], t.column("end").to_numpy()[by]
        for lo, n in zip(first[long].tolist(), size[long].tolist(), strict=True):
            keep.append(lo + np.fromiter(greedy(zip(start[lo : lo + n].tolist(), end[lo : lo + n].tolist(), strict=True)), np.int64))
        return t.take(pa.array(by[np.concatenate(keep)]))

    return kernel


def dedup(df: DataFrame, how: Column, *, keys: list[str] = ("strand", "motif", "seq_name")) -> DataFrame:
    """The rows kept (``start``, ``end`` closed, ``arrival`` the order of coming): chains are dealt out by hash, some thousands to a task."""
    keys = list(keys)
    rows, n = islands(df.withColumn("_priority", how), keys), parts(df)
    marked = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys, "island"), F.lit(n * 4)))
    marked = marked.repartition(n, "_bucket") if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else marked
    return marked.groupBy("_bucket").applyInArrow(_greedy_kernel(keys), marked.schema).select(*df.columns)


def by_closing(df: DataFrame, keys: list[str] = ("strand", "motif", "seq_name")) -> DataFrame:
    """The order in which a reader of sorted ranges settles chains: as a later start of its key closes each, open ones at the end by the key's first row; column ``rank`` from 0.

    A chain is closed by the arrival of its key's next chain; the key's last one
    stays open to the end.  Within a chain rows come by arrival.  One order
    over all rows, which is what a text file of them has.
    """
    keys = list(keys)
    rows = islands(df, keys)
    key = Window.partitionBy(*keys)
    chains = rows.groupBy(*keys, "island").agg(F.min("arrival").alias("_first")).withColumns({"_closed": F.lead("_first").over(key.orderBy("island")), "_key": F.min("_first").over(key)})
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "island"]]
    on = same[0]
    for s in same[1:]:
        on = on & s
    placed = rows.alias("r").join(chains.alias("c"), on).select("r.*", F.col("c._closed"), F.col("c._key"))
    order = Window.orderBy(F.col("_closed").isNull(), "_closed", "_key", "arrival")
    return placed.withColumn("rank", F.row_number().over(order) - 1).drop("_closed", "_key", "island")
