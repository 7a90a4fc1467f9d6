"""What is done to hits afterwards: q-values, orders, strands, other formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import rc


def add_qvalues(hits: DataFrame, possible: int) -> DataFrame:
    """``qvalue``: p times the possible hits over the rank (by p, then score downwards), at most 1, never falling.

    Equal (p, score) pairs are counted first, so that the one order over all hits runs over distinct pairs alone.
    """
    pairs = hits.groupBy("pvalue", "score").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("pvalue", F.desc("score"))
    last = pairs.withColumn("_rank", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    raw = last.withColumn("_q", F.least(F.lit(1.0), F.col("pvalue") * F.lit(float(possible)) / F.col("_rank")))
    q = raw.withColumn("qvalue", F.min("_q").over(w.rowsBetween(0, Window.unboundedFollowing))).select(F.col("pvalue").alias("_p"), F.col("score").alias("_s"), "qvalue")
    return hits.join(q, (F.col("pvalue") == F.col("_p")) & (F.col("score") == F.col("_s"))).drop("_p", "_s")


def flip_rc(hits: DataFrame) -> DataFrame:
    return hits.withColumn("match", F.when(F.col("strand") == "-", rc(F.col("match"))).otherwise(F.col("match")))


def sort_coord(hits: DataFrame) -> DataFrame:
    return hits.orderBy("seq_name", "start", "end", "motif", "strand")


def sort_motif(hits: DataFrame) -> DataFrame:
    return hits.orderBy("motif", "seq_name", "start", "end", "strand")


def sort_pval(hits: DataFrame) -> DataFrame:
    return hits.orderBy("pvalue", F.desc("score"), "seq_name", "start", "motif", "strand")


def bed_score(p: Column) -> Column:
    return F.least(F.lit(1000), F.floor(-10 * F.log10(p))).cast("int")


def to_bed(hits: DataFrame) -> DataFrame:
    """Six columns and p-value, score, percentage and match."""
    return hits.select("seq_name", (F.col("start") - 1).alias("chrom_start"), F.col("end").alias("chrom_end"), F.col("motif").alias("name"), bed_score(F.col("pvalue")).alias("bed_score"), "strand", "pvalue", "score", "score_pct", "match")


def _tenth(score: Column) -> Column:
    return F.format_string("%.1f", F.when(score < 0, F.ceil(score * 10)).otherwise(F.floor(score * 10)) / 10.0)


def to_gff3(hits: DataFrame) -> DataFrame:
    return hits.select(F.concat_ws("\t", "seq_name", F.lit("strandspark"), F.lit("nucleotide_motif"), F.col("start").cast("string"), F.col("end").cast("string"), _tenth(F.col("score")), "strand", F.lit("."), F.concat(F.lit("Name="), "motif", F.lit(";match="), "match")).alias("value"))


def to_gtf(hits: DataFrame) -> DataFrame:
    return hits.select(F.concat_ws("\t", "seq_name", F.lit("strandspark"), F.lit("nucleotide_motif"), F.col("start").cast("string"), F.col("end").cast("string"), _tenth(F.col("score")), "strand", F.lit("."), F.concat(F.lit('motif "'), "motif", F.lit('"; match "'), "match", F.lit('";'))).alias("value"))


def standard_kmers_only(counts: DataFrame) -> DataFrame:
    return counts.filter(~F.col("kmer").contains("N"))
