"""Motif enrichment of positive over negative units: sequences, sites or rank sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import bh, fisher_udf, mann_whitney
from ..model import Motif, consensus
from .scan import unit_kernel
from .shuffle import shuffle


def units(seqs: DataFrame, motifs: list[Motif], *, masked: bool = False, forward: bool = False) -> DataFrame:
    """``unit, motif_id, n_hits, max_score, positions`` for every unit (column ``unit``, ``seq``, optional ``strand``) and motif."""
    strand = F.col("strand") if "strand" in seqs.columns else F.lit(".")
    rows = seqs.select("unit", "seq", (strand != "-").alias("plus"), ((strand != "+") & F.lit(not forward)).alias("minus"))
    return rows.mapInArrow(unit_kernel(motifs, masked, forward), "unit string, motif_id int, n_hits long, max_score long, positions long")


def with_null(units_: DataFrame, *, k: int = 2, seed: int = 1) -> DataFrame:
    """Positive units (``unit, seq``, optional ``strand``; parts of sequences where ranges are in use) and as many negatives, column ``positive``.

    A negative is a shuffle of its unit that keeps k-mers, both strands of it count; units shorter than k are copied.
    """
    null = shuffle(units_.select(F.col("unit").alias("name"), "seq"), k, seed=seed, keep_short=True).withColumnRenamed("name", "unit")
    columns = ["unit", "seq"] + [c for c in ("strand",) if c in units_.columns]
    null = null.withColumn("strand", F.lit(".")) if "strand" in columns else null
    return units_.select(*columns).withColumn("positive", F.lit(True)).unionByName(null.select(*columns).withColumn("positive", F.lit(False)))


def counts(seqs: DataFrame, motifs: list[Motif], **options) -> DataFrame:
    """Per motif: units, units with a hit, hits and scored positions of each set (column ``positive``)."""
    spark = seqs.sparkSession
    got = units(seqs.withColumn("unit", F.concat(F.when(F.col("positive"), "+").otherwise("-"), "unit")), motifs, **options)
    pos = F.startswith("unit", F.lit("+"))
    side = lambda c, p: F.sum(F.when(p, c).otherwise(0)).cast("long")
    per = got.groupBy("motif_id").agg(
        side(F.lit(1), pos).alias("pos_n"), side((F.col("n_hits") > 0).cast("long"), pos).alias("pos_seq_hits"), side(F.col("n_hits"), pos).alias("pos_site_hits"),
        side(F.lit(1), ~pos).alias("neg_n"), side((F.col("n_hits") > 0).cast("long"), ~pos).alias("neg_seq_hits"), side(F.col("n_hits"), ~pos).alias("neg_site_hits"),
        side(F.col("positions"), pos).alias("pos_positions"), side(F.col("positions"), ~pos).alias("neg_positions"),
    )
    names = spark.createDataFrame([(i, m.name, consensus(m.ppm)) for i, m in enumerate(motifs)], "motif_id int, motif string, consensus string")
    return names.join(per, "motif_id").select("motif", "motif_id", "consensus", *[c for c in per.columns if c != "motif_id"])


def enrich(seqs: DataFrame, motifs: list[Motif], *, test: str = "seqs", q: float = 0.1, shuffle_k: int = 2, seed: int = 1, **options) -> DataFrame:
    """Enrichment rows, sorted by q-value, p-value and motif, those of a q-value up to q.

    seqs: units with ``positive``; without that column all are positives and
    the negatives are shuffles of them (see ``with_null``).  test: ``seqs`` (units with hits), ``sites`` (hits over positions) or
    ``ranksum`` (largest scores; units too short rank lowest).
    """
    if "positive" not in seqs.columns:
        seqs = with_null(seqs, k=shuffle_k, seed=seed)
    c = counts(seqs, motifs, **options)
    if test == "ranksum":
        got = units(seqs.withColumn("unit", F.concat(F.when(F.col("positive"), "+").otherwise("-"), "unit")), motifs, **options)
        low = F.lit(-(1 << 31)).cast("long")
        t = mann_whitney(got.withColumn("max_score", F.coalesce("max_score", low)), "motif_id", "max_score", F.startswith("unit", F.lit("+")))
        rows = c.join(t.select("motif_id", "auc", "z", "pvalue"), "motif_id").withColumns({"effect": F.col("auc"), "log2_effect": F.log2(F.col("auc") / F.greatest(1 - F.col("auc"), F.lit(1e-9)))})
    else:
        a, b, n, m = ("pos_seq_hits", "neg_seq_hits", "pos_n", "neg_n") if test == "seqs" else ("pos_site_hits", "neg_site_hits", "pos_positions", "neg_positions")
        A, B, N, M = (F.col(x) for x in (a, b, n, m))
        rate = F.when(B == 0, F.lit(0.5) / M).otherwise(B / M)
        effect = F.when(N == 0, 0.0).otherwise((A / N) / rate)
        rows = c.withColumn("pvalue", fisher_udf(A, B, N - A, M - B)).withColumn("effect", effect).withColumn("log2_effect", F.when(F.col("effect") > 0, F.log2("effect")).otherwise(F.lit(float("-inf"))))
    return bh(rows, ties=["motif_id"]).filter(F.col("qvalue") <= q).orderBy("qvalue", "pvalue", "motif_id")
