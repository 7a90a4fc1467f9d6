"""Comparison of query motifs with a database: ungapped alignments, null distributions, p- and q-values."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import bh
from ..model import Motif, background, consensus, reverse_complement

BINS = 50


def columns_frame(spark: SparkSession, motifs: list[Motif], *, both: bool = False) -> DataFrame:
    """``motif_i, name, width, orientation, pos, a, c, g, t`` in long form; both: reverse complements as well."""
    rows = [(i, m.name, m.width, o, j, *map(float, p)) for i, m in enumerate(motifs) for o, ppm in (("+", m.ppm), ("-", reverse_complement(m.ppm)))[: 2 if both else 1] for j, p in enumerate(ppm)]
    return spark.createDataFrame(rows, "motif_i int, name string, width int, orientation string, pos int, a double, c double, g double, t double")


def similarity(q: list[Column], t: list[Column]) -> Column:
    """Correlation of two columns about 0.25; 0 where either hardly varies."""
    dq, dt = [x - 0.25 for x in q], [x - 0.25 for x in t]
    total = lambda xs: xs[0] + xs[1] + xs[2] + xs[3]
    vq, vt = total([x * x for x in dq]), total([x * x for x in dt])
    return F.when((vq < 1e-12) | (vt < 1e-12), 0.0).otherwise(total([x * y for x, y in zip(dq, dt, strict=True)]) / F.sqrt(vq * vt))


METRICS = {"pcc": similarity}


def alignments(queries: DataFrame, targets: DataFrame, *, min_overlap: int = 5, metric: str = "pcc") -> DataFrame:
    """``query_i, target_i, orientation, offset, score, overlap`` for every admissible offset (target column = query column - offset)."""
    f = METRICS[metric]
    q, t = queries.alias("q"), targets.filter("orientation = '+'").alias("t")
    need = F.least(F.lit(min_overlap), F.col("q.width"), F.col("t.width"))
    d = F.col("q.pos") - F.col("t.pos")
    pair = q.join(t, (d >= need - F.col("t.width")) & (d <= F.col("q.width") - need))
    s = f([F.col(f"q.{x}") for x in "acgt"], [F.col(f"t.{x}") for x in "acgt"])
    return pair.groupBy(F.col("q.motif_i").alias("query_i"), F.col("t.motif_i").alias("target_i"), F.col("q.orientation").alias("orientation"), d.alias("offset")).agg(F.sum(s).alias("score"), F.count(F.lit(1)).cast("int").alias("overlap"))


def best_alignments(al: DataFrame) -> DataFrame:
    """Per pair the alignment of the largest sum (first orientation, then offset, of equals) and ``n_tested``."""
    w = Window.partitionBy("query_i", "target_i")
    r = F.row_number().over(w.orderBy(F.desc(F.round("score", 9)), F.when(F.col("orientation") == "+", 0).otherwise(1), "offset"))
    return al.withColumns({"n_tested": F.count(F.lit(1)).over(w), "_r": r}).filter("_r = 1").drop("_r")


def null_histogram(queries: DataFrame, targets: DataFrame, metric: str = "pcc") -> DataFrame:
    """``query_i, orientation, pos, bin, n``: similarities of each query column to all target columns, in 51 bins."""
    t = targets.filter("orientation = '+'")
    kinds = t.groupBy("a", "c", "g", "t").agg(F.count(F.lit(1)).alias("k")).alias("t")  # equal columns once
    s = METRICS[metric]([F.col(f"q.{x}") for x in "acgt"], [F.col(f"t.{x}") for x in "acgt"])
    b = F.floor((s + 1) / 2 * BINS + 0.5).cast("int")
    return queries.alias("q").crossJoin(kinds).groupBy(F.col("q.motif_i").alias("query_i"), F.col("q.orientation").alias("orientation"), F.col("q.pos").alias("pos"), b.alias("bin")).agg(F.sum("k").alias("n"))


def enumerated_columns(bkg) -> tuple[np.ndarray, np.ndarray]:
    """The 56 columns over a grid of fifths and their Dirichlet-multinomial weights."""
    alpha = np.maximum(4 * np.asarray(background(bkg)), 0.1)
    cols = [(a, c, g, 5 - a - c - g) for a in range(6) for c in range(6 - a) for g in range(6 - a - c)]
    lg = math.lgamma
    w = [math.exp(sum(lg(n + x) - lg(x) - lg(n + 1) for n, x in zip(col, alpha, strict=True))) for col in cols]
    return np.array(cols) / 5.0, np.array(w) / sum(w)


def _similar(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    dq, dt = q - 0.25, t - 0.25
    vq, vt = (dq * dq).sum(), (dt * dt).sum(axis=1)
    flat = (vq < 1e-12) | (vt < 1e-12)
    return np.where(flat, 0.0, dt @ dq / np.sqrt(np.where(flat, 1.0, vq * vt)))


def compare(spark: SparkSession, queries: list[Motif], targets: list[Motif], *, min_overlap: int = 5, q: float = 0.1, forward: bool = False, enumerate_null: bool = False, bkg=(0.25,) * 4) -> DataFrame:
    """``query_id, target_id, offset, p_value, q_value, score, overlap, query_consensus, target_consensus, orientation``."""
    qf, tf = columns_frame(spark, queries, both=not forward), columns_frame(spark, targets)
    best = best_alignments(alignments(qf, tf, min_overlap=min_overlap))
    cols, weight = enumerated_columns(bkg) if enumerate_null else (np.concatenate([m.ppm for m in targets]), None)
    weight = np.full(len(cols), 1 / len(cols)) if weight is None else weight
    pmf = {(i, o): [np.bincount(np.floor((_similar(c, cols) + 1) / 2 * BINS + 0.5).astype(int), weight, BINS + 1) for c in ppm] for i, m in enumerate(queries) for o, ppm in (("+", m.ppm), ("-", reverse_complement(m.ppm)))}
    names = {i: (m.name, consensus(m.ppm), consensus(reverse_complement(m.ppm))) for i, m in enumerate(queries)}
    tnames = {i: (m.name, consensus(m.ppm)) for i, m in enumerate(targets)}
    shared = spark.sparkContext.broadcast((pmf, names, tnames))  # as large as the motifs

    def kernel(frames):
        import pandas as pd

        nulls, names_, tnames_ = shared.value
        cache: dict = {}
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                start = max(0, r.offset)
                key = (r.query_i, r.orientation, start, r.overlap)
                if key not in cache:
                    total = np.ones(1)
                    for c in nulls[key[:2]][start : start + r.overlap]:
                        total = np.convolve(total, c)
                    cache[key] = np.cumsum(total[::-1])[::-1]
                at = int(math.floor((r.score / r.overlap + 1) / 2 * BINS * r.overlap + 0.5))
                tail = cache[key]
                p = min(1.0, max(0.0, float(tail[min(max(at, 0), len(tail) - 1)]) * r.n_tested))
                qn, tn = names_[r.query_i], tnames_[r.target_i]
                text = qn[1] if r.orientation == "+" else qn[2]
                out.append((r.query_i, r.target_i, qn[0], tn[0], r.offset, p, r.score, r.overlap, text[start : start + r.overlap], tn[1][start - r.offset : start - r.offset + r.overlap], r.orientation))
            yield pd.DataFrame(out, columns=["query_i", "target_i", "query_id", "target_id", "offset", "p_value", "score", "overlap", "query_consensus", "target_consensus", "orientation"])

    rows = best.mapInPandas(kernel, "query_i int, target_i int, query_id string, target_id string, offset int, p_value double, score double, overlap int, query_consensus string, target_consensus string, orientation string")
    return bh(rows, "p_value", "q_value", ["query_i"], ["target_i"]).filter(F.col("q_value") <= q).orderBy("query_i", "q_value", "p_value", "target_i").drop("query_i", "target_i")
