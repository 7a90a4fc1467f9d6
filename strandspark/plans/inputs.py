"""Logical inputs derived from the given tables, in Spark and as SQL for the oracle.

The tables hold prose: a sequence is a text's letters a-z, lower-cased and
mapped onto ACGT in turn; ranges and sets come from ids and labels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import spread
from ..model import Motif

_FROM, _TO = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"

#: The motifs of the queries (our own), as probabilities of A, C, G, T.
PPMS = {
    "ebox": [[0.05, 0.85, 0.05, 0.05], [0.80, 0.05, 0.10, 0.05], [0.02, 0.90, 0.04, 0.04], [0.05, 0.05, 0.85, 0.05], [0.04, 0.06, 0.05, 0.85], [0.05, 0.05, 0.80, 0.10]],
    "gcbox": [[0.10, 0.10, 0.75, 0.05], [0.05, 0.05, 0.85, 0.05], [0.04, 0.04, 0.90, 0.02], [0.10, 0.70, 0.15, 0.05], [0.05, 0.05, 0.85, 0.05], [0.20, 0.05, 0.70, 0.05]],
    "tatab": [[0.04, 0.06, 0.05, 0.85], [0.90, 0.03, 0.03, 0.04], [0.05, 0.03, 0.02, 0.90], [0.85, 0.03, 0.05, 0.07], [0.60, 0.05, 0.05, 0.30], [0.45, 0.10, 0.20, 0.25]],
}
WIDTH = 6
PVALUE = 1e-3


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/{name}.parquet"))


def motifs() -> list[Motif]:
    return [Motif(name, np.array(ppm)) for name, ppm in PPMS.items()]


def seqs(spark: SparkSession, d: str) -> DataFrame:
    """``seq_num, name, comment, seq`` of all documents; the explode keeps Spark from working the sequence out at each use of it."""
    t = table(spark, d, "documents")
    seq = F.translate(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", ""), _FROM, _TO)
    return t.select(F.col("doc_id").alias("seq_num"), F.col("doc_id").cast("string").alias("name"), F.col("lang").alias("comment"), F.explode(F.array(seq)).alias("seq"))


#: The same with unknown, ambiguous and lower-case letters and U for the rarer ones.
_MIXED = "ACGTNcgUacNTACGTnCGTAutRaU"


def mixed(spark: SparkSession, d: str) -> DataFrame:
    """``seq_num, name, comment, seq`` of all documents, over more letters than ACGT; texts without letters are empty sequences."""
    seq = F.translate(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", ""), _FROM, _MIXED)
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq_num"), F.col("doc_id").cast("string").alias("name"), F.col("lang").alias("comment"), F.explode(F.array(seq)).alias("seq"))


def ranges(spark: SparkSession, d: str) -> DataFrame:
    """A range of each sequence of one letter or more, by its number and length."""
    n = F.length("seq").cast("long")
    i = F.col("seq_num")
    start = F.pmod(i * 7, n)
    return seqs(spark, d).filter(n > 0).select(i.alias("range_id"), F.col("name").alias("seq_name"), start.alias("start"), F.least(start + 20 + F.pmod(i, F.lit(180)), n).alias("end"), F.when(i % 2 == 0, ".").otherwise(F.concat(F.lit("r"), i.cast("string"))).alias("name"), F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(".")), (i % 3 + 1).cast("int")).alias("strand"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """``unit, seq, positive``: the sequences with a quality label."""
    q = table(spark, d, "labels").select(F.col("doc_id").alias("seq_num"), (F.col("quality") == 1).alias("positive"))
    return seqs(spark, d).join(q, "seq_num").select(F.col("name").alias("unit"), "name", "seq", "positive")


def intervals(spark: SparkSession, d: str) -> DataFrame:
    """Line items as ranges of suppliers: ``seq_name, strand, motif, start, end, score, arrival``."""
    t = table(spark, d, "lineitem")
    return t.select(F.col("l_suppkey").alias("seq_name"), F.col("l_linestatus").alias("strand"), F.col("l_returnflag").alias("motif"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"), F.col("l_extendedprice").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("arrival"))


SEQS = f"""seqs AS (SELECT doc_id AS seq_num, doc_id::VARCHAR AS name, lang AS comment,
  translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), '{_FROM}', '{_TO}') AS seq FROM documents)"""
MIXED = f"""seqs AS (SELECT doc_id AS seq_num, doc_id::VARCHAR AS name, lang AS comment,
  translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), '{_FROM}', '{_MIXED}') AS seq FROM documents)"""
#: The same as plain letters: U as T, what is no standard base N; of a masked set lower case is N too.
PLAIN = MIXED.replace("seqs AS", "mixed AS") + ", seqs AS (SELECT seq_num, name, comment, regexp_replace(replace(upper(seq), 'U', 'T'), '[^ACGT]', 'N', 'g') AS seq FROM mixed)"
MASKED = MIXED.replace("seqs AS", "mixed AS") + ", seqs AS (SELECT seq_num, name, comment, regexp_replace(replace(seq, 'U', 'T'), '[^ACGT]', 'N', 'g') AS seq FROM mixed)"
RANGES = """ranges AS (SELECT seq_num AS range_id, name AS seq_name, (seq_num * 7) % length(seq) AS start,
  least((seq_num * 7) % length(seq) + 20 + seq_num % 180, length(seq))::BIGINT AS "end",
  CASE WHEN seq_num % 2 = 0 THEN '.' ELSE 'r' || seq_num END AS name, (['+', '-', '.'])[(seq_num % 3 + 1)::INT] AS strand FROM seqs WHERE length(seq) > 0)"""
INTERVALS = """iv AS (SELECT l_suppkey AS seq_name, l_linestatus AS strand, l_returnflag AS motif, l_partkey AS start, l_partkey + l_quantity::BIGINT AS "end",
  l_extendedprice AS score, l_orderkey * 10 + l_linenumber AS arrival FROM lineitem)"""
CELLS = "ppm AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {i}, '{b}', {p}::DOUBLE)" for m, ppm in PPMS.items() for i, col in enumerate(ppm) for b, p in zip("ACGT", col, strict=True)) + """) AS v(motif, pos, base, p)),
cells AS (SELECT motif, pos, base, trunc(1000 * log2(((p * 1000 + 0.25) / 1001) / 0.25))::BIGINT AS s FROM ppm)"""
PMF = "d0 AS (SELECT DISTINCT motif, 0::BIGINT AS s, 1.0::DOUBLE AS p FROM ppm), " + ", ".join(f"d{i + 1} AS (SELECT d.motif, d.s + c.s AS s, sum(d.p * 0.25) AS p FROM d{i} d JOIN cells c ON c.motif = d.motif AND c.pos = {i} GROUP BY 1, 2)" for i in range(WIDTH)) + f", pmf AS (SELECT * FROM d{WIDTH}), surv AS (SELECT motif, s, sum(p) OVER (PARTITION BY motif ORDER BY s DESC) AS pv FROM pmf)"


def rc_sql(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


#: Distinct windows with their scores on both strands, and where they stand.
HITS = f"""win AS (SELECT seq_num, name, unnest(range(1, length(seq) - {WIDTH - 2})) AS start, seq FROM seqs WHERE length(seq) >= {WIDTH}),
w AS (SELECT name AS seq_name, start, substr(seq, start, {WIDTH}) AS match FROM win),
kinds AS (SELECT DISTINCT match FROM w WHERE NOT contains(match, 'N')),
scored AS (SELECT k.match, c.motif, sum(CASE WHEN substr(k.match, c.pos + 1, 1) = c.base THEN c.s END)::BIGINT AS plus, sum(CASE WHEN substr({rc_sql("k.match")}, c.pos + 1, 1) = c.base THEN c.s END)::BIGINT AS minus FROM kinds k, cells c GROUP BY 1, 2),
tops AS (SELECT motif, sum(m)::BIGINT AS top FROM (SELECT motif, pos, max(s) AS m FROM cells GROUP BY 1, 2) GROUP BY 1),
sides AS (SELECT match, motif, '+' AS strand, plus AS s FROM scored UNION ALL SELECT match, motif, '-', minus FROM scored),
good AS (SELECT b.match, b.motif, b.strand, b.s, v.pv, 100.0 * b.s / t.top AS pct FROM sides b JOIN surv v ON v.motif = b.motif AND v.s = b.s JOIN tops t ON t.motif = b.motif WHERE v.pv < {PVALUE}),
hits AS (SELECT w.seq_name, w.start, w.start + {WIDTH - 1} AS "end", g.strand, g.motif, g.pv AS pvalue, g.s / 1000.0 AS score, g.pct AS score_pct, w.match, g.s AS score_i FROM w JOIN good g USING (match))"""
