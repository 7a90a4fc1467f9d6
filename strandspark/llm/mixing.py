"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key ``-ln(u) / weight``, u being fixed by
its id, so heavier documents tend to come earlier.  Within a source the
documents stand in the order of their keys; a source's token budget first pays
for complete epochs over all its documents, then for the first documents of
that order until the rest of the budget is spent.  The document at which it
ends is taken in part, so each source meets its budget to the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, boxed, id_key, running_before, saved, table, unit_hash

#: ASCII signs that count against a document's quality.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
#: Documents in a block of the running sums, about.
BLOCK = 4000


def quality(text: Column) -> Column:
    """A weight in [0.1, 1]: the share of characters that are no ASCII signs; 0.1 for empty texts."""
    n = F.length(text)
    return F.when(n > 0, F.greatest(F.lit(0.1), F.length(F.translate(text, SIGNS, "")) / n)).otherwise(F.lit(0.1))


def targets(sources: DataFrame, shares: tuple[int, ...], cap: int) -> DataFrame:
    """(key, source_size) and a share each -> target: shares of the total size, none above cap times the source's size.

    Sources in order of cap * size / share fill first: the level at which the
    uncapped ones stand is that of the first source not above its cap.
    """
    everything = Window.orderBy("_null", "source")
    ranked = sources.withColumn("_rank", F.row_number().over(everything)).withColumn("_w", F.element_at(F.array(*[F.lit(int(x)) for x in shares]), ((F.col("_rank") - 1) % len(shares) + 1).cast("int")))
    by_ratio = Window.orderBy((F.col("source_size") / F.col("_w")), "_rank")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = (
        ranked.withColumn("_total", F.sum("source_size").over(whole))
        .withColumn("_left", F.col("_total") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("_shares", F.sum("_w").over(after))
        .withColumn("_free", F.col("_left") * F.col("_w") <= cap * F.col("source_size") * F.col("_shares"))
        .withColumn("_level", F.min(F.when(F.col("_free"), F.struct(F.col("_rank").cast("double") * 0 + F.col("source_size") / F.col("_w"), F.col("_rank"), (F.col("_left") / F.col("_shares")).alias("level")))).over(whole)["level"])
    )
    return t.withColumn("target", F.least(F.col("_level") * F.col("_w"), (F.col("source_size") * cap).cast("double")))


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weight: Column | None = None, shares: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken`` (and the columns of ``keep``).

    size: words of the text (null: 0).  Sources are ordered by code point,
    null last, and given the shares in turn.  taken: words that the mix takes
    of the document, repeats counted; at most ``cap`` times its size.

    Null or empty texts have size 0 and are never taken; null ids draw the key
    of an empty id; repeated rows are documents of their own, ties in the order
    of (key, id, size); very long texts are counted whole; an empty table gives
    no rows; other columns, whatever their names, are ignored unless named in ``keep``.
    """
    text = F.col(text_col)
    slim = saved(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *[F.col(c).alias(f"_keep_{c}") for c in keep or []],
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            (-F.log(unit_hash(F.col(id_col), seed=seed)) / (quality(text) if weight is None else weight)).alias("_key"),
        ).withColumn("_null", F.col("source").isNull().cast("int")).withColumn("_source", F.coalesce("source", F.lit("")))
    )
    sources = slim.groupBy("_null", "_source").agg(F.first("source").alias("source"), F.sum("size").cast("long").alias("source_size"), F.count("*").alias("_n"))
    t = targets(sources, shares, cap).withColumn("_budget", F.round("target").cast("long"))
    t = t.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("_budget") / F.col("source_size"))).otherwise(0).cast("long"))
    t = t.select("_null", "_source", "source_size", "target", "_epochs", (F.col("_budget") - F.col("_epochs") * F.col("source_size")).alias("_rest"), "_n")
    # of known size from here on: joined without dealing documents out by source, unless there are very many sources
    rows = slim.drop("source").join(saved(t), ["_null", "_source"])
    block = F.floor((1 - F.exp(-F.col("_key"))) * F.ceil(F.col("_n") / BLOCK))
    placed = running_before(rows, ["_null", "_source"], block, ["_key", "doc_id", "size"], "size", "_before")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("_rest") - F.col("_before")))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("_epochs") * F.col("size") + part).alias("taken"), *[F.col(f"_keep_{c}").alias(c) for c in keep or []])


def mixed(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself, all columns kept: each document's row once for each whole copy taken, the last one if half of it or more is taken."""
    key = ["_id", "_no", "_key"]  # plain equality, so that join and window are dealt out alike
    keyed = boxed(docs, doc=F.col(id_col), **id_key(F.col(id_col)), _key=F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), text=F.col(text_col), source=F.col(source_col))
    got = mix(keyed, id_col="doc", text_col="text", source_col="source", keep=key, **options).filter("size > 0")
    copies = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    total = got.groupBy(*key).agg(F.sum(copies).alias("_copies")).filter("_copies > 0")
    # rows of one id and text are the same document again: the first gives all of their copies
    one = keyed.select("row", *key).join(total, key).withColumn("_row", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))).filter("_row = 1")
    return one.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("row.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents, shares 5, 2, 1 by source, at most three epochs."""
    return mix(table(spark, sf_dir, "documents"))


_SIGNS_SQL = SIGNS.replace("'", "''")
OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
      / CASE WHEN length(text) > 0 THEN greatest(0.1, length(translate(text, '{_SIGNS_SQL}', ''))::DOUBLE / length(text)) ELSE 0.1 END AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM r),
f AS (SELECT *, (sum(source_size) OVER ()) - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
  sum(w) OVER (ORDER BY source_size::DOUBLE / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sh FROM w),
l AS (SELECT lft::DOUBLE / sh::DOUBLE AS level FROM f WHERE lft * w <= 3 * source_size * sh ORDER BY source_size::DOUBLE / w, rk LIMIT 1),
t AS (SELECT source, source_size, least((SELECT level FROM l) * w, 3.0::DOUBLE * source_size) AS target FROM f),
e AS (SELECT *, round(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT d.doc_id, d.size, e.source_size, e.target, epochs, budget - epochs * e.source_size AS rest,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM p
"""
