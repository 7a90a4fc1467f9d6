"""Benchmark decontamination: size-partitioned MinHash containment search.

A benchmark item of n distinct word shingles is contained in a document if the
document holds at least ``ceil(threshold * n)`` of them, so at most
``n - ceil(threshold * n)`` are missing.  The item's sketch is its bottom
MinHash values, one more than may be missing: a containing document, however
long, must hold one of them, so the search loses nothing.  Sketch lengths
depend on the item's size alone, so items are partitioned by size: each size
has one length.  Shingles that very many items share come last in the order of
the values, so that sketches seldom hold them.

Documents meet the sketches by hash join, and only the pairs that meet there
are candidates.  A candidate is verified on the words themselves: the documents
of candidates are read again, and the item's shingles are looked up among theirs
as texts.  Native: joins, arrays and aggregates only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, saved, table

SHINGLE = 5
THRESHOLD = 0.8
#: Items that may share a shingle before it comes last in their sketches.
CROWD = 64


def word_array(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null or blank texts."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\u000b\f\r", "abcdefghijklmnopqrstuvwxyz     ")
    return F.filter(F.split(low, " +"), lambda w: w != "")


def _shingles(words: Column, k: int, one, whole) -> Column:
    """``one(i)`` for each place of k words, or ``whole`` if there are fewer than k but any."""
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), one)).when(n > 0, F.array(whole)).otherwise(F.array())


def shingle_hashes(words: Column, k: int) -> Column:
    """Hashes of the k-word shingles of an array of words (of all words, if fewer than k)."""
    return _shingles(words, k, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]), F.xxhash64(F.concat_ws(" ", words), F.lit(-1)))


def shingle_texts(words: Column, k: int) -> Column:
    """The shingles themselves, their words parted by a space; no two different ones have equal texts."""
    return _shingles(words, k, lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)]), F.concat_ws(" ", words))


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """(item_id, _item, h, s) distinct -> adds ``n`` (size), ``need`` and ``sketch`` (is among the bottom values)."""
    item = Window.partitionBy("item_id", "_item")
    crowded = items.groupBy("s").agg((F.count("*") > CROWD).alias("_crowded"))
    need = F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9))
    rank = F.row_number().over(item.orderBy("_crowded", "h", "s"))
    return items.join(crowded, "s").withColumn("n", F.count("*").over(item)).withColumn("need", need).withColumn("sketch", rank <= F.col("n") - F.col("need") + 1).drop("_crowded")


def search(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``doc_id, item_id, n_shared, n_shingles, containment`` for every document and item it contains (see ``pairs``)."""
    return pairs(docs, items, **options).drop("text_key")


def candidates(docs: DataFrame, bench: DataFrame, k: int) -> DataFrame:
    """``doc_id, _doc, item_id, _item``: documents (doc_id, _doc, _words) and the items of whose sketch they hold a value."""
    held = docs.select("doc_id", "_doc", F.explode(shingle_hashes(F.col("_words"), k)).alias("h"))
    return held.join(bench.filter("sketch").select("h", "item_id", "_item"), "h").select("doc_id", "_doc", "item_id", "_item").distinct()


def verified(docs: DataFrame, bench: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The candidates that hold enough of the item's shingles, compared as texts, with ``n, n_shared``."""
    both = lambda x, y: F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{y}.doc_id")) & (F.col(f"{x}._doc") == F.col(f"{y}._doc"))
    again = docs.alias("d").join(found.select("doc_id", "_doc").distinct().alias("f"), both("d", "f"), "left_semi")
    held = again.select("doc_id", "_doc", F.explode(shingle_texts(F.col("_words"), k)).alias("s"))
    held = held.join(bench.select("s"), "s", "left_semi").distinct()
    asked = found.alias("f").join(bench.alias("b"), F.col("f.item_id").eqNullSafe(F.col("b.item_id")) & (F.col("f._item") == F.col("b._item"))).select("f.*", "b.s", "b.n", "b.need")
    got = asked.alias("a").join(held.alias("h"), both("a", "h") & (F.col("a.s") == F.col("h.s"))).select("a.*")
    return got.groupBy("doc_id", "_doc", "item_id", "_item", "n", "need").agg(F.count("*").alias("n_shared")).filter("n_shared >= need")


def pairs(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, text_key, item_id, n_shared, n_shingles, containment`` for every document and item it contains.

    text_key: a hash of the document's text; containment: the share of the item's distinct k-word shingles (A-Z
    lower-cased, words parted by white space) that the document holds; pairs of
    ``threshold`` or more are returned, once per distinct text of a document id
    and an item id.  A text of fewer than k words has one shingle of all its
    words, which only texts of just those words share; null and blank texts have
    none and are never in a pair.  Null ids are kept.  Very long texts are read
    whole.  An empty table gives no rows; repeated rows give one pair; other
    columns, whatever their names, are ignored.
    """
    item, text = F.coalesce(F.col(item_text_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    words = F.col("_words")
    bench = items.select(F.col(item_col).alias("item_id"), F.xxhash64(item).alias("_item"), word_array(item).alias("_words"))
    bench = bench.select("item_id", "_item", F.inline(F.arrays_zip(shingle_hashes(words, k).alias("h"), shingle_texts(words, k).alias("s")))).distinct()
    bench = saved(sketches(bench, threshold))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("_doc"), word_array(text).alias("_words"))
    found = saved(candidates(rows, bench, k))
    sure = verified(rows, bench, found, k).groupBy("doc_id", "item_id", "_doc", "_item").agg(F.max("n_shared").alias("n_shared"), F.max("n").alias("n_shingles"))
    return sure.select("doc_id", F.col("_doc").alias("text_key"), "item_id", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that contain no item, all columns kept."""
    bad = pairs(docs, items, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias("_bad"), F.col("text_key").alias("_key")).distinct()
    rows = boxed(docs, _id=F.col(id_col), _text=F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return rows.join(bad, F.col("_id").eqNullSafe(F.col("_bad")) & (F.col("_text") == F.col("_key")), "left_anti").select("row.*")


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Query: every benchmark item against all documents, five words, containment 0.8."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SH = """list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: concat_ws(' ', w[i], w[i+1], w[i+2], w[i+3], w[i+4]))
  WHEN len(w) > 0 THEN [concat_ws(' ', '<', array_to_string(w, ' '))] ELSE [] END)"""
_W = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
OP5_SQL = f"""
WITH dw AS (SELECT doc_id, text, {_W} AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
ds AS (SELECT doc_id, text, unnest({_SH}) AS s FROM dw),
bw AS (SELECT item_id, text, {_W} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
bs AS (SELECT item_id, text, unnest({_SH}) AS s, len({_SH}) AS n FROM bw)
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, any_value(n)::BIGINT AS n_shingles, count(*)::DOUBLE / any_value(n) AS containment
FROM ds JOIN bs USING (s) GROUP BY doc_id, ds.text, item_id, bs.text HAVING count(*) >= ceil(any_value(n) * 0.8::DOUBLE - 1e-9)
"""
