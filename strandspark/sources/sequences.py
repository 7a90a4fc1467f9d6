"""FASTA, FASTQ, BED and hit tables as DataFrames, and their text forms."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import MotifError


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``seq_num, name, comment, seq``: records split at lines that start with ``>``; gzip by the file's ending.

    seq_num numbers the records of all files in their order of reading (it has gaps between files' parts).
    """
    raw = spark.read.text(path, lineSep="\n>").select(F.monotonically_increasing_id().alias("seq_num"), F.regexp_replace("value", r"^\s*>", "").alias("value"))
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "")
    return raw.filter(F.trim("value") != "").select("seq_num", F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.regexp_extract(head, r"^\S*\s+(.*)$", 1).alias("comment"), seq.alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """``seq_num, name, comment, seq, qual`` of four-line records; a quality of another length is an error.

    Lines are numbered by the number of lines in the earlier blocks of their
    file, so that no task sees more than its block; seq_num goes on from file to file.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select("value", meta["file_path"].alias("_f"), meta["file_block_start"].alias("_b"), F.monotonically_increasing_id().alias("_n"))
    blocks = lines.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_c"), F.min("_n").alias("_low"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("_before", before).select("_f", "_b", (F.col("_before") - F.col("_low")).alias("_shift"), "_c")
    files = blocks.groupBy("_f").agg(F.ceil(F.sum("_c") / 4).alias("_r"))
    files = files.select("_f", F.coalesce(F.sum("_r").over(Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    n = lines.join(F.broadcast(blocks.drop("_c")), ["_f", "_b"]).withColumn("_i", F.col("_n") + F.col("_shift"))  # one row per block of a file
    rec = n.groupBy("_f", F.floor(F.col("_i") / 4).alias("_r")).agg(*[F.max(F.when(F.col("_i") % 4 == i, F.col("value"))).alias(f"_{i}") for i in range(4)])
    ok = F.length("_1") == F.length("_3")
    seq = F.when(ok & F.startswith("_0", F.lit("@")) & F.startswith("_2", F.lit("+")), F.col("_1")).otherwise(F.raise_error(F.concat(F.lit("bad FASTQ record "), F.coalesce("_0", F.lit("at the end")))))
    return rec.join(F.broadcast(files), "_f").select((F.col("_earlier") + F.col("_r") + 1).cast("long").alias("seq_num"), F.regexp_extract("_0", r"^@(\S*)", 1).alias("name"), F.regexp_extract("_0", r"^\S*\s+(.*)$", 1).alias("comment"), seq.alias("seq"), F.col("_3").alias("qual"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """``range_id, seq_name, start, end, name, strand``; headers and blank lines skipped, bad rows an error."""
    rows = spark.read.text(path).filter(~F.col("value").rlike(r"^(#|browser|track)|^\s*$")).select(F.monotonically_increasing_id().alias("range_id"), F.split(F.rtrim(F.regexp_replace("value", r"\r$", "")), "\t").alias("f"))
    strand = F.coalesce(F.get("f", 5), F.lit("."))
    good = (F.size("f") >= 3) & F.try_to_number(F.get("f", 1), F.lit("999999999999999")).isNotNull() & (F.get("f", 1).cast("long") < F.get("f", 2).cast("long")) & strand.isin("+", "-", ".")
    first = lambda c: F.regexp_extract(c, r"^\s*(\S*)", 1)
    return rows.withColumn("_ok", F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("bad BED row "), F.array_join("f", " "))))).filter("_ok").select("range_id", first(F.get("f", 0)).alias("seq_name"), F.get("f", 1).cast("long").alias("start"), F.get("f", 2).cast("long").alias("end"), F.when(F.coalesce(first(F.get("f", 3)), F.lit("")) == "", ".").otherwise(first(F.get("f", 3))).alias("name"), strand.alias("strand"))


_HITS = r"^##(strandspark|(bed_range\t.*)?seq_name(\t|$))"


def is_hits(spark: SparkSession, path: str) -> bool:
    """Whether a file starts, before any row, with the header of a table of hits."""
    for row in spark.read.text(path).filter("trim(value) <> ''").limit(3).collect():
        if re.match(_HITS, row[0]):
            return True
        if not row[0].startswith("#"):
            return False
    return False


def comments(spark: SparkSession, path: str) -> DataFrame:
    """``arrival, value``: the lines that are no rows and stand before the rows of a deduplicated table as they are."""
    return spark.read.text(path).withColumn("arrival", F.monotonically_increasing_id()).filter(F.col("value").rlike("^(#|browser|track)")).select("arrival", "value")


def read_hits(spark: SparkSession, path: str, *, form: str | None = None) -> DataFrame:
    """Ranges to look for overlaps in, with ``arrival``, their order, and ``value``, their line.

    form: ``hits`` (9 to 12 tab-parted fields) or ``bed`` (at least 4: the fifth is the score; starts
    are moved to closed coordinates); by default as the file's header says.  Comments are skipped; numbers
    that are none, too few fields, a p-value of 0 or below, another strand than + - . and a start beyond the end are errors.
    """
    hits = is_hits(spark, path) if form is None else form == "hits"
    rows = spark.read.text(path).withColumn("arrival", F.monotonically_increasing_id()).filter(~F.col("value").rlike(r"^#|^\s*$" if hits else r"^(#|browser|track)|^\s*$"))
    rows = rows.withColumn("f", F.split(F.regexp_replace("value", r"\r$", ""), "\t"))
    n = F.size("f")
    i = F.when(n >= 11, 2).otherwise(0) if hits else F.lit(0)
    get = lambda k: F.get("f", i + k)
    number = lambda c, kind: F.expr(f"try_cast({c} AS {kind})")
    named = {"seq_name": 0, "_start": 1, "_end": 2, "strand": 3, "motif": 4, "_p": 5, "_score": 6, "_pct": 7, "match": 8} if hits else {"seq_name": 0, "_start": 1, "_end": 2, "motif": 3, "_score": 4, "strand": 5}
    t = rows.select("arrival", "value", n.alias("_n"), F.when(i == 2, F.get("f", 0)).alias("bed_range"), F.when(i == 2, F.get("f", 1)).alias("bed_name"), *[get(k).alias(c) for c, k in named.items()])
    t = t.withColumns({"start": number("_start", "bigint") + (0 if hits else 1), "end": number("_end", "bigint"), "score": number("_score", "double")})
    t = t.withColumns({"pvalue": number("_p", "double"), "score_pct": number("_pct", "double")} if hits else {"pvalue": F.lit(None).cast("double"), "score_pct": F.lit(None).cast("double"), "match": F.lit(None).cast("string"), "strand": F.coalesce("strand", F.lit("."))})
    fields = F.col("_n").between(9, 12) if hits else F.col("_n") >= 4
    fault = (
        F.when(~fields, "another number of fields than there should be").when(F.col("start").isNull() | F.col("end").isNull(), "no number in the start or end field")
        .when((F.col("pvalue") if hits else F.when(F.col("_n") >= 5, F.col("score")).otherwise(0.0)).isNull(), "no number in the score field")
        .when((F.col("pvalue") <= 0) if hits else F.lit(False), "a p-value is above 0").when(F.col("start") > F.col("end"), "a start beyond the end").when(~F.col("strand").isin("+", "-", "."), "a strand is one of + - .")
    )
    t = t.withColumn("_fault", fault).withColumn("seq_name", F.when(F.col("_fault").isNull(), F.col("seq_name")).otherwise(F.raise_error(F.concat("_fault", F.lit(": "), "value"))))
    return t.select("arrival", "seq_name", "start", "end", "strand", "motif", "pvalue", "score", "score_pct", "match", "bed_range", "bed_name", "value")


def range_from_text(spark: SparkSession, text: str) -> DataFrame:
    """One range of ``seq:start-end[:strand]``, 0-based and half open."""
    m = re.fullmatch(r"(\S+):(\d+)-(\d+)(?::([-+.]))?", text)
    if not m or int(m[2]) >= int(m[3]):
        raise MotifError(f"{text!r} is no range")
    return spark.createDataFrame([(0, m[1], int(m[2]), int(m[3]), ".", m[4] or ".")], "range_id long, seq_name string, start long, end long, name string, strand string")


def bound(ranges: DataFrame, seqs: DataFrame, *, strict: bool = True, clip: bool = True) -> DataFrame:
    """Ranges with their sequences; strict: unknown names and starts beyond the end are errors, else left out."""
    got = ranges.join(seqs.select(F.col("name").alias("seq_name"), "seq"), "seq_name", "left" if strict else "inner")
    n = F.length("seq")
    bad = F.col("seq").isNull() | (F.col("start") >= n)
    if strict:
        got = got.withColumn("seq", F.when(bad, F.raise_error(F.concat(F.lit("range outside any sequence: "), F.col("seq_name")))).otherwise(F.col("seq")))
    else:
        got = got.filter(~bad)
    return got.withColumn("end", F.least("end", F.length("seq").cast("long"))) if clip else got


def renamed(df: DataFrame, order: str, name: str = "name", *, rename: bool = False) -> DataFrame:
    """Equal names: an error, or ``__N<ordinal>`` after all but the first."""
    w = Window.partitionBy(name).orderBy(order)
    n = F.row_number().over(w)
    other = F.concat(F.col(name), F.lit("__N"), F.col(order).cast("string")) if rename else F.raise_error(F.concat(F.lit("name occurs more than once: "), F.col(name)))
    return df.withColumn("_dup", n).withColumn(name, F.when(F.col("_dup") > 1, other).otherwise(F.col(name))).drop("_dup")


def fasta_text(df: DataFrame, width: int = 60) -> DataFrame:
    """``value``: a FASTA record for each row, wrapped at width (0: not)."""
    head = F.concat(F.lit(">"), "name", F.when(F.coalesce("comment", F.lit("")) != "", F.concat(F.lit(" "), "comment")).otherwise("")) if "comment" in df.columns else F.concat(F.lit(">"), "name")
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n") if width else F.col("seq")
    return df.select(F.concat(head, F.lit("\n"), body).alias("value"))


def write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    fasta_text(df, width).write.text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).csv(path)


def shortest(value):
    """A double as C's ``%.9g`` prints it: nine digits, no trailing zeros."""
    text = F.format_string("%.8e", value)
    exp = F.regexp_extract(text, r"e([-+]\d+)$", 1).cast("int")
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^(-?\d\.?\d*)e", 1), r"\.?0+$", "")
    plain = F.regexp_replace(F.regexp_replace(F.format_number(F.round(value.cast("decimal(38,14)"), 14), 14), ",", ""), r"\.?0+$", "")
    return F.when(value == 0, "0").when((exp < -4) | (exp >= 9), F.concat(mantissa, F.lit("e"), F.when(exp < 0, "-").otherwise("+"), F.lpad(F.abs(exp).cast("string"), 2, "0"))).otherwise(plain)


def hit_text(hits: DataFrame) -> DataFrame:
    """``value``: a tab-parted line for each hit, with its range first if there is one."""
    extra = [c for c in ("bed_range", "bed_name") if c in hits.columns]
    return hits.select(F.concat_ws("\t", *extra, "seq_name", F.col("start").cast("string"), F.col("end").cast("string"), "strand", "motif", shortest(F.col("pvalue")), F.format_string("%.3f", F.col("score")), F.format_string("%.1f", F.col("score_pct")), "match").alias("value"))


def hit_headers(seqs: DataFrame, widths: list[int], *, ranges: DataFrame | None = None, strands: int = 2, options: str = "") -> DataFrame:
    """``line, value``: the three lines before a table of hits; the second tells the sets' sizes, the third the columns."""
    from ..functions.exprs import gc_count, n_count, standard_count

    s, n = F.col("seq"), F.length("seq").cast("long")
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    room = sum((total(F.greatest(n - w + 1, F.lit(0))) for w in widths), F.lit(0)) * strands
    got = seqs.agg(F.count(F.lit(1)).alias("n"), total(n).alias("size"), total(gc_count(s)).alias("gc"), total(standard_count(s)).alias("known"), total(n_count(s)).alias("other"), room.cast("long").alias("room"))
    gc = F.format_string("%.2f", F.when(F.col("known") > 0, 100.0 * F.col("gc") / F.col("known")).otherwise(0.0))
    text = lambda name, c: F.concat(F.lit(f" {name}="), c.cast("string"))
    parts = [F.lit(f"##MotifCount={len(widths)} MotifSize={sum(widths)}")]
    columns = "seq_name start end strand motif pvalue score score_pct match".split()
    if ranges is not None:
        bed = ranges.agg(F.count(F.lit(1)).alias("bed_n"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("bed_size"))
        got, columns = got.crossJoin(F.broadcast(bed)), ["bed_range", "bed_name", *columns]  # one row each
        parts += [text("BedCount", F.col("bed_n")), text("BedSize", F.col("bed_size"))]
    parts += [text("SeqCount", F.col("n")), text("SeqSize", F.col("size")), F.concat(F.lit(" GC="), gc, F.lit("%")), text("Ns", F.col("other"))]
    if ranges is None:
        parts.append(text("MaxPossibleHits", F.col("room")))
    lines = [F.lit(f"##strandspark [ {options + ' ' if options else ''}]"), F.concat(*parts), F.lit("##" + "\t".join(columns))]
    return got.select(F.posexplode(F.array(*lines)).alias("line", "value")).coalesce(1)


def hit_report(hits: DataFrame, seqs: DataFrame, widths: list[int], **options) -> DataFrame:
    """``value``: a table of hits as text, its headers first."""
    return hit_headers(seqs, widths, **options).select("value").unionByName(hit_text(hits))
