"""Everyday operations over sequences (``seq_num, name, comment, seq``); all native but masks and the k-mer matrix."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import gc_bin, gc_count, gc_fraction, grouped_ranges, kmers, masked, rc, standard_count, to_dna, to_rna
from ..model import MotifError
from .scan import portions


def reverse_complement(seqs: DataFrame) -> DataFrame:
    return seqs.withColumn("seq", rc(F.col("seq")))


def rna(seqs: DataFrame) -> DataFrame:
    return seqs.withColumn("seq", to_rna(F.col("seq")))


def dna(seqs: DataFrame) -> DataFrame:
    return seqs.withColumn("seq", to_dna(F.col("seq")))


def duplicate(seqs: DataFrame, n: int) -> DataFrame:
    """Each sequence n times, named ``-1`` to ``-n``; comments go."""
    if n < 1:
        raise MotifError("at least one copy")
    return seqs.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumns({"name": F.concat("name", F.lit("-"), F.col("_i").cast("string")), "comment": F.lit("")}).drop("_i")


def subset(seqs: DataFrame, ranges: DataFrame) -> DataFrame:
    """The ranges' parts of the sequences, ends clipped, minus strands reverse-complemented; named by column 4 or ``seq:start-end``."""
    s = F.substring(F.col("seq"), (F.col("start") + 1).cast("int"), (F.least("end", F.length("seq").cast("long")) - F.col("start")).cast("int"))
    got = ranges.join(seqs.select("seq_num", F.col("name").alias("seq_name"), "seq"), "seq_name").filter(F.col("start") < F.length("seq"))
    name = F.when(F.col("name") != ".", F.col("name")).otherwise(F.concat("seq_name", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.least("end", F.length("seq").cast("long")).cast("string")))
    return got.select("seq_num", "start", name.alias("name"), F.when(F.col("strand") == "-", rc(s)).otherwise(s).alias("seq"))


def mask(seqs: DataFrame, ranges: DataFrame, *, hard: bool = False) -> DataFrame:
    """Ranges in lower case, or N; strands don't matter, unknown names neither."""
    names, n, at = seqs.columns, len(seqs.columns), seqs.columns.index("seq")
    got = seqs.join(grouped_ranges(ranges).withColumnRenamed("seq_name", "name"), "name", "left").select(*names, F.col("ranges.start").alias("_starts"), F.col("ranges.end").alias("_ends"))

    def kernel(batches):
        for batch in batches:
            for part in portions(batch, at):
                new = pa.array([masked(*x, hard) for x in zip(*(part.column(c).to_pylist() for c in (at, n, n + 1)), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([new if c == at else part.column(c) for c in range(n)], names=names)

    return got.mapInArrow(kernel, seqs.schema)


def _chance(seed: int):
    """Twelve hexadecimal digits by seed, number and name: the same in every engine."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("seq_num").cast("string"), F.col("name"))), 1, 12)


def reservoir(seqs: DataFrame, n: int, seed: int) -> DataFrame:
    """n sequences, each set as likely as any other; all if there are fewer."""
    return seqs.withColumn("_r", _chance(seed)).orderBy("_r", "seq_num", "name").limit(n).drop("_r")


def bernoulli(seqs: DataFrame, share: float, seed: int) -> DataFrame:
    """Each sequence with that probability, decided by its number and name alone."""
    if not 0 < share < 1:
        raise MotifError("a share is between 0 and 1")
    return seqs.filter(F.conv(_chance(seed), 16, 10).cast("double") < F.lit(share * (1 << 48)))


def gc_histogram(seqs: DataFrame, step: float = 0.05) -> DataFrame:
    """``bin, bin_lo, bin_hi, seq_count, bp_count`` for every bin; sequences without standard bases are left out."""
    bins = seqs.sparkSession.range(math.ceil(1 / step)).select(F.col("id").cast("int").alias("bin"))
    # one pass over the sequences and no filter on them, which would work each out once more; a null bin meets none
    rows = seqs.select(gc_fraction(F.col("seq")).alias("_gc"), F.length("seq").cast("long").alias("_n"))
    got = rows.groupBy(F.when(F.col("_gc").isNotNull(), gc_bin(F.col("_gc"), step)).alias("bin")).agg(F.count(F.lit(1)).alias("seq_count"), F.sum("_n").alias("bp_count"))
    return bins.join(got, "bin", "left").select("bin", (F.col("bin") * F.lit(step)).alias("bin_lo"), F.least(F.lit(1.0), (F.col("bin") + 1) * F.lit(step)).alias("bin_hi"), F.coalesce("seq_count", F.lit(0)).cast("long").alias("seq_count"), F.coalesce("bp_count", F.lit(0)).cast("long").alias("bp_count"))


def composition(seqs: DataFrame) -> DataFrame:
    """One row: sequences, bases, standard and other letters, GC, letters masked soft and hard."""
    s, low = F.col("seq"), "abcdefghijklmnopqrstuvwxyz"
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias
    n = F.length(s)
    return seqs.agg(F.count(F.lit(1)).alias("sequences"), total(n)("bases"), total(standard_count(s))("standard"), total(n - standard_count(s))("other"), total(gc_count(s))("gc"), total(n - F.length(F.translate(s, low, "")))("soft_masked"), total(n - F.length(F.translate(s, "N", "")))("hard_masked"))


def unknown_letters(seqs: DataFrame, share: float = 0.01) -> DataFrame:
    """Letters that are no standard bases and make up more than that share of all: ``letter, n``."""
    all_ = seqs.agg(F.sum(F.length("seq").cast("long")).alias("_all"))
    other = seqs.select(F.explode(F.split(F.translate("seq", "ACGTUacgtu", ""), "")).alias("letter")).filter("letter <> ''").groupBy("letter").agg(F.count(F.lit(1)).alias("n"))
    return other.crossJoin(F.broadcast(all_)).filter(F.col("n") > F.col("_all") * share).drop("_all")


#: Shares of letters that are no standard bases from which on a set is warned of.
WARNINGS = (0.9, 0.5, 0.1)


def checked(seqs: DataFrame, what: str = "the set") -> list[str]:
    """What is odd about a set of sequences, in words; no sequences, empty ones alone and no standard base at all are errors."""
    r = composition(seqs).first()
    if not r["sequences"]:
        raise MotifError(f"{what} has no sequences")
    if not r["bases"]:
        raise MotifError(f"all sequences of {what} are empty")
    if not r["standard"]:
        raise MotifError(f"{what} has no standard bases")
    share = r["other"] / r["bases"]
    return [f"{share:.1%} of the letters of {what} are no standard bases"] if share >= WARNINGS[-1] else []


def check_options(action: str, given) -> None:
    """Whether an everyday operation can be run with these options (names): those it needs are there, and none that it doesn't know."""
    needs = {"subset": {"ranges"}, "mask": {"ranges"}, "dup": {"n"}}
    knows = {"subset": {"ranges"}, "mask": {"ranges", "hard"}, "dup": {"n"}, "subsample": {"n", "share", "seed"}, "hist": {"step"}, "format": {"width"}}
    plain = {"stats", "rc", "rna", "dna", "composition"}
    given = set(given)
    if action not in plain | set(knows):
        raise MotifError(f"no such operation: {action}")
    if missing := needs.get(action, set()) - given:
        raise MotifError(f"{action} needs {', '.join(sorted(missing))}")
    if unknown := given - knows.get(action, set()):
        raise MotifError(f"{action} doesn't know {', '.join(sorted(unknown))}")
    if action == "subsample" and len(given & {"n", "share"}) != 1:
        raise MotifError("subsample takes either n or share")


def kmer_counts(seqs: DataFrame, k: int) -> DataFrame:
    """``name, kmer, n`` over ACGTN (upper case, U as T, all other letters N)."""
    up = F.translate(F.upper("seq"), "U", "T")
    clean = F.regexp_replace(up, "[^ACGT]", "N")
    return seqs.select("name", F.explode(kmers(clean, k)).alias("kmer")).groupBy("name", "kmer").agg(F.count(F.lit(1)).alias("n"))


def kmer_matrix(counts: DataFrame, k: int) -> DataFrame:
    """A column for every k-mer over ACGTN in that order."""
    import itertools

    if k > 5:
        raise MotifError("a matrix of k-mers is wide enough at 5")
    return counts.groupBy("name").pivot("kmer", ["".join(x) for x in itertools.product("ACGTN", repeat=k)]).sum("n").na.fill(0)
