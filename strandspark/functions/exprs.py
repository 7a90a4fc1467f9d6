"""Column builders over sequences: composition, complements, k-mers, masks; all of them built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import COMPLEMENT_FROM, COMPLEMENT_TO


def _n(seq: Column, letters: str) -> Column:
    """How many of the letters: what a translation that deletes them takes away."""
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def gc_count(seq: Column) -> Column:
    return _n(seq, "GCgc")


def standard_count(seq: Column) -> Column:
    return _n(seq, "ACGTUacgtu")


def gc_fraction(seq: Column) -> Column:
    """GC among standard bases; null where there are none."""
    return F.try_divide(gc_count(seq), standard_count(seq))


def n_count(seq: Column) -> Column:
    """Letters that are no standard bases."""
    return F.length(seq) - standard_count(seq)


def rc(seq: Column) -> Column:
    """The reverse complement, all IUPAC letters, case kept."""
    return F.reverse(F.translate(seq, COMPLEMENT_FROM, COMPLEMENT_TO))


def to_rna(seq: Column) -> Column:
    return F.translate(seq, "Tt", "Uu")


def to_dna(seq: Column) -> Column:
    return F.translate(seq, "Uu", "Tt")


def kmers(seq: Column, k: int) -> Column:
    """The substrings of k letters in their order; empty for shorter texts.

    One pass of a look-ahead expression: a substring for each place would work
    out the sequence's own expression again at every place.
    """
    return F.regexp_extract_all(seq, F.lit(f"(?=(.{{{k}}}))"), F.lit(1))


def gc_bin(gc: Column, step: float) -> Column:
    """The bin of a GC fraction, the last one closed; floor in doubles, as it comes."""
    import math

    return F.least(F.floor(gc / F.lit(step)).cast("int"), F.lit(math.ceil(1 / step) - 1))


def masked(text: str | None, starts: list | None, ends: list | None, hard: bool = False) -> str | None:
    """A text with its ranges in lower case, or N: cut at their merged ends and joined once."""
    if text is None or not starts:
        return text
    out, at = [], 0
    for x, y in sorted(zip(starts, ends, strict=True)):
        x, y = max(x, at), min(y, len(text))
        if x < y:
            out += [text[at:x], "N" * (y - x) if hard else text[x:y].lower()]
            at = y
    return "".join([*out, text[at:]])


def wrapped(seq: Column, width: int = 60) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n") if width else seq


def grouped_ranges(ranges: DataFrame) -> DataFrame:
    """``seq_name, ranges``: the ranges of each sequence, sorted by start."""
    return ranges.groupBy("seq_name").agg(F.array_sort(F.collect_list(F.struct("start", "end", "range_id", "name", "strand"))).alias("ranges"))
