"""Planting motif instances in sequences, with the truth of where they went."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import Stream, row_stream
from ..model import Motif, MotifError, reverse_complement


def poisson(mean: float, rng: Stream) -> int:
    """A Poisson number: by products of uniforms below 30, above by a rounded normal."""
    if mean < 30:
        limit, n, p = math.exp(-mean), 0, rng.unit()
        while p > limit:
            n, p = n + 1, p * rng.unit()
        return n
    z = math.sqrt(-2 * math.log(1 - rng.unit())) * math.cos(2 * math.pi * rng.unit())
    return max(0, round(mean + math.sqrt(mean) * z))


def instance(ppm: np.ndarray, rng: Stream) -> str:
    out = []
    for p in ppm:
        r, i = rng.unit() * p.sum(), 0
        while i < 3 and r >= p[: i + 1].sum():
            i += 1
        out.append("ACGT"[i])
    return "".join(out)


def _start(room: int, centre: int, rng: Stream) -> int:
    """A start below room: the mean of ``centre`` uniform ones."""
    return min(room - 1, int(sum(rng.unit() for _ in range(centre)) / centre * room))


def _free(taken: list[tuple[int, int]], a: int, b: int, gap: int) -> bool:
    return all(b + gap <= s or e + gap <= a for s, e in taken)


def plant(seqs: DataFrame, motifs: list[Motif], *, rate: float | None = None, number: int | None = None, gap: int = 0, centre: int = 1, forward: bool = False, seed: int = 1) -> DataFrame:
    """``name, seq, sites`` (array of start, end, motif, strand; 0-based, half open) with instances written in.

    rate: a Poisson number of mean rate * length each; number: that many.  Up to
    100 places are tried for each; those that overlap earlier ones (with the gap) are not taken.
    """
    if (rate is None) == (number is None) or not 1 <= centre <= 64:
        raise MotifError("give a rate or a number, and 1 to 64 draws")
    forms = [(m.name, m.ppm, reverse_complement(m.ppm)) for m in motifs]

    def kernel(frames):
        for f in frames:
            out = []
            for name, seq in f.itertuples(index=False, name=None):
                rng, taken, sites = row_stream(seed, name), [], []
                for _ in range(number if rate is None else poisson(rate * len(seq), rng)):
                    for _try in range(100):
                        who, ppm, back = forms[rng.below(len(forms))]
                        room = len(seq) - len(ppm) + 1
                        if room < 1:
                            if rate is not None:
                                break
                            continue
                        a = _start(room, centre, rng)
                        if _free(taken, a, a + len(ppm), gap):
                            minus = not forward and rng.below(2) == 1
                            seq = seq[:a] + instance(back if minus else ppm, rng) + seq[a + len(ppm) :]
                            taken.append((a, a + len(ppm)))
                            sites.append((a, a + len(ppm), who, "-" if minus else "+"))
                            break
                out.append((name, seq, [dict(zip(("start", "end", "motif", "strand"), s, strict=True)) for s in sites]))
            yield pd.DataFrame(out, columns=["name", "seq", "sites"])

    return seqs.select("name", "seq").mapInPandas(kernel, "name string, seq string, sites array<struct<start:long,end:long,motif:string,strand:string>>")


def plant_at(seqs: DataFrame, ranges: DataFrame, motifs: list[Motif], *, seed: int = 1) -> DataFrame:
    """Instances of the motifs named by the ranges; one of another width stands at the range's middle, if it fits."""
    spark = seqs.sparkSession
    known = spark.createDataFrame([(m.name, m.width) for m in motifs], "name string, width int")
    bad = ranges.join(F.broadcast(known), "name", "left_anti").limit(1).collect()  # at most one row
    if bad:
        raise MotifError(f"no motif is named {bad[0]['name']}")
    by = {m.name: m for m in motifs}
    from ..functions.exprs import grouped_ranges

    rows = seqs.select("name", "seq").join(grouped_ranges(ranges).withColumnRenamed("seq_name", "name"), "name", "left")

    def kernel(frames):
        for f in frames:
            out = []
            for name, seq, parts in f.itertuples(index=False, name=None):
                rng, sites = row_stream(seed, name), []
                for r in parts if parts is not None else []:
                    m = by[r["name"]]
                    a = r["start"] if r["end"] - r["start"] == m.width else (r["start"] + r["end"]) // 2 - m.width // 2
                    if 0 <= a and a + m.width <= len(seq):
                        minus = r["strand"] == "-"
                        seq = seq[:a] + instance(reverse_complement(m.ppm) if minus else m.ppm, rng) + seq[a + m.width :]
                        sites.append({"start": a, "end": a + m.width, "motif": m.name, "strand": "-" if minus else "+"})
                out.append((name, seq, sites))
            yield pd.DataFrame(out, columns=["name", "seq", "sites"])

    return rows.mapInPandas(kernel, "name string, seq string, sites array<struct<start:long,end:long,motif:string,strand:string>>")


def truth_bed(planted: DataFrame) -> DataFrame:
    """``value``: the same as BED lines, a dot for the score."""
    return truth(planted).select(F.concat_ws("\t", "seq_name", F.col("start").cast("string"), F.col("end").cast("string"), "motif", F.lit("."), "strand").alias("value"))


def shortfalls(planted: DataFrame, number: int) -> DataFrame:
    """``name, n_sites``: the sequences in which fewer sites than asked for found room."""
    return planted.select("name", F.size("sites").alias("n_sites")).filter(F.col("n_sites") < number)


def truth(planted: DataFrame) -> DataFrame:
    """``seq_name, start, end, motif, strand`` of what was planted."""
    return planted.select(F.col("name").alias("seq_name"), F.posexplode("sites").alias("p", "s")).select("seq_name", "s.*")
