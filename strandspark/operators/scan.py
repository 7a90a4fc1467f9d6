"""Scanning sequences with motifs: exact p-values, both strands, ranges, masks.

Sequences of a batch are one flat array of base codes with a code that matches
nothing between them, so a motif's scores over the whole batch take one table
look-up per column.  The threshold is compared there, so only hits become rows.
Motifs are small and go to the workers with the kernel.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import gc_fraction, kmers, n_count
from ..model import AMBIGUOUS, IUPAC, UNIFORM, Motif, from_consensus, reverse_complement, scored, with_threshold

_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i
_CODE[ord("U")] = _CODE[ord("u")] = 3
_CODE_MASKED = _CODE.copy()
_CODE_MASKED[97:123] = 4
#: Bytes of sequence scored at once, at most; longer sequences are cut, with an overlap of the widest motif.
CHUNK = 1 << 22
#: Letters of a batch, and starts of windows, that a kernel looks at together: what it holds doesn't grow with a batch's rows or texts.
PORTION = 1 << 18


def prepare(motifs: list[Motif], *, pvalue: float | None = 1e-4, bkg=UNIFORM, pseudo: float = 1, nsites: float = 1000) -> list[Motif]:
    """Scored motifs with thresholds, ready for the kernel; a consensus motif is matched exactly."""
    out = []
    for m in motifs:
        exact = m.kind == "consensus"
        s = scored(m, UNIFORM if exact else bkg, 1000 if exact else nsites, 1 if exact else pseudo)
        out.append(with_threshold(s, pvalue, UNIFORM if exact else bkg, exact=exact))
    return out


def exact(consensus: str) -> list[Motif]:
    """The motif that fits where the IUPAC string does."""
    return prepare([from_consensus(consensus)])


def portions(batch: pa.RecordBatch, column: int, letters: int | None = None):
    """The batch in slices of about PORTION letters in that column; a longer text ends its slice."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // (letters or PORTION)
    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield batch.slice(a, b - a)


def encode(texts: list[str], masked: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts with a 4 after each, and each text's start."""
    raw = [t.encode("latin-1", "replace") for t in texts]
    flat = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    return (_CODE_MASKED if masked else _CODE)[flat], np.append(0, np.cumsum([len(r) + 1 for r in raw]))


def triples(codes: np.ndarray) -> np.ndarray:
    """Every three letters from each place on as one number."""
    codes = np.concatenate([codes, np.full(2, 4, np.uint8)])
    return codes[:-2] * np.uint8(25) + codes[1:-1] * np.uint8(5) + codes[2:]


def window_scores(codes: np.ndarray, pwm: np.ndarray, triple: np.ndarray | None = None) -> np.ndarray:
    """The score at every offset; windows with an unknown base score far below any threshold.  triple: of the codes, where they are known."""
    w = len(pwm)
    n = len(codes) - w + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    # three columns at a time: one look-up in a table of all three-letter codes; sums of 50 columns stay within 32 bits
    columns = np.concatenate([pwm, np.full((w, 1), AMBIGUOUS)], axis=1).astype(np.int32)
    columns = np.concatenate([columns, np.zeros((-w % 3, 5), np.int32)])
    triple = triples(codes) if triple is None else triple
    out = np.zeros(n, np.int32)
    for i in range(0, len(columns), 3):
        a, b, c = columns[i : i + 3]
        out += np.take((a[:, None, None] + b[:, None] + c).ravel(), triple[i : i + n])
    return out


def pieces(codes: np.ndarray, halo: int):
    """The first start of every PORTION starts of windows of up to halo + 1 letters, their codes and triples."""
    for lo in range(0, len(codes), PORTION):
        part = codes[lo : lo + PORTION + halo]
        yield lo, part, triples(part)


def window_hits(part: np.ndarray, triple: np.ndarray, pwm: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts within a piece whose windows reach the threshold, and their scores."""
    s = window_scores(part[: PORTION + len(pwm) - 1], pwm, triple)
    at = np.flatnonzero(s >= threshold)
    return at, s[at]


def _kernel(motifs: list[Motif], masked: bool, forward: bool):
    live = [m for m in motifs if m.threshold is not None]
    halo = max([m.width for m in live], default=1) - 1

    def kernel(batches):
        for batch in batches:
            for part in portions(batch, 1):
                yield from one(part)

    def one(batch):
        # key, seq, offset, plus (scan the forward strand), minus
        texts = [t or "" for t in batch.column(1).to_pylist()]
        codes, starts = encode(texts, masked)
        flat = np.frombuffer("\n".join([*texts, ""]).encode(), np.uint8) if all(t.isascii() for t in texts) else None
        plus, minus = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
        offset = batch.column(2).to_numpy(zero_copy_only=False)
        widths, top = np.array([m.width for m in live] or [0]), np.array([m.max_score for m in live] or [1])
        names, signs = pa.array([m.name for m in live], pa.string()), pa.array(["+", "-"])
        for lo, part, triple in pieces(codes, halo):
            got, pv, match = [[] for _ in range(5)], [], []
            for j, m in enumerate(live):
                for strand, pwm in enumerate((m.pwm, reverse_complement(m.pwm))):
                    if strand and forward:
                        continue
                    at, s = window_hits(part, triple, pwm, m.threshold)
                    at += lo
                    row = np.searchsorted(starts, at, side="right") - 1
                    ok = (minus if strand else plus)[row]
                    at, row, s = at[ok], row[ok], s[ok]
                    for g, x in zip(got, (row, at - starts[row], np.full(len(at), j), np.full(len(at), strand), s), strict=True):
                        g.append(x)
                    pv.append(m.pvalue(s))
                    if flat is not None:
                        match.append(flat[at[:, None] + np.arange(m.width)].ravel())
            row, at, j, strand, s = (np.concatenate(g) if g else np.zeros(0, np.int64) for g in got)
            width = widths[j]
            if flat is None:
                match = pa.array([texts[r][a : a + w] for r, a, w in zip(row, at, width, strict=True)], pa.string())
            else:
                ends = np.append(0, np.cumsum(width)).astype(np.int32)
                match = pa.Array.from_buffers(pa.string(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(match) if match else np.zeros(0, np.uint8))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(offset[row] + at + 1), pa.array(offset[row] + at + width), signs.take(pa.array(strand)), names.take(pa.array(j)), pa.array(np.concatenate(pv) if pv else np.zeros(0)), pa.array(s.astype(np.int64)), pa.array(100.0 * s / np.where(top[j] == 0, 1, top[j])), match],
                names=["key", "start", "end", "strand", "motif", "pvalue", "score_i", "score_pct", "match"],
            )

    return kernel


_OUT = "key string, start long, end long, strand string, motif string, pvalue double, score_i long, score_pct double, match string"


def chunked(seqs: DataFrame, halo: int, size: int = CHUNK) -> DataFrame:
    """Rows ``name, seq, offset`` of at most size letters: each window of halo + 1 letters stands whole in just one chunk."""
    n = F.length("seq")
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))
    return seqs.withColumn("_at", F.explode(starts)).withColumns({"offset": F.col("_at").cast("long"), "seq": F.substring(F.col("seq"), F.col("_at") + 1, F.lit(size + halo))}).drop("_at")


def scan(seqs: DataFrame, motifs: list[Motif], *, forward: bool = False, masked: bool = False) -> DataFrame:
    """Hits of prepared motifs in ``name, seq``; 1-based closed coordinates, ``score`` in bits, ``score_i`` its integer."""
    halo = max([m.width for m in motifs], default=1) - 1
    rows = chunked(seqs.select("name", "seq"), halo).select("name", "seq", "offset", F.lit(True).alias("plus"), F.lit(True).alias("minus"))
    return _finish(rows.mapInArrow(_kernel(motifs, masked, forward), _OUT).withColumnRenamed("key", "seq_name"))


def scan_ranges(seqs: DataFrame, ranges: DataFrame, motifs: list[Motif], *, masked: bool = False) -> DataFrame:
    """Hits wholly inside each range (overlapping ranges report them again); strand ``+`` or ``-`` looks at that one alone."""
    label = F.concat("seq_name", F.lit(":"), (F.col("start") + 1).cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit("("), "strand", F.lit(")"))
    cut = ranges.join(seqs.select(F.col("name").alias("seq_name"), "seq"), "seq_name").withColumn("end", F.least("end", F.length("seq").cast("long"))).filter("start < end")
    rows = cut.select(F.concat_ws("\x01", label, F.col("name"), F.col("seq_name")).alias("key"), F.substring(F.col("seq"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("seq"), F.col("start").alias("offset"), (F.col("strand") != "-").alias("plus"), (F.col("strand") != "+").alias("minus"))
    hits = rows.mapInArrow(_kernel(motifs, masked, False), _OUT)
    part = F.split("key", "\x01")
    return _finish(hits.withColumns({"bed_range": part[0], "bed_name": part[1], "seq_name": part[2]}).drop("key"), ["bed_range", "bed_name"])


def _finish(hits: DataFrame, extra: list[str] | None = None) -> DataFrame:
    return hits.select(*(extra or []), "seq_name", "start", "end", "strand", "motif", "pvalue", (F.col("score_i") / 1000.0).alias("score"), "score_pct", "match", "score_i")


def consensus_positions(seqs: DataFrame, consensus: str) -> DataFrame:
    """Where an IUPAC string fits the forward strand: ``seq_name, start, end, match``, by expressions alone."""
    w = len(consensus)
    pattern = "(?i)^" + "".join(f"[{IUPAC[c].replace('T', 'TU')}]" for c in consensus.upper()) + "$"
    at = seqs.select(F.col("name").alias("seq_name"), F.posexplode(kmers(F.col("seq"), w)).alias("p", "match")).filter(F.col("match").rlike(pattern))
    return at.select("seq_name", (F.col("p") + 1).cast("long").alias("start"), (F.col("p") + w).cast("long").alias("end"), "match")


def max_possible_hits(seqs: DataFrame, widths: list[int], *, strands: int = 2) -> DataFrame:
    """One row: the windows of all motifs on all sequences."""
    per = [F.sum(F.greatest(F.length("seq").cast("long") - w + 1, F.lit(0))) for w in widths]
    total = per[0]
    for p in per[1:]:
        total = total + p
    return seqs.agg((F.coalesce(total, F.lit(0)) * strands).cast("long").alias("max_possible_hits"))


def unit_kernel(motifs: list[Motif], masked: bool, forward: bool):
    """(unit, seq, plus, minus) -> unit, motif number, hits, largest score (null: shorter than the motif) and positions: windows on the strands looked at, one strand at least."""

    low = np.iinfo(np.int32).min

    def kernel(batches):
        for batch in batches:
            for part in portions(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                codes, starts = encode(texts, masked)
                triple = triples(codes)
                n, first = len(texts), starts[:-1]
                sides = [part.column(c).to_numpy(zero_copy_only=False) for c in (2, 3)]
                strands, out = np.maximum(1, sides[0].astype(np.int64) + sides[1]), [[] for _ in range(5)]
                for j, m in enumerate(motifs):
                    hits, best = np.zeros(n, np.int64), np.full(n, low)
                    # windows that hold a text's end
                    across = (starts[1:, None] - np.arange(1, m.width + 1)).ravel()
                    across = across[across >= 0]
                    for strand, pwm in enumerate((m.pwm, reverse_complement(m.pwm))):
                        if strand and forward:
                            continue
                        s = np.full(len(codes), low)
                        found = window_scores(codes, pwm, triple)
                        s[: len(found)] = found
                        s[across] = low
                        if m.threshold is not None:
                            hits += np.where(sides[strand], np.add.reduceat(s >= m.threshold, first, dtype=np.int64), 0)
                        best = np.maximum(best, np.where(sides[strand], np.maximum.reduceat(s, first), low))
                    out[0].append(np.arange(n))
                    out[1].append(np.full(n, j))
                    out[2].append(hits)
                    out[3].append(best)
                    out[4].append(np.maximum(0, np.diff(starts) - m.width) * strands)
                row, j, h, b, room = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(j.astype(np.int32)), pa.array(h), pa.array(b.astype(np.int64), mask=b == low), pa.array(room.astype(np.int64))], names=["unit", "motif_id", "n_hits", "max_score", "positions"])

    return kernel


def seq_stats(seqs: DataFrame) -> DataFrame:
    """``seq_num, seq_name, size, gc_pct, n_count``; gc_pct 0 where there is no standard base."""
    s = F.col("seq")
    return seqs.select("seq_num", F.col("name").alias("seq_name"), F.length(s).cast("long").alias("size"), F.coalesce(gc_fraction(s) * 100, F.lit(0.0)).alias("gc_pct"), n_count(s).cast("long").alias("n_count"))


def range_stats(seqs: DataFrame, ranges: DataFrame) -> DataFrame:
    """The same for each range."""
    cut = ranges.join(seqs.select(F.col("name").alias("seq_name"), "seq"), "seq_name").withColumn("seq", F.substring(F.col("seq"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))
    s = F.col("seq")
    return cut.select("range_id", "seq_name", "start", "end", F.length(s).cast("long").alias("size"), F.coalesce(gc_fraction(s) * 100, F.lit(0.0)).alias("gc_pct"), n_count(s).cast("long").alias("n_count"))
