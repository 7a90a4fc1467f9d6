"""Alphabet, limits and the motif in its two forms (probabilities, integer scores)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

#: Fixed values of the formats and of the score grid.
BASES = "ACGT"
SCALE = 1000
AMBIGUOUS = -10_000_000
MAX_WIDTH = 50
MAX_NAME = 255
MAX_GRID = 2_097_152
UNIFORM = (0.25, 0.25, 0.25, 0.25)
#: IUPAC letters and the bases they stand for.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "M": "AC", "K": "GT", "S": "CG", "W": "AT", "H": "ACT", "B": "CGT", "V": "ACG", "D": "AGT", "N": "ACGT"}
LETTER = {v: k for k, v in IUPAC.items() if k != "U"}
#: Complements of all IUPAC letters, in both cases; what else there is stays.
COMPLEMENT_FROM = "ACGTUacgtuRYKMBVDHrykmbvdh"
COMPLEMENT_TO = "TGCAAtgcaaYRMKVBHDyrmkvbhd"

SEQUENCE = "seq_num long, name string, comment string, seq string, qual string"
RANGE = "range_id long, seq_name string, start long, end long, name string, strand string"
HIT = "seq_name string, start long, end long, strand string, motif string, pvalue double, score double, score_pct double, match string"


class MotifError(ValueError):
    """Input that can't be a motif, range, sequence or option."""


def background(values=UNIFORM) -> np.ndarray:
    """Four frequencies; if one is below 0.001, all are raised by that; then they sum to one."""
    b = np.asarray(values, dtype=np.float64)
    if b.shape != (4,) or (b < 0).any():
        raise MotifError("a background is four frequencies")
    if (b < 0.001).any():
        b = b + 0.001
    return b / b.sum()


def normalised(column) -> np.ndarray:
    """A probability column: rejected if its sum is off by over 0.1, rescaled if by over 0.02."""
    p = np.asarray(column, dtype=np.float64)
    off = abs(p.sum() - 1)
    if off > 0.1:
        raise MotifError(f"column sums to {p.sum():g}")
    return p / p.sum() if off > 0.02 else p


def cell_score(p, b, nsites: float = 1000, pseudo: float = 1, floor: float = 0.0):
    """The integer log-odds of probabilities p: trunc(1000 * log2(smoothed / background))."""
    x = (np.asarray(p) * nsites + pseudo / 4) / (nsites + pseudo)
    with np.errstate(divide="ignore"):
        return np.trunc(SCALE * np.log2(np.maximum(x, floor) / np.asarray(b))).astype(np.int64)


@dataclass
class Motif:
    """A motif: probabilities ``ppm`` [width, 4]; ``pwm`` scores [width, 4] once it is scored."""

    name: str
    ppm: np.ndarray
    nsites: int | None = None
    counts: np.ndarray | None = None
    kind: str = "probability"
    altname: str = ""
    bkg: tuple[float, ...] | None = None
    pwm: np.ndarray | None = None
    cdf: np.ndarray | None = field(default=None, repr=False)
    offset: int = 0
    threshold: int | None = None

    @property
    def width(self) -> int:
        return len(self.ppm)

    @property
    def max_score(self) -> int:
        return int(self.pwm.max(axis=1).sum())

    @property
    def min_score(self) -> int:
        return int(self.pwm.min(axis=1).sum())

    def pvalue(self, score):
        """P(score or more) of integer scores on the grid."""
        return self.cdf[np.asarray(score) - self.offset]


def scored(m: Motif, bkg=UNIFORM, nsites: float = 1000, pseudo: float = 1) -> Motif:
    """The motif with its integer scores; counts are smoothed as their formats ask.

    Counts of the four-row format are smoothed once as counts and once more as
    probabilities; counts of the row-per-position format are divided by the sum before smoothing.
    """
    b = background(bkg)
    if m.kind == "rows4":
        n = m.counts[0].sum()
        p = (m.counts + pseudo / 4) / (n + pseudo)
        return replace(m, pwm=cell_score(p, b, n, pseudo))
    if m.kind == "columns4":
        p = (m.counts + pseudo / 4) / m.counts.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore"):
            return replace(m, pwm=np.trunc(SCALE * np.log2(p / b)).astype(np.int64))
    return replace(m, pwm=cell_score(m.ppm, b, nsites, pseudo))


def distribution(pwm: np.ndarray, bkg=UNIFORM) -> tuple[np.ndarray, int]:
    """P(score or more) over the score grid and the grid's first score, by convolving columns one at a time."""
    b = background(bkg)
    low = min(0, int(pwm.min()))
    span = int(max(0, pwm.max())) - low
    size = span * len(pwm) + 1
    if size > MAX_GRID:
        raise MotifError(f"score grid of {size} cells is over {MAX_GRID}")
    pdf = np.zeros(size)
    pdf[0] = 1.0
    for i, column in enumerate(pwm):
        new = np.zeros(size)
        top = i * span + 1
        for score, weight in zip(column, b, strict=True):
            at = int(score) - low
            new[at : at + top] += pdf[:top] * weight
        pdf = new
    total = pdf.sum()
    if abs(total - 1) > 1e-4:
        pdf /= total
    return np.minimum(np.cumsum(pdf[::-1])[::-1], 1.0), low * len(pwm)


def with_threshold(m: Motif, pvalue: float | None = 1e-4, bkg=UNIFORM, *, exact: bool = False) -> Motif:
    """The motif with its distribution and threshold: the smallest grid score with P below pvalue.

    pvalue None: threshold 0.  exact: the largest score.  A motif whose best P exceeds
    pvalue by more than 0.01% gets no threshold and never matches.
    """
    cdf, offset = distribution(m.pwm, bkg)
    if exact:
        t = m.max_score
    elif pvalue is None:
        t = 0
    else:
        below = np.flatnonzero(cdf < pvalue)
        best = cdf[m.max_score - offset]
        t = None if best / max(pvalue, 1e-300) > 1.0001 else int(min(below[0] + offset, m.max_score)) if len(below) else m.max_score
    return replace(m, cdf=cdf, offset=offset, threshold=t)


def reverse_complement(matrix: np.ndarray) -> np.ndarray:
    return matrix[::-1, ::-1]


def information(ppm: np.ndarray) -> np.ndarray:
    """Bits of each column, at least 0."""
    p = np.asarray(ppm, dtype=np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.maximum(0.0, 2 + np.where(p > 0, p * np.log2(p), 0.0).sum(axis=1))


def trimmed(m: Motif, bits: float) -> Motif:
    """Without flanking columns of less than so many bits; unchanged if fewer than three would be left."""
    keep = np.flatnonzero(information(m.ppm) >= bits)
    if len(keep) == 0 or keep[-1] - keep[0] + 1 < 3:
        return m
    cut = slice(keep[0], keep[-1] + 1)
    return replace(m, ppm=m.ppm[cut], counts=None if m.counts is None else m.counts[cut], pwm=None if m.pwm is None else m.pwm[cut])


def consensus(ppm: np.ndarray, share: float = 0.75) -> str:
    """Per column the letter of the likeliest bases that reach the share together (ties in the order ACGT)."""
    out = []
    for p in np.asarray(ppm):
        order = np.argsort(-p, kind="stable")
        k = int(np.searchsorted(np.cumsum(p[order]), share - 1e-12)) + 1
        out.append(LETTER["".join(sorted(BASES[i] for i in order[: min(k, 4)]))])
    return "".join(out)


def consensus_by_base(ppm: np.ndarray, least: float = 0.25) -> str:
    """Per column the letter of all bases with at least that probability, else of the likeliest."""
    out = []
    for p in np.asarray(ppm):
        found = [BASES[i] for i in range(4) if p[i] >= least] or [BASES[int(np.argmax(p))]]
        out.append(LETTER["".join(found)])
    return "".join(out)


def max_log_odds(ppm: np.ndarray, bkg=UNIFORM) -> float:
    return float(np.log2(np.maximum(np.asarray(ppm).max(axis=1), 1e-12) / np.maximum(np.asarray(bkg)[np.asarray(ppm).argmax(axis=1)], 1e-12)).sum())


def from_consensus(text: str, *, third: float = 0.333) -> Motif:
    """A motif of an IUPAC string: two letters 0.5 each, three ``third`` each."""
    share = {1: 1.0, 2: 0.5, 3: third, 4: 0.25}
    if not text or len(text) > MAX_WIDTH:
        raise MotifError("a consensus has 1 to 50 letters")
    try:
        sets = [IUPAC[c] for c in text.upper()]
    except KeyError as e:
        raise MotifError(f"{e} is no IUPAC letter") from None
    return Motif(text, np.array([[share[len(s)] if b in s else 0.0 for b in BASES] for s in sets]), kind="consensus")


def smoothed(ppm: np.ndarray, nsites: float, pseudo: float, bkg=UNIFORM) -> np.ndarray:
    return (np.asarray(ppm) * nsites + pseudo * np.asarray(bkg)) / (nsites + pseudo)


def from_counts(name: str, counts: np.ndarray, bkg=UNIFORM, pvalue: float = 1e-4, pseudo: float = 1) -> Motif:
    """A scored motif of a count matrix; if no score is rare enough the threshold is taken at 0.01."""
    n = float(max(1.0, counts.sum(axis=1).max()))
    raw = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    ppm = (raw * n + pseudo / 4) / (n + pseudo)
    m = Motif(name, ppm, nsites=int(n))
    m = replace(m, pwm=cell_score(ppm, background(bkg), n, pseudo, floor=1e-12))
    out = with_threshold(m, pvalue, bkg)
    return out if out.threshold is not None else with_threshold(m, 0.01, bkg)
