"""Motif formats into one another, through probabilities."""

from __future__ import annotations

import numpy as np

from ..model import UNIFORM, Motif, MotifError, trimmed
from ..sources.motifs import WRITERS, read


def convert(text: str, to: str, *, trim: float | None = None, nsites: int | None = None, pseudo: float = 0, bkg=UNIFORM, full_names: bool = False) -> str:
    """The motifs of a text in another format (or the same, made regular); nsites: instead of the motifs' own."""
    if to not in WRITERS or trim is not None and not 0 <= trim <= 2:
        raise MotifError("no such format or number of bits")
    out: list[Motif] = []
    for m in read(text, full_names=full_names):
        if m.counts is not None and pseudo:
            n = 1000.0
            m.ppm = (m.ppm * n + pseudo / 4) / (n + pseudo)
        m.nsites = nsites or m.nsites
        m = trimmed(m, trim) if trim is not None else m
        m.ppm = m.ppm / np.maximum(m.ppm.sum(axis=1, keepdims=True), 1e-12)
        out.append(m)
    return WRITERS[to](out, bkg, 1000)
