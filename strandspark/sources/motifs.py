"""Motif text formats: readers (with detection) and writers; small data, on the driver."""

from __future__ import annotations

import re

import numpy as np

from ..model import MAX_NAME, MAX_WIDTH, Motif, MotifError, background, consensus, consensus_by_base, max_log_odds, normalised

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def detect(text: str) -> str:
    """meme, jaspar, homer or hocomoco."""
    if re.search(r"^MEME version ", text, re.M):
        return "meme"
    at = re.search(r"^>.*$", text, re.M)
    if not at:
        raise MotifError("no motif format recognised")
    body = text[at.end() :].lstrip("\n")
    first = body.split("\n", 1)[0]
    if re.match(r"\s*[Aa]\s*\[", first) or "[" in first:
        return "jaspar"
    if "\t" in at[0]:
        return "homer"
    if "-" in first:
        raise MotifError("log-odds matrices are not read")
    return "hocomoco"


def _name(text: str, full: bool) -> str:
    text = " ".join(text.split()) if full else (text.split() or [""])[0]
    if not text or len(text) > MAX_NAME:
        raise MotifError("a motif name has 1 to 255 characters")
    return text


def _row(line: str) -> list[float]:
    values = [float(x) for x in line.split()]
    if len(values) != 4:
        raise MotifError(f"four values expected: {line!r}")
    return values


def _width(n: int, name: str) -> None:
    if not 0 < n <= MAX_WIDTH:
        raise MotifError(f"motif {name} has {n} columns, 1 to {MAX_WIDTH} are possible")


def read_meme(text: str, full_names: bool = False) -> list[Motif]:
    out, bkg, lines, i = [], None, text.splitlines(), 0
    name = None
    while i < len(lines):
        line = lines[i].strip()
        i += 1
        if line.startswith("ALPHABET"):
            letters = line.split("=", 1)[-1].strip().upper() if "=" in line else line[8:].strip().upper()
            if letters and not set(letters.split()[0]) <= set("ACGTU") and "DNA" not in letters and "RNA" not in letters:
                raise MotifError(f"alphabet {letters} is not of DNA or RNA")
        elif line.startswith("Background letter frequencies") and bkg is None:
            found = []
            while i < len(lines) and len(found) < 4:
                found += re.findall(rf"[ACGTUacgtu]\s+({_NUMBER})", lines[i])
                i += 1
            if len(found) != 4:
                raise MotifError("four background frequencies expected")
            bkg = tuple(background([float(x) for x in found]))
        elif line.startswith("MOTIF"):
            name = _name(line[5:], full_names)
        elif line.startswith("letter-probability matrix") and name is not None:
            n = re.search(r"nsites[ =\t]*(\d+)", line)
            rows = []
            while i < len(lines) and re.match(rf"\s*{_NUMBER}(\s|$)", lines[i]):
                rows.append(normalised(_row(lines[i])))
                i += 1
            _width(len(rows), name)
            out.append(Motif(name, np.array(rows), nsites=int(n[1]) if n and int(n[1]) else None))
            name = None
    for m in out:
        m.bkg = bkg
    return out


def read_homer(text: str, full_names: bool = False) -> list[Motif]:
    out = []
    for block in re.split(r"^>", text, flags=re.M)[1:]:
        head, *rows = block.splitlines()
        parts = head.split("\t")
        if len(parts) < 2:
            raise MotifError("a header has a consensus and a name, parted by a tab")
        name = _name(parts[1], full_names)
        ppm = np.array([normalised(_row(r)) for r in rows if r.strip()])
        _width(len(ppm), name)
        out.append(Motif(name, ppm))
    return out


def read_jaspar(text: str, full_names: bool = False, integers: bool = False) -> list[Motif]:
    out = []
    for block in re.split(r"^>", text, flags=re.M)[1:]:
        head, *rows = block.splitlines()
        name, by = _name(head, full_names), {}
        for r in rows:
            if r.strip():
                m = re.fullmatch(r"\s*([ACGTUacgtu])\s*\[(.*)\]\s*", r)
                if not m or (base := m[1].upper().replace("U", "T")) in by:
                    raise MotifError(f"row {r!r} of motif {name}")
                by[base] = [float(x) for x in m[2].split()]
        if sorted(by) != list("ACGT") or len({len(v) for v in by.values()}) != 1:
            raise MotifError(f"motif {name} needs four rows of one length")
        counts = np.array([by[b] for b in "ACGT"]).T
        _width(len(counts), name)
        if integers and (counts != np.trunc(counts)).any():
            raise MotifError(f"motif {name} has counts that are no integers")
        sums = counts.sum(axis=1)
        if (abs(sums - sums[0]) > 1).any() or (sums <= 0).any():
            raise MotifError(f"motif {name} has columns of different sums")
        out.append(Motif(name, counts / sums[:, None], nsites=int(sums[0] + 0.5), counts=counts, kind="rows4"))
    return out


def read_hocomoco(text: str, full_names: bool = False) -> list[Motif]:
    out = []
    for block in re.split(r"^>", text, flags=re.M)[1:]:
        head, *rows = block.splitlines()
        name = _name(head, full_names)
        counts = np.array([_row(r) for r in rows if r.strip()])
        _width(len(counts), name)
        sums = counts.sum(axis=1)
        if (sums < 0.99).any() or (counts < 0).any():
            raise MotifError(f"motif {name} has rows that are no counts")
        out.append(Motif(name, counts / sums[:, None], nsites=int(sums[0] + 0.5), counts=counts, kind="columns4"))
    return out


READERS = {"meme": read_meme, "homer": read_homer, "jaspar": read_jaspar, "hocomoco": read_hocomoco}


def read(text: str, *, full_names: bool = False, rename: bool = False) -> list[Motif]:
    """Motifs of any format; equal names are an error, or get ``__N<ordinal>`` with ``rename``."""
    motifs = READERS[detect(text)](text, full_names)
    if not motifs:
        raise MotifError("no motifs")
    seen: dict[str, int] = {}
    for i, m in enumerate(motifs, 1):
        if m.name in seen:
            if not rename:
                raise MotifError(f"motif name {m.name} occurs more than once")
            m.name = f"{m.name}__N{i}"
        seen[m.name] = i
    return motifs


def read_file(path: str, **options) -> list[Motif]:
    import gzip

    opener = gzip.open if path.endswith(".gz") else open
    with opener(path, "rt") as f:
        return read(f.read(), **options)


def write_meme(motifs: list[Motif], bkg=(0.25,) * 4, nsites: int = 1000, *, with_consensus: bool = False) -> str:
    """with_consensus: names are cut at the first blank and followed by the motif's consensus, as refined motifs are written."""
    named = lambda m: f"{m.name.split(maxsplit=1)[0]} {consensus(m.ppm)}" if with_consensus else m.name
    out = ["MEME version 4", "", "ALPHABET= ACGT", "", "strands: + -", "", "Background letter frequencies", " ".join(f"{b} {x:.5f}" for b, x in zip("ACGT", bkg, strict=True)), ""]
    for m in motifs:
        out += [f"MOTIF {named(m)}", f"letter-probability matrix: alength= 4 w= {m.width} nsites= {m.nsites or nsites} E= 0", *[" ".join(f"{x:.6f}" for x in r) for r in m.ppm], ""]
    return "\n".join(out) + "\n"


def _whole(m: Motif, nsites: int) -> np.ndarray:
    return np.trunc(m.ppm * (m.nsites or nsites) + 0.5).astype(int)


def write_jaspar(motifs: list[Motif], bkg=None, nsites: int = 1000) -> str:
    return "".join(f">{m.name}\n" + "".join(f"{b} [ " + " ".join(f"{x:4d}" for x in row) + " ]\n" for b, row in zip("ACGT", _whole(m, nsites).T, strict=True)) for m in motifs)


def write_homer(motifs: list[Motif], bkg=(0.25,) * 4, nsites: int = 1000) -> str:
    return "".join(f">{consensus_by_base(m.ppm)}\t{m.name}\t{max_log_odds(m.ppm, bkg):.6f}\n" + "".join("\t".join(f"{x:.3f}" for x in r) + "\n" for r in m.ppm) for m in motifs)


def write_hocomoco(motifs: list[Motif], bkg=None, nsites: int = 1000) -> str:
    return "".join(f">{m.name}\n" + "".join("\t".join(str(x) for x in r) + "\n" for r in _whole(m, nsites)) for m in motifs)


WRITERS = {"meme": write_meme, "jaspar": write_jaspar, "homer": write_homer, "hocomoco": write_hocomoco}


def report(m: Motif) -> str:
    """What was parsed: name, consensus, width, scores and P at five points of the grid."""
    lo, hi = m.min_score, m.max_score
    points = [lo, lo // 2, 0, hi // 2, hi]
    return "\n".join([f"Motif: {m.name} ({consensus(m.ppm)}, width {m.width})", *["\t".join(f"{x / 1000:.3f}" for x in r) for r in m.pwm], *[f"P(score >= {p / 1000:.3f}) = {float(m.pvalue(p)):.9g}" for p in points]])
