import itertools

import numpy as np
import pytest

from strandspark import model
from strandspark.operators.convert import convert
from strandspark.sources import motifs as src

PPM = np.array([[0.7, 0.1, 0.1, 0.1], [0.05, 0.85, 0.05, 0.05], [0.1, 0.1, 0.2, 0.6]])


def test_distribution_is_exact():
    m = model.with_threshold(model.scored(model.Motif("x", PPM)), 0.05)
    every = [sum(int(m.pwm[i][b]) for i, b in enumerate(w)) for w in itertools.product(range(4), repeat=3)]
    for s in set(every):
        assert m.pvalue(s) == pytest.approx(sum(x >= s for x in every) / 64)
    assert all(m.pvalue(s) < 0.05 for s in every if s >= m.threshold) and all(m.pvalue(s) >= 0.05 for s in every if s < m.threshold)


def test_unreachable_and_exact_thresholds():
    m = model.scored(model.Motif("x", PPM))
    assert model.with_threshold(m, 1e-4).threshold is None
    assert model.with_threshold(m, exact=True).threshold == m.max_score
    assert model.with_threshold(m, None).threshold == 0


def test_counts_get_both_pseudocounts():
    m = src.read(">j\nA [ 0 3 ]\nC [ 94 75 ]\nG [ 1 0 ]\nT [ 2 19 ]\n")[0]
    p = (0 + 0.25) / (97 + 1)
    assert model.scored(m).pwm[0, 0] == int(1000 * np.log2(((p * 97 + 0.25) / 98) / 0.25))


@pytest.mark.parametrize("fmt", ["meme", "jaspar", "homer", "hocomoco"])
def test_round_trip(fmt):
    text = src.write_meme([model.Motif("a", PPM, nsites=100), model.Motif("b", PPM[::-1])])
    other = convert(text, fmt)
    assert src.detect(other) == fmt
    back = src.read(convert(other, "meme"))
    assert [m.name for m in back] == ["a", "b"] and np.allclose(back[0].ppm, PPM, atol=0.02)
    assert convert(other, fmt) == other or fmt == "meme"


def test_refined_motifs_are_named_with_their_consensus():
    m = model.Motif("id1 long name", np.array([[0.97, 0.01, 0.01, 0.01], [0.01, 0.97, 0.01, 0.01], [0.01, 0.01, 0.01, 0.97]]))
    text = src.write_meme([m], with_consensus=True)
    assert "MOTIF id1 ACT\n" in text and "MOTIF id1 long name\n" in src.write_meme([m])


def test_limits_of_motifs():
    flat = model.Motif("f", np.full((51, 4), 0.25))
    with pytest.raises(model.MotifError):
        src.read(src.write_meme([flat]))
    with pytest.raises(model.MotifError):
        model.distribution(np.array([[3_000_000, 0, 0, 0]]))
    p = np.array([0.4, 0.1995, 0.4, 0.0005])
    assert np.allclose(model.smoothed(np.array([[1.0, 0, 0, 0]]), 9, 1), [[(9 + 0.25) / 10, 0.025, 0.025, 0.025]]) and model.background(p).min() > 0.0005
    odd = model.from_counts("x", np.array([[1, 1, 1, 1]]), pvalue=1e-4)
    assert odd.threshold is not None or odd.cdf is not None


def test_bad_motifs():
    for bad in (">x\n0.1 0.2 0.3\n", ">x\nA [ 1 ]\nC [ 1 ]\nG [ 1 ]\n", "nothing", ">c\tn\t1\n0.9 0.9 0.1 0.1\n"):
        with pytest.raises(model.MotifError):
            src.read(bad)
    twice = src.write_meme([model.Motif("a", PPM)] * 2)
    with pytest.raises(model.MotifError):
        src.read(twice)
    assert [m.name for m in src.read(twice, rename=True)] == ["a", "a__N2"]


def test_consensus_rules():
    assert model.consensus(np.array([[0.8, 0.1, 0.05, 0.05], [0.5, 0.0, 0.5, 0.0]])) == "AR"
    assert model.consensus_by_base(np.array([[0.24, 0.24, 0.26, 0.26]])) == "K"
    assert np.allclose(model.from_consensus("R").ppm, [[0.5, 0, 0.5, 0]])
