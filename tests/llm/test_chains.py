"""The line chain against all labelings, and its long form against the plain one."""

import itertools

import numpy as np
import pytest

from pactlake.llm import quality_crf as crf


def enumerated(gain, trans):
    """P(good) of each line and pairwise marginals at the later line, by every labeling of one chain."""
    n = len(gain)
    p, two, total = np.zeros(n), np.zeros((n, 2, 2)), 0.0
    for y in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(gain[t] * y[t] for t in range(n)) + sum(trans[y[t - 1], y[t]] for t in range(1, n)))
        total += w
        p += w * np.array(y)
        for t in range(1, n):
            two[t, y[t - 1], y[t]] += w
    return p / total, two / total


@pytest.mark.parametrize("piece", [1, 2, 3, 256])
def test_marginals_equal_enumeration(monkeypatch, piece):
    monkeypatch.setattr(crf, "PIECE", piece)
    rng = np.random.default_rng(piece)
    sizes = [1, 2, 9, 5, 1, 7, 4]
    row = np.repeat(np.arange(len(sizes)), sizes)
    gain, trans = rng.normal(0, 2, len(row)), rng.normal(0, 1.5, (2, 2))
    p, two = crf.Chains(row).marginals(gain, trans, pairs=True)
    for r in range(len(sizes)):
        at = row == r
        want, pairs = enumerated(gain[at], trans)
        assert np.allclose(p[at], want) and np.allclose(two[at], pairs)


def test_long_chain_equals_plain_one(monkeypatch):
    rng = np.random.default_rng(4)
    gain, trans = rng.normal(0, 2, 3001), rng.normal(0, 1.5, (2, 2))
    plain = crf.Chains(np.zeros(3001, np.int64)).marginals(gain, trans)
    monkeypatch.setattr(crf, "BLOCK_LINES", 700)
    monkeypatch.setattr(crf, "PIECE", 64)
    assert np.allclose(crf.long_marginals(gain, trans), plain)


def test_features_of_blocks_equal_whole(monkeypatch):
    rng = np.random.default_rng(8)
    texts = ["", "a\n\nb b b\n", "\n", "x" * 900 + "\nlast 12"] + ["".join(rng.choice(list("ab c\n.9é"), 300)) for _ in range(20)]
    data = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    buf = np.frombuffer(b"".join(data), np.uint8)
    x, row, size = crf.line_features(buf, off)
    lines = [d.split(b"\n") for d in data]
    lines = [[*(y + b"\n" for y in x[:-1]), *([x[-1]] if x[-1] or len(x) == 1 else [])] for x in lines]
    assert row.tolist() == [i for i, x in enumerate(lines) for _ in x] and size.tolist() == [len(y) for x in lines for y in x]
    model = crf.QualityModel()
    model.w, model.trans = rng.normal(size=len(model.w)), rng.normal(size=(2, 2))
    want = crf.Chains(row).marginals(crf.with_neighbours(x, row) @ model.w, model.trans)
    assert np.allclose(model.good_lines(buf, off)[0], want, atol=1e-4)
    monkeypatch.setattr(crf, "BLOCK_LINES", 5)
    monkeypatch.setattr(crf, "BLOCK_BYTES", 64)
    assert np.allclose(crf.line_features(buf, off)[0], x)
    assert np.allclose(model.good_lines(buf, off)[0], want, atol=1e-4)


def test_a_text_of_line_breaks_alone():
    model = crf.QualityModel()
    model.w[-1] = 0.3
    buf = np.full(2_000_000, 10, np.uint8)
    assert 0 < model.score(buf, np.array([0, len(buf)]))[0] < 1
