"""The byte convolutional network against a plain convolution and finite differences."""

import math

import numpy as np

from pactlake.llm import language_id as li


def net_and_windows():
    rng = np.random.default_rng(4)
    net = li.ByteConvNet(["a", "b", "c"])
    net.p["bias"] = rng.normal(0, 0.2, len(net.p["bias"]))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 3, 40, 252, 256, 300, 700)]
    off = np.cumsum([0, *map(len, texts)])
    codes, row, weight = li.windows_of(np.frombuffer(b"".join(texts), np.uint8), off)
    return net, codes, row, weight, texts


def test_windows_hold_every_byte_once_or_with_its_overlap():
    _, codes, row, weight, texts = net_and_windows()
    for r, text in enumerate(texts):
        mine = codes[row == r]
        back = b"".join(bytes(w[: li.STRIDE if k + 1 < len(mine) else li.WINDOW].astype(np.uint8)[: None if k + 1 < len(mine) else int((w != li.PAD).sum())]) for k, w in enumerate(mine))
        assert back == bytes(c + 32 if 65 <= c <= 90 else c for c in text)


def test_pooled_equals_a_plain_convolution():
    net, codes, *_ = net_and_windows()
    got = net.pooled(codes)
    for w, window in enumerate(codes):
        for j, width in enumerate(li.WIDTHS):
            for f in range(j * li.FILTERS, (j + 1) * li.FILTERS, 5):
                best = max(
                    sum(net.p["vec"][window[at + i]][v] * net.p["conv"][i, v, f] for i in range(width) for v in range(li.VECTOR)) for at in range(li.WINDOW - li.WIDE + 1)
                )
                assert math.isclose(got[w, f], math.tanh(best + net.p["bias"][f]), abs_tol=1e-6)


def test_gradients_equal_finite_differences():
    net, codes, *_ = net_and_windows()
    y, gain = np.arange(len(codes)) % 3, np.array([0.7, 1.0, 1.9])

    def loss():
        lp = net.log_probs(net.pooled(codes))
        return -(gain[y] * lp[np.arange(len(y)), y]).mean()

    g = net.gradients(codes, y, gain)
    rng = np.random.default_rng(9)
    for name, p in net.p.items():
        some = [tuple(rng.integers(0, s) for s in p.shape) for _ in range(25)]
        for at in some:
            if name == "conv" and not net.mask[at] or name == "vec" and at[0] == li.PAD:
                assert g[name][at] == 0
                continue
            held, step = p[at], 1e-6
            p[at] = held + step
            up = loss()
            p[at] = held - step
            down = loss()
            p[at] = held
            assert abs((up - down) / (2 * step) - g[name][at]) < 1e-4 * max(1, abs(g[name][at])), (name, at)
