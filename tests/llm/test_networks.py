"""The networks against plain loops: forward passes number by number, gradients by finite differences."""

from math import exp, tanh

import numpy as np
import pytest

from colloquy.llm import cnn, quality


def cnn_by_hand(net, window):
    hidden = []
    for f in range(len(net.bias)):
        best = max(sum(float(net.embed[window[at + o]][d]) * float(net.conv[o][d][f])
                       for o in range(net.span) for d in range(net.embed.shape[1]))
                   for at in range(len(window) - net.span + 1))
        hidden.append(max(best + float(net.bias[f]), 0.0))
    z = [sum(h * float(net.out[f][c]) for f, h in enumerate(hidden)) + float(net.shift[c]) for c in range(net.out.shape[1])]
    total = sum(exp(v) for v in z)
    return [exp(v) / total for v in z]


@pytest.mark.parametrize("widths", [(3, 4, 6), (2, 3, 5), (1, 2)])
def test_symbol_network(widths):
    rng = np.random.default_rng(3)
    net = cnn.SymbolCnn(20, 3, dim=4, widths=widths, filters=5)
    windows = rng.integers(0, 20, (12, 15)).astype(np.uint8)
    net.fit(windows, np.arange(12) % 3, epochs=2)
    net.tables = None
    got = net.probabilities(windows)
    assert np.allclose(got, [cnn_by_hand(net, w) for w in windows.tolist()], atol=1e-5)


def slopes(values, loss, step=1e-5):
    """Finite differences of ``loss`` for each number of ``values`` (changed in place and put back)."""
    out = np.zeros_like(values)
    for at in np.ndindex(values.shape):
        kept = values[at]
        values[at] = kept + step
        above = loss()
        values[at] = kept - step
        out[at] = (above - loss()) / (2 * step)
        values[at] = kept
    return out


def test_gradients_of_the_symbol_network():
    rng = np.random.default_rng(4)
    net = cnn.SymbolCnn(9, 3, dim=3, widths=(2, 3), filters=4)
    for name in ("embed", "conv", "bias", "out", "shift", "mask"):
        setattr(net, name, getattr(net, name).astype(float))
    windows, labels, weights = rng.integers(0, 9, (6, 8)), np.arange(6) % 3, rng.random(6) + 0.5

    def loss():
        _, _, hidden = net._forward(windows)
        p = cnn.softmax(hidden @ net.out + net.shift)
        return float(-(weights * np.log(p[np.arange(6), labels])).mean())

    found = net._gradients(windows, labels, weights)
    for name, got in zip(("embed", "conv", "bias", "out", "shift"), found, strict=True):
        want = slopes(getattr(net, name), loss)
        assert np.allclose(got, want * net.mask if name == "conv" else want, atol=1e-5), name


def bag(seed=5, documents=5):
    rng = np.random.default_rng(seed)
    owners = np.sort(np.concatenate([np.arange(documents), rng.integers(0, documents, 9)]))
    features = rng.random((len(owners), quality.FEATURES))
    net = quality.BagNetwork()
    net.params = [p.astype(float) for p in net.params]
    net.mean, net.spread = features.mean(axis=0), features.std(axis=0) + 0.02
    return net, features, owners


def odds_by_hand(net, rows):
    w1, b1, v, u, w, c, c0 = net.params
    energies, codes = [], []
    for x in rows:
        x = [(a - m) / s for a, m, s in zip(x, net.mean, net.spread, strict=True)]
        h = [tanh(sum(x[i] * w1[i][j] for i in range(len(x))) + b1[j]) for j in range(len(b1))]
        gate = [tanh(sum(h[j] * v[j][k] for j in range(len(h)))) / (1 + exp(-sum(h[j] * u[j][k] for j in range(len(h)))))
                for k in range(len(w))]
        energies.append(sum(g * a for g, a in zip(gate, w, strict=True)))
        codes.append(h)
    total = sum(exp(e) for e in energies)
    mean = [sum(exp(e) / total * h[j] for e, h in zip(energies, codes, strict=True)) for j in range(len(c))]
    return sum(m * a for m, a in zip(mean, c, strict=True)) + c0[0]


def test_bag_network():
    net, features, owners = bag()
    got = net.log_odds(*net.passages(features), owners, 5)
    assert np.allclose(got, [odds_by_hand(net, features[owners == d]) for d in range(5)], atol=1e-5)


def test_gradients_of_the_bag_network():
    net, features, owners = bag(6, 4)
    truth, weights = np.array([0.0, 1, 1, 0]), np.array([1.0, 0.5, 2, 1])

    def loss():
        p = 1 / (1 + np.exp(-net.log_odds(*net.passages(features), owners, 4)))
        return float(-(weights * (truth * np.log(p) + (1 - truth) * np.log(1 - p))).mean())

    found = net.gradients(features, owners, 4, truth, weights)
    for k, got in enumerate(found):
        if k:  # the first layer is large: some of its rows
            assert np.allclose(got, slopes(net.params[k], loss), atol=1e-5), k
    some = net.params[0][:3]
    assert np.allclose(found[0][:3], slopes(some, loss), atol=1e-5)


def test_features_by_hand():
    """Shares of pairs of classes, and of bytes equal to those before, of one padded passage."""
    text = b"The cat, the cat: 12\n\xc3\xa9!"
    row = np.zeros((1, quality.PASSAGE), np.uint8)
    row[0, :len(text)] = np.frombuffer(text, np.uint8)
    table = quality.byte_classes()
    counts = np.zeros(quality.FEATURES)
    padded = row[0].tolist()
    for a, b in zip(padded, padded[1:], strict=False):
        counts[int(table[a]) * quality.CLASSES + int(table[b])] += 1
    counts[0] = 0
    for k, lag in enumerate(quality.LAGS):
        counts[quality.CLASSES ** 2 + k] = sum(padded[i] == padded[i - lag] and padded[i] > 0 for i in range(lag, len(padded)))
    got = quality.passage_features(row, np.array([len(text)]))[0]
    assert np.allclose(got, np.sqrt(counts / len(text)), atol=1e-5)
