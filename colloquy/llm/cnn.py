"""A small convolutional network over symbol windows, in numpy.

embedding -> filters of several widths -> max over positions -> ReLU -> one linear layer.
Training keeps only the position of each filter's maximum for the way back, as no other
position gets a gradient. For inference the embedding and the filters fold into tables over pairs of
symbols, so a window costs a few row look-ups and additions per position.
"""

from __future__ import annotations

import numpy as np

STEP = 64  # windows worked on at once; keeps the intermediate arrays in the processor's cache


class SymbolCnn:
    """Windows are arrays (n, length) of symbols below ``symbols``; symbol 0 is padding."""

    def __init__(self, symbols: int, classes: int, dim: int = 8, widths=(2, 3, 4), filters: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.symbols, self.span = symbols, 2 * ((max(widths) + 1) // 2)
        total = filters * len(widths)
        self.embed = rng.normal(0, 0.5, (symbols, dim)).astype(np.float32)
        self.mask = np.zeros((self.span, 1, total), np.float32)
        for k, width in enumerate(widths):
            self.mask[:width, :, k * filters:(k + 1) * filters] = 1
        self.conv = (rng.normal(0, 0.3, (self.span, dim, total)) * self.mask).astype(np.float32)
        self.bias = np.zeros(total, np.float32)
        self.out = rng.normal(0, 0.3, (total, classes)).astype(np.float32)
        self.shift = np.zeros(classes, np.float32)
        self.tables = None

    def _params(self):
        return [self.embed, self.conv, self.bias, self.out, self.shift]

    def _forward(self, windows: np.ndarray):
        places = windows.shape[1] - self.span + 1
        x = self.embed[windows]
        maps = sum(x[:, o:o + places] @ self.conv[o] for o in range(self.span))
        best = maps.argmax(axis=1)
        top = np.take_along_axis(maps, best[:, None, :], axis=1)[:, 0] + self.bias
        return best, top, np.maximum(top, 0)

    def fit(self, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None, epochs: int = 8,
            batch: int = 64, rate: float = 0.01, seed: int = 11) -> "SymbolCnn":
        rng, n = np.random.default_rng(seed), len(labels)
        weights = np.ones(n, np.float32) if weights is None else weights.astype(np.float32)
        first = [np.zeros_like(p) for p in self._params()]
        second = [np.zeros_like(p) for p in self._params()]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(n)
            for start in range(0, n, batch):
                rows = order[start:start + batch]
                step += 1
                for p, g, m, v in zip(self._params(), self._gradients(windows[rows], labels[rows], weights[rows]),
                                      first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
            rate *= 0.8
        return self

    def _gradients(self, windows, labels, weights):
        n, (best, top, hidden) = len(labels), self._forward(windows)
        error = softmax(hidden @ self.out + self.shift)
        error[np.arange(n), labels] -= 1
        error *= (weights / n)[:, None]
        back = (error @ self.out.T) * (top > 0)  # (n, filters)
        d_embed, d_conv = np.zeros_like(self.embed), np.zeros_like(self.conv)
        for o in range(self.span):
            seen = np.take_along_axis(windows, best + o, axis=1)  # symbol under each filter's maximum
            d_conv[o] = np.einsum("nf,nfd->df", back, self.embed[seen])
            np.add.at(d_embed, seen, back[:, :, None] * self.conv[o].T[None])
        return [d_embed, d_conv * self.mask, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]

    def folded(self) -> "SymbolCnn":
        """Tables over symbol pairs for each pair of filter columns."""
        single = [self.embed @ self.conv[o] for o in range(self.span)]
        self.tables = [(single[o][:, None, :] + single[o + 1][None, :, :]).reshape(self.symbols ** 2, -1)
                       for o in range(0, self.span, 2)]
        return self

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        if self.tables is None:
            self.folded()
        result = np.empty((len(windows), self.out.shape[1]), np.float32)
        places = windows.shape[1] - self.span + 1
        for start in range(0, len(windows), STEP):
            some = windows[start:start + STEP].astype(np.int32)
            pairs = some[:, :-1] * self.symbols + some[:, 1:]
            maps = self.tables[0][pairs[:, :places]]
            for k, rows in enumerate(self.tables[1:], 1):
                maps += rows[pairs[:, 2 * k:2 * k + places]]
            hidden = np.maximum(maps.max(axis=1) + self.bias, 0)
            result[start:start + STEP] = softmax(hidden @ self.out + self.shift)
        return result


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def text_windows(data: np.ndarray, offsets: np.ndarray, width: int):
    """Windows of ``width`` bytes over every text of an Arrow string column.

    Yields (matrix of windows, text number of each, bytes in each) a few thousand at a time; the
    last window of a text is padded with 0. Texts are covered whole; empty texts have no window.
    """
    lengths = np.diff(offsets)
    counts = -(-lengths // width)
    owners = np.repeat(np.arange(len(lengths)), counts)
    number = np.arange(len(owners)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[:-1][owners] + number * width
    sizes = np.minimum(width, offsets[1:][owners] - starts)
    columns = np.arange(width)
    for at in range(0, len(owners), 4096):
        part = slice(at, at + 4096)
        begin = starts[part]
        matrix = data[np.minimum(begin[:, None] + columns, len(data) - 1)]
        short = np.flatnonzero(sizes[part] < width)
        matrix[short] *= columns < sizes[part][short][:, None]
        yield matrix, owners[part], sizes[part]


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without nulls; offsets start anywhere."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, wide)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    return data, offsets
