"""Linear-chain conditional random fields over words, in numpy.

A word's features are strings, hashed into rows of the weights. Sequences are handled many at a
time; long ones are cut into segments whose exact messages are carried over by products of small
transfer matrices, so the number of numpy calls does not follow the longest text.

Defined cases: no labelled sequence leaves all weights at 0, so every label is equally likely; sequences have a word
at least, and callers leave out empty ones; ties go to the first label; repeated sequences have equal results.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np

#: Rows of hashed weights; words of a segment in the exact forward-backward pass; places of a batch of sequences.
ROWS, SEGMENT, CELLS = 1 << 18, 32, 1 << 17


class ChainCRF:
    def __init__(self, labels: list[str], features: Callable[[object], list[str]], rows: int = ROWS):
        self.labels, self.features, self.rows = labels, features, rows
        self.weights = np.zeros((rows, len(labels)), "float32")
        self.moves = np.zeros((len(labels), len(labels)))

    def rows_of(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the features of all words, one word after another, and how many each has."""
        if hasattr(self.features, "rows"):
            return self.features.rows(words, self.rows)
        found = [[zlib.crc32(f.encode("utf-8", "surrogatepass")) % self.rows for f in self.features(w)] for w in words]
        return np.fromiter((i for x in found for i in x), "int64"), np.array([len(x) for x in found], "int64")

    def scores(self, words: list) -> np.ndarray:
        """Emission scores of words, before any context."""
        flat, sizes = self.rows_of(words)
        out, some = np.zeros((len(words), len(self.labels))), sizes > 0
        if len(flat):
            out[some] = np.add.reduceat(self.weights[flat], (np.cumsum(sizes) - sizes)[some], 0)
        return out

    def fit(self, sequences: list[tuple[list, list[int]]], rounds: int = 40, rate: float = 0.3, decay: float = 1e-4, step: int = SEGMENT) -> None:
        """Full-batch adaptive gradients on the likelihood of the labelled sequences, cut into pieces of `step` words."""
        pieces = [(w[i : i + step], y[i : i + step]) for w, y in sequences for i in range(0, len(w), step)]
        if not pieces:
            return
        index = {w: i for i, w in enumerate(dict.fromkeys(w for words, _ in pieces for w in words))}
        n, k = len(pieces), len(self.labels)
        ids, gold, real = np.zeros((n, step), "int64"), np.zeros((n, step), "int64"), np.zeros((n, step), bool)
        for i, (w, y) in enumerate(pieces):
            ids[i, : len(w)], gold[i, : len(w)], real[i, : len(w)] = [index[x] for x in w], y, True
        flat, held = self.rows_of(list(index))
        word = np.repeat(np.arange(len(index)), held)
        used, row = np.unique(flat, return_inverse=True)
        count = np.zeros((len(index), k))
        np.add.at(count, (ids[real], gold[real]), 1)
        pairs = real[:, 1:]
        moved = np.zeros((k, k))
        np.add.at(moved, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
        w, t = np.zeros((len(used), k)), np.zeros((k, k))
        gw, gt, total = np.full(w.shape, 1e-6), np.full(t.shape, 1e-6), real.sum()
        sums = lambda at, values, m: np.stack([np.bincount(at, values[:, j], m) for j in range(k)], 1)
        for _ in range(rounds):
            emit = sums(word, w[row], len(index))
            mean, both = self._expected(emit[ids], t, real)
            grad_words = count - sums(ids[real], mean[real], len(index))
            grad_w = sums(row, grad_words[word], len(used)) / total - decay * w / len(used)
            grad_t = (moved - both) / total
            gw, gt = gw + grad_w**2, gt + grad_t**2
            w += rate * grad_w / np.sqrt(gw)
            t += rate * grad_t / np.sqrt(gt)
        self.weights = np.zeros((self.rows, k), "float32")
        self.weights[used] = w
        self.moves = t

    def _expected(self, emit: np.ndarray, moves: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = np.exp(emit - emit.max(2, keepdims=True))
        e[~real] = 1
        a, n = np.exp(moves - moves.max()), emit.shape[1]
        forward, backward = np.empty_like(e), np.ones_like(e)
        forward[:, 0] = a.sum(0) * e[:, 0]
        for i in range(n):
            if i:
                forward[:, i] = forward[:, i - 1] @ a * e[:, i]
            forward[:, i] /= forward[:, i].sum(1, keepdims=True)
        for i in range(n - 2, -1, -1):
            b = (e[:, i + 1] * backward[:, i + 1]) @ a.T
            backward[:, i] = np.where(real[:, i + 1, None], b / b.sum(1, keepdims=True), 1)
        mean = forward * backward
        mean /= mean.sum(2, keepdims=True)
        both = np.zeros_like(moves)
        for i in range(n - 1):
            now = forward[:, i, :, None] * a * (e[:, i + 1] * backward[:, i + 1])[:, None, :]
            now /= now.sum((1, 2), keepdims=True)
            both += now[real[:, i + 1]].sum(0)
        return mean, both

    def marginals(self, emit: np.ndarray, sizes: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
        """Probabilities of each word's labels by exact forward-backward; `sizes`: words of each sequence, all over 0."""
        k, a = len(self.labels), np.exp(self.moves - self.moves.max())
        per = -(-sizes // segment)  # segments of each sequence
        first = np.cumsum(per) - per
        total = int(per.sum())
        begin = np.cumsum(sizes) - sizes
        at = np.repeat(first * segment - begin, sizes) + np.arange(int(sizes.sum()))
        e = np.ones((total * segment, k))
        e[at] = np.exp(emit - emit.max(1, keepdims=True))
        real = np.zeros(total * segment, bool)
        real[at] = True
        e, real = e.reshape(total, segment, k), real.reshape(total, segment)
        into, back = np.ones((total, k)), np.ones((total, k))
        if total > len(sizes):  # messages between the segments of a sequence
            last = np.zeros(total, bool)
            last[first + per - 1] = True
            inner = np.flatnonzero(~last)
            product = np.broadcast_to(np.eye(k), (len(inner), k, k)).copy()
            for i in range(segment):
                product = (product.reshape(-1, k) @ a).reshape(-1, k, k) * e[inner, i, None, :]
                if i % 4 == 3:
                    product /= product.reshape(len(inner), -1).max(1)[:, None, None]
            of = np.full(total, -1)
            of[inner] = np.arange(len(inner))
            for step in range(1, int(per.max())):
                s = (first + step)[per > step]
                m = (into[s - 1][:, :, None] * product[of[s - 1]]).sum(1)
                into[s] = m / m.sum(1, keepdims=True)
            head = self._head(e, real, a)
            for step in range(int(per.max()) - 1, 0, -1):
                s = (first + step - 1)[per > step]
                nxt = s + 1
                tail = np.where(last[nxt][:, None], head[nxt], 0.0)
                mid = ~last[nxt]
                if mid.any():
                    tail[mid] = (product[of[nxt[mid]]] * back[nxt[mid]][:, None, :]).sum(2)
                back[s] = tail / tail.sum(1, keepdims=True)
        forward, backward = np.empty_like(e), np.empty_like(e)
        message = into
        for i in range(segment):
            message = message @ a * e[:, i]
            message = message / message.sum(1, keepdims=True)
            forward[:, i] = message
        backward[:, segment - 1] = back
        for i in range(segment - 2, -1, -1):
            b = (e[:, i + 1] * backward[:, i + 1]) @ a.T
            backward[:, i] = np.where(real[:, i + 1, None], b / b.sum(1, keepdims=True), 1)
        mean = (forward * backward).reshape(-1, k)[at]
        return mean / mean.sum(1, keepdims=True)

    @staticmethod
    def _head(e: np.ndarray, real: np.ndarray, a: np.ndarray) -> np.ndarray:
        """For each segment as the last of its sequence: the message back to before its first word."""
        message = np.ones((len(e), e.shape[2]))
        for i in range(e.shape[1] - 1, -1, -1):
            b = (e[:, i] * message) @ a.T
            message = np.where(real[:, i, None], b / b.sum(1, keepdims=True), 1)
        return message

    def viterbi(self, emit: np.ndarray, sizes: np.ndarray, cells: int = CELLS) -> np.ndarray:
        """Best labels of each sequence, many of like size at a time: at most `cells` places, or one sequence."""
        begin, out = np.cumsum(sizes) - sizes, np.zeros(int(sizes.sum()), "int64")
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            held = sizes[order[at:]] * np.arange(1, len(order) - at + 1)  # places if padded to the longest so far
            n = max(1, int(np.searchsorted(held, cells, "right")))
            part, at = order[at : at + n], at + n
            longest = int(sizes[part[-1]])
            back = np.zeros((longest, n, len(self.labels)), "int8")
            best = emit[begin[part]].astype("float64")
            for i in range(1, longest):
                on = slice(int(np.searchsorted(sizes[part], i, "right")), None)  # sizes ascend
                reach = best[on][:, :, None] + self.moves
                back[i, on] = reach.argmax(1)
                best[on] = reach.max(1) + emit[begin[part][on] + i]
            label = best.argmax(1)
            for i in range(longest - 1, -1, -1):
                on = slice(int(np.searchsorted(sizes[part], i, "right")), None)
                out[begin[part][on] + i] = label[on]
                if i:
                    label[on] = back[i, np.arange(n)[on], label[on]]
        return out
