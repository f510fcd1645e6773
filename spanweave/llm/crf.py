"""Linear-chain conditional random fields over small sets of flags, fitted and decoded in numpy.

An item (a word or a line) has an integer whose bits are its flags.  Emissions are the sums of the weights of its own
flags and of its neighbours'; a table by that integer makes them one look-up.  Decoding is Viterbi over a batch of
padded sequences, one step for all sequences at once.
"""

from __future__ import annotations

import numpy as np


def _bits(codes: np.ndarray, n_flags: int) -> np.ndarray:
    """Flags as 0 and 1, with a constant one."""
    return np.concatenate([(codes[..., None] >> np.arange(n_flags)) & 1, np.ones((*codes.shape, 1), np.int64)], -1).astype(np.float64)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Crf:
    def __init__(self, n_flags: int, n_tags: int):
        self.n_flags, self.n_tags = n_flags, n_tags
        shape = (n_flags + 1, n_tags)
        self.own, self.before, self.after = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        self.step, self.first, self.last = np.zeros((n_tags, n_tags)), np.zeros(n_tags), np.zeros(n_tags)
        self._tables = None

    def fit(self, sequences: list[tuple[list[int], list[int]]], rounds: int = 300, rate: float = 0.1, decay: float = 0.01) -> Crf:
        """Maximum likelihood with an L2 penalty by Adam; ``sequences``: codes and tags of each."""
        n, t = len(sequences), max(len(c) for c, _ in sequences)
        codes, tags, real = np.zeros((n, t), np.int64), np.zeros((n, t), np.int64), np.zeros((n, t), bool)
        for i, (c, y) in enumerate(sequences):
            codes[i, : len(c)], tags[i, : len(c)], real[i, : len(c)] = c, y, True
        size = real.sum(1)
        x = _bits(codes, self.n_flags) * real[..., None]
        prev, nxt = np.zeros_like(x), np.zeros_like(x)
        prev[:, 1:], nxt[:, :-1] = x[:, :-1], x[:, 1:]
        gold = np.eye(self.n_tags)[tags] * real[..., None]
        params = [self.own, self.before, self.after, self.step, self.first, self.last]
        speed, spread = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        rows = np.arange(n)
        for k in range(1, rounds + 1):
            emit = x @ self.own + prev @ self.before + nxt @ self.after
            alpha, beta = np.zeros((n, t, self.n_tags)), np.zeros((n, t, self.n_tags))
            alpha[:, 0] = self.first + emit[:, 0]
            for i in range(1, t):
                now = _logsum(alpha[:, i - 1, :, None] + self.step, 1) + emit[:, i]
                alpha[:, i] = np.where(real[:, i, None], now, alpha[:, i - 1])
            beta[:, t - 1] = self.last
            for i in range(t - 2, -1, -1):
                now = _logsum(self.step + (emit[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
                beta[:, i] = np.where(real[:, i + 1, None], now, self.last)
            total = _logsum(alpha[:, t - 1] + self.last, 1)
            single = np.exp(alpha + beta - total[:, None, None]) * real[..., None]
            pair = np.exp(alpha[:, :-1, :, None] + self.step + (emit + beta)[:, 1:, None, :] - total[:, None, None, None]) * real[:, 1:, None, None]
            miss = gold - single
            grads = [np.einsum("ntf,ntk->fk", x, miss), np.einsum("ntf,ntk->fk", prev, miss), np.einsum("ntf,ntk->fk", nxt, miss)]
            grads += [np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:]) - pair.sum((0, 1)), miss[:, 0].sum(0), miss[rows, size - 1].sum(0)]
            for p, g, s, v in zip(params, grads, speed, spread, strict=True):
                g = g / n - decay * p
                s += 0.1 * (g - s)
                v += 0.01 * (g * g - v)
                p += rate * (s / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        self._tables = None
        return self

    @property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emissions by code: of the item itself, and what it adds to the one after and before it."""
        if self._tables is None:
            bits = _bits(np.arange(1 << self.n_flags), self.n_flags)
            self._tables = bits @ self.own, bits @ self.before, bits @ self.after
        return self._tables

    def emissions(self, codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Scores of all tags for a row of items; ``owner`` tells the sequences apart."""
        own, before, after = self.tables
        out = own[codes]
        same = owner[1:] == owner[:-1]
        out[1:] += before[codes[:-1]] * same[:, None]
        out[:-1] += after[codes[1:]] * same[:, None]
        return out

    def silent(self, code: int = 0, tag: int = 0) -> bool:
        """Whether a sequence of nothing but ``code`` is sure to be all ``tag``: each step of that path is the best."""
        emit = sum(t[code] for t in self.tables)
        ends = [self.tables[0][code], self.tables[0][code] + self.tables[1][code], self.tables[0][code] + self.tables[2][code], emit]
        for e in ends:
            score = self.step + e
            if (score > score[tag, tag] + 1e-12).any() or (self.first + e > self.first[tag] + e[tag] + 1e-12).any():
                return False
        return bool((self.last <= self.last[tag] + 1e-12).all())

    def decode(self, codes: np.ndarray, owner: np.ndarray, batch: int = 1 << 20) -> np.ndarray:
        """The best tags of all items; ``owner`` is ascending.  A batch has about ``batch`` padded items."""
        tags = np.zeros(len(codes), np.int64)
        if not len(codes):
            return tags
        emit = self.emissions(codes, owner)
        starts = np.flatnonzero(np.diff(owner, prepend=owner[0] - 1))
        sizes = np.diff(starts, append=len(codes))
        order = np.argsort(sizes, kind="stable")
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and sizes[order[j]] * (j + 1 - i) <= batch:
                j += max(1, min(len(order) - j, (j - i) // 2))
                if j < len(order) and sizes[order[j - 1]] * (j - i) > batch:
                    j = i + max(1, batch // int(sizes[order[j - 1]]))
                    break
            group = order[i : min(j, len(order))]
            self._decode(emit, starts[group], sizes[group], tags)
            i += len(group)
        return tags

    def _decode(self, emit: np.ndarray, starts: np.ndarray, sizes: np.ndarray, tags: np.ndarray) -> None:
        n, t = len(starts), int(sizes.max())
        back = np.zeros((t, n, self.n_tags), np.int8)
        score = self.first + emit[starts]
        for i in range(1, t):
            live = np.searchsorted(sizes, i, "right")  # sizes ascend: sequences from here on have item i
            ways = score[live:, :, None] + self.step
            back[i, live:] = ways.argmax(1)
            score[live:] = ways.max(1) + emit[starts[live:] + i]
        best = (score + self.last).argmax(1)
        for i in range(t - 1, -1, -1):
            live = np.searchsorted(sizes, i, "right")
            tags[starts[live:] + i] = best[live:]
            if i:
                best[live:] = back[i, np.arange(live, n), best[live:]]
