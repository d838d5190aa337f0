"""Linear-chain CRF on batches of sequences: best path, partition function, marginals, expectations.

Sequences of a batch are padded to the longest of a group of similar lengths,
and each step over the positions works on the whole group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def groups(offsets: np.ndarray, cells: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences by length in groups of at most ``cells`` padded positions: their numbers, lengths, and an index
    (sequence, position) into the rows; positions after the end repeat the last row."""
    sizes = np.diff(offsets)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * sizes[order[end]] <= cells:
            end += 1
        own = order[at:end]
        n = sizes[own]
        yield own, n, offsets[own][:, None] + np.minimum(np.arange(n.max())[None, :], n[:, None] - 1)
        at = end


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def viterbi(e: np.ndarray, a: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The best label of each row; of equal paths the one with the smaller labels, from the end."""
    out = np.zeros(len(e), np.int64)
    for own, n, rows in groups(offsets):
        rows = rows.T
        s = e[rows]
        best = s[0]
        back = np.zeros(s.shape, np.int16)
        final = np.where((n == 1)[:, None], best, 0.0)
        for t in range(1, len(s)):
            top = best[:, :1] + a[0]
            for k in range(1, len(a)):
                other = best[:, k, None] + a[k]
                # of equal ones the first stays
                back[t][other > top] = k
                top = np.maximum(top, other)
            best = top + s[t]
            final[n == t + 1] = best[n == t + 1]
        y = final.argmax(1)
        k = np.arange(len(own))
        for t in range(len(s) - 1, -1, -1):
            live = n > t
            out[rows[t, live]] = y[live]
            if t:
                y = np.where(live, back[t, k, y], y)
    return out


def _step(a: np.ndarray):
    """``log(sum(exp(x + a)))`` over the first side of ``a``, for rows ``x``."""
    if np.ptp(a) > 500:  # the exponentials alone would vanish
        return lambda x: _lse(x[:, :, None] + a[None], 1)
    high = a.max()
    factor = np.exp(a - high)

    def run(x: np.ndarray) -> np.ndarray:
        top = x.max(axis=1, keepdims=True)
        return np.log(np.exp(x - top) @ factor) + (top + high)

    return run


def log_partition(e: np.ndarray, a: np.ndarray, offsets: np.ndarray, marginals: bool = True, pairs: bool = False):
    """The log of the sum over all paths, per sequence; the label marginals of each row; the expected transitions of all."""
    z = np.zeros(len(offsets) - 1)
    m = np.zeros_like(e)
    expected = np.zeros_like(a)
    forward, backward = _step(a), _step(a.T)
    for own, n, rows in groups(offsets):
        rows = rows.T
        s = e[rows]
        length, size, k = s.shape
        alpha = np.empty_like(s)
        alpha[0] = s[0]
        for t in range(1, length):
            alpha[t] = forward(alpha[t - 1]) + s[t]
        last = alpha[n - 1, np.arange(size)]
        z[own] = _lse(last, 1)
        if not marginals:
            continue
        beta = np.zeros((size, k))
        for t in range(length - 1, -1, -1):
            live = n > t
            p = np.exp(np.minimum(alpha[t] + beta - z[own][:, None], 0.0))
            m[rows[t, live]] = p[live]
            if t:
                ahead = s[t] + beta
                if pairs:
                    joint = np.exp(np.minimum(alpha[t - 1][:, :, None] + a[None] + ahead[:, None, :] - z[own][:, None, None], 0.0))
                    expected += joint[live].sum(0)
                beta = np.where(live[:, None], backward(ahead), 0.0)
    return z, m, expected


def path_score(e: np.ndarray, a: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The score of given labels, per sequence."""
    rows = e[np.arange(len(e)), y]
    steps = np.zeros(len(e))
    steps[1:] = a[y[:-1], y[1:]]
    steps[offsets[:-1][offsets[:-1] < len(e)]] = 0.0
    total = np.concatenate([[0.0], np.cumsum(rows + steps)])
    return total[offsets[1:]] - total[offsets[:-1]]
