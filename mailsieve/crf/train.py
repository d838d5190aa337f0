"""Training: penalised likelihood by L-BFGS (orthant-wise where there is an L1 penalty), or an online method."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LABELS
from .encode import ATTRIBUTES, attributes
from .kernels import log_partition, path_score, viterbi
from .model import CrfModel

ALGORITHMS = ("lbfgs", "l2sgd", "ap", "pa", "arow")


def likelihood(w: np.ndarray, x: np.ndarray, y: np.ndarray, offsets: np.ndarray, k: int) -> tuple[float, np.ndarray]:
    """Minus the log likelihood and its gradient; ``w`` has the weights of states, then those of transitions."""
    state, a = w[: x.shape[1] * k].reshape(-1, k), w[x.shape[1] * k :].reshape(k, k)
    e = x @ state
    z, m, expected = log_partition(e, a, offsets, pairs=True)
    m[np.arange(len(y)), y] -= 1
    inner = np.ones(len(y), bool)
    inner[offsets[:-1][offsets[:-1] < len(y)]] = False
    at = np.flatnonzero(inner)
    np.add.at(expected, (y[at - 1], y[at]), -1)
    return float(z.sum() - path_score(e, a, offsets, y).sum()), np.concatenate([(x.T @ m).ravel(), expected.ravel()])


def minimize(f: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, c1: float, steps: int, memory: int = 6) -> np.ndarray:
    """L-BFGS with two loops and a backtracking line search; with ``c1`` it stays in one orthant per step."""
    s: list[np.ndarray] = []
    t: list[np.ndarray] = []
    value, g = f(w)
    value += c1 * np.abs(w).sum()
    for _ in range(steps):
        pg = _pseudo(w, g, c1)
        if np.abs(pg).max(initial=0.0) < 1e-5 * max(1.0, np.abs(w).max(initial=0.0)):
            break
        d = -_two_loops(pg, s, t)
        if c1:
            d[d * pg > 0] = 0.0
        if d @ pg > -1e-12:
            s, t, d = [], [], -pg
        step = 1.0 if s else 1.0 / max(1.0, np.linalg.norm(pg))
        orthant = np.where(w != 0, np.sign(w), -np.sign(pg))
        for _ in range(30):
            new = w + step * d
            if c1:
                new = np.where(new * orthant > 0, new, 0.0)
            v, h = f(new)
            v += c1 * np.abs(new).sum()
            if v <= value + 1e-4 * (pg @ (new - w)):
                break
            step /= 2
        else:
            break
        if (new - w) @ (h - g) > 1e-10:
            s, t = [*s, new - w][-memory:], [*t, h - g][-memory:]
        done = abs(value - v) < 1e-7 * max(1.0, abs(value))
        w, value, g = new, v, h
        if done:
            break
    return w


def _pseudo(w: np.ndarray, g: np.ndarray, c1: float) -> np.ndarray:
    if not c1:
        return g
    right, left = g + c1, g - c1
    return np.where(w > 0, right, np.where(w < 0, left, np.where(right < 0, right, np.where(left > 0, left, 0.0))))


def _two_loops(q: np.ndarray, s: list[np.ndarray], t: list[np.ndarray]) -> np.ndarray:
    q = q.copy()
    alphas = []
    for a, b in zip(reversed(s), reversed(t), strict=True):
        alphas.append((a @ q) / (a @ b))
        q -= alphas[-1] * b
    if s:
        q *= (s[-1] @ t[-1]) / (t[-1] @ t[-1])
    for a, b, x in zip(s, t, reversed(alphas), strict=True):
        q += (x - (b @ q) / (a @ b)) * a
    return q


def online(x: np.ndarray, y: np.ndarray, offsets: np.ndarray, k: int, algorithm: str, rounds: int, c2: float, seed: int = 1) -> np.ndarray:
    """Averaged weights of a pass-by-pass method: perceptron (ap), passive-aggressive (pa), confidence-weighted (arow)
    or stochastic gradient with an L2 penalty (l2sgd)."""
    n = x.shape[1] * k
    w, total, times = np.zeros(n + k * k), np.zeros(n + k * k), 0
    spread = np.ones_like(w)
    rng = np.random.default_rng(seed)
    docs = [i for i in range(len(offsets) - 1) if offsets[i + 1] > offsets[i]]
    for r in range(rounds):
        for i in rng.permutation(docs):
            a, b = offsets[i], offsets[i + 1]
            xi, yi, one = x[a:b], y[a:b], np.array([0, b - a])
            if algorithm == "l2sgd":
                _, g = likelihood(w, xi, yi, one, k)
                w -= (g + 2 * c2 * w / len(docs)) * 0.1 / (1 + (r * len(docs) + times % len(docs)) / len(docs))
            else:
                guess = viterbi(xi @ w[:n].reshape(-1, k), w[n:].reshape(k, k), one)
                wrong = int((guess != yi).sum())
                if wrong:
                    d = _counts(xi, yi, k) - _counts(xi, guess, k)
                    if algorithm == "ap":
                        w = w + d
                    elif algorithm == "pa":
                        w = w + d * max(0.0, (wrong - w @ d) / max(1e-12, d @ d))
                    else:
                        v = float(spread @ (d * d))
                        beta = 1 / (v + 1.0)
                        w = w + max(0.0, wrong - w @ d) * beta * spread * d
                        spread = 1 / (1 / spread + d * d)
            total += w
            times += 1
    return total / max(1, times)


def _counts(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    pairs = np.zeros((k, k))
    np.add.at(pairs, (y[:-1], y[1:]), 1)
    return np.concatenate([(x.T @ np.eye(k)[y]).ravel(), pairs.ravel()])


@dataclass
class CrfEstimator:
    """Fits a model to rows of ``features`` (array of 37 fields) and ``labels`` (array of as many labels).

    L-BFGS runs over the cluster: each step broadcasts the weights and gathers
    one sum per weight.  The online methods run on the driver and take at most
    ``max_rows`` mails.
    """

    algorithm: str = "lbfgs"
    c1: float = 0.1
    c2: float = 0.1
    max_iterations: int = 100
    all_possible_transitions: bool = True
    max_rows: int = 20_000

    def get_params(self) -> dict[str, float]:
        return {"c1": self.c1, "c2": self.c2, "max_iterations": self.max_iterations, "all_possible_transitions": self.all_possible_transitions}

    def __post_init__(self) -> None:
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {self.algorithm!r}")

    def fit(self, examples: DataFrame) -> CrfModel:
        rows = examples.select("features", "labels")
        bad = rows.where(F.size("features") != F.size("labels")).limit(1).count()
        if bad:
            raise ValueError("some mail has more labels than lines, or fewer")
        found = {r.y for r in rows.select(F.explode("labels").alias("y")).distinct().collect()}
        if unknown := found - set(LABELS):
            raise ValueError(f"unknown labels: {sorted(unknown)}")
        labels = [y for y in LABELS if y in found]
        rows = rows.persist()
        try:
            if self.algorithm == "lbfgs":
                return self._fit_lbfgs(rows, labels)
            got = rows.orderBy(F.xxhash64("labels", "features")).limit(self.max_rows).toArrow()  # the same mails on every run
            x, y, offsets = _numbers(got.column("features").combine_chunks(), got.column("labels").combine_chunks(), labels)
            scale = np.maximum(np.abs(x).max(0), 1.0) if len(x) else np.ones(len(ATTRIBUTES))
            return self._model(online(x / scale, y, offsets, len(labels), self.algorithm, self.max_iterations, self.c2), labels, scale)
        finally:
            rows.unpersist()

    def _model(self, w: np.ndarray, labels: list[str], scale: np.ndarray) -> CrfModel:
        k, n = len(labels), len(ATTRIBUTES)
        return CrfModel(labels, w[: n * k].reshape(n, k) / scale[:, None], w[n * k :].reshape(k, k))

    def _fit_lbfgs(self, rows: DataFrame, labels: list[str]) -> CrfModel:
        k, n = len(labels), len(ATTRIBUTES)
        facts = _summed(rows, lambda x, y, o: np.concatenate([np.abs(x).max(0, initial=0.0), ((x != 0).T.astype(float) @ np.eye(k)[y]).ravel(), _pairs(y, o, k).ravel()]), labels, n)
        scale = np.maximum(facts[:n], 1.0)
        seen = facts[n : n + n * k] > 0
        steps = np.ones(k * k, bool) if self.all_possible_transitions else facts[n + n * k :] > 0
        mask = np.concatenate([seen, steps])

        def f(w: np.ndarray) -> tuple[float, np.ndarray]:
            def part(x: np.ndarray, y: np.ndarray, o: np.ndarray) -> np.ndarray:
                value, g = likelihood(w, x / scale, y, o, k)
                return np.concatenate([[value], g])

            got = _summed(rows, part, labels)
            return got[0] + self.c2 * float(w @ w), np.where(mask, got[1:], 0.0) + 2 * self.c2 * w

        return self._model(minimize(f, np.zeros(n * k + k * k), self.c1, self.max_iterations), labels, scale)


def _pairs(y: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    inner = np.ones(len(y), bool)
    inner[offsets[:-1][offsets[:-1] < len(y)]] = False
    at = np.flatnonzero(inner)
    np.add.at(out, (y[at - 1], y[at]), 1)
    return out


def _numbers(features: pa.Array, labels: pa.Array, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, offsets = attributes(features)
    code = {v: i for i, v in enumerate(names)}
    return x, np.array([code[v] for v in labels.flatten().to_pylist()], np.int64), offsets


def _summed(rows: DataFrame, part: Callable, labels: list[str], n_max: int = 0) -> np.ndarray:
    """The sum over all batches of what ``part`` makes of one; of its first ``n_max`` numbers the greatest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            got = part(*_numbers(b.column(0), b.column(1), labels))
            total = got if total is None else np.concatenate([np.maximum(total[:n_max], got[:n_max]), total[n_max:] + got[n_max:]])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.astype(float))], names=["slot", "value"])

    sums = rows.mapInArrow(run, "slot long, value double").groupBy("slot").agg(F.sum("value").alias("s"), F.max("value").alias("m")).collect()
    if not sums:
        raise ValueError("there is no example to learn from")
    out = np.zeros(len(sums))
    for r in sums:
        out[r.slot] = r.m if r.slot < n_max else r.s
    return out
