"""Balanced partitions of a neighbour graph and a small network that tells them from a vector; in numpy.

All of it works on a sample of bounded size, whatever the corpus.
"""

from __future__ import annotations

import numpy as np

BATCH = 512


def neighbours(vectors: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` rows of largest inner product of each row, itself left out, nearest first."""
    k = min(k, len(vectors) - 1)
    found = np.zeros((len(vectors), max(0, k)), np.int64)
    for low in range(0, len(vectors) if k > 0 else 0, BATCH):
        near = vectors[low:low + BATCH] @ vectors.T
        near[np.arange(len(near)), np.arange(low, low + len(near))] = -np.inf
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
        found[low:low + BATCH] = np.take_along_axis(top, order, 1)
    return found


def _halved(vectors: np.ndarray, rows: np.ndarray, parts: int, first: int, part: np.ndarray) -> None:
    """Deal the rows to ``parts`` partitions in proportion, each cut across the direction they vary most in."""
    if parts == 1:
        part[rows] = first
        return
    centred = vectors[rows] - vectors[rows].mean(axis=0)
    spread = centred.T @ centred
    along = centred @ np.linalg.eigh(spread)[1][:, -1]
    left = parts // 2
    cut = len(rows) * left // parts
    order = np.argsort(along, kind="stable")
    _halved(vectors, rows[order[:cut]], left, first, part)
    _halved(vectors, rows[order[cut:]], parts - left, first + left, part)


def balanced(vectors: np.ndarray, near: np.ndarray, parts: int, slack: float = 0.05, rounds: int = 8) -> np.ndarray:
    """A partition of the graph of ``near`` with few edges between its parts, none over its share plus ``slack``.

    Starts from cuts through the vectors; then nodes move to the part that holds most of their neighbours,
    largest gain first, as long as there is room.
    """
    n = len(vectors)
    part = np.zeros(n, np.int64)
    _halved(vectors, np.arange(n), parts, 0, part)
    room = int(np.ceil((1 + slack) * n / parts))
    a = np.repeat(np.arange(n), near.shape[1])
    a, b = np.concatenate([a, near.ravel()]), np.concatenate([near.ravel(), a])
    order = np.argsort(a, kind="stable")
    b = b[order]
    starts = np.searchsorted(a[order], np.arange(n + 1))
    sizes = np.bincount(part, minlength=parts)
    held = np.zeros((n, parts), np.int32)  # neighbours of each node in each part
    np.add.at(held, (a, part[np.concatenate([near.ravel(), np.repeat(np.arange(n), near.shape[1])])]), 1)
    for _ in range(rounds):
        gain = held.max(axis=1) - held[np.arange(n), part]
        moved = 0
        for node in np.argsort(-gain, kind="stable")[:int((gain > 0).sum())].tolist():
            mine = held[node]
            open_to = np.where(sizes < room, mine, -1)
            to, own = int(open_to.argmax()), int(part[node])
            if open_to[to] <= mine[own]:
                continue
            part[node] = to
            sizes[own] -= 1
            sizes[to] += 1
            others = b[starts[node]:starts[node + 1]]
            np.add.at(held, (others, own), -1)
            np.add.at(held, (others, to), 1)
            moved += 1
        if not moved:
            break
    return part


class Router:
    """One hidden layer; ``probabilities`` of each partition to hold the neighbours of a vector."""

    def __init__(self, width: int, parts: int, hidden: int, seed: int = 7) -> None:
        random = np.random.default_rng(seed)
        self.weights = [
            random.normal(0, np.sqrt(2 / max(1, width)), (width, hidden)), np.zeros(hidden),
            random.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inner = np.maximum(x @ self.weights[0] + self.weights[1], 0)
        out = inner @ self.weights[2] + self.weights[3]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return inner, out / out.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x * np.sqrt(x.shape[1]))[1]

    def train(self, x: np.ndarray, wanted: np.ndarray, epochs: int, rate: float = 2e-3, seed: int = 11) -> None:
        """Adam on the cross entropy with the wanted shares of partitions."""
        random = np.random.default_rng(seed)
        x = x * np.sqrt(x.shape[1])
        first, second = ([np.zeros_like(w) for w in self.weights] for _ in range(2))
        step, decay = 0, 1e-4
        for _ in range(epochs):
            order = random.permutation(len(x))
            for low in range(0, len(x), BATCH):
                rows = order[low:low + BATCH]
                inner, shares = self._forward(x[rows])
                out = (shares - wanted[rows]) / len(rows)
                back = (out @ self.weights[2].T) * (inner > 0)
                slopes = [x[rows].T @ back, back.sum(axis=0), inner.T @ out, out.sum(axis=0)]
                step += 1
                for k, slope in enumerate(slopes):
                    first[k] = 0.9 * first[k] + 0.1 * slope
                    second[k] = 0.999 * second[k] + 0.001 * slope**2
                    self.weights[k] -= rate * (
                        first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                        + decay * self.weights[k])


def shares(part: np.ndarray, near: np.ndarray, parts: int) -> np.ndarray:
    """Per row the share of each partition among the row itself and its neighbours."""
    wanted = np.zeros((len(part), parts))
    np.add.at(wanted, (np.arange(len(part)), part), 1)
    np.add.at(wanted, (np.repeat(np.arange(len(part)), near.shape[1]), part[near.ravel()]), 1)
    return wanted / wanted.sum(axis=1, keepdims=True)


def mass_before(probabilities: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Per (row, partition asked for) the probability of the partitions that come before it in the row's order."""
    order = np.argsort(-probabilities, axis=1, kind="stable")
    sums = np.cumsum(np.take_along_axis(probabilities, order, 1), axis=1)
    before = np.empty_like(sums)
    np.put_along_axis(before, order, np.pad(sums, ((0, 0), (1, 0)))[:, :-1], axis=1)
    return np.take_along_axis(before, part, 1)
