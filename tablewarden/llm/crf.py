"""Linear-chain conditional random field: training by L-BFGS on folded sequences, decoding by Viterbi.

A token is a list of feature names.  Sequences may be short; the operators cut their input where a tag is certain.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np

FORBIDDEN = -1e4


@dataclass(frozen=True)
class Chain:
    """Weights: ``emit`` [feature, tag], ``move`` [from, to], ``first`` and ``last`` [tag]."""

    features: dict[str, int]
    emit: np.ndarray
    move: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def emission(self, names: Iterable[str]) -> np.ndarray:
        """Score of each tag for one token; unknown features count nothing."""
        known = [self.features[n] for n in names if n in self.features]
        return self.emit[known].sum(0)

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The best tags for emissions [token, tag]; ties go to the smaller tag."""
        if len(scores) == 0:
            return []
        best, back = self.first + scores[0], []
        for row in scores[1:]:
            through = best[:, None] + self.move
            back.append(through.argmax(0))
            best = through.max(0) + row
        tags = [int((best + self.last).argmax())]
        for step in reversed(back):
            tags.append(int(step[tags[-1]]))
        return tags[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class _Folded:
    """Sequences as numbers: each distinct set of features is one type, each distinct tagged sequence of types one row with a weight.

    Rows lie in groups of like length.  ``scores`` and ``spread`` are the two products with the sparse matrix of types and features.
    """

    def __init__(self, sequences: Sequence[Sequence[Sequence[str]]], tags: Sequence[Sequence[int]], times: Sequence[int]):
        self.index: dict[str, int] = {}
        types: dict[tuple[int, ...], int] = {}
        rows: dict[tuple[tuple[int, ...], tuple[int, ...]], int] = {}
        names = sorted({f for s in sequences for token in s for f in token})
        self.index = {f: i for i, f in enumerate(names)}
        for sequence, own, n in zip(sequences, tags, times):
            if sequence:
                coded = tuple(types.setdefault(tuple([self.index[f] for f in token]), len(types)) for token in sequence)
                row = coded, tuple(own)
                rows[row] = rows.get(row, 0) + n
        self.tokens = sum(len(r[0]) * n for r, n in rows.items())
        held = list(types)
        self.feature = np.fromiter((f for t in held for f in t), np.int64)
        self.type = np.repeat(np.arange(len(held)), [len(t) for t in held]) if held else np.zeros(0, np.int64)
        by_feature = np.argsort(self.feature, kind="stable")
        self.type_by_feature = self.type[by_feature]
        self.has, self.feature_starts = np.unique(self.feature[by_feature], return_index=True)
        self.some, self.type_starts = np.unique(self.type, return_index=True)
        self.n_types = len(held)
        self.groups = []
        by_length: dict[int, list] = {}
        for row, n in rows.items():
            by_length.setdefault(1 << (len(row[0]) - 1).bit_length(), []).append((*row, n))
        for size, members in sorted(by_length.items()):
            x, y, mask = np.full((len(members), size), len(held)), np.zeros((len(members), size), np.int64), np.zeros((len(members), size), bool)
            for at, (coded, own, _) in enumerate(members):
                x[at, : len(coded)], y[at, : len(own)], mask[at, : len(coded)] = coded, own, True
            self.groups.append((x, y, mask, np.array([m[2] for m in members], float)))

    def scores(self, emit: np.ndarray) -> np.ndarray:
        """Emission of every type, and zeros for the padding."""
        made = np.zeros((self.n_types + 1, emit.shape[1]))
        if len(self.feature):
            made[self.some] = np.add.reduceat(emit[self.feature], self.type_starts)
        return made

    def spread(self, by_type: np.ndarray) -> np.ndarray:
        """Sums over types brought to their features."""
        made = np.zeros((len(self.index), by_type.shape[1]))
        if len(self.feature):
            made[self.has] = np.add.reduceat(by_type[self.type_by_feature], self.feature_starts)
        return made


def fit(sequences: Sequence[Sequence[Sequence[str]]], tags: Sequence[Sequence[int]], n_tags: int, forbidden: Iterable[tuple[int, int]] = (),
        forbidden_first: Iterable[int] = (), penalty: float = 0.5, rounds: int = 80, close: float = 1e-5, times: Sequence[int] | None = None) -> Chain:
    """Maximise the penalised conditional likelihood in at most ``rounds`` steps, or until no gradient per token exceeds ``close``.
    ``times`` says how often each sequence counts."""
    data = _Folded(sequences, tags, times or [1] * len(sequences))
    blocked, blocked_first = np.zeros((n_tags, n_tags)), np.zeros(n_tags)
    for a, b in forbidden:
        blocked[a, b] = FORBIDDEN
    for a in forbidden_first:
        blocked_first[a] = FORBIDDEN
    cuts = np.cumsum([len(data.index) * n_tags, n_tags * n_tags, n_tags])
    count = max(1, data.tokens)

    def parts(flat: np.ndarray) -> list[np.ndarray]:
        emit, move, first, last = np.split(flat, cuts)
        return [emit.reshape(-1, n_tags), move.reshape(n_tags, n_tags), first, last]

    def loss(flat: np.ndarray) -> tuple[float, np.ndarray]:
        emit, move, first, last = parts(flat)
        value, slope = 0.5 * penalty * float(flat @ flat), penalty * flat
        by_type, grads = np.zeros((data.n_types + 1, n_tags)), parts(slope)
        scores = data.scores(emit)
        for group in data.groups:
            value -= _expected(group, scores, move + blocked, first + blocked_first, last, by_type, grads[1:])
        grads[0] -= data.spread(by_type)
        return value / count, slope / count

    emit, move, first, last = parts(minimise(loss, np.zeros(cuts[-1] + n_tags), rounds, close))
    return Chain(data.index, emit, move + blocked, first + blocked_first, last)


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], at: np.ndarray, rounds: int, close: float, memory: int = 8) -> np.ndarray:
    """L-BFGS with steps halved until the loss falls enough."""
    value, slope = loss(at)
    held: deque = deque(maxlen=memory)
    for _ in range(rounds):
        if np.abs(slope).max(initial=0.0) <= close:
            break
        way, scales = slope.copy(), []
        for step, change, weight in reversed(held):
            scales.append(weight * (step @ way))
            way -= scales[-1] * change
        if held:
            step, change, _ = held[-1]
            way *= (step @ change) / (change @ change)
        else:
            way /= max(1.0, np.linalg.norm(way))
        for (step, change, weight), scale in zip(held, reversed(scales)):
            way += step * (scale - weight * (change @ way))
        fall, length = slope @ way, 1.0
        while True:
            tried = at - length * way
            now, now_slope = loss(tried)
            if now <= value - 1e-4 * length * fall or length < 1e-6:
                break
            length /= 2
        if now >= value:
            break
        step, change = tried - at, now_slope - slope
        if step @ change > 1e-12:
            held.append((step, change, 1.0 / (step @ change)))
        at, value, slope = tried, now, now_slope
    return at


def _expected(group: tuple, by_type: np.ndarray, moves: np.ndarray, starts: np.ndarray, last: np.ndarray, gaps: np.ndarray, grads: list[np.ndarray]) -> float:
    """Log-likelihood of one padded group; its observed minus expected counts go to ``gaps`` and off the gradients (forward-backward)."""
    x, y, mask, weight = group
    rows, size = y.shape
    n_tags = len(starts)
    scores = by_type[x]
    who, end = np.arange(rows), mask.sum(1) - 1
    alpha = np.zeros((size, rows, n_tags))
    alpha[0] = starts + scores[:, 0]
    for t in range(1, size):
        alpha[t] = np.where(mask[:, t, None], _logsum(alpha[t - 1][:, :, None] + moves, 1) + scores[:, t], alpha[t - 1])
    beta = np.zeros((size, rows, n_tags))
    beta[size - 1] = last
    for t in range(size - 2, -1, -1):
        beta[t] = np.where(mask[:, t + 1, None], _logsum(moves + (scores[:, t + 1] + beta[t + 1])[:, None, :], 2), last)
    total = _logsum(alpha[size - 1] + last, 1)
    heavy = mask.T[:, :, None] * weight[None, :, None]
    truth = np.eye(n_tags)[y.T]
    gap = (truth - np.exp(np.minimum(alpha + beta - total[None, :, None], 0))) * heavy
    for tag in range(n_tags):
        gaps[:, tag] += np.bincount(x.T.ravel(), gap[:, :, tag].ravel(), len(gaps))
    said = (weight * (starts[y[:, 0]] + last[y[who, end]] - total)).sum() + (np.take_along_axis(scores, y[:, :, None], 2)[:, :, 0] * mask * weight[:, None]).sum()
    if size > 1:
        inner = scores.transpose(1, 0, 2)[1:] + beta[1:]
        both = np.exp(np.minimum(alpha[:-1, :, :, None] + moves + inner[:, :, None, :] - total[None, :, None, None], 0)) * heavy[1:, :, :, None]
        seen = np.einsum("tra,trb->ab", truth[:-1], truth[1:] * heavy[1:])
        said += (moves * seen).sum()
        grads[0] -= seen - both.sum((0, 1))
    grads[1] -= gap[0].sum(0)
    grads[2] -= gap[end, who].sum(0)
    return float(said)
