"""Forward and backward recursions over many chains at once.

Positions of all chains lie one after another; chains are taken longest first, so that
the chains still running at a step are a prefix and each step is one small product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Steps:
    def __init__(self, first: np.ndarray):
        """`first`: start of each chain, and the end of the last one."""
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        self.begin, self.size = first[:-1][order], size[order]
        self.length = int(size.max(initial=0))
        # running[t]: chains longer than t
        self.running = len(size) - np.searchsorted(np.sort(size), np.arange(self.length), "right")

    def forward(self) -> Iterator[tuple[int, np.ndarray]]:
        for t in range(self.length):
            yield t, self.begin[: self.running[t]] + t

    def backward(self) -> Iterator[tuple[int, np.ndarray]]:
        """Steps that have a next one, last first."""
        for t in range(self.length - 2, -1, -1):
            yield t, self.begin[: self.running[t + 1]] + t


def forward(steps: Steps, emit: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward probabilities and the scale of every position."""
    alpha, scale = np.empty_like(emit), np.empty(len(emit), np.float64)
    before = None
    for t, at in steps.forward():
        a = emit[at] * (start if before is None else before[: len(at)] @ move)
        c = a.sum(axis=1)
        a /= c[:, None]
        alpha[at], scale[at], before = a, c, a
    return alpha, scale


def backward(
    steps: Steps, emit: np.ndarray, move: np.ndarray, alpha: np.ndarray, scale: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of every position, and expected numbers of moves."""
    beta = np.ones_like(emit)
    moves = np.zeros_like(move)
    back = move.T.copy()
    for _, at in steps.backward():
        ahead = emit[at + 1] * beta[at + 1] / scale[at + 1, None].astype(emit.dtype)
        beta[at] = ahead @ back
        moves += alpha[at].T @ ahead
    return alpha * beta, moves * move
