"""Splitting one subtree's points with NumPy, in place of many small Spark jobs."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np


@dataclass(frozen=True)
class State:
    """A node: split bounds, box, flags and the planes it lies next to."""

    path: str
    mins: tuple[float, ...]
    maxs: tuple[float, ...]
    left: tuple[float, ...]
    right: tuple[float, ...]
    periodic_left: tuple[bool, ...]
    periodic_right: tuple[bool, ...]
    left_plane: tuple[str | None, ...]
    right_plane: tuple[str | None, ...]

    @property
    def split_dim(self) -> int:
        """The widest dimension, the lowest of equals."""
        spread = [b - a for a, b in zip(self.mins, self.maxs, strict=True)]
        return spread.index(max(spread))

    def is_leaf(self, n: int, leafsize: int) -> bool:
        d = self.split_dim
        return n < leafsize or self.maxs[d] - self.mins[d] == 0

    def children(self, dim: int, at: float) -> tuple[State, State]:
        put = lambda t, v: (*t[:dim], v, *t[dim + 1 :])
        less = replace(self, path=self.path + "0", maxs=put(self.maxs, at), right=put(self.right, at), periodic_right=put(self.periodic_right, False), right_plane=put(self.right_plane, self.path))
        more = replace(self, path=self.path + "1", mins=put(self.mins, at), left=put(self.left, at), periodic_left=put(self.periodic_left, False), left_plane=put(self.left_plane, self.path))
        return less, more


@dataclass
class Finished:
    """Nodes in depth-first order; ``rows[i]`` are the points of leaf ``i``."""

    nodes: list[tuple] = field(default_factory=list)
    rows: list[np.ndarray] = field(default_factory=list)


def divide(x: np.ndarray, rows: np.ndarray, dim: int, state: State, sliding: bool) -> tuple[np.ndarray, float]:
    """Which of ``rows`` (ordered by point id) go to the less side, and the split
    value. Ties are cut by point id."""
    v = x[rows, dim]
    n = len(rows)
    if not sliding:
        k = (n + 1) // 2
        at = float(np.partition(v, k - 1)[k - 1])
        less = v < at
        equal = np.flatnonzero(v == at)
        less[equal[: k - int(less.sum())]] = True
        return less, at
    at = (state.mins[dim] + state.maxs[dim]) / 2
    less = v <= at
    if not less.any():
        less[int(v.argmin())] = True
        return less, float(v.min())
    if less.all():
        less[n - 1 - int(v[::-1].argmax())] = False
        return less, float(v[less].max())
    return less, at


def finish(x: np.ndarray, state: State, leafsize: int, sliding: bool) -> Finished:
    """The whole subtree below ``state``; ``x`` is ordered by point id."""
    out, todo = Finished(), [(state, np.arange(len(x)))]
    while todo:
        s, rows = todo.pop()
        if s.is_leaf(len(rows), leafsize) or len(rows) < 2:
            out.nodes.append((s, len(rows), None, None))
            out.rows.append(rows)
            continue
        dim = s.split_dim
        less, at = divide(x, rows, dim, s, sliding)
        out.nodes.append((s, len(rows), dim, at))
        a, b = s.children(dim, at)
        todo.append((b, rows[~less]))
        todo.append((a, rows[less]))
    return out
