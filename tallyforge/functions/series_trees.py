"""Tree models of one ordered series: a bootstrap forest in closed form and boosted trees by prefix sums.

With the position as only feature and no limit of depth a regression tree is the step function of its sample: it answers with the value
of the nearest drawn position (the smaller one on ties, the last one beyond the end), so nothing has to be grown. A boosted
tree splits ranges of positions; sums of residuals of any range come from one prefix sum, so the best cuts of all ranges of a
level are found at once.
"""

from __future__ import annotations

import numpy as np

PRIME = 2147483647


def drawn_positions(n: int, tree: int) -> np.ndarray:
    """The n bootstrap draws of a tree: a hash of draw and tree number, the same in SQL (two squarings modulo a prime)."""
    draw = np.arange(n, dtype=np.int64)
    r = (draw * 48271 + tree * 1299709 + 97) % PRIME
    r = (r * r + tree + 12345) % PRIME
    return (r * r + draw) % PRIME % n


def nearest_drawn(n: int, tree: int) -> np.ndarray:
    """For each of n positions the nearest one that the tree has drawn (the smaller one on ties)."""
    at, drawn = np.arange(n), np.zeros(n, bool)
    drawn[drawn_positions(n, tree)] = True
    below = np.maximum.accumulate(np.where(drawn, at, -1))
    above = np.minimum.accumulate(np.where(drawn, at, 2 * n)[::-1])[::-1]
    return np.where((below >= 0) & ((at - below <= above - at) | (above >= n)), below, above)


def forests(series: list[np.ndarray], trees: int) -> list[tuple[float, float]]:
    """(forecast beyond the last position, in-sample R2 held to 0..1) of a bootstrap forest over the positions of every series.

    The draws follow from the length alone, so series of one length are answered together by each tree.
    """
    out: list[tuple[float, float]] = [(0.0, 0.0)] * len(series)
    lengths = np.array([len(y) for y in series])
    for n in np.unique(lengths):
        members = np.flatnonzero(lengths == n)
        ys = np.stack([np.asarray(series[i], dtype=float) for i in members])
        total, ahead = np.zeros(ys.shape), np.zeros(len(ys))
        for tree in range(trees):
            nearest = nearest_drawn(int(n), tree)
            total += ys[:, nearest]
            ahead += ys[:, nearest[-1]]
        for i, y, fit, last in zip(members, ys, total, ahead):
            spread, missed = ((y - y.mean()) ** 2).sum(), ((y - fit / trees) ** 2).sum()
            score = 1 - missed / spread if spread > 0 else float(missed == 0)
            out[i] = (last / trees, max(0.0, min(1.0, score)))
    return out


def forest(y: np.ndarray, trees: int) -> tuple[float, float]:
    """The forest of one series."""
    return forests([y], trees)[0]


def boosted(y: np.ndarray, rounds: int, depth: int = 6, rate: float = 0.3, l2: float = 1.0) -> np.ndarray:
    """In-sample fit of boosted trees (squared loss) over the positions of ``y``; the last value is the forecast beyond the end.

    A range is cut where the gain sum^2 / (count + l2) of both sides over the whole is largest (the first on ties) and positive.
    """
    n = len(y)
    fit = np.full(n, y.mean())
    least = 1e-9 * max(float(((y - fit) ** 2).sum()), 1e-300)
    for _ in range(rounds):
        sums = np.append(0.0, np.cumsum(y - fit))
        edges, done = np.array([0, n]), False
        for _ in range(depth):
            sizes = np.diff(edges)
            a, b = np.repeat(edges[:-1], sizes), np.repeat(edges[1:], sizes)
            cut = np.arange(n)
            left, right, whole = sums[cut] - sums[a], sums[b] - sums[cut], sums[b] - sums[a]
            gain = left**2 / (cut - a + l2) + right**2 / (b - cut + l2) - whole**2 / (b - a + l2)
            gain[edges[:-1]] = -np.inf  # a cut needs a position on its left
            best = np.maximum.reduceat(gain, edges[:-1])
            first = np.flatnonzero((gain == np.repeat(best, sizes)) & (gain > least))
            if not len(first):
                done = True
                break
            first = first[np.unique(a[first], return_index=True)[1]]
            edges = np.union1d(edges, first)
        sizes = np.diff(edges)
        if done and len(sizes) == 1:
            break
        fit = fit + np.repeat(rate * np.diff(sums[edges]) / (sizes + l2), sizes)
    return fit
