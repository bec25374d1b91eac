"""Histogram gradient boosting, many fits at a time: binned features, best-first trees, penalised leaves.

All fits of one set of training rows (feature blocks, step sizes, leaves and penalties of a grid) advance together:
each step splits the best leaf of every fit, and one aggregation by (fit, node, feature, bin) over the smaller of the two
new nodes gives the histograms; those of the other node are what is left of the parent's. Settings that differ in the
number of rounds only are read off one run. Sets of training rows are tasks; see nested.nested_boosting.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

BINS = 255
LEAST_ROWS = 20
#: Gains that differ by less than this share are ties, which the first feature, bin or leaf wins.
SAME = 1e-9


@dataclass(frozen=True)
class Setting:
    """A point of the grid."""

    leaves: int
    rounds: int
    l2: float
    rate: float

    def preference(self) -> tuple:
        """Of tied settings the one with fewer leaves, fewer rounds, the larger penalty and the slower steps."""
        return self.leaves, self.rounds, -self.l2, self.rate

    def text(self) -> str:
        return f"l2_regularization={self.l2}, learning_rate={self.rate}, max_iter={self.rounds}, max_leaf_nodes={self.leaves}"


#: The grid that the primary regressor is tuned over.
GRID = tuple(Setting(leaves, rounds, l2, rate) for rate in (0.05, 0.1) for leaves in (7, 15) for rounds in (150, 300) for l2 in (0.0, 1.0))


def thresholds(x: np.ndarray, most: int = BINS) -> np.ndarray:
    """Bounds of the bins of some training values: between all neighbours, or between quantiles if there are more than most values."""
    u = np.unique(x)
    if len(u) <= most:
        return (u[:-1] + u[1:]) / 2
    return np.unique(np.quantile(x, np.linspace(0, 1, most + 1)[1:-1], method="midpoint"))


def binned(x: np.ndarray, train: np.ndarray, most: int = BINS) -> np.ndarray:
    """Bins of every row's features (a value on a bound is below it), whose bounds are those of the training rows."""
    out = np.empty(x.shape, np.uint8)
    for d in range(x.shape[1]):
        out[:, d] = np.searchsorted(thresholds(x[train, d], most), x[:, d], "left")
    return out


def filled(x: np.ndarray, train: np.ndarray) -> np.ndarray:
    """Missing values as the training rows' medians (0 where they have none)."""
    out = x.copy()
    for d in range(x.shape[1]):
        held = x[train, d]
        held = held[~np.isnan(held)]
        out[np.isnan(x[:, d]), d] = np.median(held) if len(held) else 0.0
    return out


def _tops(gain: np.ndarray) -> np.ndarray:
    """What a gain must reach in each row to be its best, up to SAME."""
    top = gain.max(1, keepdims=True)
    return top - SAME * np.abs(top)


class _Fits:
    """The fits of a set of training rows, and the features that each one uses as pairs (fit, feature), by fit."""

    def __init__(self, uses: np.ndarray, l2: np.ndarray, bins: int, least: int):
        self.l2, self.bins, self.least = l2, bins, least
        self.width = uses.sum(1)
        self.fit, self.feature = np.nonzero(uses)
        self.first = np.cumsum(self.width) - self.width
        self.pair = np.full(uses.shape, -1)
        self.pair[self.fit, self.feature] = np.arange(len(self.fit))

    def pairs(self, fits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of some fits in order, and where those of each fit begin among them."""
        width = self.width[fits]
        start = np.cumsum(width) - width
        return np.repeat(self.first[fits] - start, width) + np.arange(width.sum()), start

    def histograms(self, fits: np.ndarray, which: np.ndarray, rows: np.ndarray, g: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of gradients and counts by pair and bin, of (place in fits, training row) pairs; bins: features x rows."""
        pairs, start = self.pairs(fits)
        sums, counts = np.zeros(len(pairs) * self.bins), np.zeros(len(pairs) * self.bins)
        for d in np.unique(self.feature[pairs]):
            own = self.pair[fits, d]
            place = np.where(own >= 0, start + own - self.first[fits], -1)
            at = place[which]
            if (place < 0).any():
                held = np.flatnonzero(at >= 0)
                key, w = at[held] * self.bins + bins[d][rows[held]], g[held]
            else:
                key, w = at * self.bins + bins[d][rows], g
            sums += np.bincount(key, w, len(sums))
            counts += np.bincount(key, minlength=len(counts))
        return sums.reshape(-1, self.bins), counts.reshape(-1, self.bins)

    def best(self, fits: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of nodes of some fits, given by their pairs' histograms: gain, feature, bin, rows and gradients up to the bin."""
        pairs, start = self.pairs(fits)
        width = self.width[fits]
        nl, gl = counts.cumsum(1), sums.cumsum(1)
        n, g = nl[:, -1:].copy(), gl[:, -1:].copy()
        l2 = self.l2[self.fit[pairs]][:, None]
        barred = (nl < self.least) | (n - nl < self.least)
        gain = gl * gl / np.maximum(nl + l2, 1e-300)
        gain += (g - gl) ** 2 / np.maximum(n - nl + l2, 1e-300)
        gain -= g * g / np.maximum(n + l2, 1e-300)
        gain[barred] = -np.inf
        top = np.maximum.reduceat(gain.max(1), start)
        least = np.repeat(np.where(np.isfinite(top), top - SAME * np.abs(top), -np.inf), width)[:, None]
        good = gain >= least
        first = np.where(good.any(1), np.arange(len(pairs)), len(pairs))
        at = np.minimum.reduceat(first, start)
        bin_ = good[at].argmax(1)
        return top, self.feature[pairs[at]], bin_, nl[at, bin_], gl[at, bin_]


def boost(bins: np.ndarray, y: np.ndarray, train: np.ndarray, uses: np.ndarray, rate: np.ndarray, leaves: np.ndarray, l2: np.ndarray, stops: Sequence[int], least: int = LEAST_ROWS) -> Iterator[tuple[int, np.ndarray]]:
    """(rounds, predictions of every row by every fit) at each of the stops.

    bins: rows x features; train: the rows that fits learn from; uses: fits x features, at least one a fit. A fit adds, in each
    round, rate times a tree of up to `leaves` leaves on the residuals; its leaf with the largest gain is split as long as
    there is a split with a gain and `least` training rows on each side."""
    n, fits, most = len(y), len(rate), int(leaves.max(initial=1))
    of = _Fits(uses, l2, int(bins.max(initial=0)) + 1, least)
    rows, columns = np.flatnonzero(train), bins.T.copy()
    own = columns[:, rows].astype(np.int64)
    predicted = np.full((fits, n), y[rows].mean() if len(rows) else 0.0)
    sums, counts = (np.zeros((most, len(of.fit), of.bins)) for _ in range(2))
    every = np.arange(fits)
    gain, feature, cut, below, above, held, total = (np.zeros((fits, most)) for _ in range(7))
    facts = (gain, feature, cut, below, above)  # of each leaf's best split; below, above: rows and gradients on its lower side
    for done in range(1, max(stops) + 1):
        gradient = predicted[:, rows] - y[rows]
        node = np.zeros((fits, n), np.int8)
        gain[:] = -np.inf
        held[:, 0], total[:, 0] = len(rows), gradient.sum(1)
        sums[0], counts[0] = of.histograms(every, np.repeat(every, len(rows)), np.tile(np.arange(len(rows)), fits), gradient.ravel(), own)
        for fact, value in zip(facts, of.best(every, sums[0], counts[0]), strict=True):
            fact[:, 0] = value
        made = np.ones(fits, np.int64)
        while True:
            shown = np.maximum(gain, -1.0)
            leaf = (shown >= _tops(shown)).argmax(1)
            fs = np.flatnonzero((gain[every, leaf] > 1e-12) & (made < leaves))
            if not len(fs):
                break
            leaf, new = leaf[fs], made[fs]
            d, b = feature[fs, leaf].astype(np.int64), cut[fs, leaf]
            inside = node[fs] == leaf[:, None]
            right = inside & (columns[d] > b[:, None])
            node[fs] = np.where(right, new[:, None], node[fs]).astype(np.int8)
            for fact, low in ((held, below), (total, above)):
                fact[fs, new] = fact[fs, leaf] - low[fs, leaf]
                fact[fs, leaf] = low[fs, leaf]
            gain[fs, leaf] = -np.inf
            made[fs] += 1
            # nodes that may be split again need histograms: counted for the smaller of the two, the rest is the other's
            lower = held[fs, leaf] <= held[fs, new]
            open_ = np.flatnonzero((made[fs] < leaves[fs]) & (np.maximum(held[fs, leaf], held[fs, new]) >= 2 * least))
            if not len(open_):
                continue
            fs, leaf, new, lower = fs[open_], leaf[open_], new[open_], lower[open_]
            f, r = np.nonzero(np.where(lower[:, None], inside[open_] & ~right[open_], right[open_])[:, rows])
            small = of.histograms(fs, f, r, gradient[fs[f], r], own)
            pairs, _ = of.pairs(fs)
            width = of.width[fs]
            old, fresh, low = np.repeat(leaf, width), np.repeat(new, width), np.repeat(lower, width)[:, None]
            for table, part in zip((sums, counts), small, strict=True):
                rest = table[old, pairs] - part
                table[old, pairs], table[fresh, pairs] = np.where(low, part, rest), np.where(low, rest, part)
            for at in (leaf, new):
                can = np.flatnonzero(held[fs, at] >= 2 * least)
                if len(can):
                    one, at = fs[can], at[can]
                    pairs, _ = of.pairs(one)
                    where = np.repeat(at, of.width[one])
                    for fact, value in zip(facts, of.best(one, sums[where, pairs], counts[where, pairs]), strict=True):
                        fact[one, at] = value
        live = np.arange(most) < made[:, None]
        value = np.where(live, -rate[:, None] * total / np.maximum(held + l2[:, None], 1e-300), 0.0)
        predicted += np.take_along_axis(value, node.astype(np.int64), 1)
        if done in stops:
            yield done, predicted
