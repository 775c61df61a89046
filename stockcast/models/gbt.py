"""Gradient-boosted trees on quantile bins: squared, Poisson and pinball losses, sampling, early stopping.

Bins of all columns are numbered through, so that one count gives the sums of every (node, bin) of a level; of two sister
nodes the smaller one is counted and the other is what its parent has left. ``histogram``, ``best_splits`` and the sampling by row keys
are also what pools too large for one task are fitted with (stockcast.operators.pooled).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Settings:
    rounds: int = 2000
    eta: float = 0.05
    depth: int = 6
    min_weight: float = 5.0
    rows: float = 0.8
    columns: float = 0.8
    l2: float = 1.0
    bins: int = 256
    patience: int = 50
    no_tail_rounds: int = 150
    seed: int = 0


class Loss:
    """Gradient and hessian of a loss on raw scores, its link and starting score."""

    def __init__(self, kind: str = "squared", tau: float = 0.5):
        self.kind, self.tau = kind, tau

    def start(self, y: np.ndarray, w: np.ndarray) -> float:
        return float(np.quantile(y, self.tau)) if self.kind == "pinball" else self.start_of_mean(float(np.average(y, weights=w)))

    def start_of_mean(self, mean: float) -> float:
        return float(np.log(max(mean, 1e-6))) if self.kind == "poisson" else mean

    def link(self, f: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(f, -20, 20)) if self.kind == "poisson" else f

    def gradient(self, y: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "poisson":
            m = self.link(f)
            return m - y, m
        if self.kind == "pinball":
            return np.where(y > f, -self.tau, 1 - self.tau), np.ones(len(y))
        return f - y, np.ones(len(y))

    def values(self, y: np.ndarray, f: np.ndarray) -> np.ndarray:
        if self.kind == "poisson":
            return self.link(f) - y * np.clip(f, -20, 20)
        d = y - f
        return np.maximum(self.tau * d, (self.tau - 1) * d) if self.kind == "pinball" else d * d

    def value(self, y: np.ndarray, f: np.ndarray) -> float:
        return float(np.mean(self.values(y, f)))


class Binner:
    """Quantile bins per column, numbered through all columns; a missing value has a bin of its own, its column's last."""

    def __init__(self, edges: list[np.ndarray]):
        self.edges = edges
        self.widths = np.array([len(e) + 2 for e in edges])
        self.starts = np.cumsum(self.widths) - self.widths
        self.total = int(self.widths.sum())

    @classmethod
    def of(cls, x: np.ndarray, bins: int) -> Binner:
        return cls([np.unique(np.nanquantile(c, np.linspace(0, 1, bins)[1:-1])) if np.isfinite(c).any() else np.empty(0) for c in x.T])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        out = np.where(np.isfinite(x), out, self.widths - 1)
        return (out + self.starts).astype(np.int32)


def sampled(keys: np.ndarray, seed: int, turn: int, share: float) -> np.ndarray:
    """Whether each row takes part in a round: by a hash of its key, so that it does not matter where the row is."""
    if share >= 1:
        return np.ones(len(keys), bool)
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64((seed * 1_000_003 + turn) & 0xFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) < share * 2.0**53


def chosen_columns(n: int, seed: int, turn: int, share: float) -> np.ndarray:
    return np.sort(np.random.default_rng([seed, turn]).choice(n, max(1, round(share * n)), replace=False))


def histogram(codes: np.ndarray, node: np.ndarray, n: int, total: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(2, n, total): sums of g and h by node and bin."""
    key = (codes + (node * total)[:, None]).ravel()
    count = np.bincount(key, minlength=n * total) if (h == 1).all() else np.bincount(key, np.repeat(h, codes.shape[1]), n * total)
    return np.stack([np.bincount(key, np.repeat(g, codes.shape[1]), n * total), count]).reshape(2, n, total)


@dataclass(frozen=True)
class Chosen:
    """The bins of some columns, numbered without gaps."""

    binner: Binner
    columns: np.ndarray

    def __post_init__(self) -> None:
        widths = self.binner.widths[self.columns]
        fill = object.__setattr__
        fill(self, "firsts", np.cumsum(widths) - widths)
        fill(self, "total", int(widths.sum()))
        fill(self, "owner", np.repeat(np.arange(len(self.columns)), widths))

    def codes(self, codes: np.ndarray) -> np.ndarray:
        return codes[:, self.columns] + (self.firsts - self.binner.starts[self.columns])


def best_splits(sums: np.ndarray, chosen: Chosen, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column, bin) that splits each node best, a bin beyond all if none does, and (4, nodes): g and h of the left and of the right rows.

    Of splits as good as the best but for rounding, the first by column and bin is taken.
    """
    n, every = sums.shape[1], np.arange(sums.shape[1])
    end = chosen.firsts[1] if len(chosen.firsts) > 1 else chosen.total
    whole = sums[:, :, :end].sum(axis=2)
    left = sums.cumsum(axis=2)
    left -= chosen.owner * whole[:, :, None]  # every column has all rows
    g, h = left
    other_g, other_h = whole[0][:, None] - g, whole[1][:, None] - h
    bad = (h < s.min_weight) | (other_h < s.min_weight)
    score = g * g
    score /= h + s.l2
    other_g *= other_g
    other_h += s.l2
    other_g /= other_h
    score += other_g
    score -= (whole[0] ** 2 / (whole[1] + s.l2))[:, None]
    score[bad] = 0
    top = score.max(axis=1)
    at = (score >= (top * (1 - 1e-9))[:, None]).argmax(axis=1)
    split = top > 1e-12
    column = chosen.columns[chosen.owner[at]]
    limit = at - chosen.firsts[chosen.owner[at]] + chosen.binner.starts[column]
    ends = np.where(split, left[:, every, at], whole)
    return np.where(split, column, 0), np.where(split, limit, chosen.binner.total), np.concatenate([ends, whole - ends])


def descend(node: np.ndarray, codes: np.ndarray, column: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The nodes of the next level; those that aren't split send all rows left."""
    return node * 2 + (codes[np.arange(len(codes)), column[node]] > limit[node])


#: Levels of (column, bin), then the leaf values.
Tree = tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]


def leaves(ends: np.ndarray, s: Settings) -> np.ndarray:
    """Newton steps of the leaves below the last splits."""
    g, h = np.stack([ends[0], ends[2]], axis=1).ravel(), np.stack([ends[1], ends[3]], axis=1).ravel()
    return -g / (h + s.l2) * s.eta


def quantile_leaves(node: np.ndarray, residual: np.ndarray, n: int, tau: float, eta: float) -> np.ndarray:
    """eta times the tau-quantile of the residuals in each leaf, by linear interpolation; 0 in empty leaves."""
    order = np.lexsort((residual, node))
    r, counts = residual[order], np.bincount(node, minlength=n)
    starts = np.cumsum(counts) - counts
    at = tau * (counts - 1).clip(0)
    low = np.floor(at).astype(np.int64)
    high = np.minimum(low + 1, (counts - 1).clip(0))
    some = counts > 0
    out = np.zeros(n)
    a, b = r[(starts + low)[some]], r[(starts + high)[some]]
    out[some] = a + (b - a) * (at - low)[some]
    return out * eta


def grow(codes: np.ndarray, g: np.ndarray, h: np.ndarray, binner: Binner, columns: np.ndarray, s: Settings) -> tuple[Tree, np.ndarray]:
    """A full tree, and the leaf of each row."""
    chosen = Chosen(binner, columns)
    node, levels, n, own = np.zeros(len(codes), np.int64), [], 1, chosen.codes(codes)
    before = ends = None
    for _ in range(s.depth):
        if before is None:
            sums = histogram(own, node, n, chosen.total, g, h)
        else:
            counts = np.bincount(node, minlength=n).reshape(-1, 2)
            small = np.arange(n // 2) * 2 + (counts[:, 1] < counts[:, 0])
            rows = np.flatnonzero(small[node >> 1] == node)
            part = histogram(own[rows], node[rows] >> 1, n // 2, chosen.total, g[rows], h[rows])
            sums = np.empty((2, n, chosen.total))
            sums[:, small], sums[:, small ^ 1] = part, before - part
        column, limit, ends = best_splits(sums, chosen, s)
        levels.append((column, limit))
        node = descend(node, codes, column, limit)
        before, n = sums, n * 2
    return (levels, leaves(ends, s)), node


def apply(tree: Tree, codes: np.ndarray) -> np.ndarray:
    node = np.zeros(len(codes), np.int64)
    for column, limit in tree[0]:
        node = descend(node, codes, column, limit)
    return tree[1][node]


class Model:
    def __init__(self, loss: Loss, settings: Settings = Settings(), binner: Binner | None = None):
        self.loss, self.settings, self.binner = loss, settings, binner

    def fit(self, x: np.ndarray, y: np.ndarray, is_fit: np.ndarray, weight: np.ndarray | None = None, keys: np.ndarray | None = None) -> Model:
        """Boosts on the rows of is_fit; the others decide when to stop. Same input, same model; keys say which rows a round samples."""
        s = self.settings
        w = np.ones(len(y)) if weight is None else weight
        if not is_fit.any():
            is_fit = np.ones(len(y), bool)
        self.binner = self.binner or Binner.of(x[is_fit], s.bins)
        b, yf, wf = self.binner(x[is_fit]), y[is_fit], w[is_fit]
        bt, yt = self.binner(x[~is_fit]), y[~is_fit]
        kf = (np.arange(len(y)) if keys is None else keys)[is_fit]
        self.base = self.loss.start(yf, wf)
        f, ft, best, at = np.full(len(yf), self.base), np.full(len(yt), self.base), np.inf, 0
        self.trees: list[Tree] = []
        for k in range(s.rounds if len(yt) else min(s.rounds, s.no_tail_rounds)):
            rows = np.flatnonzero(sampled(kf, s.seed, k, s.rows))
            if not len(rows):
                continue
            columns = chosen_columns(x.shape[1], s.seed, k, s.columns)
            g, h = self.loss.gradient(yf[rows], f[rows])
            tree, node = grow(b[rows], g * wf[rows], h * wf[rows], self.binner, columns, s)
            if self.loss.kind == "pinball":
                tree = tree[0], quantile_leaves(node, yf[rows] - f[rows], 1 << s.depth, self.loss.tau, s.eta)
            self.trees.append(tree)
            f += apply(tree, b)
            if len(yt):
                ft += apply(tree, bt)
                now = self.loss.value(yt, ft)
                if now < best - 1e-12:
                    best, at = now, len(self.trees)
                elif len(self.trees) - at >= s.patience:
                    break
        if len(yt):
            self.trees = self.trees[: max(at, 1)]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self.binner(x)
        return self.loss.link(self.base + sum((apply(t, b) for t in self.trees), np.zeros(len(x))))
