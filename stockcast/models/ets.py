"""Additive Holt-Winters smoothing with a weekly season and estimated start values.

For given weights, one-step errors are linear in the start values (level, trend, one value a weekday, which add up to 0). So the
recursion runs for the errors and for their derivatives at once, for many weights side by side, and least squares gives
the best start values of each. The weights are searched on a grid that narrows around its best point, then by a pattern search.
"""

from __future__ import annotations

import numpy as np

#: Rounds of the narrowing grid and of the pattern search; bounds of the weights.
ROUNDS, MOVES, LOW, HIGH = 4, 8, 0.001, 0.999


def first_values(y: np.ndarray, season: int) -> np.ndarray:
    """Level, trend and season of the first two seasons."""
    first, second = y[:season], y[season : 2 * season]
    return np.concatenate([[first.mean(), (second.mean() - first.mean()) / season], first - first.mean()])


def _errors(y: np.ndarray, season: int, a: np.ndarray, b: np.ndarray, g: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Squared one-step errors and the final state, for many parameter sets at once; start: one set of values for all, or a row for each."""
    start = first_values(y, season) if start is None else start
    state = np.broadcast_to(start, (len(a), season + 2)).T
    level, trend, seasonal = state[0].copy(), state[1].copy(), state[2:].copy()
    total = np.zeros(len(a))
    for t in range(season, len(y)):
        s = seasonal[t % season]
        e = y[t] - (level + trend + s)
        total += e * e
        before = level
        level = before + trend + a * e
        trend = trend + b * a * e
        seasonal[t % season] = s + g * (1 - a) * e
    return total, level, trend, seasonal


def best_starts(y: np.ndarray, season: int, a: np.ndarray, b: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each parameter set the start values of least squared errors, and those errors' sum."""
    base = first_values(y, season)
    free = np.zeros((season + 1, season + 2))  # directions in which the start values may move
    free[0, 0] = free[1, 1] = 1
    for k in range(season - 1):
        free[2 + k, 2 + k], free[2 + k, season + 1] = 1, -1
    n, m = len(a), season + 2
    # column 0 has the errors from the first values, the others what a step in each direction does
    level, trend = (np.repeat(np.concatenate([[base[k]], free[:, k]])[None], n, 0) for k in (0, 1))
    seasonal = np.stack([np.repeat(np.concatenate([[base[2 + k]], free[:, 2 + k]])[None], n, 0) for k in range(season)])
    alpha, beta, gamma = a[:, None], (a * b)[:, None], (g * (1 - a))[:, None]
    errors = np.empty((len(y) - season, n, m))
    observed = np.zeros(m)
    for t in range(season, len(y)):
        observed[0] = y[t]
        s = seasonal[t % season]
        e = observed - level
        e -= trend
        e -= s
        errors[t - season] = e
        level = level + trend + alpha * e
        trend = trend + beta * e
        seasonal[t % season] = s + gamma * e
    e, slopes = errors[:, :, 0].T, errors[:, :, 1:].transpose(1, 0, 2)
    gram, right = np.matmul(slopes.transpose(0, 2, 1), slopes), np.matmul(slopes.transpose(0, 2, 1), e[:, :, None])
    gram += 1e-10 * np.trace(gram, axis1=1, axis2=2)[:, None, None] * np.eye(m - 1)
    step = -np.linalg.solve(gram, right)[:, :, 0]
    rest = e + np.matmul(slopes, step[:, :, None])[:, :, 0]
    total, plain = (rest * rest).sum(axis=1), (e * e).sum(axis=1)
    better = np.isfinite(total) & (total <= plain)
    return base + np.where(better[:, None], step, 0.0) @ free, np.where(better, total, plain)


def search(y: np.ndarray, season: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, start values and the sum of squared errors."""
    center, width, best = np.array([0.3, 0.1, 0.2]), np.array([0.3, 0.1, 0.2]), (np.inf, None, None)

    def among(points: np.ndarray) -> None:
        nonlocal best
        points = np.clip(points, LOW, HIGH)
        starts, totals = best_starts(y, season, *points.T)
        k = int(np.argmin(totals))
        if totals[k] < best[0]:
            best = (float(totals[k]), points[k], starts[k])

    for _ in range(ROUNDS):
        axes = [c + w * np.array([-1, -0.5, 0, 0.5, 1]) for c, w in zip(center, width, strict=True)]
        among(np.stack([x.ravel() for x in np.meshgrid(*axes, indexing="ij")], axis=1))
        center, width = best[1], width / 2
    reach = width * 2
    for _ in range(MOVES):
        before = best[0]
        among(np.concatenate([best[1] + d * reach * np.eye(3) for d in (-1.0, -0.3, 0.3, 1.0)]))
        reach = reach if best[0] < before * (1 - 1e-6) else reach / 4
    return best[1], best[2], best[0]


def fit_forecast(y: np.ndarray, horizon: int, season: int = 7) -> np.ndarray:
    """Forecasts after the least squared one-step error over weights and start values."""
    y = np.asarray(y, float)
    if len(y) < 2 * season:
        raise ValueError("too short")
    weights, start, _ = search(y, season)
    _, level, trend, seasonal = _errors(y, season, *(np.array([c]) for c in weights), start)
    h = np.arange(1, horizon + 1)
    return level[0] + h * trend[0] + seasonal[(len(y) + h - 1) % season, 0]
