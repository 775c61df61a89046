"""Autoregressive moving-average forecasts with a season and regressors, by conditional least squares.

The polynomials of plain and seasonal lags are multiplied. Errors are those of the whole recursion given zeros before the
sample; regressors, mean and all coefficients are fitted together by damped Gauss-Newton steps, from the two-stage least
squares of a long autoregression. All orders of a search are scored over one sample, which begins after the longest lag of any,
and series are scaled first, so that an order does not depend on the unit.
"""

from __future__ import annotations

from itertools import product

import numpy as np

Order = tuple[int, int, int, int]  # p, q, P, Q
#: Steps at most, the least relative gain of one, how far roots stay from the unit circle, how near inverse roots count as common.
STEPS, LEAST_GAIN, MARGIN, COMMON = 30, 1e-7, 1e-3, 0.2


def grid(seasonal: bool) -> list[Order]:
    """All orders tried: seasonal ones with p, q up to 2 and P, Q up to 1, others with p, q up to 3."""
    if seasonal:
        return [(p, q, sp, sq) for p, q, sp, sq in product(range(3), range(3), range(2), range(2))]
    return [(p, q, 0, 0) for p, q in product(range(4), range(4))]


def longest_lag(season: int, seasonal: bool) -> int:
    """The longest lag of any order of the grid."""
    return max(max(p + season * sp, q + season * sq) for p, q, sp, sq in grid(seasonal))


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(a, b, rcond=None)[0]


def _polynomial(c: np.ndarray, step: int, sign: int) -> np.ndarray:
    """1 + sign * (c1 B^step + c2 B^(2 step) + ...)."""
    out = np.zeros(len(c) * step + 1)
    out[0] = 1
    out[step::step] = sign * c
    return out


def _inverse(poly: np.ndarray, n: int) -> np.ndarray:
    """The first n terms of 1 / poly, whose first term is 1."""
    lags = [(k, float(v)) for k, v in enumerate(poly) if k and v]
    out = [1.0] + [0.0] * (n - 1)
    for t in range(1, n):
        out[t] = -sum(v * out[t - k] for k, v in lags if k <= t)
    return np.array(out)


def _filtered(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The causal filter of each column of x by weights, zeros before the sample."""
    n = len(x)
    if len(weights) <= 32:
        out = np.zeros_like(x)
        for k, v in enumerate(weights[:n]):
            if v:
                out[k:] += v * x[: n - k]
        return out
    size = 1 << (2 * n - 1).bit_length()
    shape = (-1, *[1] * (x.ndim - 1))
    return np.fft.irfft(np.fft.rfft(weights, size).reshape(shape) * np.fft.rfft(x, size, axis=0), size, axis=0)[:n]


def _lagged(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([np.zeros((min(k, len(x)), *x.shape[1:])), x[: max(0, len(x) - k)]])


def _inside(c: np.ndarray, sign: int) -> bool:
    """Whether all roots of 1 + sign * (c1 z + ...) are outside the unit circle."""
    if not len(c):
        return True
    if len(c) == 1:
        return bool(abs(c[0]) < 1 - MARGIN)
    roots = np.roots(np.concatenate([(sign * c)[::-1], [1.0]]))
    return bool(len(roots) == 0 or np.abs(roots).min() > 1 + MARGIN)


def _inverse_roots(c: np.ndarray, sign: int) -> np.ndarray:
    """The inverse roots of 1 + sign * (c1 z + ...)."""
    return np.roots(np.concatenate([[1.0], sign * c])) if len(c) else np.empty(0)


class Fit:
    """A fitted order on one series; the series is differenced by the season if seasonal.

    start: errors before it are not counted; the longest lag of the order, if not given.
    """

    def __init__(self, y: np.ndarray, order: Order, season: int, seasonal: bool, x: np.ndarray | None = None, start: int | None = None):
        self.y, self.season, self.seasonal, self.order = np.asarray(y, float), season, seasonal, order
        p, q, sp, sq = order
        difference = lambda v: v[season:] - v[:-season] if seasonal else v
        w = difference(self.y)
        self.scale = float(w.std()) or 1.0
        self.start = max(p + season * sp, q + season * sq) if start is None else start
        n_free = p + q + sp + sq
        self.columns = np.ones((len(w), 1))
        self.n_x = 0
        if x is not None:
            dx = difference(np.asarray(x, float))
            self.used = np.flatnonzero(np.ptp(dx, axis=0) > 0)  # what never changes tells nothing
            self.n_x = len(self.used)
            self.columns = np.column_stack([dx[:, self.used], self.columns])
        n = len(w) - self.start
        self.n_params = n_free + self.columns.shape[1] + 1
        if n <= self.n_params + 1:
            raise ValueError("too short")
        z = w / self.scale
        params = np.concatenate([self._begin(z - self.columns @ (beta := _solve(self.columns, z))), beta])
        e, jacobian, sse = self._errors(z, params)
        damping = 1e-3
        for _ in range(STEPS if n_free else 1):
            a, g = jacobian.T @ jacobian, jacobian.T @ e[self.start :]
            while damping < 1e8:
                step = np.linalg.solve(a + damping * (np.diag(a) + 1e-9) * np.eye(len(g)), g)
                moved = params - step
                found = self._errors(z, moved)
                if found is not None and found[2] < sse:
                    break
                damping *= 8
            else:
                break
            gain = 1 - found[2] / sse if sse > 0 else 0.0
            params, (e, jacobian, sse), damping = moved, found, max(damping / 8, 1e-9)
            if gain < LEAST_GAIN:
                break
        self.params, self.e, self.z = params, e, z
        self.sigma2 = sse / n * self.scale**2
        if not np.isfinite(self.sigma2):
            raise FloatingPointError("no finite fit")
        k = self.n_params
        self.aicc = n * np.log(max(sse / n, 1e-12)) + 2 * k + 2 * k * (k + 1) / (n - k - 1)

    def _split(self, params: np.ndarray) -> tuple[np.ndarray, ...]:
        p, q, sp, sq = self.order
        return tuple(np.split(params, np.cumsum([p, sp, q, sq])))

    def _begin(self, u: np.ndarray) -> np.ndarray:
        """Plain coefficients regressed on lagged values and on the errors of a long autoregression, seasonal ones small; shrunk until roots allow."""
        p, q, sp, sq = self.order
        long = min(2 * self.season + 7, len(u) // 4)
        base = np.stack([_lagged(u, k) for k in range(1, long + 1)], axis=1)
        e = u - base @ _solve(base[long:], u[long:])
        e[:long] = 0
        design = np.stack([*(_lagged(u, k) for k in range(1, p + 1)), *(_lagged(e, k) for k in range(1, q + 1))], axis=1) if p + q else np.empty((len(u), 0))
        c = _solve(design[long + 3 :], u[long + 3 :]) if p + q else np.empty(0)
        ar, ma = c[:p], c[p:]
        while not (_inside(ar, -1) and _inside(ma, 1)):
            ar, ma = ar * 0.9, ma * 0.9
        return np.concatenate([ar, np.full(sp, 0.1), ma, np.full(sq, -0.1)])

    def _errors(self, z: np.ndarray, params: np.ndarray) -> tuple[np.ndarray, np.ndarray, float] | None:
        """Errors, their derivatives and sum of squares after the start; None outside the region of stable coefficients."""
        ar, sar, ma, sma, beta = self._split(params)
        if not (np.isfinite(params).all() and _inside(ar, -1) and _inside(sar, -1) and _inside(ma, 1) and _inside(sma, 1)):
            return None
        n, s = len(z), self.season
        plain, seasonal = _polynomial(ar, 1, -1), _polynomial(sar, s, -1)
        inner, outer = (_inverse(_polynomial(c, k, 1), n) if len(c) else np.ones(1) for c, k in ((ma, 1), (sma, s)))
        back = lambda v: _filtered(outer, _filtered(inner, v))
        u = z - self.columns @ beta
        e = back(_filtered(plain, _filtered(seasonal, u)))
        by_ar, by_sar = back(_filtered(seasonal, u)) if len(ar) else None, back(_filtered(plain, u)) if len(sar) else None
        by_ma, by_sma = _filtered(inner, e) if len(ma) else None, _filtered(outer, e) if len(sma) else None
        slopes = [-_lagged(by_ar, k) for k in range(1, len(ar) + 1)] + [-_lagged(by_sar, s * k) for k in range(1, len(sar) + 1)]
        slopes += [-_lagged(by_ma, k) for k in range(1, len(ma) + 1)] + [-_lagged(by_sma, s * k) for k in range(1, len(sma) + 1)]
        fixed = -back(_filtered(plain, _filtered(seasonal, self.columns)))
        jacobian = np.column_stack([*slopes, fixed])[self.start :]
        sse = float(e[self.start :] @ e[self.start :])
        return (e, jacobian, sse) if np.isfinite(sse) and np.isfinite(jacobian).all() else None

    def has_common_root(self) -> bool:
        """Whether a plain or seasonal pair of polynomials nearly shares a root: then a smaller order says the same."""
        ar, sar, ma, sma, _ = self._split(self.params)
        pairs = ((_inverse_roots(ar, -1), _inverse_roots(ma, 1)), (_inverse_roots(sar, -1), _inverse_roots(sma, 1)))
        return any(len(a) and len(b) and np.abs(a[:, None] - b[None, :]).min() < COMMON for a, b in pairs)

    def forecast(self, horizon: int, x_ahead: np.ndarray | None = None, x_back: np.ndarray | None = None) -> np.ndarray:
        """x_ahead: regressors of the horizon; x_back: those of the season before, if differenced."""
        ar, sar, ma, sma, beta = self._split(self.params)
        phi = np.convolve(_polynomial(ar, 1, -1), _polynomial(sar, self.season, -1))
        theta = np.convolve(_polynomial(ma, 1, 1), _polynomial(sma, self.season, 1))
        u, e, y = list(self.z - self.columns @ beta), list(self.e), list(self.y)
        for h in range(horizon):
            value = -sum(c * u[-k] for k, c in enumerate(phi) if k and c) + sum(c * e[-k] for k, c in enumerate(theta) if k and c)
            u.append(value)
            e.append(0.0)
            level = value + beta[-1]
            if self.n_x:
                ahead = np.asarray(x_ahead[h], float) - (np.asarray(x_back[h], float) if self.seasonal else 0)
                level += float(ahead[self.used] @ beta[:-1])
            y.append(level * self.scale + (y[-self.season] if self.seasonal else 0))
        return np.array(y[-horizon:])


def select(y: np.ndarray, season: int, seasonal: bool, x: np.ndarray | None = None) -> Order:
    """The order with the least AICc over one sample; none left is an error.

    Orders that can't be fitted are skipped, and so are those whose polynomials share a root: their likelihood has no definite
    coefficients, so that AICc, which counts them, would favour them on noise.
    """
    best: tuple[float, Order] | None = None
    start = longest_lag(season, seasonal)
    for order in grid(seasonal):
        try:
            made = Fit(y, order, season, seasonal, x, start)
            score = np.inf if made.has_common_root() else made.aicc
        except (FloatingPointError, ValueError, np.linalg.LinAlgError):
            continue
        if np.isfinite(score) and (best is None or score < best[0] - 1e-9):
            best = (score, order)
    if best is None:
        raise ValueError("no order could be fitted")
    return best[1]
