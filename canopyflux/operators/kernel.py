"""The numerical kernel of change detection, in numpy: one series in, its segments out.

The series of a location is fitted with harmonic models by the lasso. A model is started on a stable year, extended
while new observations agree with it, and closed where ``peek`` observations in a row don't; what lies before the first
model and after the last one gets a plain model of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from math import ceil, erf, exp, gamma, lgamma, log, pi, sqrt

import numpy as np

from canopyflux.params import CcdParams

BANDS = ("ndvi", "green", "swir2")
#: A model fits when it has this many observations to compare with; also the least window with seasonal errors.
SEASONAL = 24


# --- statistics --------------------------------------------------------------------------------------------------------


def chi2_cdf(x: float, degrees: int) -> float:
    """Lower regularised incomplete gamma function of degrees / 2 at x / 2."""
    if x <= 0:
        return 0.0
    if degrees == 3:
        return erf(sqrt(x / 2)) - sqrt(2 * x / pi) * exp(-x / 2)
    a, z = degrees / 2, x / 2
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= z / k
            total += term
        return total * exp(-z + a * log(z) - lgamma(a))
    # continued fraction of the upper part (modified Lentz)
    b = z + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        n = -i * (i - a)
        b += 2
        d = 1 / (n * d + b)
        c = b + n / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - exp(-z + a * log(z)) / gamma(a) * h


@lru_cache(64)
def chi2_ppf(p: float, degrees: int) -> float:
    """The quantile, by bisection."""
    low, high = 0.0, 10.0
    while chi2_cdf(high, degrees) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, degrees) < p else (low, mid)
    return (low + high) / 2


def smallest_mode(values: np.ndarray) -> int:
    found, counts = np.unique(values, return_counts=True)
    return int(found[counts.argmax()])


def variogram(values: np.ndarray) -> np.ndarray:
    """Median absolute first difference of each row."""
    return np.median(np.abs(np.diff(values, axis=1)), axis=1)


def adjusted_variogram(dates: np.ndarray, values: np.ndarray) -> np.ndarray:
    """As :func:`variogram`, but at the first lag whose most frequent gap is over 30 days, and from gaps over 30 days only."""
    for lag in range(1, len(dates)):
        gaps = dates[lag:] - dates[:-lag]
        if smallest_mode(gaps) > 30:
            steps = np.abs(values[:, lag:] - values[:, :-lag])
            return np.median(steps[:, gaps > 30], axis=1)
    return variogram(values)


def adjust_peek(dates: np.ndarray, default: int) -> int:
    """More observations to look ahead at where they are denser than every 16 days. A median gap of 0 leaves the default."""
    gap = np.median(np.diff(dates))
    return max(default, int(np.round(default * 16 / gap))) if gap else default


def change_threshold(peek: int, params: CcdParams) -> float:
    degrees, p = len(params.detection_bands), params.chisquare_prob
    if peek > params.peek_size:
        p = 1 - (1 - p) ** (params.peek_size / peek)
    return chi2_ppf(p, degrees)


# --- models ------------------------------------------------------------------------------------------------------------


def harmonics(dates: np.ndarray, days: float) -> np.ndarray:
    """Rows of [t, cos wt, sin wt, cos 2wt, sin 2wt, cos 3wt, sin 3wt]."""
    angle = 2 * pi / days * dates.astype(float)
    return np.column_stack([dates, *(f(k * angle) for k in (1, 2, 3) for f in (np.cos, np.sin))]).astype(float)


@dataclass(frozen=True)
class Fit:
    """Models of all bands over one window. coefficients: band by term, unused terms 0."""

    coefficients: np.ndarray
    intercept: np.ndarray
    residual: np.ndarray
    rmse: np.ndarray

    def predict(self, terms: np.ndarray) -> np.ndarray:
        return self.coefficients @ terms.T + self.intercept[:, None]


def _optima(gram: np.ndarray, moments: np.ndarray, penalty: float, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By band the lasso's optimum where its coefficients have the signs of ``near``, and whether they have.

    Given the signs, the optimum is the solution of a linear system in the terms that aren't 0.
    """
    sign = np.sign(near)
    used = np.abs(sign)
    system = gram * used[:, :, None] * used[:, None, :]
    diagonal = np.arange(gram.shape[0])
    system[:, diagonal, diagonal] += 1 - used
    try:
        out = np.linalg.solve(system, (used * (moments - penalty * sign))[:, :, None])[..., 0]
    except np.linalg.LinAlgError:
        return near, np.zeros(len(near), bool)
    rest = np.abs(moments - out @ gram) * (1 - used)
    return out, (out * sign >= used * 1e-300).all(1) & (rest <= penalty).all(1)


def _nearby(gram: np.ndarray, moments: np.ndarray, penalty: float, near: np.ndarray, steps: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_optima`, but where the signs are wrong others are tried: terms that change theirs go, and the one that is
    farthest out of bounds comes in. What is told to be an optimum is one, as it is held against the same conditions."""
    out, right = _optima(gram, moments, penalty, near)
    signs = np.sign(near)
    for _ in range(steps):
        wrong = np.flatnonzero(~right)
        if not len(wrong):
            break
        sign, rest = signs[wrong], moments[wrong] - out[wrong] @ gram
        turned = (sign != 0) & (out[wrong] * sign <= 0)
        beyond = np.where(sign == 0, np.abs(rest), 0.0)
        term, rows = beyond.argmax(1), np.arange(len(wrong))
        into = (beyond[rows, term] > penalty) & ~turned.any(1)
        sign[turned] = 0
        sign[rows[into], term[into]] = np.sign(rest[rows[into], term[into]])
        signs[wrong] = sign
        out[wrong], right[wrong] = _optima(gram, moments[wrong], penalty, sign)
    return out, right


def lasso(gram: np.ndarray, moment: np.ndarray, square: float, penalty: float, sweeps: int, tolerance: float = 1e-4) -> np.ndarray:
    """Coordinate descent on centred sums: gram = X'X, moment = X'y, square = y'y, penalty = n * alpha.

    A sweep costs a handful of multiplications, whatever the number of observations. It ends when coordinates have come
    to rest and the duality gap is within tolerance * y'y. Where the signs found are those of the optimum, the optimum
    itself is returned.
    """
    k = len(moment)
    rows, q = gram.tolist(), moment.tolist()
    w, slope = [0.0] * k, list(q)  # slope = X'(y - Xw), kept up to date
    used = [j for j in range(k) if rows[j][j]]
    for sweep in range(sweeps):
        largest = moved = 0.0
        for j in used:
            scale, old = rows[j][j], w[j]
            rho = slope[j] + scale * old
            new = (rho - penalty) / scale if rho > penalty else (rho + penalty) / scale if rho < -penalty else 0.0
            if new != old:
                step = new - old
                slope = [a - step * b for a, b in zip(slope, rows[j], strict=True)]
                w[j] = new
                moved = max(moved, abs(step))
            largest = max(largest, abs(new))
        if largest == 0 or moved < tolerance * largest or sweep == sweeps - 1:
            wq = sum(a * b for a, b in zip(w, q, strict=True))
            rest = square - wq - sum(a * b for a, b in zip(w, slope, strict=True))
            steep = max(map(abs, slope))
            shrink = penalty / steep if steep > penalty else 1.0
            gap = (0.5 * rest * (1 + shrink**2) if steep > penalty else rest) + penalty * sum(map(abs, w)) - shrink * (square - wq)
            if gap <= tolerance * square:
                break
    best, right = _optima(gram, moment[None], penalty, np.array([w]))
    return best[0] if right[0] else np.array(w)


def fit_lasso(terms: np.ndarray, values: np.ndarray, coefs: int, params: CcdParams, near: Fit | None = None) -> Fit:
    """Lasso with a free intercept on the first coefs - 1 terms (least squares if alpha is 0), for all bands.

    near: the fit of a window that differs by an observation or so; mostly its signs are right, and no search is needed.
    """
    n, used = len(terms), coefs - 1
    x = terms[:, :used]
    mean_x, mean_y = np.add.reduce(x, 0) / n, np.add.reduce(values, 1) / n
    xc, yc = x - mean_x, values - mean_y[:, None]
    weights = np.zeros((len(values), terms.shape[1]))
    if params.alpha:
        gram, moments, squares = xc.T @ xc, xc.T @ yc.T, np.einsum("ij,ij->i", yc, yc)
        if near is None:
            right = np.zeros(len(values), bool)
        else:
            weights[:, :used], right = _nearby(gram, moments.T, n * params.alpha, near.coefficients[:, :used])
        for b in np.flatnonzero(~right):
            weights[b, :used] = lasso(gram, moments[:, b], float(squares[b]), n * params.alpha, params.lasso_max_iter)
    else:
        weights[:, :used] = np.linalg.lstsq(xc, yc.T, rcond=None)[0].T
    intercept = mean_y - weights[:, :used] @ mean_x
    residual = values - (weights[:, :used] @ x.T + intercept[:, None])
    free = n - coefs
    rmse = np.sqrt(np.einsum("ij,ij->i", residual, residual) / free) if free > 0 else np.full(len(values), np.nan)
    return Fit(weights, intercept, residual, rmse)


#: Fits all bands of a window: (terms, values by band, number of coefficients, parameters, a near fit or None).
Fitter = Callable[[np.ndarray, np.ndarray, int, CcdParams, Fit | None], Fit]


def bisquare(residual: np.ndarray, c: float = 4.685) -> np.ndarray:
    return np.where(np.abs(residual) < c, (1 - (residual / c) ** 2) ** 2, 0.0)


def robust_scale(residual: np.ndarray, dropped: int = 4) -> float:
    """Median absolute residual without the smallest ones, as a standard deviation."""
    left = np.sort(np.abs(residual))[dropped:]
    half = len(left) // 2
    return float((left[half] if len(left) % 2 else (left[half - 1] + left[half]) / 2) / 0.6745) if half else float(np.median(left) / 0.6745)


def _solve(x: np.ndarray, weights: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weighted least squares for each row of weights and of y, by normal equations; the least solution where these fail."""
    weighted = x.T[None] * weights[:, None, :]
    try:
        return np.linalg.solve(weighted @ x, (weighted @ y[:, :, None]))[..., 0]
    except np.linalg.LinAlgError:
        return np.array([np.linalg.lstsq(x * np.sqrt(w)[:, None], v * np.sqrt(w), rcond=None)[0] for w, v in zip(weights, y, strict=True)])


def robust_fit(x: np.ndarray, y: np.ndarray, rounds: int = 5, weigh=bisquare, scale_of=robust_scale, tolerance: float = 1e-8) -> np.ndarray:
    """Iteratively reweighted least squares of each row of y. A row ends when no coefficient has fallen by more than the tolerance."""
    tiny = np.finfo(float).eps
    now = _solve(x, np.ones_like(y), y)
    q = np.linalg.qr(x)[0]
    leverage = 1 / np.sqrt(1 - np.minimum((q * q).sum(1), 0.9999))
    floor = tiny * y.std(1)
    going = np.ones(len(y), bool)
    for _ in range(rounds):
        residual = (y - now @ x.T) * leverage
        scale = np.array([max(f, scale_of(r)) for f, r in zip(floor, residual, strict=True)])
        going &= scale >= tiny
        if not going.any():
            break
        new = _solve(x, weigh(residual / np.where(scale < tiny, 1, scale)[:, None]), y)
        before, now = now, np.where(going[:, None], new, now)
        going &= (before - now > tolerance).any(1)
        if not going.any():
            break
    return now


def cloud_outliers(dates: np.ndarray, values: np.ndarray, vario: np.ndarray, params: CcdParams) -> np.ndarray:
    """Observations that a robust seasonal model of any of the bands is far from.

    The model has a yearly wave and one as long as the window's years; for a window of one year both are the same.
    """
    days = dates.astype(float)
    w, years = 2 * pi / params.avg_days_yr, ceil((days[-1] - days[0]) / params.avg_days_yr)
    waves = [w] if years <= 1 else [w, w / years]
    x = np.column_stack([*(f(k * days) for k in waves for f in (np.cos, np.sin)), np.ones(len(days))])
    bands = list(params.tmask_bands)
    far = np.abs(robust_fit(x, values[bands]) @ x.T - values[bands]) > vario[bands, None] * params.t_const
    return far.any(0)


# --- the state machine -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Segment:
    start_day: int
    end_day: int
    break_day: int
    observation_count: int
    change_probability: int
    coefficients: np.ndarray
    intercept: np.ndarray
    rmse: np.ndarray
    magnitude: np.ndarray


class Detector:
    """Works through one series. ``live`` holds the places of observations not yet ruled out; windows count among these."""

    def __init__(self, dates: np.ndarray, values: np.ndarray, params: CcdParams, fitter: Fitter = fit_lasso) -> None:
        self.p, self.fitter = params, fitter
        # dates are counted from the first one, which keeps sums of products well-conditioned; angles need true dates
        self.zero = int(dates[0]) if len(dates) else 0
        self.all_dates, self.all_values = dates, values
        self.all_terms = harmonics(dates, params.avg_days_yr)
        if len(dates):
            self.all_terms[:, 0] -= self.zero
        self.live = np.arange(len(dates))
        self._view()
        self.segments: list[Segment] = []

    def _view(self) -> None:
        self.dates, self.values, self.terms = self.all_dates[self.live], self.all_values[:, self.live], self.all_terms[self.live]

    def _rule_out(self, places: np.ndarray | int) -> None:
        self.live = np.delete(self.live, places)
        self._view()

    def _fit(self, lo: int, hi: int, coefs: int, near: Fit | None = None) -> Fit:
        return self.fitter(self.terms[lo:hi], self.values[:, lo:hi], coefs, self.p, near)

    def _scores(self, residual: np.ndarray, error: np.ndarray) -> np.ndarray:
        """Sum over the bands of the squared residuals in units of the usual scatter, by observation."""
        bands = list(self.p.detection_bands)
        unit = np.maximum(self.vario[bands], error)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            return ((residual[bands] / unit) ** 2).sum(0)

    def _residual(self, fit: Fit, at: slice | np.ndarray) -> np.ndarray:
        return np.abs(self.values[:, at] - fit.predict(self.terms[at]))

    def run(self) -> list[Segment]:
        p = self.p
        if len(self.live) <= p.meow_size:
            return []
        self.peek = adjust_peek(self.dates, p.peek_size)
        self.limit = change_threshold(self.peek, p)
        self.outlier_limit = chi2_ppf(p.outlier_prob, len(p.detection_bands))
        self.vario = adjusted_variogram(self.dates, self.values)
        lo, hi, done, first = 0, p.meow_size, 0, True
        while hi <= len(self.live) - p.meow_size:
            first = first and not self.segments
            lo, hi, fit = self._start(lo, hi)
            if fit is None:
                break
            if lo > done:
                lo, hi = self._back(lo, hi, fit, done)
            if lo - done > self.peek and first:
                self._plain(done, lo)
                first = False
            if hi + self.peek > len(self.live):
                break
            hi = self._forward(lo, hi)
            done, lo, hi = hi, hi, hi + p.meow_size
        if done + self.peek < len(self.live):
            self._plain(done, len(self.live))
        return self.segments

    def _start(self, lo: int, hi: int) -> tuple[int, int, Fit | None]:
        """The next window of a year at least that is stable once cloudy observations are ruled out."""
        p, fit = self.p, None
        while hi + p.meow_size < len(self.live):
            if self.dates[hi - 1] - self.dates[lo] < p.day_delta:
                hi += 1
                continue
            out = cloud_outliers(self.dates[lo:hi], self.values[:, lo:hi], self.vario, p)
            kept = self.dates[lo:hi][~out]
            if len(kept) < p.meow_size or kept[-1] - kept[0] < p.day_delta:
                hi += 1
                continue
            if out.any():
                self._rule_out(lo + np.flatnonzero(out))
                hi -= int(out.sum())
            fit = self._fit(lo, hi, 4, fit)
            if self._stable(fit, lo, hi):
                return lo, hi, fit
            lo, hi = lo + 1, hi + 1
        return lo, hi, None

    def _stable(self, fit: Fit, lo: int, hi: int) -> bool:
        span = self.dates[hi - 1] - self.dates[lo]
        drift = np.abs(fit.coefficients[:, 0] * span) + np.abs(fit.residual[:, 0]) + np.abs(fit.residual[:, -1])
        return bool(self._scores(drift[:, None], fit.rmse[list(self.p.detection_bands)])[0] < self.limit)

    def _back(self, lo: int, hi: int, fit: Fit, done: int) -> tuple[int, int]:
        """Takes in observations before the window, as long as they agree with its model."""
        error = fit.rmse[list(self.p.detection_bands)]
        while lo > done:
            if lo - done > self.peek:
                last = lo - self.peek + 1
            elif lo - self.peek <= 0:
                last = 0
            else:
                last = done
            score = self._scores(self._residual(fit, np.arange(lo - 1, last - 1, -1)), error)
            if score.min() > self.limit:
                break
            if score[0] > self.outlier_limit:
                self._rule_out(lo - 1)
                lo, hi = lo - 1, hi - 1
                continue
            lo -= 1
        return lo, hi

    def _seasonal_error(self, fit: Fit, lo: int, hi: int) -> np.ndarray:
        """Error of the model's observations closest in the year to the end of the window."""
        bands = list(self.p.detection_bands)
        if hi - lo <= SEASONAL:
            return fit.rmse[bands]
        ahead = self.dates[lo:hi] - self.dates[max(lo, min(hi + self.peek - 1, len(self.all_dates) - 1, hi - 1))]
        off = np.abs(np.round(ahead / 365.25) * 365.25 - ahead)
        near = np.argsort(off, kind="stable")[:SEASONAL]
        return np.sqrt((fit.residual[bands][:, near] ** 2).sum(1)) / 4

    def _forward(self, lo: int, hi: int) -> int:
        """Extends the window to the next break or the end of the series, and adds the segment."""
        p, fit = self.p, None
        first_span = self.dates[hi - 1] - self.dates[lo]
        changed, residual, ahead = 0, np.zeros((len(self.values), 1)), hi
        while hi < len(self.live):
            n = hi - lo
            span = self.dates[hi - 1] - self.dates[lo]
            if fit is None or n < SEASONAL or span >= p.min_years * first_span:
                first_span = span
                share = n / p.num_obs_factor
                coefs = p.coefficient_min if share < p.coefficient_mid else p.coefficient_mid if share < p.coefficient_max else p.coefficient_max
                fit = self._fit(lo, hi, coefs, fit)
            ahead = hi
            residual = self._residual(fit, slice(hi, hi + self.peek))
            score = self._scores(residual, self._seasonal_error(fit, lo, hi))
            if score.min() > self.limit:
                changed = 1
                break
            if score[0] > self.outlier_limit:
                self._rule_out(hi)
                continue
            hi += 1
        if fit is None:
            fit = self._fit(lo, hi, p.coefficient_min)
        self._add(fit, lo, hi, min(ahead, len(self.live) - 1), changed, np.median(residual, axis=1))
        return hi

    def _plain(self, lo: int, hi: int) -> None:
        """A segment without a change for observations that no model took in."""
        self._add(self._fit(lo, hi, self.p.coefficient_min), lo, hi, min(hi, len(self.live) - 1), 0, np.zeros(len(self.values)))

    def _add(self, fit: Fit, lo: int, hi: int, at: int, changed: int, magnitude: np.ndarray) -> None:
        intercept = fit.intercept - fit.coefficients[:, 0] * self.zero
        day = [int(self.dates[i]) for i in (lo, hi - 1, at)]
        self.segments.append(Segment(*day, hi - lo, changed, fit.coefficients, intercept, fit.rmse, magnitude))


def detect(dates: np.ndarray, ndvi: np.ndarray, green: np.ndarray, swir2: np.ndarray, params: CcdParams | None = None, fitter: Fitter = fit_lasso) -> tuple[list[Segment], np.ndarray]:
    """Segments of a series and the mask of the observations that were used. Order of the input doesn't matter, but for equal dates.

    Bands without any scatter have no scale to compare with; such a series has no stable start and gets one plain segment.
    """
    dates, values = np.asarray(dates), np.array([ndvi, green, swir2], float)
    if values.shape[1:] != dates.shape:
        raise ValueError("bands and dates differ in length")
    order = np.argsort(dates, kind="stable")
    found = Detector(dates[order].astype(np.int64), values[:, order], params or CcdParams(), fitter)
    segments = found.run()
    mask = np.zeros(len(dates), bool)
    mask[found.live] = True
    return segments, mask
