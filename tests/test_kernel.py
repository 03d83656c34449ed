"""The kernel against closed forms, brute force and properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from canopyflux.operators import kernel as k
from canopyflux.params import CcdParams

P = CcdParams()
DAYS = np.arange(736000, 736000 + 3 * 365, 5)


def waves(days, noise=0.0, seed=0):
    r = np.random.default_rng(seed)
    w = 2 * np.pi / 365.2425
    return [
        5000 + 1500 * np.cos(w * days) + noise * r.normal(0, 120, len(days)),
        600 + 80 * np.sin(w * days) + noise * r.normal(0, 25, len(days)),
        1500 + 200 * np.cos(w * days) + noise * r.normal(0, 50, len(days)),
    ]


def test_chi_square_quantiles():
    assert k.chi2_ppf(0.999, 3) == pytest.approx(16.26623619623813, rel=1e-9)
    assert k.chi2_ppf(0.95, 1) == pytest.approx(3.841458820694124, rel=1e-9)
    assert k.chi2_ppf(0.95, 4) == pytest.approx(9.487729036781154, rel=1e-9)
    assert k.change_threshold(19, P) == pytest.approx(5.973965, rel=1e-6)


def test_few_observations_have_no_model():
    n = 12
    segments, mask = k.detect(DAYS[:n], *(b[:n] for b in waves(DAYS)))
    assert segments == [] and mask.all()


def test_a_steady_series_is_one_segment():
    segments, mask = k.detect(DAYS, *waves(DAYS, 1.0))
    assert [(s.start_day, s.end_day, s.change_probability) for s in segments] == [(DAYS[0], DAYS[-1], 0)]
    assert mask.mean() > 0.98


def test_a_step_is_a_break_on_its_day():
    days = np.arange(736000, 736000 + 5 * 365, 5)
    after = days >= 736000 + 2 * 365
    a, b, c = waves(days, 1.0)
    segments, _ = k.detect(days, a - 4000 * after, b + 400 * after, c + 1000 * after)
    assert segments[0].break_day == days[after][0] and segments[0].change_probability == 1
    assert segments[1].start_day == days[after][0]
    assert segments[0].magnitude[0] == pytest.approx(4000, rel=0.1)


def test_a_spike_is_masked_and_no_break():
    a, b, c = waves(DAYS, 1.0)
    i = 130
    a[i] -= 4000
    b[i] += 900
    c[i] += 2500
    segments, mask = k.detect(DAYS, a, b, c)
    assert not mask[i] and [s.change_probability for s in segments] == [0]


def test_bands_without_scatter_have_one_plain_segment():
    flat = np.full(len(DAYS), 100.0)
    segments, _ = k.detect(DAYS, flat, flat, flat)
    assert [s.change_probability for s in segments] == [0]


@settings(max_examples=10, deadline=None)
@given(st.integers(0, 10_000))
def test_order_of_rows_does_not_matter(seed):
    order = np.random.default_rng(seed).permutation(len(DAYS))
    bands = waves(DAYS, 1.0, 3)
    a, _ = k.detect(DAYS, *bands)
    b, _ = k.detect(DAYS[order], *(x[order] for x in bands))
    assert [(s.start_day, s.end_day, s.break_day) for s in a] == [(s.start_day, s.end_day, s.break_day) for s in b]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.floats(0.01, 50))
def test_lasso_reaches_the_optimum(seed, alpha):
    r = np.random.default_rng(seed)
    x, y = r.normal(size=(40, 7)), r.normal(size=40) * 10
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.array(k.lasso(xc.T @ xc, xc.T @ yc, float(yc @ yc), 40 * alpha, 10_000, 1e-10))
    steep = xc.T @ (yc - xc @ w) / 40  # optimality: alpha * sign(w), or within alpha where w is 0
    assert np.all(np.abs(steep) <= alpha * (1 + 1e-4) + 1e-6)
    assert np.allclose(steep[w != 0], alpha * np.sign(w[w != 0]), atol=1e-3 * (1 + alpha))


def test_without_penalty_it_is_least_squares():
    r = np.random.default_rng(1)
    terms = k.harmonics(DAYS, 365.2425)
    terms[:, 0] -= DAYS[0]
    y = np.array([r.normal(size=len(DAYS))])
    fit = k.fit_lasso(terms, y, 8, CcdParams(alpha=0))
    want = np.linalg.lstsq(np.column_stack([terms, np.ones(len(DAYS))]), y[0], rcond=None)[0]
    assert np.allclose(fit.coefficients[0], want[:7]) and fit.intercept[0] == pytest.approx(want[7])


def test_robust_fit_ignores_gross_errors():
    x = np.column_stack([np.arange(30.0), np.ones(30)])
    y = np.array([2 * x[:, 0] + 1 + np.random.default_rng(0).normal(0, 0.01, 30)])
    y[0, [4, 17]] += 1000
    assert np.allclose(k.robust_fit(x, y, rounds=30)[0], [2, 1], atol=0.05)


def test_smallest_mode_and_gaps():
    assert k.smallest_mode(np.array([5, 3, 5, 3, 9])) == 3
    assert k.adjust_peek(np.arange(0, 100, 5), 6) == 19
    assert k.adjust_peek(np.zeros(10), 6) == 6
    assert k.adjust_peek(np.arange(0, 1000, 30), 6) == 6


def test_fits_nearby_need_no_search(monkeypatch):
    """Windows that differ by an observation mostly have signs that differ by a term; the optimum is found without a search, and is the same."""
    from canopyflux.operators import kernel

    r = np.random.default_rng(4)
    days = 736000 + np.sort(r.choice(2500, 500, replace=False))
    bands = [1000 * np.sin(days / 58.1 + k) + r.normal(0, 900, len(days)) for k in range(3)]
    calls, search = [], kernel.lasso
    monkeypatch.setattr(kernel, "lasso", lambda *a, **k: calls.append(1) or search(*a, **k))
    got, mask = kernel.detect(days, *bands)
    few = len(calls)
    monkeypatch.setattr(kernel, "_nearby", lambda gram, moments, penalty, near: (near, np.zeros(len(near), bool)))
    want, mask_ = kernel.detect(days, *bands)
    assert (mask == mask_).all() and len(got) == len(want) and few < (len(calls) - few) / 20
    for a, b in zip(got, want, strict=True):
        assert (a.start_day, a.end_day, a.break_day, a.change_probability) == (b.start_day, b.end_day, b.break_day, b.change_probability)
        np.testing.assert_allclose(a.coefficients, b.coefficients, rtol=1e-6, atol=1e-9)
