"""Exact binomial and normal statistics without a statistics package."""

from __future__ import annotations

import math
from statistics import NormalDist

#: Stirling errors of small integers come from lgamma; beyond, from the series.
_SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
#: Unit roundoffs within which a reciprocal counts as an integer; the largest planned sample.
RECIPROCAL_ULPS, MOST_TRIALS = 8, 100_000_000


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _stirling_error(n: float) -> float:
    """log(n!) less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    total, power = 0.0, 1 / n
    for c in _SERIES:
        total += c * power
        power /= n * n
    return total


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without cancellation."""
    if abs(x - mean) < 0.1 * (x + mean):
        v = (x - mean) / (x + mean)
        total, term, k = (x - mean) * v, 2 * x * v, 1
        while True:
            term *= v * v
            more = total + term / (2 * k + 1)
            if more == total:
                return more
            total, k = more, k + 1
    return x * math.log(x / mean) + mean - x if x else mean


def binomial_pmf(k: int, n: int, p: float) -> float:
    """By saddle point, exact to rounding for any n."""
    if p in (0.0, 1.0):
        return float(k == n * p)
    if k == 0:
        return math.exp(n * math.log1p(-p))
    if k == n:
        return math.exp(n * math.log(p))
    log = _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - _deviance(k, n * p) - _deviance(n - k, n * (1 - p))
    return math.exp(log) * math.sqrt(n / (2 * math.pi * k * (n - k)))


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta integral (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 100_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-16:
            return out
    return out


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p)."""
    if k >= n or p <= 0:
        return 1.0
    if k < 0 or p >= 1:
        return 0.0
    # P(X <= k) = I_{1-p}(n - k, k + 1); the shared prefactor is a pmf.
    a, b = k + 1, n - k
    front = binomial_pmf(k + 1, n, p) * (k + 1) * (1 - p) if k + 1 <= n else 0.0
    if p < (a + 1) / (a + b + 2):
        return 1 - front * _fraction(a, b, p) / a
    return front * _fraction(b, a, 1 - p) / b


def binomial_upper(successes: int, trials: int, alpha: float) -> float:
    """One-sided Clopper-Pearson upper bound, by bisection on the tail."""
    if trials <= 0 or not 0 <= successes <= trials or not 0 < alpha < 1:
        raise ValueError("needs trials > 0, 0 <= successes <= trials and 0 < alpha < 1")
    if successes == trials:
        return 1.0
    low, high = successes / trials, 1.0
    while True:
        mid = (low + high) / 2
        if mid in (low, high):
            return mid
        low, high = (mid, high) if binomial_tail(successes, trials, mid) > alpha else (low, mid)


def upper_within(successes: int, trials: int, limit: float, alpha: float) -> bool:
    """Whether the upper bound is at most ``limit``: one tail, no inverse."""
    return successes < trials and binomial_tail(successes, trials, limit) <= alpha or successes == trials and limit >= 1


def binomial_two_sided(k: int, n: int, p: float) -> float:
    """Exact two-sided test: all outcomes no likelier than the observed one."""
    own = binomial_pmf(k, n, p) * (1 + 1e-7)
    mode = math.floor((n + 1) * p)
    if binomial_pmf(min(mode, n), n, p) <= own:
        return 1.0

    def edge(lo: int, hi: int, rising: bool) -> int:
        """Last (or first) outcome of the far side that is no likelier."""
        while lo < hi:
            mid = (lo + hi + rising) // 2
            fits = binomial_pmf(mid, n, p) <= own
            if rising:
                lo, hi = (mid, hi) if fits else (lo, mid - 1)
            else:
                lo, hi = (lo, mid) if fits else (mid + 1, hi)
        return lo

    if k <= n * p:
        far = edge(mode, n + 1, False) if binomial_pmf(n, n, p) <= own else n + 1
        return min(1.0, binomial_tail(k, n, p) + (1 - binomial_tail(far - 1, n, p)))
    far = edge(0, mode, True) if binomial_pmf(0, n, p) <= own else -1
    return min(1.0, (1 - binomial_tail(k - 1, n, p)) + binomial_tail(far, n, p))


def count_cycle(rate: float) -> int:
    """Trials after which one more adverse count is planned: ceil(1/rate), rounding errors forgiven."""
    if not 0 <= rate <= 1:
        raise ValueError("rate must lie between 0 and 1")
    if rate == 0:
        return 1
    r = 1 / rate
    near = round(r)
    return max(1, near if abs(r - near) <= RECIPROCAL_ULPS * math.ulp(r) else math.ceil(r))


def planned_count(rate: float, trials: int) -> int:
    return min(trials, math.ceil(rate * trials))


def _check(rate: float, limit: float, alpha: float, most: int) -> None:
    if not (0 <= rate <= 1 and 0 < limit < 1 and 0 < alpha < 1 and most > 0):
        raise ValueError("needs 0 <= rate <= 1, 0 < limit < 1, 0 < alpha < 1 and a positive cap")


def passing_trials(rate: float, limit: float, alpha: float, most: int = MOST_TRIALS) -> int | None:
    """A sample size whose planned counts pass the bound: the first one near the crossing."""
    _check(rate, limit, alpha, most)
    if rate >= limit:
        return None

    def passes(n: int) -> bool:
        return upper_within(planned_count(rate, n), n, limit, alpha)

    below, above = 1, 1
    while not passes(above):
        if above >= most:
            return None
        below, above = above, min(most, 2 * above)
    while above - below > 1:
        middle = (below + above) // 2
        below, above = (below, middle) if passes(middle) else (middle, above)
    reach = max(5_000, 4 * count_cycle(rate))
    return next((n for n in range(max(1, above - reach), above) if passes(n)), above)


def stable_trials(rate: float, limit: float, alpha: float, most: int = MOST_TRIALS) -> tuple[int, int] | None:
    """(sample size, cycle): it and all sizes within one count cycle after it pass."""
    start = passing_trials(rate, limit, alpha, most)
    if start is None:
        return None
    cycle = count_cycle(rate)
    while start + cycle <= most:
        failing = next((n for n in range(start, start + cycle + 1) if not upper_within(planned_count(rate, n), n, limit, alpha)), None)
        if failing is None:
            return start, cycle
        start = failing + 1
    return None
