"""Numerical kernels that Spark lacks, on plain arrays: distributions, exact tests, models, smoothing.

They run on bounded groups only (a trait, a state table, a few thousand rows), inside
applyInPandas or on aggregated sufficient statistics.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np

NORMAL = NormalDist()


def beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    return out


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * beta_fraction(a, b, x) / a
    return 1.0 - front * beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def t_two_sided_many(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """t_two_sided of whole arrays; equal degrees of freedom share their gamma functions, the fractions of all rows advance together."""
    a, x = df / 2, df / (df + t * t)
    kinds, which = np.unique(a, return_inverse=True)
    front = np.array([math.lgamma(k + 0.5) - math.lgamma(k) - math.lgamma(0.5) for k in kinds])[which]
    turn = x >= (a + 1) / (a + 2.5)  # the fraction of the other tail is the short one
    p, q, y = np.where(turn, 0.5, a), np.where(turn, a, 0.5), np.where(turn, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(front + a * np.log(x) + 0.5 * np.log1p(-x))
        tiny = 1e-300
        floor = lambda v: np.where(np.abs(v) > tiny, v, tiny)
        c, d = np.ones_like(y), 1.0 / floor(1.0 - (p + q) * y / (p + 1))
        out = d.copy()
        for m in range(1, 500):
            for step in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1.0 / floor(1.0 + step * d)
                c = floor(1.0 + step / c)
                out *= c * d
            if (np.abs(c * d - 1.0) < 1e-16).all():
                break
        tail = front * out / p
    tail = np.where(turn, 1.0 - tail, tail)
    return np.where(t == 0, 1.0, np.where(np.isfinite(t), tail, 0.0))


def polygamma(x: np.ndarray, order: int) -> np.ndarray:
    """Digamma (order 0) or trigamma (1) of positive values: recurrence up to 10, then the asymptotic series."""
    x, out = np.array(x, float), np.zeros(len(x))
    for _ in range(10):
        low = x < 10
        out[low] += -1 / x[low] if order == 0 else 1 / x[low] ** 2
        x[low] += 1
    u = 1 / (x * x)
    if order == 0:
        return out + np.log(x) - 0.5 / x - u * (1 / 12 - u * (1 / 120 - u * (1 / 252 - u * (1 / 240 - u / 132))))
    return out + 1 / x + u / 2 + u / x * (1 / 6 - u * (1 / 30 - u * (1 / 42 - u * (1 / 30 - u * 5 / 66))))


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def gamma_lower(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return front * total
    b, c = x + 1 - a, 1e300
    d = out = 1 / b
    for i in range(1, 1000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        out *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1.0 - front * out


def chi2_upper(x: float, df: float) -> float:
    return 1.0 - gamma_lower(df / 2, x / 2)


def root(f: Callable[[float], float], low: float, high: float, steps: int = 200) -> float:
    """A zero of a monotone function by bisection."""
    rising = f(high) > f(low)
    for _ in range(steps):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if (f(mid) > 0) == rising:
            high = mid
        else:
            low = mid
    return (low + high) / 2


def t_quantile(p: float, df: float) -> float:
    half = root(lambda t: 1 - t_two_sided(t, df) / 2 - max(p, 1 - p), 0.0, 1e6)
    return half if p >= 0.5 else -half


def _mode(step: Callable[[np.ndarray], np.ndarray], low: int, high: int) -> int:
    """The likeliest k of low .. high; step(k) is the logarithm of p(k + 1) / p(k), which falls."""
    while low < high:
        mid = (low + high) // 2
        if step(np.array([mid], float))[0] > 0:
            low = mid + 1
        else:
            high = mid
    return low


def _law(step: Callable[[np.ndarray], np.ndarray], low: int, high: int, least: float = -760.0) -> tuple[int, np.ndarray]:
    """The first k and the logarithms, up to a constant, of a law on low .. high with one peak, as far as they are above `least` from it: what is
    beyond is 0 as a double, so the table grows with the spread and not with the range."""
    mode = _mode(step, low, high)

    def side(k: int, way: int, end: int) -> np.ndarray:
        parts, at, size = [], 0.0, 1024
        while k != end and at > least:
            n = min(size, abs(end - k))
            steps = np.arange(n, dtype=float) * way + k
            logs = at + np.cumsum(step(steps) if way > 0 else -step(steps - 1))
            parts.append(logs)
            at, k, size = logs[-1], k + way * n, size * 2
        return np.concatenate(parts) if parts else np.zeros(0)

    down, up = side(mode, -1, low), side(mode, 1, high)
    return mode - len(down), np.concatenate([down[::-1], [0.0], up])


def _two_sided(first: int, logs: np.ndarray, at: int) -> float:
    """Sum of the probabilities that are no larger than the observed one."""
    if not first <= at < first + len(logs):
        return 0.0
    p = np.exp(logs)
    return float(min(1.0, p[logs <= logs[at - first] + math.log1p(1e-7)].sum() / p.sum()))


def poisson_rate_test(x1: int, t1: float, x2: int, t2: float, level: float = 0.95) -> dict[str, float]:
    """Exact comparison of two Poisson rates, given the total: ratio, p and Clopper-Pearson limits of the ratio."""
    n, share = int(x1 + x2), t1 / (t1 + t2)
    rise = math.log(share) - math.log1p(-share)
    law = _law(lambda k: np.log((n - k) / (k + 1)) + rise, 0, n)
    tail = (1 - level) / 2
    low = 0.0 if x1 == 0 else root(lambda p: beta_cdf(x1, n - x1 + 1, p) - tail, 0.0, 1.0)
    high = 1.0 if x1 == n else root(lambda p: beta_cdf(x1 + 1, n - x1, p) - (1 - tail), 0.0, 1.0)
    odds = lambda p: math.inf if p >= 1 else p / (1 - p) * t2 / t1
    ratio = (x1 / t1) / (x2 / t2) if x2 else (math.inf if x1 else math.nan)
    return {"ratio": ratio, "p": _two_sided(*law, int(x1)) if n else 1.0, "low": odds(low), "high": odds(high)}


def fisher_exact(a: int, b: int, c: int, d: int, level: float = 0.95) -> dict[str, float]:
    """2 x 2 table [[a, b], [c, d]]: two-sided p, conditional maximum-likelihood odds ratio and its limits."""
    a, row, col, n = int(a), int(a + b), int(a + c), int(a + b + c + d)
    lowest, highest = max(0, row + col - n), min(row, col)
    step = lambda k: np.log((col - k) / (k + 1) * (row - k) / (n - col - row + k + 1))

    def law(log_odds: float) -> tuple[np.ndarray, np.ndarray]:
        first, logs = _law(lambda k: step(k) + log_odds, lowest, highest)
        p = np.exp(logs)
        return np.arange(first, first + len(p)), p / p.sum()

    def moment(log_odds: float) -> float:
        k, p = law(log_odds)
        return float((p * k).sum()) - a

    def above(log_odds: float) -> float:
        k, p = law(log_odds)
        return float(p[k >= a].sum())

    def below(log_odds: float) -> float:
        k, p = law(log_odds)
        return float(p[k <= a].sum())

    tail = (1 - level) / 2
    top, bottom = a == highest, a == lowest
    solve = lambda f: math.exp(root(f, -60.0, 60.0))
    odds = math.inf if top else 0.0 if bottom else solve(moment)
    low = 0.0 if bottom else solve(lambda o: above(o) - tail)
    high = math.inf if top else solve(lambda o: tail - below(o))
    return {"odds_ratio": odds, "p": _two_sided(*_law(step, lowest, highest), a), "low": low, "high": high}


def least_squares(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Ordinary least squares with an intercept: coefficients, standard errors, t and p; raises on deficient rank."""
    design = np.column_stack([np.ones(len(y)), x])
    if len(y) <= design.shape[1] or np.linalg.matrix_rank(design) < design.shape[1]:
        raise ValueError("the design has deficient rank")
    q, r = np.linalg.qr(design)
    beta = np.linalg.solve(r, q.T @ y)
    df = len(y) - design.shape[1]
    inverse = np.linalg.inv(r)
    se = np.sqrt(((y - design @ beta) ** 2).sum() / df * (inverse * inverse).sum(1))
    t = beta / np.where(se > 0, se, np.nan)
    return {"beta": beta, "se": se, "t": t, "p": np.array([t_two_sided(v, df) if not math.isnan(v) else math.nan for v in t])}


def midranks(x: np.ndarray) -> np.ndarray:
    _, inverse, count = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[inverse]


def inverse_normal_ranks(x: np.ndarray) -> np.ndarray:
    return np.array([NORMAL.inv_cdf((r - 0.5) / len(x)) for r in midranks(x)])


def spearman_permutation(x: np.ndarray, y: np.ndarray, n: int, seed: int) -> tuple[float, float]:
    """rho and its two-sided plus-one permutation p."""
    a, b = midranks(x), midranks(y)
    a, b = (a - a.mean()) / (a.std() or 1), (b - b.mean()) / (b.std() or 1)
    rho = float((a * b).mean())
    rng = np.random.default_rng(seed)
    null = np.array([(a * rng.permutation(b)).mean() for _ in range(n)])
    return rho, float(((np.abs(null) >= abs(rho) - 1e-12).sum() + 1) / (n + 1))


def partial_spearman(x: np.ndarray, y: np.ndarray, nuisance: np.ndarray, n: int, seed: int) -> tuple[float, float]:
    """Rank correlation of residuals on the nuisance columns; p from permuted residuals (Freedman-Lane)."""
    z = np.column_stack([np.ones(len(x)), *[midranks(c) for c in nuisance.T]])
    if np.linalg.matrix_rank(z) < z.shape[1]:
        raise ValueError("the nuisance columns have deficient rank")
    q, _ = np.linalg.qr(z)
    residual = lambda v: v - q @ (q.T @ v)
    a, b = residual(midranks(x)), residual(midranks(y))
    correlate = lambda u, v: float(u @ v / math.sqrt((u @ u) * (v @ v)))
    rho, rng = correlate(a, b), np.random.default_rng(seed)
    null = np.array([correlate(a, residual(rng.permutation(b))) for _ in range(n)])
    return rho, float(((np.abs(null) >= abs(rho) - 1e-12).sum() + 1) / (n + 1))


def lowess(x: np.ndarray, y: np.ndarray, share: float = 0.45, rounds: int = 1) -> np.ndarray:
    """Locally weighted lines with tricube weights and `rounds` bisquare reweightings; share 1 for six points or fewer."""
    n = len(x)
    share = 1.0 if n <= 6 else share
    near, robust, fit = max(2, min(n, math.ceil(share * n))), np.ones(n), np.zeros(n)
    for step in range(rounds + 1):
        for i in range(n):
            d = np.abs(x - x[i])
            h = np.partition(d, near - 1)[near - 1]
            w = robust * np.clip(1 - (d / h) ** 3, 0, None) ** 3 if h > 0 else robust * (d == 0)
            total = w.sum()
            mx, my = (w @ x) / total, (w @ y) / total
            spread = w @ (x - mx) ** 2
            fit[i] = my + ((w @ ((x - mx) * (y - my))) / spread * (x[i] - mx) if spread > 1e-12 else 0.0)
        if step < rounds:
            off = np.abs(y - fit)
            scale = 6 * np.median(off)
            robust = np.clip(1 - (off / scale) ** 2, 0, None) ** 2 if scale > 0 else np.ones(n)
    return fit


def bootstrap_interval(x: np.ndarray, statistic: Callable[[np.ndarray], float], n: int, seed: int, level: float = 0.95) -> tuple[float, float]:
    rng = np.random.default_rng(seed)
    draws = [statistic(x[rng.integers(0, len(x), len(x))]) for _ in range(n)]
    return tuple(np.quantile(draws, [(1 - level) / 2, (1 + level) / 2]).tolist())


def silhouette_mean(distances: np.ndarray, labels: np.ndarray) -> float:
    """Mean of (b - a) / max(a, b) over a full distance matrix, a the mean distance to the own cluster and b to the nearest other one;
    0 for a cluster of one."""
    own = labels[:, None] == np.unique(labels)[None]
    size, total = own.sum(0), distances @ own
    inside = total[own] / np.maximum(size[own.argmax(1)] - 1, 1)
    outside = np.where(own, np.inf, total / size).min(1)
    most = np.maximum(inside, outside)
    return float(np.where((size[own.argmax(1)] > 1) & (most > 0), (outside - inside) / np.where(most > 0, most, 1), 0.0).mean())


def line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of the least-squares line; slope 0 where x does not vary."""
    spread = ((x - x.mean()) ** 2).sum()
    slope = ((x - x.mean()) * (y - y.mean())).sum() / spread if spread > 0 else 0.0
    return float(y.mean() - slope * x.mean()), float(slope)


def smooth(x: np.ndarray, y: np.ndarray, share: float = 0.45) -> np.ndarray:
    """Fitted values at x: locally weighted lines for four distinct places or more, a parabola for three of four points
    or more, otherwise a line; nan for fewer than three points or two places, and at points that are not finite."""
    fit, ok = np.full(len(y), np.nan), np.isfinite(x) & np.isfinite(y)
    a, b = x[ok], y[ok]
    places = len(np.unique(a))
    if len(a) < 3 or places < 2:
        return fit
    if places >= 4:
        order = np.argsort(a, kind="stable")
        fit[ok] = np.interp(a, a[order], lowess(a[order], b[order], min(max(share, 0.2), 1.0)))
    elif places == 3 and len(a) >= 4:
        fit[ok] = np.polyval(np.polyfit(a, b, 2), a)
    else:
        start, slope = line(a, b)
        fit[ok] = start + slope * a
    return fit


def pseudo_r2(y: np.ndarray, fit: np.ndarray) -> float:
    """1 less the share of the variation around the mean that the fit leaves, within [0, 1]; nan for fewer than three points or no variation."""
    ok = np.isfinite(y) & np.isfinite(fit)
    total = ((y[ok] - y[ok].mean()) ** 2).sum() if ok.sum() >= 3 else 0.0
    return float(np.clip(1 - ((y[ok] - fit[ok]) ** 2).sum() / total, 0.0, 1.0)) if total > 0 else math.nan


def smooth_permutation(x: np.ndarray, y: np.ndarray, n: int, seed: int, share: float = 0.45) -> dict[str, float]:
    """pseudo_r2 of the smooth fit, its plus-one permutation p, and the slope toward smaller x. Nothing for fewer than four
    points or three places."""
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = x[ok], y[ok]
    out = {"r2": math.nan, "p": math.nan, "slope": math.nan, "points": len(x), "permutations": n}
    seen = pseudo_r2(y, smooth(x, y, share)) if len(x) >= 4 and len(np.unique(x)) >= 3 else math.nan
    if math.isnan(seen):
        return out
    rng = np.random.default_rng(seed)
    null = np.array([pseudo_r2(z, smooth(x, z, share)) for z in (rng.permutation(y) for _ in range(n))])
    null = null[np.isfinite(null)]
    p = ((null >= seen - 1e-15).sum() + 1) / (len(null) + 1) if len(null) else math.nan
    return out | {"r2": seen, "p": float(p), "slope": line(-x, y)[1], "permutations": len(null)}


def fixed_mean_mixture(x: np.ndarray, states: np.ndarray, sigma: float | None = None, rounds: int = 100, floor: float = 0.05) -> dict[str, np.ndarray | float]:
    """Mixture of normals at fixed integer states with one offset and one sigma (expectation-maximisation)."""
    offset, weight = 0.0, np.full(len(states), 1 / len(states))
    sigma = sigma or max(0.1, float(x.std() / 2) if len(x) > 1 else 0.1)
    for _ in range(rounds):
        logs = np.log(np.clip(weight, 1e-300, None)) - 0.5 * ((x[:, None] - states - offset) / sigma) ** 2 - math.log(sigma)
        top = logs.max(1, keepdims=True)
        part = np.exp(logs - top)
        part /= part.sum(1, keepdims=True)
        moved = float((part * (x[:, None] - states)).sum() / len(x))
        spread = math.sqrt(float((part * (x[:, None] - states - moved) ** 2).sum() / len(x)))
        weight, done = part.mean(0), abs(moved - offset) < 1e-12 and abs(max(floor, spread) - sigma) < 1e-12
        offset, sigma = moved, max(floor, spread)
        if done:
            break
    return {"offset": offset, "sigma": sigma, "weight": weight, "state": states[part.argmax(1)]}


def labelled_mixture(x: np.ndarray, y: np.ndarray, pool: np.ndarray | None = None) -> dict[str, np.ndarray | float]:
    """fixed_mean_mixture of integer copies: a line from the labelled (x, y) scales the pool (the labelled x without one);
    states reach from its floor (0 at least) to its ceiling and one; sigma starts from the labelled residuals (0.1 at least)."""
    if not len(x):
        raise ValueError("no labelled values")
    intercept, slope = line(x, y)
    scaled = intercept + slope * (x if pool is None or not len(pool) else pool)
    states = np.arange(max(0, math.floor(scaled.min())), math.ceil(scaled.max()) + 2, dtype=float)
    start = max(0.1, float((intercept + slope * x - y).std()))
    return {"intercept": intercept, "slope": slope, "states": states} | fixed_mean_mixture(scaled, states, start)


def logistic_fit(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> dict[str, np.ndarray]:
    """Logistic regression with an intercept by reweighted least squares: beta, se, p (Wald); raises without convergence."""
    design = np.column_stack([np.ones(len(y)), x])
    beta = np.zeros(design.shape[1])
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        w = mu * (1 - mu)
        step = np.linalg.solve(design.T @ (w[:, None] * design), design.T @ (y - mu))
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    else:
        raise ValueError("no convergence: the outcome may be separated")
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ (w[:, None] * design))))
    return {"beta": beta, "se": se, "p": np.array([2 * NORMAL.cdf(-abs(z)) for z in beta / se])}


def count_model(x: np.ndarray, y: np.ndarray, exposure: np.ndarray, theta: float = math.inf, rounds: int = 100) -> dict[str, np.ndarray | float]:
    """Log-linear count regression with offset log(exposure), by reweighted least squares: Poisson, or negative binomial of a given theta."""
    design = np.column_stack([np.ones(len(y)), x])
    beta = np.zeros(design.shape[1])
    beta[0] = math.log(y.sum() / exposure.sum())
    for _ in range(rounds):
        mu = np.exp(np.clip(design @ beta, -50, 50)) * exposure
        w = mu / (1 + mu / theta)
        step = np.linalg.solve(design.T @ (w[:, None] * design), design.T @ (w * (y - mu) / mu))
        beta = beta + step
        if np.abs(step).max() < 1e-12:
            break
    mu = np.exp(design @ beta) * exposure
    w = mu / (1 + mu / theta)
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ (w[:, None] * design))))
    lg = np.vectorize(math.lgamma)
    if math.isinf(theta):
        loglik = float((y * np.log(mu) - mu - lg(y + 1)).sum())
    else:
        loglik = float((lg(y + theta) - lg(y + 1) - math.lgamma(theta) + theta * np.log(theta / (theta + mu)) + y * np.log(mu / (theta + mu))).sum())
    dispersion = float((((y - mu) ** 2) / mu).sum() / (len(y) - design.shape[1]))
    return {"beta": beta, "se": se, "loglik": loglik, "dispersion": dispersion, "aic": 2 * (design.shape[1] + (not math.isinf(theta))) - 2 * loglik}


def chosen_count_model(x: np.ndarray, y: np.ndarray, exposure: np.ndarray, limit: float = 1.5) -> dict[str, np.ndarray | float | str]:
    """Poisson, or negative binomial with theta of maximum likelihood if the dispersion exceeds the limit."""
    poisson = count_model(x, y, exposure)
    if poisson["dispersion"] <= limit:
        return poisson | {"family": "Poisson"}
    golden, low, high = (math.sqrt(5) - 1) / 2, -6.0, 10.0
    score = lambda v: -count_model(x, y, exposure, math.exp(v))["loglik"]
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if score(a) < score(b) else (a, high)
    theta = math.exp((low + high) / 2)
    return count_model(x, y, exposure, theta) | {"family": "Negative_binomial", "theta": theta}


def likelihood_ratio(small: float, large: float, df: int) -> tuple[float, float]:
    chi = max(0.0, 2 * (large - small))
    return chi, chi2_upper(chi, df)


def average_linkage(d: np.ndarray) -> list[tuple[int, int, float, int]]:
    """UPGMA merges (a, b, height, size) of a square distance matrix; ties go to the smallest pair."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    ids, size, out = list(range(n)), np.ones(n), []
    alive = np.ones(n, bool)
    for step in range(n - 1):
        masked = np.where(alive[:, None] & alive[None, :], d, np.inf)
        i, j = divmod(int(masked.argmin()), n)
        i, j = min(i, j), max(i, j)
        out.append((min(ids[i], ids[j]), max(ids[i], ids[j]), float(masked[i, j]), int(size[i] + size[j])))
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i], d[i, i] = row, row, np.inf
        size[i], ids[i], alive[j] = size[i] + size[j], n + step, False
    return out


def cut_clusters(merges: list[tuple[int, int, float, int]], n: int, clusters: int | None = None, height: float | None = None) -> np.ndarray:
    """Labels 0.. in order of the first member, after cutting to a number of clusters or below a height."""
    keep = merges[: n - clusters] if clusters is not None else [m for m in merges if m[2] <= height]
    root_ = list(range(n + len(merges)))
    find = lambda v: v if root_[v] == v else find(root_[v])
    for k, (a, b, _, _) in enumerate(merges):
        if k < len(keep):
            root_[find(a)] = root_[find(b)] = n + k
    names: dict[int, int] = {}
    return np.array([names.setdefault(find(i), len(names)) for i in range(n)])


def newick(merges: list[tuple[int, int, float, int]], names: list[str], form: str = ".6f") -> str:
    text, height = dict(enumerate(names)), dict.fromkeys(range(len(names)), 0.0)
    for k, (a, b, h, _) in enumerate(merges):
        node = len(names) + k
        text[node] = f"({text.pop(a)}:{h / 2 - height[a]:{form}},{text.pop(b)}:{h / 2 - height[b]:{form}})"
        height[node] = h / 2
    return next(iter(text.values())) + ";"


def principal_coordinates(d: np.ndarray, axes: int) -> tuple[np.ndarray, np.ndarray]:
    """Classical scaling: coordinates and the share explained by each axis with a positive eigenvalue."""
    n = len(d)
    centre = np.eye(n) - 1.0 / n
    values, vectors = np.linalg.eigh(-0.5 * centre @ (d * d) @ centre)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    good = values > 1e-9
    return (vectors[:, good] * np.sqrt(values[good]))[:, :axes], (values[good] / values[good].sum())[:axes]
