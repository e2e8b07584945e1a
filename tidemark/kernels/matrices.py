"""Matrix-valued kernels: VAR(2), spectral radius, Kalman filter and likelihood, HP and Hamilton filters."""

from __future__ import annotations

import numpy as np

from tidemark.kernels import ar
from tidemark.kernels.paths import Null


# ------------------------------------------------ VAR(2)
def var2(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """c (m, k), A1, A2 (m, k, k) and spectral radius of batches of windows (m, w, k); NaN where the design is singular."""
    m, w, k = windows.shape
    z = np.concatenate([np.ones((m, w - 2, 1)), windows[:, 1:-1], windows[:, :-2]], 2)
    y = windows[:, 2:]
    scale = np.sqrt((z * z).mean(1, keepdims=True))
    scale[scale == 0] = 1
    q, r = np.linalg.qr(z / scale)
    d = np.abs(np.diagonal(r, axis1=1, axis2=2))
    ok = d.min(1) > 1e-10 * d.max(1)
    beta = np.full((m, 2 * k + 1, k), np.nan)
    if ok.any():
        beta[ok] = np.linalg.solve(r[ok], np.swapaxes(q[ok], 1, 2) @ y[ok]) / np.swapaxes(scale[ok], 1, 2)
    a1, a2 = np.swapaxes(beta[:, 1 : k + 1], 1, 2), np.swapaxes(beta[:, k + 1 :], 1, 2)
    return beta[:, 0], a1, a2, radius(a1, a2)


def companion(a1: np.ndarray, a2: np.ndarray) -> np.ndarray:
    m, k, _ = a1.shape
    lower = np.broadcast_to(np.concatenate([np.eye(k), np.zeros((k, k))], 1), (m, k, 2 * k))
    return np.concatenate([np.concatenate([a1, a2], 2), lower], 1)


def radius(a1: np.ndarray, a2: np.ndarray) -> np.ndarray:
    f = companion(a1, a2)
    ok = np.isfinite(f).all((1, 2))
    out = np.full(len(f), np.nan)
    if ok.any():
        out[ok] = np.abs(np.linalg.eigvals(f[ok])).max(1)
    return out


def rolling_var2(x: np.ndarray, window: int = 40) -> tuple[np.ndarray, ...]:
    return var2(np.ascontiguousarray(np.swapaxes(np.lib.stride_tricks.sliding_window_view(x, window, axis=0), 1, 2)))


def var_null(x: np.ndarray) -> Null | None:
    """The full-sample VAR(2), where it is strictly stable."""
    c, a1, a2, m = var2(x[None])
    return Null(x, c[0], [a1[0], a2[0]]) if m[0] < 1 else None


def _var_values(paths: np.ndarray, window: int, **_):
    """Spectral radius, and the first variable's autocorrelation, of the window that ends at a position.  A window's
    moments are differences of running totals; one that hardly varies is fitted from its own values."""
    lag1 = ar.windowed(paths, window)
    m, n, k = paths.shape
    centred = paths - paths.mean(1, keepdims=True)
    row = np.concatenate([np.ones((m, n - 2, 1)), centred[:, 2:], centred[:, 1:-1], centred[:, :-2]], 2)
    total = np.zeros((m, n - 1, 1 + 3 * k, 1 + 3 * k))
    np.cumsum(row[:, :, :, None] * row[:, :, None, :], axis=1, out=total[:, 1:])
    thin = ar.THIN * (centred * centred).sum(1).min(1) + 1e-300

    def radii(rows, at):
        g = total[rows, at - 1] - total[rows, at + 1 - window]
        mean = g[:, 0, 1:] / g[:, :1, 0]
        g = g[:, 1:, 1:] - mean[:, :, None] * g[:, 0, None, 1:]
        weak = np.diagonal(g, axis1=1, axis2=2).min(1) < thin[rows]
        g[weak] = np.eye(3 * k)
        scale = np.sqrt(np.diagonal(g, axis1=1, axis2=2))
        g = g / scale[:, :, None] / scale[:, None, :]
        flat = np.linalg.cond(g[:, k:, k:]) > 1e14
        g[flat] = np.eye(3 * k)
        beta = np.linalg.solve(g[:, k:, k:], g[:, k:, :k]) * scale[:, None, :k] / scale[:, k:, None]
        out = radius(np.swapaxes(beta[:, :k], 1, 2), np.swapaxes(beta[:, k:], 1, 2))
        own = np.flatnonzero(weak | flat)
        if len(own):
            out[own] = var2(paths[rows[own][:, None], at[own][:, None] + np.arange(1 - window, 1)])[3]
        return out

    return lambda metric, rows, at: lag1(metric, rows, at) if metric == "lag1" else radii(rows, at)


def var_test(x: np.ndarray, rng: np.random.Generator, B: int = 1000, metrics=("primary",), **opts) -> list[dict]:
    """The surrogate test of a VAR(2)'s spectral radius before onsets of the first variable; residual vectors are
    resampled jointly."""
    return ar.surrogate_test(x, lambda: var_null(x), _var_values, rng, B, metrics, **({"chunk": max(1, min(200, 100_000 // len(x)))} | opts))


def roots_stable(coefficients: np.ndarray) -> tuple[bool, float]:
    """All roots (constant term first) inside the unit circle, and the distance of the nearest to the circle."""
    r = np.abs(np.roots(coefficients[::-1]))
    return bool((r < 1).all()), float(np.abs(r - 1).min())


def schur_cohn(coefficients: np.ndarray) -> np.ndarray:
    """All roots inside the unit circle, of real polynomials of one degree (m, d + 1), constant term first: a step for each degree,
    scaled to its largest coefficient."""
    p, ok = coefficients.T, np.ones(len(coefficients), bool)
    for _ in range(len(p) - 1):
        q = (p[-1] * p - p[0] * p[::-1])[1:]
        most = np.abs(q).max(0)
        ok &= (np.abs(p[0]) < np.abs(p[-1])) & (most > 0)
        p = q / np.where(ok, most, 1)
    return ok


def largest_modulus(coefficients: np.ndarray, squarings: int = 30) -> np.ndarray:
    """Largest modulus of the roots of the same polynomials, by `squarings` root squarings; each time the roots' scale is taken out
    first, and its logarithm counts half as much as the one before.  Relative error below 1e-7."""
    p = coefficients[:, ::-1].T / coefficients[:, -1]
    d = len(p) - 1
    power, log = np.arange(1.0, d + 1)[:, None], np.zeros(p.shape[1])
    for k in range(squarings + 1):
        scale = (np.abs(p[1:]) ** (1 / power)).max(0)
        with np.errstate(divide="ignore"):
            log += np.log(scale) * 0.5**k
        if k == squarings:
            break
        p[1:] /= np.where(scale == 0, 1, scale) ** power
        q = np.zeros_like(p)
        for i in range(d + 1):  # terms i and j of one parity meet at (i + j) / 2
            odd = i % 2
            n = (d - odd) // 2 + 1
            q[(i + odd) // 2 : (i + odd) // 2 + n] += (-p[i] if odd else p[i]) * p[odd::2]
        p = q
    return np.exp(log)


# ------------------------------------------------ state space
def factored(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit upper-triangular U and diagonal d with p = U diag(d) U'; a zero pivot has a zero column."""
    p, k = np.array(p, float), len(p)
    u, d = np.eye(k), np.zeros(k)
    for j in reversed(range(k)):
        if p[j, j] < -1e-12 * max(1.0, abs(p).max()):
            raise ValueError("a covariance is positive semidefinite")
        d[j] = max(p[j, j], 0.0)
        if d[j]:
            u[:j, j] = p[:j, j] / d[j]
            p[:j, :j] -= d[j] * np.outer(u[:j, j], u[:j, j])
    return u, d


def state_filter(y: np.ndarray, z: np.ndarray, t: np.ndarray, q: np.ndarray, h: float, mean: np.ndarray, spread: np.ndarray, burn: int = 0) -> dict:
    """Filter y[i] = z[i] b[i] + noise of variance h, b[i+1] = t b[i] + noise of covariance q, from b[0] of this mean and
    covariance: filtered states, prediction errors and variances, and the log likelihood from observation `burn` on.
    The covariance is carried as U D U': observations by scalar steps over its columns, moves by weighted
    orthogonalisation of the rows of [t U, U_q]."""
    k, n = z.shape[1], len(y)
    if not h > 0 or not (np.isfinite(y).all() and np.isfinite(z).all()):
        raise ValueError("observations are finite, and their noise has a positive variance")
    (u, d), (uq, dq) = factored(spread), factored(q)
    b = np.array(mean, float)
    states, errors, variances = np.empty((n, k)), np.empty(n), np.empty(n)
    for i in range(n):
        load = z[i] @ u
        gains = d * load
        total = h + np.concatenate([[0.0], np.cumsum(load * gains)])
        errors[i], variances[i] = y[i] - z[i] @ b, total[-1]
        direction = np.zeros(k)
        new = u.copy()
        for j in range(k):
            new[:, j] = u[:, j] - direction * load[j] / total[j]
            direction = direction + u[:, j] * gains[j]
        u, d = new, d * total[:-1] / total[1:]
        b = b + direction * (errors[i] / total[-1])
        states[i] = b
        b = t @ b
        rows, weight = np.concatenate([t @ u, uq], 1), np.concatenate([d, dq])
        u, d = np.eye(k), np.zeros(k)
        for j in reversed(range(k)):
            d[j] = (rows[j] ** 2 * weight).sum()
            if d[j]:
                u[:j, j] = rows[:j] @ (rows[j] * weight) / d[j]
                rows[:j] -= u[:j, j, None] * rows[j]
    e, f = errors[burn:], variances[burn:]
    return {"states": states, "errors": errors, "variances": variances, "loglik": float(-0.5 * (np.log(2 * np.pi * f) + e * e / f).sum())}


#: Prior variance of the coefficients of the time-varying model.
DIFFUSE = 1e8


def tv_ar2(x: np.ndarray, r1: float, r2: float, burn: int = 3) -> tuple[np.ndarray, float, float]:
    """Time-varying AR(2): filtered (intercept, phi1, phi2), noise variance and log likelihood with the variance
    concentrated out.  Intercept fixed, both lags random walks with variance ratios r1, r2."""
    ll, states, noise = tv_filters(np.asarray(x, float)[None], np.array([[r1]]), np.array([[r2]]), burn, states=True)
    return states[:, :, 0, 0], float(noise[0, 0]), float(ll[0, 0])


GRID = np.concatenate([[0.0], 10.0 ** np.linspace(-8, -1, 15)])


def fit_tv_ar2(x: np.ndarray) -> dict:
    """One series' variance ratios by likelihood (see fit_tv_many), and its filtered states there."""
    x = np.asarray(x, float)
    r1, r2, ll, top = fit_tv_many(x[None])
    states, noise, ll = tv_ar2(x, r1[0], r2[0])
    return {"r1": float(r1[0]), "r2": float(r2[0]), "loglik": ll, "grid_loglik": float(top[0]), "sigma2": noise, "states": states}


def tv_filters(x: np.ndarray, r1: np.ndarray, r2: np.ndarray, burn: int = 3, states: bool = False):
    """Log likelihoods (m, g) of `tv_ar2` for paths x (m, n) at ratios r1, r2 (m, g), all filters at once in factored
    form (P = U D U'); with `states` also the filtered (intercept, phi1, phi2), (n - 2, 3, m, g), and the noise variance.
    A failed filter is NaN."""
    m, n = x.shape
    r1, r2 = (np.broadcast_to(np.asarray(r, float), (m, np.shape(r)[-1])) for r in (r1, r2))
    zero = np.zeros(r1.shape)
    u01, u02, u12, a0, a1, a2 = zero, zero, zero, zero, zero, zero
    d0 = d1 = d2 = np.full(r1.shape, DIFFUSE)
    logs, squares = zero, zero
    kept = np.empty((n - 2, 3, *r1.shape)) if states else None
    with np.errstate(all="ignore"):
        for t in range(2, n):
            z1, z2 = x[:, t - 1, None], x[:, t - 2, None]
            f1, f2 = u01 + z1, u02 + u12 * z1 + z2
            g1, g2 = d1 * f1, d2 * f2
            e0 = 1.0 + d0
            e1 = e0 + f1 * g1
            e2 = e1 + f2 * g2
            v = x[:, t, None] - a0 - z1 * a1 - z2 * a2
            b0 = d0 + u01 * g1
            n01, n12 = u01 - d0 * f1 / e0, u12 - g1 * f2 / e1
            n02 = u02 - b0 * f2 / e1
            k = v / e2
            a0, a1, a2 = a0 + (b0 + u02 * g2) * k, a1 + (g1 + u12 * g2) * k, a2 + g2 * k
            d0, d1, d2 = d0 / e0, d1 * e0 / e1, d2 * e1 / e2
            if t - 2 >= burn:
                logs, squares = logs + np.log(e2), squares + v * k
            if states:
                kept[t - 2] = a0, a1, a2
            p2 = d2 + r2  # the step of the random walks, by weighted Gram-Schmidt
            u12, u02 = n12 * d2 / p2, n02 * d2 / p2
            c1, c0 = n12 - u12, n02 - u02
            p1 = d1 + d2 * c1 * c1 + r1 + r2 * u12 * u12
            u01 = (n01 * d1 + c0 * c1 * d2 + u02 * u12 * r2) / p1
            h1, h2, h3 = n01 - u01, c0 - u01 * c1, u01 * u12 - u02
            d0, d1, d2 = d0 + d1 * h1 * h1 + d2 * h2 * h2 + r1 * u01 * u01 + r2 * h3 * h3, p1, p2
        count = n - 2 - burn
        ll = -0.5 * (count * np.log(2 * np.pi * squares / count) + logs + count)
    ll = np.where(np.isfinite(ll), ll, np.nan)
    return (ll, kept, squares / count) if states else ll


def fit_tv_many(x: np.ndarray, refine: int = 25, chunk: int = 16) -> tuple[np.ndarray, ...]:
    """Ratios r1, r2, log likelihood and the grid's best log likelihood of every path: the best point of the grid (ties:
    smaller ratios), then a bounded search on the log ratios by golden sections, axis by axis, taken only if it is no
    worse; NaN where all points fail."""
    r1, r2 = (g.ravel()[None] for g in np.meshgrid(GRID, GRID, indexing="ij"))
    order = np.lexsort((r1[0], r1[0] + r2[0]))  # the first of equals has the smaller ratios
    r1, r2 = r1[:, order], r2[:, order]
    grid = np.concatenate([tv_filters(x[lo : lo + chunk], r1, r2) for lo in range(0, len(x), chunk)])
    at = np.where(np.isnan(grid), -np.inf, grid).argmax(1)
    top = grid[np.arange(len(x)), at]
    ll, point = top.copy(), np.stack([r1[0, at], r2[0, at]])
    for axis in (0, 1, 0, 1):
        free = point[axis] > 0
        log = np.log10(np.where(free, point[axis], 1.0))
        lo, hi = np.maximum(-10.0, log - 0.5), np.minimum(0.0, log + 0.5)
        own, other = x[free], point[1 - axis][free, None]
        at_ = lambda u: tv_filters(own, *((10**u, other) if axis == 0 else (other, 10**u)))  # noqa: B023, E731
        lo, hi = lo[free, None], hi[free, None]
        if not len(own):
            continue
        for _ in range(refine):
            a, b = lo + 0.382 * (hi - lo), lo + 0.618 * (hi - lo)
            left = at_(a) >= at_(b)
            lo, hi = np.where(left, lo, a), np.where(left, b, hi)
        mid = (lo + hi) / 2
        got = at_(mid)[:, 0]
        better = got >= ll[free]
        where = np.flatnonzero(free)[better]
        ll[where], point[axis, where] = got[better], 10 ** mid[better, 0]
    return point[0], point[1], ll, top


TV_METRICS = ("primary", "held_fixed", "trend")


def tv_test(x: np.ndarray, rng: np.random.Generator, B: int = 1000, metrics=TV_METRICS, first: int = 39, **opts) -> list[dict]:
    """The surrogate test of the filtered modulus of the time-varying AR(2), from position `first` on: every path's
    variance ratios by likelihood (primary, trend), or those of the series itself (held_fixed)."""
    x = np.asarray(x, float)
    held: list = []

    def values(paths, due, **_):
        paths = paths[:, :, 0]
        moduli = {name: np.full(paths.shape, np.nan) for name in ("own", "held")}
        if len(due):
            own = np.stack(fit_tv_many(paths[due])[:2])
            if not held:  # the observed series comes first
                held.extend(own[:, 0])
            for name, (p, q) in {"own": own[:, :, None], "held": np.broadcast_to(np.array(held)[:, None, None], (2, len(due), 1))}.items():
                states = tv_filters(paths[due], p, q, states=True)[1]
                moduli[name][due, first:] = ar.modulus(states[first - 2 :, 1, :, 0], states[first - 2 :, 2, :, 0]).T
        return lambda metric, row, at: moduli["held" if metric == "held_fixed" else "own"][row, at]

    return ar.surrogate_test(x[:, None], lambda: ar.null_model(x), values, rng, B, metrics, window=first + 1, **opts)


def local_level(y: np.ndarray, grid=np.logspace(-4, 3, 29), refine: int = 40) -> dict:
    """Local level model by likelihood over the signal-to-noise ratio, variance concentrated out: the best grid point,
    the grid carried on beyond an end while that is better, then golden sections on the log ratio; and both open ends,
    no level noise (ratio 0) and no observation noise (ratio infinite), of which the grid gives only neighbours."""

    def at(h, q):
        out = state_filter(y, np.ones((len(y), 1)), np.eye(1), np.array([[q]]), max(h, 1e-300), y[:1], np.eye(1) * 1e6, 1)
        v, f = out["errors"][1:], out["variances"][1:]
        s2 = float((v * v / f).mean())
        ll = float(-0.5 * (len(v) * np.log(2 * np.pi * s2) + np.log(f).sum() + len(v)))
        return {"ratio": float(q) if h else np.inf, "noise": h * s2, "level_noise": float(q * s2), "loglik": ll}

    of = lambda u: at(1.0, 10.0**u)
    logs = np.log10(grid)
    step = logs[1] - logs[0]
    points = [of(u) for u in logs]
    k = int(np.argmax([p["loglik"] for p in points]))
    u, best = logs[k], points[k]
    way = -step if k == 0 else step if k == len(logs) - 1 else 0.0
    while way and abs(u + way) <= 12 and (more := of(u + way))["loglik"] > best["loglik"]:
        u, best = u + way, more
    lo, hi = u - step, u + step
    for _ in range(refine):
        c, d = lo + 0.381966 * (hi - lo), lo + 0.618034 * (hi - lo)
        if of(c)["loglik"] >= of(d)["loglik"]:
            hi = d
        else:
            lo = c
    for other in (of((lo + hi) / 2), at(1.0, 0.0), at(0.0, 1.0)):
        if other["loglik"] >= best["loglik"]:
            best = other
    return best


# ------------------------------------------------ filters
def hp_cycle(y: np.ndarray, penalty: float = 1600.0) -> np.ndarray:
    """y minus its penalised trend: (I + penalty D'D) trend = y, a pentadiagonal system solved in linear time."""
    n = len(y)
    if n < 3:
        return np.zeros(n)
    d0, d1, d2 = np.ones(n), np.zeros(n), np.zeros(n)
    for i in range(n - 2):
        for j, u in enumerate((1, -2, 1)):
            d0[i + j] += penalty * u * u
        d1[i] += penalty * 1 * -2
        d1[i + 1] += penalty * -2 * 1
        d2[i] += penalty
    # LDL' of a band matrix of width two
    dd, l1, l2 = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        dd[i] = d0[i] - (l1[i - 1] ** 2 * dd[i - 1] if i > 0 else 0) - (l2[i - 2] ** 2 * dd[i - 2] if i > 1 else 0)
        if i + 1 < n:
            l1[i] = (d1[i] - (l2[i - 1] * l1[i - 1] * dd[i - 1] if i > 0 else 0)) / dd[i]
        if i + 2 < n:
            l2[i] = d2[i] / dd[i]
    t = y.astype(float).copy()
    for i in range(n):
        t[i] -= (l1[i - 1] * t[i - 1] if i > 0 else 0) + (l2[i - 2] * t[i - 2] if i > 1 else 0)
    t /= dd
    for i in range(n - 1, -1, -1):
        t[i] -= (l1[i] * t[i + 1] if i + 1 < n else 0) + (l2[i] * t[i + 2] if i + 2 < n else 0)
    return y - t


def hamilton_cycle(y: np.ndarray, h: int = 8, p: int = 4) -> np.ndarray:
    """Residual of y[t+h] on (1, y[t], ..., y[t-p+1]); NaN where it isn't defined or the design is singular."""
    n = len(y)
    out = np.full(n, np.nan)
    if n < h + p + p + 1:
        return out
    t = np.arange(p - 1, n - h)
    z = np.stack([np.ones(len(t)), *(y[t - j] for j in range(p))], 1)
    beta, _, rank, _ = np.linalg.lstsq(z, y[t + h], rcond=None)
    if rank == p + 1:
        out[t + h] = y[t + h] - z @ beta
    return out
