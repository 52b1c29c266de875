"""Batch kernels for exponential smoothing, intermittent demand and theta models.

Recursions run over weeks with all series and all grid points of a parameter at
once.  Every fold is a prefix, so one sweep serves all of them: the state is
copied out when a fold's last train week is reached.  Parameter grids and seasonal
treatment follow the published methods; grid widths are this package's choice.
"""

from __future__ import annotations

import numpy as np

H = 13
SEASON = 52
SES_GRID = np.arange(1, 100) / 100.0
DEMAND_GRID = np.arange(10, 31) / 100.0


def _snapshots(n: np.ndarray, t: int):
    """(series, fold) pairs whose train part ends with week t (0-based)."""
    return np.nonzero(n == t + 1)


def _flat(level: np.ndarray, h: int = H) -> np.ndarray:
    return np.repeat(level[:, :, None], h, axis=2)


def _best(sse: np.ndarray, values: np.ndarray) -> np.ndarray:
    pick = np.argmin(sse, axis=-1)[..., None]
    return np.take_along_axis(values, pick, axis=-1)[..., 0]


def ses_levels(y: np.ndarray, n: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Final level and one-step squared error per (series, fold, alpha)."""
    a, b = grid[None, :], 1 - grid[None, :]
    level = np.repeat(y[:, :1], len(grid), axis=1)
    sse = np.zeros_like(level)
    out_l = np.zeros((*n.shape, len(grid)))
    out_s = np.zeros_like(out_l)
    for t in range(y.shape[1]):
        if t:
            e = y[:, t, None] - level
            sse = sse + e * e
            level = a * y[:, t, None] + b * level
        i, j = _snapshots(n, t)
        out_l[i, j], out_s[i, j] = level[i], sse[i]
    return out_l, out_s


def simple_smoothing(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    level, sse = ses_levels(y, n, SES_GRID)
    return _flat(_best(sse, level))


def fixed_smoothing(alpha: float):
    def kernel(y, n):
        return _flat(ses_levels(y, n, np.array([alpha]))[0][:, :, 0])

    return kernel


def croston(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Smoothed demand size over smoothed gap between demands; no demand gives 0."""
    grid = DEMAND_GRID
    b_size, g = len(y), len(grid)
    a = grid[None, :]
    size, gap = np.zeros((b_size, g)), np.ones((b_size, g))
    sse_z, sse_p = np.zeros((b_size, g)), np.zeros((b_size, g))
    last = np.full(b_size, -1)
    seen = np.zeros(b_size, bool)
    out = np.zeros(n.shape)
    for t in range(y.shape[1]):
        hit = np.flatnonzero(y[:, t] != 0)
        if len(hit):
            z = y[hit, t, None]
            p = (t - last[hit])[:, None].astype(float)
            old = seen[hit][:, None]
            ez, ep = z - size[hit], p - gap[hit]
            sse_z[hit] += np.where(old, ez * ez, 0.0)
            sse_p[hit] += np.where(old, ep * ep, 0.0)
            size[hit] = np.where(old, a * z + (1 - a) * size[hit], z)
            gap[hit] = np.where(old, a * p + (1 - a) * gap[hit], p)
            last[hit] = t
            seen[hit] = True
        i, j = _snapshots(n, t)
        if len(i):
            out[i, j] = np.where(seen[i], _best(sse_z[i], size[i]) / _best(sse_p[i], gap[i]), 0.0)
    return _flat(out)


def imapa(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Mean over aggregation levels of smoothed block sums, per week."""
    out = np.zeros(n.shape)
    cum = np.concatenate([np.zeros((len(y), 1)), np.cumsum(y, axis=1)], axis=1)
    demands = np.cumsum(y != 0, axis=1)
    last_pos = np.maximum.accumulate(np.where(y != 0, np.arange(1, y.shape[1] + 1), 0), axis=1)
    for j in range(n.shape[1]):
        nj = n[:, j]
        at = np.maximum(nj, 1)[:, None] - 1
        count = np.take_along_axis(demands, at, 1)[:, 0]
        span = np.take_along_axis(last_pos, at, 1)[:, 0]
        levels = np.where(count > 0, np.maximum(np.floor(span / np.maximum(count, 1) + 0.5), 1), 0).astype(int)
        total = np.zeros(len(y))
        for k in range(1, int(levels.max(initial=0)) + 1):
            rows = np.flatnonzero((levels >= k) & (nj >= k))
            blocks = nj[rows] // k
            start = nj[rows] - blocks * k
            edge = start[:, None] + k * np.arange(int(blocks.max(initial=0)) + 1)[None, :]
            edge = np.minimum(edge, nj[rows][:, None])
            sums = np.diff(np.take_along_axis(cum[rows], edge, 1), axis=1)
            level, sse = ses_levels(sums, blocks[:, None], DEMAND_GRID)
            total[rows] += _best(sse, level)[:, 0] / k
        out[:, j] = total / np.maximum(levels, 1)
    return _flat(out)


# ---- error / trend state space ----------------------------------------------------------

_ALPHA = np.array([0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 0.95])
_BETA = np.array([0.01, 0.05, 0.1, 0.3, 0.6])
_PHI = np.array([0.8, 0.9, 0.98])


def ets_grid() -> np.ndarray:
    """Rows (alpha, beta, phi, parameters): ANN, AAN and damped AAN."""
    rows = [(a, 0.0, 0.0, 3) for a in _ALPHA]
    rows += [(a, a * b, 1.0, 5) for a in _ALPHA for b in _BETA]
    rows += [(a, a * b, p, 6) for a in _ALPHA for b in _BETA for p in _PHI]
    return np.array(rows)


def auto_ets(y: np.ndarray, n: np.ndarray, h: int = H) -> np.ndarray:
    """Non-seasonal additive forms and the multiplicative-error level, chosen by AICc."""
    grid = ets_grid()
    al, be, ph = (grid[None, :, i] for i in range(3))
    level = np.repeat(y[:, :1], len(grid), axis=1)
    slope = np.zeros_like(level)
    sse = np.zeros_like(level)
    m = len(_ALPHA)  # the multiplicative form shares the level recursion of ANN
    rel, logs = np.zeros((len(y), m)), np.zeros((len(y), m))
    valid = y[:, :1] > 0
    out = np.zeros((*n.shape, h))
    for t in range(y.shape[1]):
        if t:
            mu = level + ph * slope
            e = y[:, t, None] - mu
            sse = sse + e * e
            base = mu[:, :m]
            valid = valid & (base > 1e-8).all(1, keepdims=True) & (y[:, t, None] > 0)
            safe = np.where(valid, base, 1.0)
            rel = rel + (e[:, :m] / safe) ** 2
            logs = logs + np.log(safe)
            slope = ph * slope + be * e
            level = mu + al * e
        i, j = _snapshots(n, t)
        if len(i):
            size = float(t + 1)
            k = grid[:, 3][None, :]
            room = np.maximum(size - k - 1, 0.5)
            extra = 2 * k + 2 * k * (k + 1) / room
            ic = size * np.log(sse[i] / size + 1e-12) + extra
            mult = size * np.log(rel[i] / size + 1e-12) + 2 * logs[i] + extra[:, :m]
            mult = np.where(valid[i], mult, np.inf)
            pick = np.argmin(np.concatenate([ic, mult], axis=1), axis=1)
            pick = np.where(pick >= len(grid), pick - len(grid), pick)
            l, b, p = level[i, pick], slope[i, pick], grid[pick, 2]
            damp = np.cumsum(p[:, None] ** np.arange(1, h + 1)[None, :], axis=1)
            out[i, j] = l[:, None] + damp * b[:, None]
    return out


def holt_parameters(y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Level and trend weights of the best additive-trend form."""
    a, b = (v.ravel() for v in np.meshgrid(_ALPHA, _BETA, indexing="ij"))
    level = np.repeat(y[:, :1], len(a), axis=1)
    slope, sse = np.zeros_like(level), np.zeros_like(level)
    out = np.zeros((2, *n.shape))
    for t in range(y.shape[1]):
        if t:
            mu = level + slope
            e = y[:, t, None] - mu
            sse = sse + e * e
            slope = slope + a * b * e
            level = mu + a * e
        i, j = _snapshots(n, t)
        pick = np.argmin(sse[i], axis=1) if len(i) else np.array([], int)
        out[0, i, j], out[1, i, j] = a[pick], b[pick]
    return out[0], out[1]


# ---- theta -----------------------------------------------------------------------------------

_THETA_GRID = np.arange(1, 100) / 100.0


def _line(y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares intercept and slope on t = 1..n per fold."""
    t = np.arange(1, y.shape[1] + 1)
    at = np.maximum(n, 1) - 1
    sy = np.take_along_axis(np.cumsum(y, 1), at, 1)
    sty = np.take_along_axis(np.cumsum(y * t, 1), at, 1)
    k = np.maximum(n, 1).astype(float)
    st = k * (k + 1) / 2
    var = k * (k * k - 1) / 12
    slope = np.where(k > 1, (sty - st * sy / k) / np.where(var > 0, var, 1), 0.0)
    return sy / k - slope * (k + 1) / 2, slope


def _theta(y: np.ndarray, n: np.ndarray, dynamic: bool, h: int) -> np.ndarray:
    """One-step error is (y - l) - w * g with w = 1 - 1/theta, so the best theta of
    each alpha has a closed form; only alpha is searched on a grid."""
    al = _THETA_GRID[None, :]
    q = 1 - al
    level = np.repeat(y[:, :1], al.shape[1], axis=1)
    shape = level.shape
    ee, ea, eb, aa, ab, bb = (np.zeros(shape) for _ in range(6))
    mean, slope = y[:, 0].copy(), np.zeros(len(y))
    inter = y[:, 0].copy()
    a_fold, b_fold = _line(y, n)
    out = np.zeros((*n.shape, h))
    for t in range(1, y.shape[1] + 1):  # t = weeks seen
        if t > 1:
            e = y[:, t - 1, None] - level
            ca = q ** (t - 1)
            cb = (1 - q**t) / al
            if dynamic:
                g = ca * inter[:, None] + cb * slope[:, None]
                ea += e * g
                aa += g * g
            else:
                ea += e * ca
                eb += e * cb
                aa += ca * ca
                ab += ca * cb
                bb += cb * cb
            ee += e * e
            level = al * y[:, t - 1, None] + q * level
            new = y[:, t - 1]
            slope = ((t - 2) * slope + 6 * (new - mean) / t) / (t + 1)
            mean = ((t - 1) * mean + new) / t
            inter = mean - slope * (t + 1) / 2
        i, j = _snapshots(n, t - 1)
        if not len(i):
            continue
        if dynamic:
            num, den = ea[i], aa[i]
        else:
            A, B = a_fold[i, j][:, None], b_fold[i, j][:, None]
            num = A * ea[i] + B * eb[i]
            den = A * A * aa[i] + 2 * A * B * ab[i] + B * B * bb[i]
        w = np.clip(np.where(den > 1e-12, num / np.where(den > 1e-12, den, 1), 0.0), 0.0, 1.0)
        sse = ee[i] - 2 * w * num + w * w * den
        pick = np.argmin(sse, axis=1)
        rows = np.arange(len(i))
        alpha, l, wt = _THETA_GRID[pick], level[i, pick], w[rows, pick]
        if dynamic:
            A, B, mu_bar = inter[i].copy(), slope[i].copy(), mean[i].copy()
        else:
            A, B, mu_bar = a_fold[i, j], b_fold[i, j], None
        for s in range(h):
            k = t + s + 1
            mu = l + wt * ((1 - alpha) ** (k - 1) * A + (1 - (1 - alpha) ** k) / alpha * B)
            out[i, j, s] = mu
            l = alpha * mu + (1 - alpha) * l
            if dynamic:
                B = ((k - 2) * B + 6 * (mu - mu_bar) / k) / (k + 1)
                mu_bar = ((k - 1) * mu_bar + mu) / k
                A = mu_bar - B * (k + 1) / 2
    return out


def acf_matrix(y: np.ndarray, n: np.ndarray, lags: int) -> np.ndarray:
    """Autocorrelations 0..lags of each row's first n values; beyond the length NaN."""
    mask = np.arange(y.shape[1])[None, :] < n[:, None]
    k = np.maximum(n, 1)[:, None]
    mean = np.where(mask, y, 0).sum(1, keepdims=True) / k
    d = np.where(mask, y - mean, 0.0)
    c0 = (d * d).sum(1)
    # a constant series is exactly zero around its first value
    flat = np.where(mask, np.abs(y - y[:, :1]), 0).max(1, initial=0) == 0
    out = np.full((len(y), lags + 1), np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        for lag in range(lags + 1):
            if lag < y.shape[1]:
                c = (d[:, lag:] * d[:, : y.shape[1] - lag]).sum(1)
                out[:, lag] = np.where((n > lag) & ~flat, c / c0, np.nan)
    return out


def _seasonal_part(y: np.ndarray, n: np.ndarray, season: int) -> np.ndarray:
    """Mean deviation from the trend line per week of the season, (series, season)."""
    a, b = _line(y, n[:, None])
    t = np.arange(1, y.shape[1] + 1)
    mask = np.arange(y.shape[1])[None, :] < n[:, None]
    dev = np.where(mask, y - a - b * t, 0.0)
    pad = -y.shape[1] % season
    cells = np.pad(dev, ((0, 0), (0, pad))).reshape(len(y), -1, season)
    count = np.pad(mask, ((0, 0), (0, pad))).reshape(len(y), -1, season).sum(1)
    s = cells.sum(1) / np.maximum(count, 1)
    return s - s.mean(1, keepdims=True)


def _is_seasonal(y: np.ndarray, n: np.ndarray, season: int) -> np.ndarray:
    r = acf_matrix(y, n, season)
    spread = np.sqrt((1 + 2 * np.nansum(r[:, 1:season] ** 2, axis=1)) / np.maximum(n, 1))
    return (n >= 2 * season + 1) & (np.abs(np.nan_to_num(r[:, season])) > 1.645 * spread)


def _theta_kernel(dynamic: bool, season: int = SEASON, h: int = H):
    def kernel(y: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = _theta(y, n, dynamic, h)
        for j in range(n.shape[1]):
            rows = np.flatnonzero(_is_seasonal(y, n[:, j], season))
            if len(rows):
                s = _seasonal_part(y[rows], n[rows, j], season)
                week = np.arange(y.shape[1]) % season
                plain = _theta(y[rows] - s[:, week], n[rows, j][:, None], dynamic, h)[:, 0]
                ahead = (n[rows, j][:, None] + np.arange(h)[None, :]) % season
                out[rows, j] = plain + np.take_along_axis(s, ahead, 1)
        return out

    return kernel


optimized_theta = _theta_kernel(dynamic=False)
dynamic_theta = _theta_kernel(dynamic=True)


# ---- boosted additive components ------------------------------------------------------------

_ROUNDS = 10
_SETTINGS = [(s, lr) for s in (False, True) for lr in (0.3, 0.9)]


def _basis(weeks: int, season: int, harmonics: int = 3) -> tuple[np.ndarray, np.ndarray]:
    t = np.arange(weeks)
    trend = np.stack([np.ones(weeks), t / 52.0], axis=1)
    k = np.arange(1, harmonics + 1)
    ang = 2 * np.pi * t[:, None] * k[None, :] / season
    return trend, np.concatenate([np.sin(ang), np.cos(ang)], axis=1)


def _project(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Per-series least-squares solver (series, terms, weeks) over its train weeks."""
    gram = np.einsum("bt,tp,tq->bpq", mask, x, x) + 1e-6 * np.eye(x.shape[1])
    return np.linalg.solve(gram, x.T[None] * mask[:, None, :])


def _boost(y, n, use_season: bool, rate: float, h: int, season: int) -> np.ndarray:
    """Start at the median; rounds of damped line, Fourier terms, smoothed residual."""
    weeks = y.shape[1]
    mask = (np.arange(weeks)[None, :] < n[:, None]).astype(float)
    trend, fourier = _basis(weeks + h, season)
    center = np.nanmedian(np.where(mask > 0, y, np.nan), axis=1)[:, None]
    fit = np.repeat(center, weeks + h, axis=1)
    parts = [(trend, _project(trend[:weeks], mask), rate * 0.5)]
    if use_season:
        parts.append((fourier, _project(fourier[:weeks], mask), rate))
    for _ in range(_ROUNDS):
        for basis, solver, step in parts:
            coef = np.einsum("bpt,bt->bp", solver, (y - fit[:, :weeks]) * mask)
            fit = fit + step * coef @ basis.T
    resid = (y - fit[:, :weeks]) * mask
    level, _ = ses_levels(resid, n[:, None], np.array([0.2]))
    last = (n[:, None] + np.arange(h)[None, :])
    return np.take_along_axis(fit, last, 1) + rate * level[:, 0]


def auto_boosted(y: np.ndarray, n: np.ndarray, h: int = H, season: int = SEASON) -> np.ndarray:
    """The setting with the smallest absolute error on the last h train weeks, refitted."""
    out = np.zeros((*n.shape, h))
    for j in range(n.shape[1]):
        nj = np.maximum(n[:, j], 1)
        inner = np.maximum(nj - h, 1)
        held = np.minimum(inner[:, None] + np.arange(h)[None, :], y.shape[1] - 1)
        truth = np.take_along_axis(y, held, 1)
        inside = held < nj[:, None]
        errors, fits = [], []
        for use_season, rate in _SETTINGS:
            trial = _boost(y, inner, use_season, rate, h, season)
            errors.append((np.abs(trial - truth) * inside).sum(1))
            fits.append(_boost(y, nj, use_season, rate, h, season))
        pick = np.argmin(np.stack(errors, 1), axis=1)
        out[:, j] = np.stack(fits, 1)[np.arange(len(y)), pick]
    return out


# The statistical models that need a fit, by output name.
STAT_KERNELS = {
    "CrostonOptimized": croston,
    "IMAPA": imapa,
    "AutoETS": auto_ets,
    "SESOpt": simple_smoothing,
    "OptimizedTheta": optimized_theta,
    "DynamicOptimizedTheta": dynamic_theta,
    "AutoMFLES": auto_boosted,
}
