from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcast.config import TSF, CvConfig
from loomcast.operators import batches, classes, features, naive, regimes
from loomcast.operators import smoothing as S
from loomcast.operators.fitted import feature_kernel, partial


def _demand(rows=6, weeks=130, seed=0):
    rng = np.random.default_rng(seed)
    return rng.poisson(4, (rows, weeks)) * (rng.random((rows, weeks)) < 0.5) * 1.0


def _ses(y, grid):
    best = None
    for a in grid:
        level, sse = y[0], 0.0
        for v in y[1:]:
            sse += (v - level) ** 2
            level = a * v + (1 - a) * level
        if best is None or sse < best[0]:
            best = (sse, level)
    return best[1]


def test_smoothing_matches_plain_loop():
    y = _demand()
    n = np.array([[130, 117]] * 6)
    got = S.simple_smoothing(y, n)
    for i, j in itertools.product(range(6), range(2)):
        assert np.allclose(got[i, j], _ses(y[i, : n[i, j]], S.SES_GRID))


def test_croston_and_imapa_match_plain_loops():
    y = _demand(seed=3)
    n = np.array([[130]] * 6)
    crost, ima = S.croston(y, n), S.imapa(y, n)
    for i in range(6):
        at = np.flatnonzero(y[i])
        z, p = y[i][at], np.diff(np.concatenate([[-1], at])).astype(float)
        assert np.allclose(crost[i, 0], _ses(z, S.DEMAND_GRID) / _ses(p, S.DEMAND_GRID))
        levels = max(int(np.floor((at[-1] + 1) / len(at) + 0.5)), 1)
        parts = []
        for k in range(1, levels + 1):
            cut = y[i][130 % k :].reshape(-1, k).sum(1)
            parts.append(_ses(cut, S.DEMAND_GRID) / k)
        assert np.allclose(ima[i, 0], np.mean(parts))


def test_no_demand_is_zero():
    y, n = np.zeros((2, 30)), np.array([[30], [10]])
    assert (S.croston(y, n) == 0).all() and (S.imapa(y, n) == 0).all()


@pytest.mark.parametrize("name", list(S.STAT_KERNELS))
def test_folds_equal_truncated_runs(name):
    """A fold's forecast is what the model gives on the truncated series alone."""
    y = _demand(rows=3, weeks=150, seed=5)
    lengths = [150, 131, 118]
    whole = S.STAT_KERNELS[name](y, np.array([lengths] * 3))
    assert whole.shape == (3, 3, 13) and np.isfinite(whole).all()
    for j, k in enumerate(lengths):
        alone = S.STAT_KERNELS[name](y[:, :k], np.array([[k]] * 3))
        assert np.allclose(alone[:, 0], whole[:, j], atol=1e-8)


def test_theta_closed_form_is_the_grid_optimum():
    """The best theta per alpha equals a fine search over theta."""
    y = _demand(rows=1, weeks=60, seed=8)[0] + 5
    n = len(y)
    t = np.arange(1, n + 1)
    slope, inter = np.polyfit(t, y, 1)
    best = (np.inf, None)
    for a in S._THETA_GRID:
        for w in np.linspace(0, 1, 201):
            level, sse = y[0], 0.0
            for k in range(2, n + 1):
                mu = level + w * ((1 - a) ** (k - 1) * inter + (1 - (1 - a) ** k) / a * slope)
                sse += (y[k - 1] - mu) ** 2
                level = a * y[k - 1] + (1 - a) * level
            if sse < best[0]:
                k = n + 1
                mu = level + w * ((1 - a) ** (k - 1) * inter + (1 - (1 - a) ** k) / a * slope)
                best = (sse, mu)
    got = S.optimized_theta(y[None], np.array([[n]]))[0, 0, 0]
    assert abs(got - best[1]) < 0.05


def test_seasonal_series_is_recognised():
    t = np.arange(208)
    y = (10 + 5 * np.sin(2 * np.pi * t / 52))[None]
    assert S._is_seasonal(y, np.array([208]), 52)[0]
    fc = S.optimized_theta(y, np.array([[208]]))[0, 0]
    truth = 10 + 5 * np.sin(2 * np.pi * np.arange(208, 221) / 52)
    assert np.abs(fc - truth).max() < 1.0


def test_custom_model_falls_back(make_panel):
    p = make_panel({"1-1-1": [2.0] * 40, "1-1-2": [1.0] * 20})

    def broken(y, h):
        if len(y) < 30:
            raise RuntimeError("no")
        return np.array([np.nan, -5.0] + [7.0] * (h - 2))

    out = batches.panel_forecast(p, {"M": broken}, folds=False, live=True)
    got = {}
    for r in out.orderBy("id", "date").collect():
        got.setdefault(r["id"], []).append(r["prediction_M"])
    assert got["1-1-1"] == [0.0, 0.0] + [7.0] * 11 and got["1-1-2"] == [1.0] * 13


def test_short_series_baselines(make_panel):
    p = make_panel({"1-1-1": [4.0] * 10})
    row = naive.live_forecast(p).first()
    assert row["prediction_WindowAverage"] == 0 and row["prediction_SeasonalNaive"] == 0
    assert row["prediction_HistoricAverage"] == 4.0


def test_every_forecast_has_thirteen_weeks(make_panel):
    p = make_panel({"1-1-1": list(range(1, 140)), "1-1-2": [3, 0] * 35})
    fc = batches.kernel_forecast(p, S.STAT_KERNELS)
    per = fc.groupBy("id", "cutoff_date").count().select("count").distinct().collect()
    assert [r[0] for r in per] == [13]
    cols = [c for c in fc.columns if c.startswith("prediction_")]
    bad = fc.filter(" or ".join(f"{c} is null or isnan({c}) or {c} < 0" for c in cols)).count()
    assert bad == 0


# ---- classes ---------------------------------------------------------------------------------


def _features(spark, ids, value=0.0):
    return spark.createDataFrame([(i, float(value)) for i in ids], f"id string, {TSF}seas_acf1 double")


def test_flags_and_precedence(spark, make_panel):
    series = {
        "1-1-1": [5] + [0] * 60,  # last year zero
        "1-1-2": [5, 3] * 30 + [0] * 13,  # last quarter zero
        "1-1-3": [5, 0, 0] * 20,  # short streaks, many zeros
        "1-1-4": [3] * 40,  # never above 3
        "1-1-5": [9] * 40,
        "1-1-6": [0, 0, 5][::-1] + [0] * 9,  # 12 weeks, all but the first zero
    }
    p = make_panel(series)
    out = classes.calculate_live_classification(p, _features(spark, series))
    got = {r["id"]: r["class"] for r in out.collect()}
    assert got["1-1-1"] == "all_zero" and got["1-1-2"] == "trailing_zero"
    assert got["1-1-3"] == "sparse" and got["1-1-4"] == "small_sales" and got["1-1-5"] == "regular"
    assert got["1-1-6"] == "sparse"


def test_opening_run_counts_one_short(make_panel):
    from loomcast.operators.prefix import fold_stats

    p = make_panel({"1-1-1": [5] * 5 + [0] * 10, "1-1-2": [0] + [5] * 5 + [0] * 9})
    got = {r["id"]: r["sale_streak"] for r in fold_stats(p, folds=False, live=True).collect()}
    assert got == {"1-1-1": 4, "1-1-2": 5}


def test_nan_correlation_counts_as_seasonal(spark, make_panel):
    p = make_panel({"1-1-1": [9] * 53, "1-1-2": [9] * 52})
    out = classes.calculate_live_classification(p, _features(spark, ["1-1-1", "1-1-2"], np.nan))
    assert {r["id"]: r["class"] for r in out.collect()} == {"1-1-1": "seasonal", "1-1-2": "regular"}


def test_constant_season_is_seasonal(make_panel):
    t = np.arange(208)
    p = make_panel({"1-1-1": list(10 + 5 * np.sin(2 * np.pi * t / 52))})
    acf = features.seasonal_acf(p, live=True)
    assert acf.first()[TSF + "seas_acf1"] > 0.55
    assert classes.calculate_live_classification(p, acf).first()["class"] == "seasonal"


def test_series_that_ends_early_drops_out(make_panel):
    p = make_panel({"1-1-1": [9] * 150, "1-1-2": [9, 8] * 65})
    cv = CvConfig(n_windows=2)
    out = classes.calculate_cv_classification(p, features.seasonal_acf(p, cv), cv)
    assert {r["id"] for r in out.collect()} == {"1-1-1"}


def test_window_and_batch_correlations_agree(make_panel):
    y = _demand(rows=1, weeks=160, seed=4)[0] + 1
    p = make_panel({"1-1-1": list(y)})
    a = features.seasonal_acf(p, live=True).first()[TSF + "seas_acf1"]
    b = features.calculate_live_tsfeatures(p).first()[TSF + "seas_acf1"]
    d = y - y.mean()
    assert np.isclose(a, b) and np.isclose(a, (d[52:] * d[:-52]).sum() / (d * d).sum())


def test_partial_correlations_solve_the_normal_equations():
    r = np.array([[1.0, 0.6, 0.3, 0.2, 0.1, 0.05]])
    got = partial(r, 3)[0]
    for k in (1, 2, 3):
        toeplitz = np.array([[r[0, abs(i - j)] for j in range(k)] for i in range(k)])
        assert np.isclose(got[k], np.linalg.solve(toeplitz, r[0, 1 : k + 1])[-1])


def test_features_do_not_depend_on_padding():
    names, compute = feature_kernel(52, True)
    y = _demand(rows=4, weeks=160, seed=9)
    both = compute(y, np.array([[160, 130]] * 4))
    alone = compute(y[:, :130], np.array([[130]] * 4))
    for name in names:
        assert np.allclose(both[name][:, 1], alone[name][:, 0], equal_nan=True), name


# ---- regimes ---------------------------------------------------------------------------------


def test_clear_level_shift():
    y = np.array([10.0] * 30 + [100.0] * 30)
    assert regimes.segment_ends(y, [60]) == [[30, 60]]
    assert list(regimes.regime_numbers(np.array([1.0]), 1)) == [0]


def test_segmentation_is_the_brute_force_optimum():
    rng = np.random.default_rng(2)
    for _ in range(5):
        n = 27
        y = np.concatenate([rng.normal(0, 1, 12), rng.normal(3, 1, n - 12)])
        d2 = (y[:, None] - y[None, :]) ** 2
        gamma = 1 / np.median(d2[np.triu_indices(n, 1)])
        k = np.exp(-np.clip(d2 * gamma, *regimes.KERNEL_RANGE))
        np.fill_diagonal(k, 1.0)

        def cost(ends):
            total = 0.0
            for a, b in zip([0, *ends], ends):
                total += (b - a) - k[a:b, a:b].sum() / (b - a) + 1.0
            return total

        inner = [b for b in range(5, n, 5) if n - b >= 2]
        options = [
            [*c, n] for r in range(len(inner) + 1) for c in itertools.combinations(inner, r)
        ]
        want = min(options, key=cost)
        assert np.isclose(cost(regimes.segment_ends(y, [n], penalty=1.0)[0]), cost(want))


def _plain_segmentation(y, n, penalty):
    """Cost of the best segmentation of y[:n] from the whole kernel matrix, and of any given one."""
    d2 = (y[:n, None] - y[None, :n]) ** 2
    med = np.median(d2[np.triu_indices(n, 1)])
    k = np.exp(-np.clip(d2 / (med or 1.0), *regimes.KERNEL_RANGE))
    np.fill_diagonal(k, 1.0)
    total = np.zeros((n + 1, n + 1))
    total[1:, 1:] = k.cumsum(0).cumsum(1)

    def part(a, b):
        return b - a - (total[b, b] - 2 * total[a, b] + total[a, a]) / (b - a) + penalty

    best = {0: 0.0}
    for b in range(5, n, 5):
        best[b] = min(best[a] + part(a, b) for a in best)
    return min(best[a] + part(a, n) for a in best if a <= n - 2), lambda ends: sum(map(part, [0, *ends], ends))


@pytest.mark.parametrize("kind", range(5))
def test_pruned_race_is_as_good_as_the_whole_matrix(kind):
    rng = np.random.default_rng(kind)
    for _ in range(12):
        n = int(rng.integers(2, 160))
        y = [
            rng.poisson(3, n).astype(float),
            np.repeat(rng.normal(size=8) * 5, 20)[:n] + rng.normal(size=n) * 0.3,
            (rng.random(n) < 0.1) * rng.poisson(30, n).astype(float),
            3.0 + rng.choice([0, 1e-3, 0.1], n),  # near the flat top of the clipped kernel
            np.cumsum(rng.normal(size=n)),
        ][kind]
        lengths = sorted({*(int(x) for x in rng.integers(0, n + 1, 4)), min(n, n // 5 * 5 + 1), n})
        for penalty in (0.5, 2.0, 11.0):
            for m, ends in zip(lengths, regimes.segment_ends(y, lengths, penalty)):
                if m < 2:
                    assert ends == ([m] if m else [])
                    continue
                want, cost = _plain_segmentation(y, m, penalty)
                assert ends[-1] == m and np.isclose(cost(ends), want, atol=1e-7), (m, penalty, ends)
        for m in lengths:
            if m >= 2:
                d2 = (y[:m, None] - y[None, :m]) ** 2
                assert np.isclose(regimes.median_square(y[:m]), np.median(d2[np.triu_indices(m, 1)]), rtol=1e-15, atol=0)


def test_starts_that_cannot_win_are_dropped():
    rng = np.random.default_rng(0)
    y = np.repeat(rng.normal(size=10) * 20, 50) + rng.normal(size=500)
    race = regimes._Race(y, np.array([1 / regimes.median_square(y)]), regimes.PENALTY)
    while race.done + regimes.JUMP < len(y):
        race.advance(1)
    assert len(race.starts) < 30 and race.kernel_values < len(y) ** 2 / 3


def test_fold_regimes_cover_every_train_week(make_panel):
    p = make_panel({"1-1-1": [10.0] * 60 + [100.0] * 60, "1-1-2": [1.0] * 5})
    cv = CvConfig(n_windows=2)
    out = regimes.calculate_cv_partitions(p, cv)
    counts = {(r["id"], str(r["cutoff_date"])): r["count"] for r in out.groupBy("id", "cutoff_date").count().collect()}
    assert sorted(counts.values()) == [101, 107]
    live = regimes.calculate_live_partition(p)
    assert live.filter("id = '1-1-2'").count() == 5
    newest = regimes.last_regime(live.filter("id = '1-1-1'"))
    assert newest.count() == 60 and newest.agg(F.max("partition")).first()[0] == 1
