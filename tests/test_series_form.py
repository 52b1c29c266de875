"""Frames with one row per series give the rows that weekly rows give, without spreading the calendar first."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcast.config import DEFAULT_CV
from loomcast.operators import classes, dashboard, features, naive, prefix, regimes, scores, trees
from loomcast.operators.cv import rolling_origin, rolling_origin_series, to_series
from loomcast.operators.panel import remove_leading_zeros, to_long
from loomcast.plans import base, lag_models
from loomcast.sources import panels


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    """A few shipments: uneven weeks, series that open with returns, a supplier without lines."""
    rng = np.random.default_rng(5)
    start = dt.date(2000, 1, 3)
    lines = []
    for supp, part, rate in ((1, 3, 0.9), (1, 43, 0.2), (2, 7, 0.05), (3, 80, 0.5), (3, 39, 0.02)):
        for day in range(0, 7 * 130):
            if rng.random() < rate / 3:
                qty = float(-rng.integers(1, 3) if day < 70 else rng.integers(1, 9))  # returns at first
                lines.append((supp, part, start + dt.timedelta(days=day), qty, qty * 2.5, "AN"[part % 2]))
    lines.append((9, 1, dt.date(1990, 1, 1), 1.0, 1.0, "A"))  # no such supplier: sets no bound
    root = str(tmp_path_factory.mktemp("star"))
    spark.createDataFrame(
        lines, "l_suppkey long, l_partkey long, l_shipdate date, l_quantity double, l_extendedprice double, l_returnflag string"
    ).write.parquet(f"{root}/lineitem.parquet")
    spark.createDataFrame([(k, k % 2) for k in (1, 2, 3, 4)], "s_suppkey long, s_nationkey int").write.parquet(
        f"{root}/supplier.parquet"
    )
    return root


def _sorted(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("series, dense", [("sparse_series", "sparse_panel"), ("weekly_series", "weekly_panel")])
def test_series_hold_the_trimmed_panel(spark, star, series, dense):
    cube = getattr(panels, dense)(spark, star)
    cols = ["Client", "Warehouse", "Product", "date", "sales", "price", "phase", "id"]
    want = _sorted(remove_leading_zeros(cube).select(*cols))
    got = panels.rows(getattr(panels, series)(spark, star))
    assert got.columns == cols and _sorted(got) == want and want
    spans = {(r["lo"], r["hi"]) for r in cube.groupBy("id").agg({"date": "min"}).withColumnRenamed("min(date)", "lo").join(
        cube.groupBy("id").agg({"date": "max"}).withColumnRenamed("max(date)", "hi"), "id").collect()}
    assert len(spans) == 1 and min(spans)[0] >= dt.date(2000, 1, 3)  # one calendar, set by known suppliers
    newest = panels.rows(getattr(panels, series)(spark, star), last=5)
    last = max(r[3] for r in want)
    assert _sorted(newest) == [r for r in want if r[3] > last - dt.timedelta(weeks=5)]


def test_thin_rows_come_without_window(spark, star):
    plan = base.thin(spark, star)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Window" not in plan and "SortMergeJoin" not in plan


def test_filling_the_calendar_is_not_copied_into_filters(spark, star):
    for dense in (base.primary, base.thin, panels.weekly_panel):
        df = dense(spark, star)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        filters = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter")]
        assert filters and not any("zip_with" in f or "sort_array" in f or "array_sort" in f for f in filters)
        assert plan.count("sort_array(") + plan.count("array_sort(") == 1  # sorted once a series, outside all lambdas


def test_class_inputs_of_arrays_equal_those_of_rows(spark, star, make_panel):
    rng = np.random.default_rng(2)
    made = make_panel({
        "1-1-1": [3.0] * 120,
        "1-1-2": rng.integers(0, 2, 200).tolist(),
        "1-1-3": (10 + 5 * np.sin(np.arange(180) / 52 * 2 * np.pi)).round().tolist(),
        "1-1-4": [4.0] + [0.0] * 90,
        "1-1-5": [1.0, 2.0],
    })
    for panel in (made, panels.rows(panels.sparse_series(spark, star))):
        for how in ({"folds": True}, {"folds": False, "live": True}):
            want = _sorted(prefix.fold_class_inputs(panel, **how))
            got = prefix.fold_class_inputs(to_series(panel), **how)
            assert got.dtypes == prefix.fold_class_inputs(panel, **how).dtypes
            for a, b in zip(_sorted(got), want, strict=True):
                assert a[:-1] == b[:-1] and a[-1] == pytest.approx(b[-1], nan_ok=True, abs=1e-12)
    series = to_series(made)
    assert _sorted(classes.classify_panel(series)) == _sorted(classes.classify_panel(made))
    assert _sorted(classes.calculate_cv_classification(series, features.seasonal_acf(series))) == _sorted(
        classes.calculate_cv_classification(made, features.seasonal_acf(made))
    )


def test_fold_rows_and_scores_from_arrays(spark, star):
    series = panels.sparse_series(spark, star)
    panel = panels.rows(series).select("id", "date", "sales")
    cols = ["id", "date", "fold", "train_end", "is_test", "sales"]
    assert _sorted(rolling_origin_series(series).select(cols)) == _sorted(rolling_origin(panel).select(cols))
    joined = scores.clipped_scores(naive.cross_validate(panel), panel)
    beside = scores.clipped_scores(naive.cross_validate(series, actual=True), None)
    assert repr(_sorted(beside)) == repr(_sorted(joined))


def test_wide_layout_and_stacked_folds(spark, star):
    cube = panels.weekly_panel(spark, star).filter("phase = 1")
    cols = ["Client", "Warehouse", "Product", "date"]
    for value, name in (("y", "sales"), ("prices", "price")):
        wide = panels.wide(spark, star, 1, value)
        want = cube.selectExpr(*cols[:3], "cast(date as string) as date", name)
        assert _sorted(to_long(wide, name)) == _sorted(want)
        plan = wide._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "pivot" not in plan


def test_regimes_carry_sales(spark, make_panel):
    steps = {f"1-1-{k}": [1.0] * 40 + [30.0] * 40 for k in range(4)}
    panel = make_panel({**steps, "1-1-9": [2.0] * 30})
    series = to_series(panel)
    parts = regimes.calculate_live_partition(panel, 1.5, 1e-3)
    beside = regimes.calculate_live_partition(series, 1.5, 1e-3, values=True)
    cols = ["id", "date", "sales", "partition"]
    want = _sorted(panel.join(parts, ["id", "date"]).select(cols))
    assert _sorted(beside.select(cols)) == want
    old = dashboard.regime_view(panel.select("id", "date", "sales"), parts, 2)
    new = dashboard.regime_view(None, beside, 2)
    assert _sorted(new.select(cols)) == _sorted(old.select(cols)) and new.select("id").distinct().count() == 2
    assert "BroadcastHashJoin" not in str(
        dashboard.with_regimes(panel, parts)._jdf.queryExecution().executedPlan().toString()
    )


def test_newest_weeks_cover_the_folds(spark, star):
    series = panels.weekly_series(spark, star)
    forecast = naive.cross_validate(series)
    cv = DEFAULT_CV
    newest = panels.rows(series, last=(cv.n_windows - 1) * cv.step + cv.h)
    want, got = (_sorted(base.rounded(scores.error_sums(forecast, x))) for x in (panels.rows(series), newest))
    assert got == want


def test_complete_lag_rows_equal_dropped_rows(spark, make_panel):
    rng = np.random.default_rng(3)
    gaps = [None if i in (20, 90) else float(i % 5) for i in range(140)]
    panel = make_panel({"1-1-1": rng.integers(0, 9, 130).tolist(), "1-1-2": gaps, "1-1-3": [2.0] * 50, "1-1-4": [1.0] * 110})
    design = trees.lag_design(panel)
    kept = design.na.drop(subset=trees.RECURSIVE_LAGGED)
    want = _sorted(kept.groupBy("id").agg(F.count("*").alias("n"), F.min("date").alias("first_date")))
    found = lag_models._complete_rows(design)
    assert _sorted(found) == want and {r[0] for r in want} == {"1-1-1", "1-1-2", "1-1-4"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("sort_array" in line for line in plan.splitlines() if "Filter" in line)
