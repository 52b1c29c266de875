from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from loomcast.functions import expr
from loomcast.functions import windows as Wf
from loomcast.operators import cv as C
from loomcast.operators import dashboard, joins, panel, scale, scores, submission
from loomcast.sources import tables
from loomcast.sources.lineage import scratch_path


def test_float_div_rules(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None)], "a double, b double"
    )
    got = [r[0] for r in df.select(expr.float_div(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 0.5 and got[1] == math.inf and got[2] == -math.inf and math.isnan(got[3])
    assert got[4] is None and got[5] is None


def test_clean_and_clip(spark):
    df = spark.createDataFrame([(float("nan"),), (-2.0,), (None,), (3.0,)], "x double")
    got = [tuple(r) for r in df.select(expr.clean_forecast("x"), expr.clip_unit("x")).collect()]
    assert got[0][0] == 0.0 and math.isnan(got[0][1])
    assert got[1] == (0.0, 0.0) and got[2] == (None, None) and got[3] == (3.0, 1.0)


def test_mean_horizontal_skips_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 3.0), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(expr.mean_horizontal(["a", "b"])).collect()] == [1.0, 2.0, None]


def test_cube_from_wide_files(spark):
    sales = spark.createDataFrame([(1, 2, 3, 5.0, None)], "Client int, Warehouse int, Product int, `2020-01-06` double, `2020-01-13` double")
    price = spark.createDataFrame([(1, 2, 3, 9.0)], "Client int, Warehouse int, Product int, `2020-01-06` double")
    cube = panel.join_into_cube(panel.join_sales_dfs(sales), panel.join_price_dfs(price))
    got = {r["date"]: (r["sales"], r["price"], r["phase"], r["id"]) for r in cube.collect()}
    assert got == {
        dt.date(2020, 1, 6): (5.0, 9.0, 0, "1-2-3"),
        dt.date(2020, 1, 13): (None, None, 0, "1-2-3"),
    }


def test_id_is_null_when_a_key_is_null(spark):
    df = spark.createDataFrame([(1, None, 3)], "Client int, Warehouse int, Product int")
    assert df.select(panel.series_id()).first()[0] is None


def test_leading_zeros(make_panel):
    p = make_panel({"1-1-1": [-1, 0, 3, 0], "1-1-2": [0, 0, 0, 0], "1-1-3": [None, 2, 0, 0]})
    got = [(r["id"], r["sales"]) for r in panel.remove_leading_zeros(p).orderBy("id", "date").collect()]
    assert got == [("1-1-1", 3.0), ("1-1-1", 0.0), ("1-1-3", 2.0), ("1-1-3", 0.0), ("1-1-3", 0.0)]


def test_price_fill_ignores_null_prefix(make_panel):
    p = make_panel({"1-1-1": [1, 1, 1, 1]}, {"1-1-1": [None, None, 2.0, None]})
    assert Wf.price_group(p).select("price_group").distinct().collect()[0][0] == 2.0


def test_rolling_origin_equals_loop(make_panel):
    p = make_panel({"1-1-1": list(range(1, 60)), "1-1-2": list(range(1, 25))})
    rows = C.rolling_origin(p, h=13, n_windows=3, step=6).collect()
    last = {"1-1-1": dt.date(2020, 1, 6) + dt.timedelta(weeks=58), "1-1-2": dt.date(2020, 1, 6) + dt.timedelta(weeks=23)}
    base = p.collect()
    want = set()
    for f in range(3):
        for r in base:
            lo = last[r["id"]] - dt.timedelta(weeks=f * 6 + 13)
            hi = last[r["id"]] - dt.timedelta(weeks=f * 6)
            has_train = any(x["id"] == r["id"] and x["date"] <= lo for x in base)
            if has_train and r["date"] <= hi:
                want.add((r["id"], r["date"], f, r["date"] > lo))
    assert {(r["id"], r["date"], r["fold"], r["is_test"]) for r in rows} == want


def test_array_folds_equal_row_folds_with_missing_weeks(make_panel):
    p = make_panel({"1-1-1": list(range(1, 60))})
    gappy = p.filter(~F.col("sales").isin(5.0, 30.0))
    cv = C.CvConfig(n_windows=3)
    arrays = {(r["fold"]): r["n"] for r in C.fold_series(C.to_series(gappy), cv).collect()}
    rows = C.rolling_origin(gappy, h=13, n_windows=3, step=6).filter("not is_test")
    assert arrays == {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}


def test_leave_one_out_never_trains_on_its_fold(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "g int")
    out = C.leave_one_out(df, [1, 2, 3], "g").filter("not is_val")
    assert out.count() == 6 and out.filter("g = held_out").count() == 0


def test_length_check_and_alignment(spark):
    a = spark.createDataFrame([("a", 1, 1.0), ("b", 1, None)], "id string, date int, x double")
    b = spark.createDataFrame([("a", 1, 2.0), ("c", 1, 3.0)], "id string, date int, y double")
    got = joins.join_live_preds(a, b).collect()
    assert [tuple(r) for r in got] == [("a", 1, 1.0, 2.0)]
    with pytest.raises(ValueError, match="Lengths"):
        joins.join_live_preds(a, b.limit(1))


def test_submission_checks(spark):
    preds = spark.createDataFrame([("1-2-3", dt.date(2020, 1, 6), 1.5)], "id string, date date, pred double")
    raw = spark.createDataFrame([(1, 2, 3)], "Client int, Warehouse int, Product int")
    row = submission.format_submission(preds, raw).first()
    assert row.asDict() == {"Client": 1, "Warehouse": 2, "Product": 3, "2020-01-06": 1.5}
    with pytest.raises(ValueError, match="missing"):
        submission.format_submission(preds.drop("pred"), raw)
    with pytest.raises(ValueError, match="rows"):
        submission.format_submission(preds, raw.union(raw.selectExpr("9", "9", "9")))


def _forecast(spark, rows):
    return spark.createDataFrame(
        rows, "id string, date date, cutoff_date date, prediction_A double, prediction_B double"
    )


def test_scores_on_zero_sales(spark):
    d = dt.date(2020, 1, 6)
    fc = _forecast(spark, [("zero", d, d, 1.0, 0.0), ("some", d, d, 3.0, 2.0)])
    sales = spark.createDataFrame([("zero", d, 0.0), ("some", d, 2.0)], "id string, date date, sales double")
    fine, _, total = scores.calc_cv_scores(fc, sales)
    got = {r["id"]: (r["prediction_A"], r["prediction_B"]) for r in fine.collect()}
    assert got["zero"][0] == math.inf and math.isnan(got["zero"][1]) and got["some"] == (1.0, 0.0)
    clipped = {r["id"]: r for r in scores.clipped_scores(fc, sales).collect()}
    assert clipped["zero"]["prediction_A"] == 1.0 and math.isnan(clipped["zero"]["prediction_B"])
    assert {r["model"]: r["score"] for r in total.collect()} == {"A": 2.0, "B": 0.0}


def test_winner_ties_and_rank_ties(spark):
    d = dt.date(2020, 1, 6)
    s = spark.createDataFrame([("x", d, 0.5, 0.5), ("y", d, 0.2, 0.5)], "id string, cutoff_date date, prediction_A double, prediction_B double")
    want = {("x", "A"), ("x", "B"), ("y", "A")}
    assert {(r["id"], r["model"]) for r in scores.winner_models(s).collect()} == want
    assert {(r["id"], r["model"]) for r in scores.winner_rows(s).collect()} == want
    total = spark.createDataFrame([("B", 1.0), ("A", 1.0)], "model string, score double")
    assert {r["model"]: r["rank"] for r in dashboard.leaderboard(total).collect()} == {"A": 1, "B": 2}


def test_class_errors_keep_missing_class(spark):
    d = dt.date(2020, 1, 6)
    errors = spark.createDataFrame(
        [("x", d, d, "A", -1.0), ("y", d, d, "A", 3.0)], "id string, date date, cutoff_date date, model string, error double"
    )
    cls = spark.createDataFrame([("x", d, "regular")], "id string, cutoff_date date, class string")
    got = {r["class"]: (r["bias"], r["mae"], r["score"]) for r in scores.class_errors(errors, cls).collect()}
    assert got == {"regular": (-1.0, 1.0, 2.0), None: (3.0, 3.0, 6.0)}


def test_exact_quantiles_with_a_hot_value(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    values = np.concatenate([np.full(4000, 7.0), rng.normal(5, 3, 6000)])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    probs = [i / 20 for i in range(1, 20)]
    assert np.allclose(scale.exact_quantiles(df, "x", probs), np.quantile(values, probs), atol=1e-12)


def test_quantile_labels_are_left_open(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.5,)], "x double")
    got = [r[0] for r in df.select(scale.interval_label(F.col("x"), [1.0, 2.0])).collect()]
    assert got == ["(-inf, 1.0]", "(1.0, 2.0]", "(2.0, inf]"]


def test_layers_and_preview(spark):
    path = scratch_path(spark, "layer")
    df = spark.createDataFrame([("a", dt.date(2020, 1, 6), 1.0)], "id string, cutoff_date date, x double")
    tables.write_layer(df, path)
    back = tables.read_layer(spark, path)
    assert [tuple(r) for r in back.select("id", "cutoff_date", "x").collect()] == [("a", dt.date(2020, 1, 6), 1.0)]
    assert tables.preview(spark.range(50)).count() == 10


def test_shared_folder_comes_from_the_session():
    from types import SimpleNamespace

    from loomcast.sources.lineage import shared_dir

    named = SimpleNamespace(conf={"spark.checkpoint.dir": "hdfs://shared/cp"})
    assert shared_dir(named) == "hdfs://shared/cp"
    unset = SimpleNamespace(
        conf={"spark.sql.warehouse.dir": "hdfs://shared/warehouse/"},
        sparkContext=SimpleNamespace(getCheckpointDir=lambda: None),
    )
    assert shared_dir(unset) == "hdfs://shared/warehouse/_lineage"


def test_thin_panel_reads_every_supplier(spark, tmp_path):
    from loomcast.sources import panels

    day = dt.date(1996, 1, 1)
    lines = [(s, 40 * s + p, day + dt.timedelta(weeks=w), 2.0, 10.0) for s in range(1, 26) for p in (1, 2) for w in (0, 3)]
    spark.createDataFrame(
        lines, "l_suppkey long, l_partkey long, l_shipdate date, l_quantity double, l_extendedprice double"
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(s, s % 5) for s in range(1, 26)], "s_suppkey long, s_nationkey int").write.parquet(
        str(tmp_path / "supplier.parquet")
    )
    got = panels.sparse_panel(spark, str(tmp_path))
    series = {tuple(r) for r in got.select("Warehouse", "Product").distinct().collect()}
    assert series == {(s, p) for s in range(1, 26) for p in (1, 2)}
    assert got.count() == 50 * 4


def test_min_train_size_counts_before_rows_are_multiplied(make_panel):
    """Folds of at least that many train weeks, whole, and no window over the multiplied rows."""
    p = make_panel({"1-1-1": [1.0] * 40, "1-1-2": [2.0] * 30, "1-1-3": [3.0] * 12})
    rows = C.rolling_origin(p.select("id", "date"), h=13, n_windows=3, step=6, min_train_size=15)
    every = C.rolling_origin(p.select("id", "date"), h=13, n_windows=3, step=6)
    train = {}
    for r in every.collect():
        train[r["id"], r["fold"]] = train.get((r["id"], r["fold"]), 0) + (not r["is_test"])
    kept = {k for k, n in train.items() if n >= 15}
    assert kept == {("1-1-1", 0), ("1-1-1", 1), ("1-1-1", 2), ("1-1-2", 0)}
    key = lambda r: (r["id"], r["fold"], r["date"])
    want = sorted((r for r in every.collect() if (r["id"], r["fold"]) in kept), key=key)
    assert sorted(rows.collect(), key=key) == want and rows.columns == every.columns
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Window")  # the explode stands above every window
