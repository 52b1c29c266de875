"""Baseline forecasts computed with built-in array functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcast.config import DEFAULT_CV, PRED, CvConfig
from loomcast.functions.expr import clean_forecast
from loomcast.operators.cv import fold_series, to_series


def array_mean(y: Column) -> Column:
    return F.try_divide(F.aggregate(y, F.lit(0.0), lambda a, x: a + x), F.size(y).cast("double"))


def window_average(y: Column, n: Column, window: int) -> Column:
    """Mean of the last `window` values; a shorter series forecasts 0."""
    tail = F.slice(y, n - window + 1, window)
    return F.when(n >= window, array_mean(tail)).otherwise(F.lit(0.0))


def seasonal_naive(y: Column, n: Column, horizon: Column, season: int) -> Column:
    """Value one season back, repeated; a shorter series forecasts 0."""
    position = n - season + ((horizon - 1) % season) + 1
    return F.when(n >= season, F.try_element_at(y, position.cast("int"))).otherwise(F.lit(0.0))


def baseline_forecasts(folded: DataFrame, cv: CvConfig = DEFAULT_CV) -> DataFrame:
    """Wide forecasts `id, date, cutoff_date, fold, prediction_*` from fold rows; `sales` beside them where `test` is given."""
    y, n = F.col("y"), F.col("n")
    test = ["test"] if "test" in folded.columns else []
    date = F.date_add("cutoff_date", (F.col("horizon") - 1) * 7)
    # as after a left join on id and date
    sales = F.when(F.col("id").isNotNull(), F.try_element_at("test", date)) if test else None
    per_series = folded.select(
        "id",
        "fold",
        "cutoff_date",
        "n",
        "y",
        *test,
        window_average(y, n, cv.h).alias("_wa"),
        array_mean(y).alias("_ha"),
        F.explode(F.sequence(F.lit(1), F.lit(cv.h))).alias("horizon"),
    )
    out = {
        "ZeroModel": F.lit(0.0),
        "WindowAverage": F.col("_wa"),
        "SeasonalNaive": seasonal_naive(y, n, F.col("horizon"), cv.season),
        "HistoricAverage": F.col("_ha"),
    }
    return per_series.select(
        "id",
        date.alias("date"),
        "cutoff_date",
        "fold",
        *[clean_forecast(c).alias(PRED + m) for m, c in out.items()],
        *([sales.alias("sales")] if test else []),
    )


def cross_validate(panel: DataFrame, cv: CvConfig = DEFAULT_CV, actual: bool = False) -> DataFrame:
    """Forecasts of all folds; with `actual` beside the `sales` of their weeks, which saves scores the join."""
    return baseline_forecasts(fold_series(to_series(panel), cv, actual=actual), cv).drop("fold")


def live_forecast(panel: DataFrame, cv: CvConfig = DEFAULT_CV) -> DataFrame:
    folded = fold_series(to_series(panel), cv, folds=False, live=True)
    return baseline_forecasts(folded, cv).drop("fold", "cutoff_date")
