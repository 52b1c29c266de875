"""Scores and error reports.

Scores are ratios of additive sums.  `error_sums` computes the sums once at the
finest grain (map-side combined); coarser grains only add them up.  All frames
stay wide until the rows are few, so the forecast table is joined to sales once
per row and not once per model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomcast.config import PRED
from loomcast.functions.expr import (
    clip_unit,
    cols_with_prefix,
    competition_score,
    float_div,
    model_names,
    strip_prefix,
    sum0,
)
from loomcast.operators.panel import forecast_to_long


def with_sales(forecast: DataFrame, sales: DataFrame | None, how: str = "left") -> DataFrame:
    """Forecasts beside the sales of their weeks; a forecast that carries `sales` is not joined."""
    if "sales" in forecast.columns:
        return forecast
    return forecast.join(sales.select("id", "date", "sales"), ["id", "date"], how)


def error_sums(
    forecast: DataFrame, sales: DataFrame | None, by: Sequence[str] = ("id", "cutoff_date")
) -> DataFrame:
    """Per group: `sales_abs`, and per model the absolute and the signed error sum."""
    joined = with_sales(forecast, sales)
    sums = [sum0(F.abs("sales")).alias("sales_abs")]
    for m in model_names(forecast):
        e = F.col(PRED + m) - F.col("sales")
        sums += [sum0(F.abs(e)).alias(f"abs_{m}"), sum0(e).alias(f"err_{m}")]
    return joined.groupBy(*by).agg(*sums)


def _models_of(sums: DataFrame) -> list[str]:
    return [c[4:] for c in sums.columns if c.startswith("abs_")]


def coarsen(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    parts = [c for c in sums.columns if c == "sales_abs" or c[:4] in ("abs_", "err_")]
    return sums.groupBy(*by).agg(*[sum0(F.col(c)).alias(c) for c in parts])


def scores_from_sums(sums: DataFrame) -> DataFrame:
    models = _models_of(sums)
    keys = [c for c in sums.columns if c != "sales_abs" and c[:4] not in ("abs_", "err_")]
    return sums.select(
        *keys,
        *[
            (
                float_div(F.abs(F.col(f"err_{m}")), F.col("sales_abs"))
                + float_div(F.col(f"abs_{m}"), F.col("sales_abs"))
            ).alias(PRED + m)
            for m in models
        ],
    )


def scores_to_long(scores: DataFrame, index: Sequence[str] = ()) -> DataFrame:
    return forecast_to_long(scores, index, "score")


def calc_cv_scores(
    forecast: DataFrame, sales: DataFrame | None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores per (id, cutoff), per cutoff, and in total (long)."""
    fine = error_sums(forecast, sales)
    per_cutoff = coarsen(fine, ["cutoff_date"])
    total = coarsen(per_cutoff, [])
    return (
        scores_from_sums(fine),
        scores_from_sums(per_cutoff),
        scores_to_long(scores_from_sums(total)),
    )


def grouped_scores(forecast: DataFrame, sales: DataFrame | None, by: Sequence[str]) -> DataFrame:
    """Score columns by any keys present on the forecast."""
    t = F.col("sales")
    return with_sales(forecast, sales).groupBy(*by).agg(
        *[competition_score(c, t).alias(c) for c in cols_with_prefix(forecast)]
    )


def clipped_scores(forecast: DataFrame, sales: DataFrame | None) -> DataFrame:
    """Per-series fold scores clipped to [0, 1]; NaN is kept."""
    scores = scores_from_sums(error_sums(forecast, sales))
    return scores.select(
        "id", "cutoff_date", *[clip_unit(c).alias(c) for c in cols_with_prefix(scores)]
    )


# ---- error fact and reports ---------------------------------------------------


def calc_errors(forecast: DataFrame, sales: DataFrame | None) -> DataFrame:
    """Long fact `id, date, cutoff_date, model, prediction, sales, error`."""
    joined = with_sales(forecast, sales)
    long = forecast_to_long(joined, ["id", "date", "cutoff_date", "sales"])
    return long.select(
        "id",
        "date",
        "cutoff_date",
        "model",
        "prediction",
        "sales",
        (F.col("prediction") - F.col("sales")).alias("error"),
    )


def error_report(errors: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean signed error, mean absolute error and their score per group."""
    return (
        errors.groupBy(*by)
        .agg(F.avg("error").alias("bias"), F.avg(F.abs("error")).alias("mae"))
        .withColumn("score", F.col("mae") + F.abs("bias"))
    )


def total_errors(errors: DataFrame) -> DataFrame:
    return error_report(errors, ["model", "cutoff_date"])


def horizon_errors(errors: DataFrame) -> DataFrame:
    horizon = (F.floor(F.datediff("date", "cutoff_date") / 7) + 1).cast("int")
    return error_report(errors.withColumn("horizon", horizon), ["horizon", "model"])


def class_errors(errors: DataFrame, classification: DataFrame) -> DataFrame:
    """Per (cutoff, class, model); series without a class report under null.

    Errors are first summed per (series, fold, model), so the join moves one row
    in place of one per horizon.
    """
    per_series = errors.groupBy("id", "cutoff_date", "model").agg(
        F.sum("error").alias("s"), F.sum(F.abs("error")).alias("a"), F.count("error").alias("n")
    )
    classes = classification.select("id", "cutoff_date", "class")
    return (
        per_series.join(classes, ["id", "cutoff_date"], "left")
        .groupBy("cutoff_date", "class", "model")
        .agg(F.sum("s").alias("s"), F.sum("a").alias("a"), F.sum("n").alias("n"))
        .select(
            "cutoff_date",
            "class",
            "model",
            F.try_divide("a", "n").alias("mae"),
            F.try_divide("s", "n").alias("bias"),
        )
        .withColumn("score", F.col("mae") + F.abs("bias"))
    )


def winner_models(scores: DataFrame) -> DataFrame:
    """All models that tie on the smallest mean score of a series."""
    means = scores.groupBy("id").agg(*[F.avg(c).alias(c) for c in cols_with_prefix(scores)])
    long = scores_to_long(means, ["id"])
    best = F.min("score").over(W.partitionBy("id"))
    return long.withColumn("_best", best).filter(F.col("score") == F.col("_best")).drop("_best")


def winner_rows(scores: DataFrame) -> DataFrame:
    """Same result without a window: the minimum is taken across columns in each row."""
    cols = cols_with_prefix(scores)
    means = scores.groupBy("id").agg(*[F.avg(c).alias(c) for c in cols])
    best = F.array_min(F.array(*cols))
    long = scores_to_long(means.withColumn("_best", best), ["id", "_best"])
    return long.filter(F.col("score") == F.col("_best")).drop("_best")


def total_order(total_scores: DataFrame) -> list[str]:
    """Model names by total score; one short row per model."""
    rows = total_scores.select("model", strip_prefix("model").alias("m"), "score")
    return [r["m"] for r in rows.orderBy("score", "m").collect()]
