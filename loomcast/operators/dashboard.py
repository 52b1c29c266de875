"""The data part of every report page, as functions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomcast.config import KEYS, PRED
from loomcast.functions.expr import (
    cols_with_prefix,
    cols_without_prefix,
    competition_score,
    model_names,
)
from loomcast.functions.windows import forward_fill
from loomcast.operators.cv import is_series, series_keys
from loomcast.operators.naive import array_mean
from loomcast.operators.panel import drawn_ids, forecast_to_long, pivot_mean
from loomcast.operators.scores import grouped_scores, scores_to_long, with_sales

# ---- sales exploration --------------------------------------------------------


def _rollup_id(kept: Sequence[str]) -> Column:
    if not kept:
        return F.lit("All")
    parts: list[Column] = []
    for k in kept:
        parts += [F.lit("-"), F.col(k).cast("string")]
    return F.concat(*parts[1:])


def sales_rollup(sales: DataFrame, dropped: Sequence[str] = ()) -> DataFrame:
    """Sum of sales and mean forward-filled price per date, over the dropped keys."""
    kept = [k for k in KEYS if k not in dropped]
    filled = sales.withColumn("price", forward_fill("price", series_keys(sales)))
    return (
        filled.groupBy("date", *kept)
        .agg(F.sum("sales").alias("sales"), F.avg("price").alias("price"))
        .withColumn("id", _rollup_id(kept))
    )


def sales_cube(sales: DataFrame) -> DataFrame:
    """All eight key subsets at once; `level` is the bit mask of dropped keys."""
    filled = sales.withColumn("price", forward_fill("price", series_keys(sales)))
    subsets = [
        [F.col(k) for k in kept] + [F.col("date")]
        for n in range(len(KEYS) + 1)
        for kept in combinations(KEYS, n)
    ]
    return (
        filled.groupingSets(subsets, *KEYS, "date")
        .agg(
            F.grouping_id().alias("_g"),
            F.sum("sales").alias("sales"),
            F.avg("price").alias("price"),
        )
        .select(
            *KEYS, "date", F.shiftright("_g", 1).cast("int").alias("level"), "sales", "price"
        )
    )


def filter_keys(df: DataFrame, **values) -> DataFrame:
    for name, value in values.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def top_series(sales: DataFrame, n: int = 10) -> DataFrame:
    """n largest series by mean sales (per-task top-n, then merge)."""
    if is_series(sales):
        means = sales.select("id", array_mean(F.col("y")).alias("scale"))
    else:
        means = sales.groupBy("id").agg(F.avg("sales").alias("scale"))
    return means.orderBy(F.desc("scale"), "id").limit(n)


def rows_of(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id"), "id", "left_semi")


def with_regimes(sales: DataFrame | None, partitions: DataFrame) -> DataFrame:
    """Weeks beside their regime; without `sales` the regimes carry them.

    Regime files compress to next to nothing, so the planner would take their rows for few and gather them for a broadcast.
    """
    if sales is None:
        return partitions.filter(F.col("id").isNotNull())
    return sales.join(partitions.select("id", "date", "partition").hint("merge"), ["id", "date"])


def multi_regime_ids(sales: DataFrame | None, partitions: DataFrame) -> DataFrame:
    """Series with more than one regime; min and max suffice, no distinct."""
    return (
        with_regimes(sales, partitions)
        .groupBy("id")
        .agg(F.min("partition").alias("lo"), F.max("partition").alias("hi"))
        .filter(F.col("hi") > F.col("lo"))
        .select("id")
    )


def regime_view(
    sales: DataFrame | None, partitions: DataFrame, n: int = 20, seed: int = 0, multiple: bool = True
) -> DataFrame:
    """Weeks of n series; the series are drawn first, so only their rows are joined."""
    ids = multi_regime_ids(sales, partitions) if multiple else with_regimes(sales, partitions)
    ids = drawn_ids(ids, n, seed)
    return with_regimes(None if sales is None else rows_of(sales, ids), rows_of(partitions, ids))


# ---- model groups -------------------------------------------------------------


def in_group(name: Column, group: str) -> Column:
    is_ensemble = name.contains("Ensemble")
    return {"Single": ~is_ensemble, "Ensemble": is_ensemble, "All": F.lit(True)}[group]


def filter_models(df: DataFrame, group: str) -> DataFrame:
    return df.filter(in_group(F.col("model"), group))


def select_models(df: DataFrame, group: str = "All", models: Sequence[str] | None = None) -> DataFrame:
    names = model_names(df) if models is None else list(models)
    if group != "All":
        names = [m for m in names if ("Ensemble" in m) == (group == "Ensemble")]
    return df.select(*cols_without_prefix(df), *[PRED + m for m in names])


def filter_cutoffs(df: DataFrame, cutoffs: Sequence[str] | None) -> DataFrame:
    if cutoffs is None:
        return df
    return df.filter(F.col("cutoff_date").cast("string").isin(list(cutoffs)))


# ---- classification page --------------------------------------------------------


def share(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("len"))


def class_model_table(
    class_errors: DataFrame, classes: Sequence[str], cutoffs: Sequence[str] | None = None
) -> DataFrame:
    return pivot_mean(filter_cutoffs(class_errors, cutoffs), "model", "class", "score", classes)


def class_model_order(class_errors: DataFrame) -> DataFrame:
    """Mean score per class and model with its place within the class."""
    means = class_errors.groupBy("class", "model").agg(F.avg("score").alias("score"))
    w = W.partitionBy("class").orderBy("score", "model")
    return means.withColumn("place", F.row_number().over(w))


# ---- contest page ---------------------------------------------------------------


def leaderboard(total_scores: DataFrame) -> DataFrame:
    """Rank over the table of models (one row per model)."""
    w = W.partitionBy(F.lit(0)).orderBy("score", "model")
    return total_scores.withColumn("rank", F.row_number().over(w))


def cutoff_scores_long(cv_scores: DataFrame, cutoffs: Sequence[str] | None = None) -> DataFrame:
    picked = filter_cutoffs(cv_scores, cutoffs)
    long = scores_to_long(picked, ["cutoff_date"])
    return long.withColumn("cutoff_date", F.date_format("cutoff_date", "yyyy-MM-dd"))


def cutoff_score_order(cv_scores: DataFrame) -> DataFrame:
    means = cutoff_scores_long(cv_scores).groupBy("model").agg(F.avg("score").alias("score"))
    return leaderboard(means)


def cutoff_ranks(cv_scores: DataFrame) -> DataFrame:
    long = scores_to_long(cv_scores, ["cutoff_date"])
    w = W.partitionBy("cutoff_date").orderBy("score", "model")
    return long.withColumn("rank", F.row_number().over(w))


def mean_rank(cv_scores: DataFrame) -> DataFrame:
    return cutoff_ranks(cv_scores).groupBy("model").agg(F.avg("rank").alias("mean_rank"))


def metrics_long(report: DataFrame, index: Sequence[str]) -> DataFrame:
    return report.unpivot(list(index), ["mae", "bias", "score"], "metric", "value")


def score_composition(total_errors: DataFrame) -> DataFrame:
    long = metrics_long(total_errors, ["model", "cutoff_date"])
    return long.groupBy("model", "metric").agg(F.avg("value").alias("value"))


def horizon_profile(horizon_errors: DataFrame, model: str) -> DataFrame:
    return horizon_errors.filter(F.col("model") == model)


def score_by_scale(forecast: DataFrame, sales: DataFrame, categories: DataFrame) -> DataFrame:
    """Score per sales-scale bin and model, long."""
    scored = with_sales(forecast.join(categories.select("id", "bin"), "id"), sales, "inner")
    per_bin = scored.groupBy("bin").agg(
        *[competition_score(c, "sales").alias(c) for c in cols_with_prefix(forecast)]
    )
    return scores_to_long(per_bin, ["bin"])


# ---- one-series pages -------------------------------------------------------------


def series_scores(
    forecast: DataFrame, sales: DataFrame, series: str, cutoffs: Sequence[str]
) -> DataFrame:
    """One series: model x cutoff table of scores; the id filter reaches the scans."""
    one = forecast.filter(F.col("id") == series)
    scores = grouped_scores(one, sales.filter(F.col("id") == series), ["id", "cutoff_date"])
    long = scores_to_long(scores, ["id", "cutoff_date"])
    return (
        long.withColumn("cutoff_date", F.col("cutoff_date").cast("string"))
        .groupBy("model")
        .pivot("cutoff_date", list(cutoffs))
        .agg(F.first("score"))
    )


def series_lines(
    sales: DataFrame, cv_forecast: DataFrame, live_forecast: DataFrame, series: str
) -> DataFrame:
    """Actuals, fold forecasts and live forecasts of one series, long."""
    none = F.lit(None).cast("date")
    actual = sales.filter(F.col("id") == series).select(
        F.lit("actual").alias("kind"), "date", none.alias("cutoff_date"),
        F.lit("sales").alias("model"), F.col("sales").alias("value"),
    )
    cv = forecast_to_long(cv_forecast.filter(F.col("id") == series), ["date", "cutoff_date"], "value")
    live = forecast_to_long(live_forecast.filter(F.col("id") == series), ["date"], "value")
    cols = ["kind", "date", "cutoff_date", "model", "value"]
    return (
        actual.unionByName(cv.withColumn("kind", F.lit("cv")).select(cols))
        .unionByName(
            live.withColumn("kind", F.lit("live")).withColumn("cutoff_date", none).select(cols)
        )
    )


def worst_series(
    errors: DataFrame, model: str, n: int = 50, cutoffs: Sequence[str] | None = None
) -> DataFrame:
    picked = filter_cutoffs(errors.filter(F.col("model") == model), cutoffs)
    sums = picked.groupBy("id").agg(F.sum(F.abs("error")).alias("error"))
    return sums.orderBy(F.desc("error"), "id").limit(n)


def vip_ids(sales: DataFrame, vip: DataFrame) -> DataFrame:
    return rows_of(sales.select("id").distinct(), vip)
