"""Inputs shared by the registered queries, and rounding for comparison."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcast.config import PRED
from loomcast.functions.expr import mean_horizontal
from loomcast.operators import cv as C
from loomcast.operators import naive
from loomcast.sources import panels

Query = Callable[[SparkSession, str], DataFrame]

MIX = PRED + "MixerWigeSeveEnsemble"


def primary_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean panel, one row per series."""
    return panels.weekly_series(spark, sf_dir)


def thin_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean panel of thin series, one row each."""
    return panels.sparse_series(spark, sf_dir)


def primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean dense panel."""
    return panels.rows(primary_series(spark, sf_dir))


def thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean panel of thin series."""
    return panels.rows(thin_series(spark, sf_dir))


def with_mix(fc: DataFrame) -> DataFrame:
    return fc.withColumn(
        MIX, mean_horizontal([PRED + "WindowAverage", PRED + "SeasonalNaive"])
    )


def cv_forecast(prim: DataFrame, actual: bool = False) -> DataFrame:
    return with_mix(naive.cross_validate(prim, actual=actual))


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded for comparison across engines; everything else unchanged."""
    return df.select(
        *[
            F.round(F.col(f"`{n}`"), digits).alias(n)
            if t == "double" and n not in skip
            else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def weeks(first: str, n: int, step: int = 1) -> str:
    """Literal list of dates for SQL, every `step` weeks from the first: the calendar of the tables is fixed."""
    start = date.fromisoformat(first)
    return ", ".join(f"'{start + timedelta(weeks=i * step)}'" for i in range(n))


def dates_of(df: DataFrame) -> list[str]:
    """ISO dates in a frame: one short value per week of the calendar."""
    rows = df.select(F.col("date").cast("string")).distinct().collect()
    return sorted(r[0] for r in rows)


def first_id(df: DataFrame) -> str:
    return df.agg(F.min("id")).collect()[0][0]


__all__ = ["C", "MIX", "Query", "cv_forecast", "dates_of", "first_id", "primary", "primary_series", "rounded", "thin", "thin_series", "weeks", "with_mix"]
