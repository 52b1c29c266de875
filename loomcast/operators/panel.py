"""Reshaping: wide files to a clean long panel, and back to wide reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomcast.config import KEYS, PRED
from loomcast.functions.expr import cols_with_prefix, mean_horizontal, strip_prefix


def to_long(df: DataFrame, name: str) -> DataFrame:
    """Unpivot every non-key column; null cells are kept."""
    values = [c for c in df.columns if c not in KEYS]
    typed = df.select(*KEYS, *[F.col(f"`{c}`").cast("double").alias(c) for c in values])
    return typed.unpivot(KEYS, [F.col(f"`{c}`") for c in values], "date", name)


def join_dfs(*dfs: DataFrame, name: str) -> DataFrame:
    """Long form of each wide frame, tagged with its ordinal `phase`, stacked."""
    tagged = [to_long(df, name).withColumn("phase", F.lit(i)) for i, df in enumerate(dfs)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out


def join_sales_dfs(*dfs: DataFrame) -> DataFrame:
    return join_dfs(*dfs, name="sales")


def join_price_dfs(*dfs: DataFrame) -> DataFrame:
    return join_dfs(*dfs, name="price")


def series_id() -> Column:
    """`C-W-P`; null if any part is null."""
    return F.concat("Client", F.lit("-"), "Warehouse", F.lit("-"), "Product")


def join_into_cube(sales: DataFrame, price: DataFrame) -> DataFrame:
    return sales.join(price, on=[*KEYS, "date", "phase"], how="left").select(
        *KEYS,
        F.to_date("date", "yyyy-MM-dd").alias("date"),
        F.col("sales").cast("double").alias("sales"),
        F.col("price").cast("double").alias("price"),
        "phase",
        series_id().alias("id"),
    )


def remove_leading_zeros(cube: DataFrame) -> DataFrame:
    """Keep each series from its first week with positive sales on.

    The start is an unordered window minimum, so no running frame is needed.
    """
    first_sale = F.min(F.when(F.col("sales") > 0, F.col("date"))).over(W.partitionBy(*KEYS))
    return (
        cube.withColumn("_first", first_sale).filter(F.col("date") >= F.col("_first")).drop("_first")
    )


def select_prefix(df: DataFrame, keep: Sequence[str], prefix: str = PRED) -> DataFrame:
    return df.select(*keep, *cols_with_prefix(df, prefix))


def forecast_to_long(
    df: DataFrame, index: Sequence[str] = ("id", "date", "cutoff_date"), value: str = "prediction"
) -> DataFrame:
    long = df.unpivot(list(index), cols_with_prefix(df), "model", value)
    return long.withColumn("model", strip_prefix("model"))


def pivot_dates(df: DataFrame, keys: Sequence[str], value: str, dates: Sequence[str]) -> DataFrame:
    """One column per listed ISO date; the list is explicit, so no extra pass finds it."""
    return df.groupBy(*keys).pivot("date", list(dates)).agg(F.first(value))


def pivot_mean(
    df: DataFrame, index: str, on: str, value: str, columns: Sequence[str]
) -> DataFrame:
    return df.groupBy(index).pivot(on, list(columns)).agg(F.avg(value))


def split_id(col: str = "id") -> list[Column]:
    parts = F.split(col, "-")
    return [parts[i].cast("bigint").alias(k) for i, k in enumerate(KEYS)]


def align_frames(left: DataFrame, right: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both frames extended to the union of their keys (nulls where absent)."""
    on = list(on)
    keys = left.select(*on).union(right.select(*on)).distinct()
    return keys.join(left, on, "left"), keys.join(right, on, "left")


def row_mean(df: DataFrame, cols: Sequence[str], alias: str) -> DataFrame:
    return df.withColumn(alias, mean_horizontal(list(cols)))


def subsample(df: DataFrame, n: int = 100, seed: int | None = None, id_col: str = "id") -> DataFrame:
    """All rows of n distinct ids, drawn in the order of a seeded hash.

    `limit` over an ordering is a per-task top-n followed by a merge, and the id
    side is only broadcast by the planner's own size check.
    """
    return df.join(drawn_ids(df, n, seed, id_col), id_col, "left_semi")


def drawn_ids(df: DataFrame, n: int = 100, seed: int | None = None, id_col: str = "id") -> DataFrame:
    order = F.md5(F.concat(F.col(id_col), F.lit(str(seed or 0))))
    return df.select(id_col).distinct().orderBy(order, id_col).limit(n)
