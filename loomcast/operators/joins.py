"""N-way joins of forecast frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multi_join(*dfs: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    return reduce(lambda a, b: a.join(b, list(on), how), dfs)


def stack_and_align(*dfs: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner N-way join of frames with unique keys, in a single shuffle.

    The frames are stacked with nulls in foreign columns and folded by key; a key
    stays if every frame holds it.
    """
    on = list(on)
    tagged = [df.withColumn("_src", F.lit(1 << i)) for i, df in enumerate(dfs)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    values = [c for c in stacked.columns if c not in (*on, "_src")]
    folded = stacked.groupBy(*on).agg(
        F.bit_or("_src").alias("_src"),
        *[F.first(c, ignorenulls=True).alias(c) for c in values],
    )
    return folded.filter(F.col("_src") == (1 << len(dfs)) - 1).drop("_src")


def check_equal_lengths(*dfs: DataFrame) -> None:
    """One job counts all inputs; unequal lengths raise."""
    tags = [df.select(F.lit(i).alias("src")) for i, df in enumerate(dfs)]
    rows = reduce(DataFrame.unionAll, tags).groupBy("src").count().collect()
    found = {r["src"]: r["count"] for r in rows}
    lengths = {found.get(i, 0) for i in range(len(dfs))}
    if len(lengths) > 1:
        raise ValueError(f"Lengths of DataFrames are not equal: {sorted(lengths)}")


def join_cv_preds(*dfs: DataFrame, check: bool = True) -> DataFrame:
    if check:
        check_equal_lengths(*dfs)
    return stack_and_align(*dfs, on=["id", "date", "cutoff_date"])


def join_live_preds(*dfs: DataFrame, check: bool = True) -> DataFrame:
    if check:
        check_equal_lengths(*dfs)
    return stack_and_align(*dfs, on=["id", "date"])
