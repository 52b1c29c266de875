"""Rolling-origin folds, leave-one-cutoff-out folds, future grids.

A fold is a column, never a loop.  `rolling_origin` works on rows;
`fold_series` is the array form used by all per-series jobs: the panel is
shuffled once by series and every fold is a slice of the same array.  A series
holds one value per week, so its array is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomcast.config import DEFAULT_CV, KEYS, CvConfig

LIVE = -1  # fold number of the run on all data


def weeks_back(date: Column, weeks: Column) -> Column:
    return F.date_sub(date, (weeks * 7).cast("int"))


def rolling_origin(
    df: DataFrame,
    h: int = 13,
    n_windows: int = 3,
    step: int | None = None,
    min_train_size: int | None = None,
    id_col: str = "id",
    time_col: str = "date",
) -> DataFrame:
    """Rows of every fold with `fold`, `is_test`, `train_end` in one pass.

    Train: date <= train_end; test: the next h weeks, only for series that have
    (enough) train rows.  `fold` 0 is the newest.  All windows share the
    partitioning by series, so there is one shuffle.
    """
    step = step or h
    by_id = W.partitionBy(id_col)
    bounded = df.withColumn("_mx", F.max(time_col).over(by_id)).withColumn(
        "_mn", F.min(time_col).over(by_id)
    )
    if min_train_size:  # counted for all folds before rows are multiplied, in the windows' partitions
        sizes = [F.count(F.when(F.col(time_col) <= weeks_back(F.col("_mx"), F.lit(i * step + h)), 1)) for i in range(n_windows)]
        bounded = bounded.withColumn("_n", F.array(*[n.over(by_id) for n in sizes]))
    folds = F.array(*[F.lit(i) for i in range(n_windows)])
    rows = (
        bounded.withColumn("fold", F.explode(folds))
        .withColumn("train_end", weeks_back(F.col("_mx"), F.col("fold") * step + h))
        .filter(
            (F.col(time_col) <= weeks_back(F.col("_mx"), F.col("fold") * step))
            & (F.col("_mn") <= F.col("train_end"))
        )
        .withColumn("is_test", F.col(time_col) > F.col("train_end"))
    )
    if min_train_size:
        rows = rows.filter(F.get("_n", F.col("fold")) >= min_train_size).drop("_n")
    return rows.drop("_mx", "_mn")


def rolling_origin_series(series: DataFrame, h: int = 13, n_windows: int = 3, step: int | None = None) -> DataFrame:
    """Rows `id, date, fold, train_end, is_test, sales` of `rolling_origin` from one row per series.

    Bounds are the ends of the array, so nothing is shuffled or sorted.
    """
    step = step or h
    first, last = F.element_at("dates", 1), F.element_at("dates", -1)
    folds = F.array(*[F.lit(i) for i in range(n_windows)])
    cut = (
        series.select("id", "dates", "y", F.explode(folds).alias("fold"))
        .withColumn("train_end", weeks_back(last, F.col("fold") * step + h))
        .filter(first <= F.col("train_end"))
        .withColumn("y", F.slice("y", F.lit(1), train_length(weeks_back(last, F.col("fold") * step))))
    )
    rows = cut.select("id", "dates", "fold", "train_end", F.posexplode("y").alias("_i", "sales"))
    rows = rows.select("id", F.get("dates", F.col("_i")).alias("date"), "fold", "train_end", "sales")
    return rows.withColumn("is_test", F.col("date") > F.col("train_end"))


def leave_one_out(df: DataFrame, groups: list, group_col: str = "cutoff_date") -> DataFrame:
    """Every row once per held-out group, with `held_out` and `is_val`.

    `groups` is the (short) list of folds; it comes from the first frame.
    """
    held = F.array(*[F.lit(g) for g in groups])
    return df.withColumn("held_out", F.explode(held)).withColumn(
        "is_val", F.col(group_col) == F.col("held_out")
    )


def cutoff_list(df: DataFrame, group_col: str = "cutoff_date") -> list:
    """Sorted fold keys: one value per fold."""
    return [r[0] for r in df.select(group_col).distinct().orderBy(group_col).collect()]


def stamp_cutoff(forecast: DataFrame, by: tuple[str, ...] = ("id", "fold")) -> DataFrame:
    """`cutoff_date` = first forecast week of each series and fold."""
    return forecast.withColumn("cutoff_date", F.min("date").over(W.partitionBy(*by)))


def future_grid(df: DataFrame, h: int = 13, id_col: str = "id", time_col: str = "date") -> DataFrame:
    last = df.groupBy(id_col).agg(F.max(time_col).alias("_last"))
    return last.select(
        id_col, F.explode(F.sequence(F.lit(1), F.lit(h))).alias("horizon"), "_last"
    ).select(id_col, "horizon", F.date_add("_last", F.col("horizon") * 7).alias(time_col))


# ---- array form -------------------------------------------------------------


def series_keys(df: DataFrame) -> list[str]:
    """Key columns that name a series in this frame.

    Using the key columns beside `id` keeps the partitioning of a panel that is
    already hashed on its keys, so no second shuffle is added.
    """
    return [k for k in KEYS if k in df.columns] + ["id"]


def is_series(df: DataFrame) -> bool:
    """Whether a frame has one row per series, with `dates` and `y`, and not one per week."""
    return {"id", "dates", "y"} <= set(df.columns)


def to_series(panel: DataFrame, value: str = "sales") -> DataFrame:
    """One row per series: dates and values in date order; a frame that is in this form already is not moved."""
    if is_series(panel):
        return panel.select("id", "dates", "y")
    pts = F.sort_array(F.collect_list(F.struct("date", F.col(value).alias("v"))))
    return panel.groupBy(*series_keys(panel)).agg(pts.alias("p")).select(
        "id", F.col("p.date").alias("dates"), F.col("p.v").alias("y")
    )


def train_length(end: Column) -> Column:
    """Number of entries of `dates` up to `end`.

    On a gapless weekly series it follows from the first date alone; only a series
    with missing weeks has its dates counted.
    """
    first, last = F.element_at("dates", 1), F.element_at("dates", -1)
    gapless = F.floor(F.datediff(last, first) / 7) + 1 == F.size("dates")
    by_dates = F.floor(F.datediff(end, first) / 7) + 1
    counted = F.size(F.filter("dates", lambda d: d <= end))
    return F.when(end < first, 0).when(gapless, by_dates).otherwise(counted).cast("int")


def fold_series(
    series: DataFrame, cv: CvConfig = DEFAULT_CV, *, folds: bool = True, live: bool = False, actual: bool = False
) -> DataFrame:
    """One row per (series, fold): `id, fold, cutoff_date, n, y` with train values only.

    With `actual` also the dates and values of the h weeks behind the train part, as `test`.  Narrow: no shuffle.
    """
    wanted = (list(range(cv.n_windows)) if folds else []) + ([LIVE] if live else [])
    last = F.element_at("dates", -1)
    end = F.when(F.col("fold") == LIVE, last).otherwise(
        weeks_back(last, F.col("fold") * cv.step + cv.h)
    )
    behind = [F.slice(c, F.col("n") + 1, F.lit(cv.h)) for c in ("dates", "y")]
    test = [F.map_from_arrays(*behind).alias("test")] if actual else []
    return (
        series.withColumn("fold", F.explode(F.array(*[F.lit(i) for i in wanted])))
        .withColumn("train_end", end)
        .withColumn("n", train_length(F.col("train_end")))
        .filter(F.col("n") > 0)
        .select(
            "id",
            "fold",
            F.date_add(F.element_at("dates", F.col("n")), 7).alias("cutoff_date"),
            "n",
            F.slice("y", F.lit(1), F.col("n")).alias("y"),
            *test,
        )
    )
