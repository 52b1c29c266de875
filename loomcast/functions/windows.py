"""Per-series window functions: fills, lags, rolling statistics.

All frames are bounded row frames over one partitioning (series) and one order
(date), so any number of them share a single shuffle and sort.
"""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomcast.functions.expr import NAN, as_col, float_div


def series_window(by: str | Sequence[str] = "id"):
    keys = [by] if isinstance(by, str) else list(by)
    return W.partitionBy(*keys).orderBy("date")


def forward_fill(col: Column | str, by="id") -> Column:
    w = series_window(by).rowsBetween(W.unboundedPreceding, W.currentRow)
    return F.last(as_col(col), ignorenulls=True).over(w)


def price_group(sales: DataFrame, by="id") -> DataFrame:
    """Mean over the series of the forward-filled price; leading nulls do not count."""
    keys = [by] if isinstance(by, str) else list(by)
    filled = sales.withColumn("_ff", forward_fill("price", keys))
    return filled.withColumn("price_group", F.avg("_ff").over(W.partitionBy(*keys))).drop("_ff")


def running_sum(col: Column | str, by="id") -> Column:
    return F.sum(as_col(col)).over(series_window(by).rowsBetween(W.unboundedPreceding, 0))


def tail_rows(df: DataFrame, n: int, by="id") -> DataFrame:
    keys = [by] if isinstance(by, str) else list(by)
    w = W.partitionBy(*keys).orderBy(F.desc("date"))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def lag_columns(col: str, lags: Sequence[int], by="id") -> dict[str, Column]:
    w = series_window(by)
    return {f"lag{k}": F.lag(col, k).over(w) for k in lags}


# Rolling statistics offered on the lagged target.
ROLLING = {
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "sum": F.sum,
    "count": F.count,
}


def rolling(
    stat: str, col: Column | str, window: int, min_samples: int | None = None, lag: int = 0, by="id"
) -> Column:
    """Statistic over the `window` values that end `lag` rows back.

    Null unless at least `min_samples` (default: a full window) values exist.
    """
    c = as_col(col)
    frame = series_window(by).rowsBetween(-(window + lag - 1), -lag)
    need = window if min_samples is None else min_samples
    return F.when(F.count(c).over(frame) >= need, ROLLING[stat](c).over(frame))


def sorted_frame(col: Column | str, window: int, lag: int = 0, by="id") -> Column:
    """Sorted array of the window's values; keep it as a column before reading from it."""
    frame = series_window(by).rowsBetween(-(window + lag - 1), -lag)
    return F.sort_array(F.collect_list(as_col(col)).over(frame))


def quantile_columns(year: str, quantiles: Sequence[float], min_samples: int) -> dict[str, Column]:
    """Quantiles of a sorted array column; null below `min_samples` values."""
    return {
        f"q{int(q * 100)}": F.when(F.size(year) >= min_samples, array_quantile(F.col(year), q))
        for q in quantiles
    }


def with_rolling_quantiles(
    df: DataFrame, col: str, quantiles: Sequence[float], window: int, min_samples: int | None = None,
    lag: int = 0, by="id", prefix: str = "",
) -> DataFrame:
    """Interpolated quantiles of a row window; the window is collected and sorted once."""
    need = window if min_samples is None else min_samples
    rows = df.withColumn("_sorted", sorted_frame(col, window, lag, by))
    cols = quantile_columns("_sorted", quantiles, need)
    return rows.withColumns({prefix + k: c for k, c in cols.items()}).drop("_sorted")


def array_quantile(sorted_vals: Column, q: float) -> Column:
    """Linear interpolation between the order statistics of a sorted array."""
    pos = (F.size(sorted_vals) - 1) * F.lit(q)
    lo = F.floor(pos).cast("int")
    frac = pos - lo
    a = F.try_element_at(sorted_vals, lo + 1)
    b = F.coalesce(F.try_element_at(sorted_vals, lo + 2), a)
    return a + (b - a) * frac


def ewm_mean(col: Column | str, alpha: float = 0.9, lag: int = 1, by="id") -> Column:
    """Exponentially weighted mean of the values up to `lag` rows back.

    The recursion s = alpha*x + (1-alpha)*s starts at the first value seen.  The history read is as long
    as alpha asks for: what lies before it weighs less than 1e-32 and fixes no digit of a double.
    """
    depth = 1 if alpha >= 1 else math.ceil(-32 * math.log(10) / math.log1p(-alpha))
    frame = series_window(by).rowsBetween(-(depth + lag - 1), -lag)
    vals = F.collect_list(as_col(col)).over(frame)
    start = F.try_element_at(vals, F.lit(1))
    return F.aggregate(vals, start, lambda s, x: x * alpha + s * (1 - alpha))


def trend(col: Column | str, window: int, by="id") -> Column:
    """Value over the rolling mean one step earlier."""
    return float_div(as_col(col), rolling("mean", col, window, lag=1, by=by))


def momentum(col: Column | str, window: int, by="id") -> Column:
    """Rolling mean over the rolling mean one window earlier."""
    return float_div(
        rolling("mean", col, window, by=by), rolling("mean", col, window, lag=window, by=by)
    )


def _from_index(window: int, value: Column, by) -> Column:
    """Values from position `window` on; the first full window itself is NaN."""
    rn = F.row_number().over(series_window(by))
    return F.when(rn > window, value).otherwise(F.lit(NAN))


def rolling_zero_share(col: Column | str, window: int = 7, by="id") -> Column:
    frame = series_window(by).rowsBetween(-(window - 1), 0)
    share = F.sum((as_col(col) == 0).cast("double")).over(frame) / F.lit(float(window))
    return _from_index(window, share, by)


def _moments(col: Column | str, window: int, by):
    """Mean of x and sum of (x - mean)(t - mean t), t = 0..window-1 in the frame."""
    c = as_col(col)
    frame = series_window(by).rowsBetween(-(window - 1), 0)
    rn = F.row_number().over(series_window(by))
    sx = F.sum(c).over(frame)
    # position inside the frame = absolute position - (rn - window) - 1
    st = F.sum(c * F.col("_pos")).over(frame) - (rn - window + 1) * sx
    mid = (window - 1) / 2
    return sx / window, st - sx * mid, mid


def rolling_intercept(df: DataFrame, col: str, window: int, alias: str, by="id") -> DataFrame:
    """Intercept of the windowed line, with the slope's divisor (window-1)*var(t)."""
    pos = df.withColumn("_pos", F.row_number().over(series_window(by)).cast("double"))
    mean, cov, mid = _moments(col, window, by)
    var = (window**2 - 1) / 12
    alpha = mean - cov / ((window - 1) * var) * mid
    return pos.withColumn(alias, _from_index(window, alpha, by)).drop("_pos")


def rolling_slope(df: DataFrame, col: str, window: int, alias: str, by="id") -> DataFrame:
    """Least-squares slope of the windowed values on 0..window-1."""
    pos = df.withColumn("_pos", F.row_number().over(series_window(by)).cast("double"))
    _, cov, _ = _moments(col, window, by)
    var = (window**2 - 1) / 12
    return pos.withColumn(alias, _from_index(window, cov / (window * var), by)).drop("_pos")
