"""Column expressions that carry the null / NaN / zero-division rules.

All functions are pure Catalyst expressions and stay inside codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcast.config import PRED

NAN = float("nan")
INF = float("inf")


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def float_div(num: Column, den: Column) -> Column:
    """IEEE division: x/0 is +-inf, 0/0 is NaN, null in gives null out."""
    at_zero = (
        F.when(num.isNull(), F.lit(None).cast("double"))
        .when(F.isnan(num) | (num == 0), F.lit(NAN))
        .when(num > 0, F.lit(INF))
        .otherwise(F.lit(-INF))
    )
    return F.when(den == 0, at_zero).otherwise(F.try_divide(num, den))


def nan_to(c: Column | str, value: float) -> Column:
    return F.nanvl(as_col(c).cast("double"), F.lit(float(value)))


def clip_low(c: Column | str, low: float = 0.0) -> Column:
    """Lower clip that keeps null null and NaN NaN."""
    c = as_col(c)
    return F.when(c < low, F.lit(low)).otherwise(c)


def clip_unit(c: Column | str) -> Column:
    """Clip to [0, 1]; NaN survives, null survives."""
    c = as_col(c)
    return F.when(F.isnan(c), c).when(c < 0, F.lit(0.0)).when(c > 1, F.lit(1.0)).otherwise(c)


def clean_forecast(c: Column | str) -> Column:
    """NaN -> 0, negative -> 0, null stays null."""
    return clip_low(nan_to(c, 0.0), 0.0)


def inf_to_nan(c: Column | str) -> Column:
    c = as_col(c).cast("double")
    return F.when(F.abs(c) == INF, F.lit(NAN)).otherwise(c)


def sum0(c: Column) -> Column:
    """Sum whose value over no non-null rows is 0."""
    return F.coalesce(F.sum(c), F.lit(0.0))


# ---- scores -----------------------------------------------------------------


def mae(pred: Column | str, target: Column | str) -> Column:
    p, t = as_col(pred), as_col(target)
    return float_div(sum0(F.abs(p - t)), sum0(F.abs(t)))


def bias(pred: Column | str, target: Column | str) -> Column:
    p, t = as_col(pred), as_col(target)
    return float_div(F.abs(sum0(p - t)), sum0(F.abs(t)))


def competition_score(pred: Column | str, target: Column | str) -> Column:
    return bias(pred, target) + mae(pred, target)


def finite_or_zero(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(F.isnan(c) | (c == INF), F.lit(0.0)).otherwise(c)


def competition_loss(pred: Column | str, target: Column | str) -> Column:
    """The score as a training loss: NaN and inf count as 0."""
    return finite_or_zero(competition_score(pred, target))


# ---- column groups ----------------------------------------------------------


def cols_with_prefix(df: DataFrame, prefix: str = PRED) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def cols_without_prefix(df: DataFrame, prefix: str = PRED) -> list[str]:
    return [c for c in df.columns if not c.startswith(prefix)]


def model_names(df: DataFrame) -> list[str]:
    return [c[len(PRED):] for c in cols_with_prefix(df)]


def strip_prefix(c: Column | str, prefix: str = PRED) -> Column:
    return F.regexp_replace(as_col(c), "^" + prefix, "")


def mean_horizontal(cols: Sequence[str | Column]) -> Column:
    """Row mean over the non-null columns; null when all are null."""
    cs = [as_col(c) for c in cols]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cs[1:]), F.coalesce(cs[0], F.lit(0.0)))
    n = sum((c.isNotNull().cast("int") for c in cs[1:]), cs[0].isNotNull().cast("int"))
    return F.try_divide(total, n)


def scalar(df: DataFrame) -> Column:
    """One-row, one-column frame as a scalar subquery (no join in the plan)."""
    return df.scalar()
