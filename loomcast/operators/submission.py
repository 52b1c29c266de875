"""Wide submission tables, one per model, with their integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.config import KEYS, PRED
from loomcast.functions.expr import cols_with_prefix, strip_prefix
from loomcast.operators.panel import pivot_dates, split_id
from loomcast.sources.lineage import materialize


def _forecast_dates(preds: DataFrame) -> list[str]:
    """The horizon's dates, ascending: one value per forecast week."""
    rows = preds.select(F.date_format("date", "yyyy-MM-dd").alias("d")).distinct().collect()
    return sorted(r["d"] for r in rows)


def format_submission(
    preds: DataFrame, raw_sales: DataFrame, dates: list[str] | None = None, check: bool = True
) -> DataFrame:
    """`id, date, pred` to keys plus one column per week, on the keys of the raw file."""
    missing = {"id", "date", "pred"} - set(preds.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    if dates is None:
        dates = _forecast_dates(preds)
    elif dates != sorted(dates):
        raise ValueError("date columns are not in order")
    keyed = preds.select(*split_id(), F.date_format("date", "yyyy-MM-dd").alias("date"), "pred")
    # written once: the check and the caller read the same rows
    wide = materialize(pivot_dates(keyed, KEYS, "pred", dates), "submission")
    raw_keys = raw_sales.select(*[F.col(k).cast("bigint").alias(k) for k in KEYS])
    if check:
        sides = wide.select(F.lit(1).alias("w")).unionAll(raw_keys.select(F.lit(0).alias("w")))
        n = {r["w"]: r["count"] for r in sides.groupBy("w").count().collect()}
        if n.get(0, 0) != n.get(1, 0):
            raise ValueError(f"submission has {n.get(1, 0)} rows, raw file {n.get(0, 0)}")
    return raw_keys.join(wide, KEYS, "full")


def submission_table(
    forecast: DataFrame, raw_sales: DataFrame, check: bool = True
) -> DataFrame:
    """All models in one pivot: `model`, the keys, one column per week."""
    dates = _forecast_dates(forecast)
    cols = cols_with_prefix(forecast)
    long = forecast.unpivot(["id", "date"], cols, "model", "pred")
    keyed = long.select(
        F.lower(strip_prefix("model")).alias("model"),
        *split_id(),
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        "pred",
    )
    table = materialize(pivot_dates(keyed, ["model", *KEYS], "pred", dates), "submissions")
    if check:
        expected = raw_sales.count()
        found = {r["model"]: r["count"] for r in table.groupBy("model").count().collect()}
        for name in (c[len(PRED):].lower() for c in cols):
            if found.get(name, 0) != expected:
                raise ValueError(f"{name} has {found.get(name, 0)} rows, raw file {expected}")
    return table


def make_submissions(
    forecast: DataFrame, raw_sales: DataFrame, check: bool = True
) -> dict[str, DataFrame]:
    """One wide frame per model, named in lower case; all cut from one table."""
    table = submission_table(forecast, raw_sales, check)
    raw_keys = raw_sales.select(*[F.col(k).cast("bigint").alias(k) for k in KEYS])
    names = [c[len(PRED):].lower() for c in cols_with_prefix(forecast)]
    return {
        n: raw_keys.join(table.filter(F.col("model") == n).drop("model"), KEYS, "full") for n in names
    }
