"""Per-series numeric jobs: Arrow batches of whole series, all folds in one visit.

A series crosses to Python once, with the train lengths of its folds beside it,
since every fold is a prefix of the same array.  Kernels are vectorised over the
batch: `kernel(y, n)` gets a left-aligned matrix `y` of shape (series, weeks) and
train lengths `n` of shape (series, folds).  Spark partitions and shuffles the
work; a series is bounded by its calendar, so no task receives an unbounded group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.config import DEFAULT_CV, PRED, CvConfig
from loomcast.functions.expr import clean_forecast
from loomcast.operators.cv import LIVE, to_series, train_length
from loomcast.sources.shipping import ship_package

CHUNK = 512  # series per kernel call: keeps the working arrays inside the cache

Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]
SeriesFn = Callable[[np.ndarray, int], np.ndarray]


def fold_lengths(
    series: DataFrame,
    cv: CvConfig,
    *,
    folds: bool = True,
    live: bool = False,
    keep_dates: bool = False,
) -> DataFrame:
    """One row per series: `id, y`, and arrays `fold, cutoff_date, n` (0 = no train rows)."""
    wanted = (list(range(cv.n_windows)) if folds else []) + ([LIVE] if live else [])

    def length(f: int):
        end = F.element_at("dates", -1)
        if f != LIVE:
            end = F.date_sub(end, 7 * (f * cv.step + cv.h))
        return train_length(end)

    ns = F.array(*[length(f) for f in wanted])
    cut = F.transform("n", lambda k: F.date_add(F.try_element_at("dates", F.greatest(k, F.lit(1))), 7))
    return (
        series.withColumn("n", ns)
        .withColumn("cutoff_date", cut)
        .select("id", *(["dates"] if keep_dates else []), "y", "n", "cutoff_date")
        .withColumn("fold", F.array(*[F.lit(f) for f in wanted]))
    )


def _matrix(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Left-aligned matrix of a list column, without touching single rows."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False).astype(float)
    values = values[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0))
    if len(values):
        row = np.repeat(np.arange(len(sizes)), sizes)
        col = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)
        out[row, col] = values
    return out, sizes


def spread(df: DataFrame) -> DataFrame:
    """Even out CPU-heavy rows by hash; the cluster's own shuffle width is used."""
    spark = df.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(width, spark.sparkContext.defaultParallelism), "id")


def map_folds(lengths: DataFrame, columns: Mapping[str, str], compute: Callable) -> DataFrame:
    """Rows `id, fold, cutoff_date, <columns>` from `compute(y, n) -> {column: array}`.

    `columns` maps output names to SQL types, `double` or `array<double>`; arrays
    come back with shape (series, folds[, length]).
    """
    schema = "id string, fold int, cutoff_date date, " + ", ".join(
        f"{k} {v}" for k, v in columns.items()
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                y, _ = _matrix(part.column("y"))
                ns, _ = _matrix(part.column("n"))
                ns = ns.astype(int)
                n_folds = ns.shape[1]
                keep = np.flatnonzero(ns.reshape(-1) > 0)
                result = compute(y, ns)
                take = pa.array(keep // n_folds)
                cols = [
                    part.column("id").take(take),
                    part.column("fold").flatten().take(pa.array(keep)).cast(pa.int32()),
                    part.column("cutoff_date").flatten().take(pa.array(keep)),
                ]
                for name, kind in columns.items():
                    a = np.asarray(result[name], dtype=float)
                    if kind == "double":
                        cols.append(pa.array(a.reshape(-1)[keep]))
                    else:
                        flat = a.reshape(len(ns) * n_folds, -1)[keep]
                        width = flat.shape[1]
                        offsets = np.arange(0, flat.size + 1, width, dtype=np.int32)
                        cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel())))
                names = ["id", "fold", "cutoff_date", *columns]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    ship_package(lengths.sparkSession)
    return lengths.mapInArrow(run, schema)


def historic_average(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    cum = np.cumsum(y, axis=1)
    total = np.take_along_axis(cum, np.maximum(n, 1) - 1, axis=1)
    return total / np.maximum(n, 1)


def per_series(fn: SeriesFn, h: int) -> Kernel:
    """Kernel from a function of one series; a failing or misshapen run is left NaN-free
    by the historic average."""

    def kernel(y: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.repeat(historic_average(y, n)[:, :, None], h, axis=2)
        for i in range(len(y)):
            for j in range(n.shape[1]):
                if n[i, j] > 0:
                    try:
                        out[i, j] = np.asarray(fn(y[i, : n[i, j]], h), dtype=float)
                    except Exception:  # noqa: BLE001 - any model failure means fallback
                        pass
        return out

    return kernel


def guarded(kernel: Kernel, y: np.ndarray, n: np.ndarray, h: int) -> np.ndarray:
    """A kernel's forecasts; a series that makes it raise, and only that one, gets its historic average."""
    try:
        return kernel(y, n)
    except Exception:  # noqa: BLE001 - any model failure means fallback
        if len(y) == 1:
            return np.repeat(historic_average(y, n)[:, :, None], h, axis=2)
        return np.concatenate([guarded(kernel, y[i : i + 1], n[i : i + 1], h) for i in range(len(y))])


def forecast_arrays(
    panel: DataFrame, kernels: Mapping[str, Kernel], cv: CvConfig, folds: bool, live: bool
) -> DataFrame:
    h = cv.h

    def compute(y, n):
        return {name: guarded(kernel, y, n, h) for name, kernel in kernels.items()}

    lengths = fold_lengths(to_series(panel), cv, folds=folds, live=live)
    return map_folds(spread(lengths), {k: "array<double>" for k in kernels}, compute)


def kernel_forecast(
    panel: DataFrame,
    kernels: Mapping[str, Kernel],
    cv: CvConfig = DEFAULT_CV,
    *,
    folds: bool = True,
    live: bool = False,
) -> DataFrame:
    """Wide forecasts `id, date, cutoff_date, fold, prediction_<name>` from batch kernels."""
    arrays = forecast_arrays(panel, kernels, cv, folds, live)
    steps = F.explode(F.sequence(F.lit(1), F.lit(cv.h))).alias("horizon")
    rows = arrays.select("id", "fold", "cutoff_date", *kernels, steps)
    return rows.select(
        "id",
        F.date_add("cutoff_date", (F.col("horizon") - 1) * 7).alias("date"),
        "cutoff_date",
        "fold",
        *[
            clean_forecast(F.element_at(name, F.col("horizon"))).alias(PRED + name)
            for name in kernels
        ],
    )


def panel_forecast(
    panel: DataFrame,
    models: Mapping[str, SeriesFn],
    cv: CvConfig = DEFAULT_CV,
    *,
    folds: bool = True,
    live: bool = False,
) -> DataFrame:
    """Forecast with any functions `fn(y, h) -> h values`; the slot for outside models.

    `y` is the train part of one series.  NaN becomes 0, negatives become 0, and a
    raising function falls back to the historic average of that series.
    """
    kernels = {name: per_series(fn, cv.h) for name, fn in models.items()}
    return kernel_forecast(panel, kernels, cv, folds=folds, live=live)
