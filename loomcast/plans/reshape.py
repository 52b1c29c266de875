"""Sources, sinks, projection, reshape and join queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcast.config import KEYS, PRED

from loomcast.operators import cv as C
from loomcast.operators import dashboard, joins, naive, panel, scores, submission
from loomcast.plans.base import MIX, cv_forecast, dates_of, primary, primary_series, rounded, weeks
from loomcast.plans.registry import query
from loomcast.sources import panels, tables
from loomcast.sources.lineage import materialize, scratch_path

# ---- inputs in the raw wide layout ------------------------------------------------


def _wide(spark: SparkSession, sf_dir: str, phase: int, value: str) -> DataFrame:
    return panels.wide(spark, sf_dir, phase, {"sales": "y", "price": "prices"}[value])


def _long_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.join_sales_dfs(*[_wide(spark, sf_dir, p, "sales") for p in (0, 1)])


def _long_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.join_price_dfs(*[_wide(spark, sf_dir, p, "price") for p in (0, 1)])


# ---- sources and sinks --------------------------------------------------------------

WIDE_SALES = """
  select cast(Client as bigint) as Client, Warehouse, cast(Product as bigint) as Product,
         cast(date as varchar) as date, sales from panel where phase = 0"""


@query(WIDE_SALES)
def read_wide_csv(spark, sf_dir):
    """Wide CSV written, discovered and read back, then unpivoted (IO1)."""
    path = scratch_path(spark, "raw")
    _wide(spark, sf_dir, 0, "sales").write.csv(path, header=True)
    return panel.to_long(tables.read_wide_csv(spark, path), "sales")


@query(
    """select id, date, cutoff_date, prediction_WindowAverage, prediction_SeasonalNaive from cvfc
       where cutoff_date >= date '2001-01-01'""",
    "prediction_WindowAverage",
)
def read_forecast_layer(spark, sf_dir):
    """Forecast layer partitioned by fold: the date filter prunes folders (IO2)."""
    path = scratch_path(spark, "forecast")
    tables.write_layer(naive.cross_validate(primary_series(spark, sf_dir)), path)
    back = tables.read_layer(spark, path).filter(F.col("cutoff_date") >= F.lit("2001-01-01"))
    return rounded(
        back.select("id", "date", "cutoff_date", PRED + "WindowAverage", PRED + "SeasonalNaive")
    )


@query("select id, ha as mean_sales, n as n_train from lstat", "mean_sales")
def save_parameter_table(spark, sf_dir):
    """Per-series parameters stored as a table and loaded again (IO3)."""
    path = scratch_path(spark, "params")
    series = C.fold_series(primary_series(spark, sf_dir), folds=False, live=True)
    tables.save_parameters(
        series.select(
            "id",
            naive.array_mean(F.col("y")).alias("mean_sales"),
            F.col("n").cast("bigint").alias("n_train"),
        ),
        path,
    )
    return rounded(tables.read_layer(spark, path))


@query(
    """select lower(replace(name, 'prediction_', '')) as model, count(*) as n, sum(value) as total from (
         unpivot livefc on prediction_ZeroModel, prediction_WindowAverage, prediction_SeasonalNaive,
         prediction_HistoricAverage into name name value value) group by 1""",
    "total",
    3,
)
def submission_csv_sink(spark, sf_dir):
    """All models to CSV in one job, one folder per model, read back (IO4)."""
    path = scratch_path(spark, "submissions")
    tables.write_submissions_long(naive.live_forecast(primary_series(spark, sf_dir)), path)
    back = spark.read.schema("id string, date date, prediction double, model string").csv(
        path, header=True
    )
    return rounded(
        back.groupBy("model").agg(F.count("*").alias("n"), F.sum("prediction").alias("total")), 3
    )


@query("select id, date, sales from prim order by id, date limit 10")
def preview_rows(spark, sf_dir):
    """First ten rows in key order (IO5)."""
    return tables.preview(primary(spark, sf_dir).select("id", "date", "sales").orderBy("id", "date"))


# ---- projection, filter, reshape -------------------------------------------------------


@query(WIDE_SALES.replace("bigint", "integer"))
def wide_to_long(spark, sf_dir):
    """Unpivot all date columns (RS1)."""
    return panel.to_long(_wide(spark, sf_dir, 0, "sales"), "sales")


@query(
    """select phase, cast(date as varchar) as date, count(*) as n, sum(sales) as sales
       from panel group by 1, 2"""
)
def stack_sales_phases(spark, sf_dir):
    """Phase files stacked with their ordinal (RS2)."""
    long = _long_sales(spark, sf_dir)
    return long.groupBy("phase", "date").agg(F.count("*").alias("n"), F.sum("sales").alias("sales"))


@query(
    """select phase, cast(date as varchar) as date, count(*) as n, count(price) as priced,
              sum(price) as price from panel group by 1, 2""",
    "price",
    3,
)
def stack_price_phases(spark, sf_dir):
    """Price files stacked; null cells are kept (RS2)."""
    long = _long_price(spark, sf_dir)
    return rounded(
        long.groupBy("phase", "date").agg(
            F.count("*").alias("n"), F.count("price").alias("priced"), F.sum("price").alias("price")
        ),
        3,
    )


@query("select Client, Warehouse, Product, date, sales, price, phase, id from panel", "price", 9)
def build_cube(spark, sf_dir):
    """Sales left-joined with price on keys, date and phase; id and date typed (RS3)."""
    cube = panel.join_into_cube(_long_sales(spark, sf_dir), _long_price(spark, sf_dir))
    return rounded(cube, 9)


@query("select id, date, sales, phase from prim")
def trim_leading_zeros(spark, sf_dir):
    """Weeks before the first sale dropped (RS4)."""
    return primary(spark, sf_dir).select("id", "date", "sales", "phase")


@query("select id, date, sales, phase from sprim")
def trim_leading_zeros_sparse(spark, sf_dir):
    """The same on thin series, where long empty prefixes occur (RS4)."""
    thin = panel.remove_leading_zeros(panels.sparse_panel(spark, sf_dir))
    return thin.select("id", "date", "sales", "phase")


@query(
    """select id, date, prediction_ZeroModel, prediction_WindowAverage, prediction_SeasonalNaive,
              prediction_HistoricAverage from livefc""",
    "prediction_WindowAverage prediction_HistoricAverage",
)
def select_prefixed_columns(spark, sf_dir):
    """Column group chosen by name prefix (RS5)."""
    live = naive.live_forecast(primary_series(spark, sf_dir)).withColumn("other", F.lit(1))
    return rounded(panel.select_prefix(live, ["id", "date"]))


@query("select * from fclong", "prediction")
def forecast_to_long(spark, sf_dir):
    """Wide forecasts to model / prediction rows (RS6)."""
    return rounded(panel.forecast_to_long(cv_forecast(primary_series(spark, sf_dir))))


@query(
    f"""select * from (pivot (select Client, Warehouse, Product, cast(date as varchar) as date, sales
         from panel where phase = 1) on date in ({weeks("2001-08-06", 13)}) using first(sales) group by Client, Warehouse, Product)"""
)
def pivot_dates(spark, sf_dir):
    """One column per ISO week (RS7)."""
    cube = panels.weekly_panel(spark, sf_dir).filter(F.col("phase") == 1)
    cube = cube.select(*KEYS, F.col("date").cast("string").alias("date"), "sales")
    return panel.pivot_dates(cube, KEYS, "sales", dates_of(cube))


@query(
    "select model, " + ", ".join(f"avg(score) filter (k = {k}) as c{k}" for k in range(1, 9))
    + " from (select *, dense_rank() over (order by cutoff_date desc) as k from toterr) group by 1",
    " ".join(f"c{k}" for k in range(1, 9)),
)
def pivot_mean_score(spark, sf_dir):
    """Mean score pivoted over the folds, newest first (RS8)."""
    prim = primary_series(spark, sf_dir)
    report = materialize(scores.total_errors(scores.calc_errors(cv_forecast(prim, actual=True), None)), "report")
    folds = [str(d) for d in reversed(C.cutoff_list(report))]
    report = report.withColumn("cutoff_date", F.col("cutoff_date").cast("string"))
    wide = panel.pivot_mean(report, "model", "cutoff_date", "score", folds)
    return rounded(wide.toDF("model", *[f"c{k}" for k in range(1, len(folds) + 1)]))


@query(
    """select distinct id, cast(Client as bigint) as Client, Warehouse,
              cast(Product as bigint) as Product from prim"""
)
def split_series_id(spark, sf_dir):
    """Series id split back to its numeric keys (RS9)."""
    ids = primary(spark, sf_dir).select("id").distinct()
    return ids.select("id", *panel.split_id())


@query(
    """with p as (select cast(Client as bigint) as Client, Warehouse, cast(Product as bigint) as Product,
                         sum(sales) as total from panel group by 1, 2, 3),
            s as (select cast(Client as bigint) as Client, Warehouse, cast(Product as bigint) as Product,
                         max(sales) as top from spanel group by 1, 2, 3)
       select Client, Warehouse, Product, total, top from p full join s using (Client, Warehouse, Product)"""
    .replace("with p as", "select * from (with p as")
    + ")"
)
def align_frames(spark, sf_dir):
    """Two frames extended to the union of their keys (RS10)."""
    typed = [F.col(k).cast("bigint").alias(k) for k in KEYS]
    a = panels.weekly_panel(spark, sf_dir).groupBy(*typed).agg(F.sum("sales").alias("total"))
    b = panels.sparse_panel(spark, sf_dir).groupBy(*typed).agg(F.max("sales").alias("top"))
    left, right = panel.align_frames(a, b, KEYS)
    return left.join(right, KEYS)


@query(
    """select id, date, cutoff_date, (prediction_ZeroModel + prediction_WindowAverage
         + prediction_HistoricAverage) / 3 as mean_pred from cvfc""",
    "mean_pred",
)
def horizontal_mean(spark, sf_dir):
    """Mean across columns, nulls skipped (RS11)."""
    fc = naive.cross_validate(primary_series(spark, sf_dir))
    cols = [PRED + m for m in ("ZeroModel", "WindowAverage", "HistoricAverage")]
    return rounded(panel.row_mean(fc, cols, "mean_pred").select("id", "date", "cutoff_date", "mean_pred"))


@query(
    """select id, date, sales from prim where id in (
         select id from (select distinct id from prim) order by md5(concat(id, '42')), id limit 25)"""
)
def subsample_series(spark, sf_dir):
    """All rows of n ids drawn without replacement in seeded hash order (RS12)."""
    return panel.subsample(primary(spark, sf_dir), 25, 42).select("id", "date", "sales")


# ---- joins, sort, limit -----------------------------------------------------------------


@query(
    """select f.id, f.date, f.cutoff_date, f.prediction_SeasonalNaive, s.sales
       from cvfc f join prim s on s.id = f.id and s.date = f.date"""
)
def inner_join_sales(spark, sf_dir):
    """Forecasts with actuals by series and week."""
    prim = primary(spark, sf_dir)
    fc = naive.cross_validate(prim).select("id", "date", "cutoff_date", PRED + "SeasonalNaive")
    return scores.with_sales(fc, prim, "inner")


@query(
    """select f.id, f.date, f.prediction_SeasonalNaive, s.sales
       from livefc f left join prim s on s.id = f.id and s.date = f.date"""
)
def left_join_sales(spark, sf_dir):
    """Live forecasts keep their rows although no actuals exist yet."""
    prim = primary(spark, sf_dir)
    live = naive.live_forecast(prim).select("id", "date", PRED + "SeasonalNaive")
    return scores.with_sales(live, prim, "left")


@query(
    """select p.id, p.date, p.sales from prim p where p.date > (select max(date) - 91 from prim)
         and p.id in (select id from train where fold = 7)"""
)
def semi_join_train_ids(spark, sf_dir):
    """Last quarter of the series that already existed in the oldest fold."""
    prim = materialize(primary(spark, sf_dir), "panel")
    ids = C.rolling_origin(prim.select("id", "date"), n_windows=8, step=6).filter(
        (F.col("fold") == 7) & ~F.col("is_test")
    )
    late = prim.filter(F.col("date") > F.date_sub(prim.agg(F.max("date")).scalar(), 91))
    return dashboard.rows_of(late.select("id", "date", "sales"), ids.select("id").distinct())


@query("select id, date, cutoff_date, prediction_SeasonalNaive, prediction_WindowAverage, prediction_MixerWigeSeveEnsemble from mixfc",
       "prediction_WindowAverage prediction_MixerWigeSeveEnsemble")
def multi_join_forecasts(spark, sf_dir):
    """N-way inner join on three keys."""
    fc = cv_forecast(primary_series(spark, sf_dir))
    keys = ["id", "date", "cutoff_date"]
    parts = [fc.select(*keys, c) for c in (PRED + "SeasonalNaive", PRED + "WindowAverage", MIX)]
    return rounded(joins.multi_join(*parts, on=keys))


@query("select id, date, cutoff_date, prediction_SeasonalNaive, prediction_WindowAverage, prediction_MixerWigeSeveEnsemble from mixfc",
       "prediction_WindowAverage prediction_MixerWigeSeveEnsemble")
def join_cv_preds(spark, sf_dir):
    """The same join in one shuffle, behind the equal-length check."""
    # written once: the check and the join read three parts of it
    fc = materialize(cv_forecast(primary_series(spark, sf_dir)), "forecast")
    keys = ["id", "date", "cutoff_date"]
    parts = [fc.select(*keys, c) for c in (PRED + "SeasonalNaive", PRED + "WindowAverage", MIX)]
    return rounded(joins.join_cv_preds(*parts))


@query("select id, date, prediction_SeasonalNaive, prediction_WindowAverage from livefc",
       "prediction_WindowAverage")
def join_live_preds(spark, sf_dir):
    """Live forecasts of two sources joined behind the length check."""
    live = naive.live_forecast(primary_series(spark, sf_dir))
    parts = [live.select("id", "date", PRED + m) for m in ("SeasonalNaive", "WindowAverage")]
    return rounded(joins.join_live_preds(*parts))


@query(
    """select fold, id, count(*) as n, sum(sales) as sales from train group by 1, 2"""
)
def stack_folds(spark, sf_dir):
    """Folds cut separately and stacked; the branches share one written table of series."""
    series = materialize(primary_series(spark, sf_dir).select("id", "dates", "y"), "series")
    rows = C.rolling_origin_series(series, n_windows=8, step=6).filter(~F.col("is_test"))
    stacked = reduce(DataFrame.unionByName, [rows.filter(F.col("fold") == f) for f in range(8)])
    return stacked.groupBy("fold", "id").agg(F.count("*").alias("n"), F.sum("sales").alias("sales"))


@query("select distinct cutoff_date from cvfc")
def distinct_cutoffs(spark, sf_dir):
    """Distinct fold keys, sorted."""
    fc = naive.cross_validate(primary_series(spark, sf_dir))
    return fc.select("cutoff_date").distinct().orderBy("cutoff_date")


@query("select model, cutoff_date, bias, mae, score from toterr", "bias mae score")
def sorted_report(spark, sf_dir):
    """Report ordered by model and fold at the sink."""
    prim = primary_series(spark, sf_dir)
    report = scores.total_errors(scores.calc_errors(cv_forecast(prim, actual=True), None))
    return rounded(report).orderBy("model", "cutoff_date")


@query("select id, avg(sales) as scale from prim group by 1 order by 2 desc, 1 limit 10", "scale")
def top_series(spark, sf_dir):
    """Largest series by mean sales."""
    return rounded(dashboard.top_series(primary(spark, sf_dir), 10))


# ---- submission -------------------------------------------------------------------------


@query(
    f"""select * from (pivot (select cast(split_part(id, '-', 1) as bigint) as Client,
           cast(split_part(id, '-', 2) as bigint) as Warehouse,
           cast(split_part(id, '-', 3) as bigint) as Product,
           cast(date as varchar) as date, prediction_SeasonalNaive as pred from livefc)
         on date in ({weeks("2001-11-05", 13)}) using first(pred) group by Client, Warehouse, Product)"""
)
def format_submission(spark, sf_dir):
    """One model's live forecast in the wide submission layout, checked."""
    cube = materialize(panels.weekly_panel(spark, sf_dir), "panel")
    live = naive.live_forecast(panel.remove_leading_zeros(cube))
    preds = live.select("id", "date", F.col(PRED + "SeasonalNaive").alias("pred"))
    return submission.format_submission(preds, cube.select(*KEYS).distinct())


@query(
    """select lower(replace(name, 'prediction_', '')) as model,
              cast(split_part(id, '-', 1) as bigint) as Client,
              cast(split_part(id, '-', 2) as bigint) as Warehouse,
              cast(split_part(id, '-', 3) as bigint) as Product, sum(value) as total from (
         unpivot livefc on prediction_ZeroModel, prediction_WindowAverage, prediction_SeasonalNaive,
         prediction_HistoricAverage into name name value value) group by 1, 2, 3, 4""",
    "total",
    3,
)
def submission_per_model(spark, sf_dir):
    """One frame per model, stacked with a row total."""
    cube = materialize(panels.weekly_panel(spark, sf_dir), "panel")
    live = naive.live_forecast(panel.remove_leading_zeros(cube))
    frames = submission.make_submissions(live, cube.select(*KEYS).distinct())
    out = None
    for name, frame in frames.items():
        days = [c for c in frame.columns if c not in KEYS]
        total = sum((F.col(f"`{d}`") for d in days[1:]), F.col(f"`{days[0]}`"))
        part = frame.select(F.lit(name).alias("model"), *KEYS, total.alias("total"))
        out = part if out is None else out.unionByName(part)
    return rounded(out, 3)
