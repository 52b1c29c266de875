"""Cross-validation splits, baselines, scores and error reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomcast.config import PRED
from loomcast.functions import expr
from loomcast.operators import cv as C
from loomcast.operators import dashboard, naive, scale, scores
from loomcast.plans.base import cv_forecast, primary, primary_series, rounded, thin_series, weeks
from loomcast.plans.registry import query
from loomcast.plans.sqltext import register
from loomcast.sources.lineage import materialize

# ---- splits ---------------------------------------------------------------------------


@query(
    """select fold, id, cast(count(*) filter (date <= train_end) as bigint) as n_train,
         cast(count(*) filter (date > train_end) as bigint) as n_test,
         sum(sales) filter (date <= train_end) as train_sales,
         sum(sales) filter (date > train_end) as test_sales
       from prim join fold using (id) where date <= test_end group by 1, 2"""
)
def rolling_origin_split(spark, sf_dir):
    """Eight rolling-origin folds in one pass (CV1)."""
    rows = C.rolling_origin(primary(spark, sf_dir), h=13, n_windows=8, step=6)
    test = F.col("is_test")
    return rows.groupBy("fold", "id").agg(
        F.sum((~test).cast("int")).alias("n_train"),
        F.sum(test.cast("int")).alias("n_test"),
        F.sum(F.when(~test, F.col("sales"))).alias("train_sales"),
        F.sum(F.when(test, F.col("sales"))).alias("test_sales"),
    )


@query(
    """select id, date, f as fold, date > mx - 7 * (f * 13 + 13) as is_test, sales
       from sprim join (select id, max(date) as mx, min(date) as mn from sprim group by 1) using (id),
            (select cast(unnest(range(0, 3)) as integer) as f)
       where date <= mx - 7 * f * 13 and mn <= mx - 7 * (f * 13 + 13)"""
)
def rolling_origin_rows(spark, sf_dir):
    """Fold rows with the default step (= horizon) on thin series (CV1)."""
    rows = C.rolling_origin_series(thin_series(spark, sf_dir))
    return rows.select("id", "date", "fold", "is_test", "sales")


@query(
    """select id, fold, cast(count(*) as bigint) as n_train from train group by 1, 2
       having count(*) >= 280"""
)
def min_train_size(spark, sf_dir):
    """Folds of series with at least 280 train weeks (CV2)."""
    prim = primary(spark, sf_dir).select("id", "date")
    rows = C.rolling_origin(prim, n_windows=8, step=6, min_train_size=280)
    train = rows.filter(~F.col("is_test"))
    return train.groupBy("id", "fold").agg(F.count("*").alias("n_train"))


@query(
    """select c.cutoff_date as held_out, f.cutoff_date = c.cutoff_date as is_val,
              cast(count(*) as bigint) as n, sum(prediction_SeasonalNaive) as total
       from cvfc f cross join (select distinct cutoff_date from cvfc) c group by 1, 2"""
)
def leave_one_cutoff_out(spark, sf_dir):
    """Train (all other folds) and validation rows per held-out fold (CV3)."""
    fc = naive.cross_validate(primary_series(spark, sf_dir))
    loo = C.leave_one_out(fc, C.cutoff_list(fc))
    return loo.groupBy("held_out", "is_val").agg(
        F.count("*").alias("n"), F.sum(PRED + "SeasonalNaive").alias("total")
    )


@query("select id, date, fold, cutoff_date from prim join fold using (id) where date > train_end and date <= test_end")
def stamp_cutoff(spark, sf_dir):
    """Fold key from the first forecast week (CV4)."""
    rows = C.rolling_origin(primary(spark, sf_dir).select("id", "date"), n_windows=8, step=6)
    return C.stamp_cutoff(rows.filter("is_test").select("id", "date", "fold"))


@query(
    """select id, h as horizon, cast(mx + 7 * h as date) as date from bounds
       cross join (select cast(unnest(range(1, 14)) as integer) as h)"""
)
def future_grid(spark, sf_dir):
    """Thirteen weeks after each series' last one (CV5)."""
    return C.future_grid(primary(spark, sf_dir).select("id", "date"))


# ---- baselines ---------------------------------------------------------------------------


def _one_model(model: str):
    def run(spark, sf_dir):
        fc = naive.cross_validate(primary_series(spark, sf_dir))
        return rounded(fc.select("id", "date", "cutoff_date", PRED + model))

    return run


for _name, _model in {
    "zero_model": "ZeroModel",
    "window_average": "WindowAverage",
    "seasonal_naive": "SeasonalNaive",
    "historic_average": "HistoricAverage",
}.items():
    _fn = _one_model(_model)
    _fn.__name__ = _name
    _fn.__doc__ = f"`{_model}` over eight folds (S1-S4)."
    query(f"select id, date, cutoff_date, prediction_{_model} from cvfc", f"prediction_{_model}")(_fn)


@query("select * from livefc", "prediction_WindowAverage prediction_HistoricAverage")
def live_baselines(spark, sf_dir):
    """The same job on all data."""
    return rounded(naive.live_forecast(primary_series(spark, sf_dir)))


# ---- metrics -------------------------------------------------------------------------------

_PARTS = {
    "normalised_mae": ("mae", expr.mae, "sum(abs(error)) / sum(abs(sales))"),
    "normalised_bias": ("bias", expr.bias, "abs(sum(error)) / sum(abs(sales))"),
    "competition_score": (
        "score",
        expr.competition_score,
        "(abs(sum(error)) + sum(abs(error))) / sum(abs(sales))",
    ),
}


def _metric(alias, fn):
    def run(spark, sf_dir):
        prim = primary_series(spark, sf_dir)
        errors = scores.calc_errors(cv_forecast(prim, actual=True), None)
        return rounded(
            errors.groupBy("model", "cutoff_date").agg(fn("prediction", "sales").alias(alias))
        )

    return run


for _name, (_alias, _f, _text) in _PARTS.items():
    _fn = _metric(_alias, _f)
    _fn.__name__ = _name
    _fn.__doc__ = f"{_alias} per model and fold (M1-M3)."
    query(f"select model, cutoff_date, {_text} as {_alias} from errors group by 1, 2", _alias)(_fn)

register(
    sfc="""
  select s.id, s.cutoff_date, p.date, p.sales, case when s.n >= 52 then y.sales else 0 end as pred from (
      select id, cast(mx - 7 * (f * 6 + 12) as date) as cutoff_date, (mx - mn) // 7 + 1 - (f * 6 + 13) as n from
        (select id, max(date) as mx, min(date) as mn from sprim group by 1),
        (select cast(unnest(range(0, 8)) as integer) as f)) s
    join sprim p on s.n > 0 and p.id = s.id and p.date >= s.cutoff_date and p.date < s.cutoff_date + 91
    left join sprim y on y.id = s.id and y.date = p.date - 364""",
)


def _thin_forecast(spark, sf_dir):
    """Forecasts beside the sales of their weeks, from one row per series: no join."""
    return naive.cross_validate(thin_series(spark, sf_dir), actual=True)


@query(
    """select id, cutoff_date, case when b = 0 then 0.0 else a / b end as loss from (
         select id, cutoff_date, abs(sum(pred - sales)) + sum(abs(pred - sales)) as a, sum(abs(sales)) as b
         from sfc group by 1, 2)""",
    "loss",
)
def competition_loss(spark, sf_dir):
    """Score as a loss: series without sales count as 0 (M4)."""
    return rounded(
        _thin_forecast(spark, sf_dir).groupBy("id", "cutoff_date").agg(expr.competition_loss(PRED + "SeasonalNaive", "sales").alias("loss"))
    )


@query("select model, id, cutoff_date, score from scored", "score")
def series_fold_scores(spark, sf_dir):
    """Score per series and fold (M5)."""
    prim = primary_series(spark, sf_dir)
    fine, _, _ = scores.calc_cv_scores(cv_forecast(prim, actual=True), None)
    return rounded(scores.scores_to_long(fine, ["id", "cutoff_date"]))


@query("select * from cutscore", "score")
def fold_scores(spark, sf_dir):
    """Score per fold from the additive sums (M5)."""
    prim = primary_series(spark, sf_dir)
    _, per_cutoff, _ = scores.calc_cv_scores(cv_forecast(prim, actual=True), None)
    return rounded(scores.scores_to_long(per_cutoff, ["cutoff_date"]))


@query("select * from totscore", "score")
def total_scores(spark, sf_dir):
    """Total score per model (M5)."""
    prim = primary_series(spark, sf_dir)
    return rounded(scores.calc_cv_scores(cv_forecast(prim, actual=True), None)[2])


@query(
    """select id, cutoff_date, case when b = 0 and a = 0 then 'nan'::double
                  when b = 0 then 1.0 else least(a / b, 1) end as score from (
         select id, cutoff_date, abs(sum(pred - sales)) + sum(abs(pred - sales)) as a, sum(abs(sales)) as b
         from sfc group by 1, 2)""",
    "score",
)
def clipped_series_scores(spark, sf_dir):
    """Scores clipped to the unit interval; NaN survives (M6)."""
    fc = _thin_forecast(spark, sf_dir).select("id", "date", "cutoff_date", PRED + "SeasonalNaive", "sales")
    clipped = scores.clipped_scores(fc, None)
    x = F.col(PRED + "SeasonalNaive")
    return clipped.select("id", "cutoff_date", F.when(F.isnan(x), x).otherwise(F.round(x, 6)).alias("score"))


@query("select * from errors", "prediction error")
def error_fact(spark, sf_dir):
    """Forecast errors, long (M7)."""
    prim = primary_series(spark, sf_dir)
    return rounded(scores.calc_errors(cv_forecast(prim, actual=True), None))


@query("select * from toterr", "bias mae score")
def total_error_report(spark, sf_dir):
    """Errors per model and fold (M8)."""
    prim = primary_series(spark, sf_dir)
    return rounded(scores.total_errors(scores.calc_errors(cv_forecast(prim, actual=True), None)))


@query("select * from horerr", "bias mae score")
def horizon_error_report(spark, sf_dir):
    """Errors per horizon and model (M9)."""
    prim = primary_series(spark, sf_dir)
    return rounded(scores.horizon_errors(scores.calc_errors(cv_forecast(prim, actual=True), None)))


@query(
    """select id, model, score from (
         select id, model, round(avg(score), 9) as score,
                min(round(avg(score), 9)) over (partition by id) as best
         from scored group by 1, 2) where score = best""",
    "score",
)
def winner_models(spark, sf_dir):
    """Best model(s) of each series; ties are all kept."""
    prim = primary_series(spark, sf_dir)
    fine, _, _ = scores.calc_cv_scores(cv_forecast(prim, actual=True), None)
    # Rounded before comparing, so that both engines see the same ties.
    cols = expr.cols_with_prefix(fine)
    means = fine.groupBy("id").agg(*[F.round(F.avg(c), 9).alias(c) for c in cols])
    return rounded(scores.winner_rows(means))


@query("select id, sales_scale, weight from binned", "sales_scale weight", 9)
def sales_scale(spark, sf_dir):
    """Mean absolute sales per series and its share of the total."""
    return rounded(scale.scale_categories(primary(spark, sf_dir)).drop("bin"), 9)


@query("select id, bin from binned")
def scale_bins(spark, sf_dir):
    """Twenty quantile bins of the sales scale with interval labels."""
    return scale.scale_categories(primary(spark, sf_dir)).select("id", "bin")


@query("select id, sales_scale, bin, weight from binned where sales_scale > 12", "sales_scale weight", 9)
def vip_series(spark, sf_dir):
    """Series above a scale threshold."""
    return rounded(scale.vip_series(scale.scale_categories(primary(spark, sf_dir)), 12), 9)


# ---- dashboard ----------------------------------------------------------------------------


def _errors(spark, sf_dir):
    prim = primary_series(spark, sf_dir)
    return scores.calc_errors(cv_forecast(prim, actual=True), None)


def _cv_scores(spark, sf_dir):
    prim = primary_series(spark, sf_dir)
    return scores.calc_cv_scores(cv_forecast(prim, actual=True), None)[1]


register(
    filled="""
  select *, last_value(price ignore nulls) over
    (partition by id order by date rows between unbounded preceding and current row) as ff from prim"""
)


@query(
    """select date, Client, sum(sales) as sales, avg(ff) as price, cast(Client as varchar) as id
       from filled group by date, Client""",
    "price",
)
def sales_rollup(spark, sf_dir):
    """Sales and mean forward-filled price over two dropped keys (Q1)."""
    return rounded(dashboard.sales_rollup(primary(spark, sf_dir), ["Warehouse", "Product"]))


@query("select date, sum(sales) as sales, avg(ff) as price, 'All' as id from filled group by date", "price")
def sales_rollup_all(spark, sf_dir):
    """All keys dropped (Q1)."""
    return rounded(dashboard.sales_rollup(primary(spark, sf_dir), ["Client", "Warehouse", "Product"]))


@query(
    """select Client, Warehouse, Product, date,
         cast(grouping_id(Client, Warehouse, Product) as integer) as level,
         sum(sales) as sales, avg(ff) + 1e-9 as price from filled
       group by grouping sets ((Client, Warehouse, Product, date), (Client, Warehouse, date),
         (Client, Product, date), (Warehouse, Product, date), (Client, date), (Warehouse, date),
         (Product, date), (date))""",
    "price",
)
def sales_cube(spark, sf_dir):
    """All eight rollups in one aggregate (Q1)."""
    cube = dashboard.sales_cube(primary(spark, sf_dir))
    # some means end in a 5 at the seventh digit; a nudge on both sides keeps rounding alike
    return rounded(cube.withColumn("price", F.col("price") + 1e-9))


@query("select id, date, sales from prim where Client = 15 and Product = 65")
def filter_by_keys(spark, sf_dir):
    """Rows of chosen key values (Q2)."""
    hits = dashboard.filter_keys(primary(spark, sf_dir), Client=15, Warehouse=None, Product=65)
    return hits.select("id", "date", "sales")


@query(
    """select id, date, sales from prim where id in (
         select id from prim group by 1 order by avg(sales) desc, id limit 10)"""
)
def top_series_rows(spark, sf_dir):
    """All rows of the largest series (Q3)."""
    prim = primary(spark, sf_dir).select("id", "date", "sales")
    return dashboard.rows_of(prim, dashboard.top_series(prim, 10))


@query("select model, score, cast(row_number() over (order by score, model) as integer) as rank from totscore where contains(model, 'Ensemble')", "score")
def ensemble_models(spark, sf_dir):
    """Leaderboard of the ensembles only (Q5)."""
    prim = primary_series(spark, sf_dir)
    total = scores.calc_cv_scores(cv_forecast(prim, actual=True), None)[2]
    return rounded(dashboard.leaderboard(dashboard.filter_models(total, "Ensemble")))


@query(
    """select model, score, cast(row_number() over (order by score, model) as integer) as rank
       from (select model, round(score, 6) + 0.0 as score from totscore)"""
)
def leaderboard(spark, sf_dir):
    """Models ranked by total score."""
    prim = primary_series(spark, sf_dir)
    return dashboard.leaderboard(rounded(scores.calc_cv_scores(cv_forecast(prim, actual=True), None)[2]))


@query("select cast(cutoff_date as varchar) as cutoff_date, model, score from cutscore", "score")
def cutoff_scores(spark, sf_dir):
    """Scores of all folds, long (Q9)."""
    return rounded(dashboard.cutoff_scores_long(_cv_scores(spark, sf_dir)))


@query(
    """select model, score, cast(row_number() over (order by score, model) as integer) as rank
       from (select model, avg(score) as score from cutscore group by 1)""",
    "score",
)
def cutoff_score_order(spark, sf_dir):
    """Models ordered by mean fold score (Q9)."""
    return rounded(dashboard.cutoff_score_order(_cv_scores(spark, sf_dir)))


@query(
    """select cutoff_date, model, score,
         cast(row_number() over (partition by cutoff_date order by score, model) as integer) as rank
       from cutscore""",
    "score",
)
def cutoff_ranks(spark, sf_dir):
    """Rank of each model within each fold."""
    return rounded(dashboard.cutoff_ranks(_cv_scores(spark, sf_dir)))


@query(
    """select model, avg(rank) as mean_rank from (
         select model, row_number() over (partition by cutoff_date order by score, model) as rank
         from cutscore) group by 1""",
    "mean_rank",
)
def mean_rank(spark, sf_dir):
    """Mean rank over folds (Q10)."""
    return rounded(dashboard.mean_rank(_cv_scores(spark, sf_dir)))


@query(
    """select model, cast(count(*) as bigint) as len from (
         select id, model, round(avg(score), 9) as score,
                min(round(avg(score), 9)) over (partition by id) as best
         from scored group by 1, 2) where score = best group by 1"""
)
def wins_per_model(spark, sf_dir):
    """Number of series each model wins."""
    return dashboard.share(winner_models(spark, sf_dir), "model")


@query(
    """select model, metric, avg(value) as value from (
         unpivot toterr on mae, bias, score into name metric value value) group by 1, 2""",
    "value",
)
def score_composition(spark, sf_dir):
    """Mean of each error metric per model, long (Q12)."""
    return rounded(dashboard.score_composition(scores.total_errors(_errors(spark, sf_dir))))


@query("select * from horerr where model = 'SeasonalNaive'", "bias mae score")
def horizon_profile(spark, sf_dir):
    """Errors by horizon of one model (Q13)."""
    return rounded(
        dashboard.horizon_profile(scores.horizon_errors(_errors(spark, sf_dir)), "SeasonalNaive")
    )


@query(
    """select bin, model, (abs(sum(error)) + sum(abs(error))) / sum(abs(sales)) as score
       from errors join binned using (id) group by 1, 2""",
    "score",
)
def score_by_scale(spark, sf_dir):
    """Score per sales-scale bin and model (Q14)."""
    prim = primary(spark, sf_dir)
    fc = cv_forecast(prim)
    return rounded(dashboard.score_by_scale(fc, prim, scale.scale_categories(prim)))


@query(
    f"""select * from (pivot (select model, cast(cutoff_date as varchar) as cutoff_date,
         round(score, 6) + 0.0 as score from scored where id = '15-0-65')
       on cutoff_date in ({weeks("2000-10-16", 8, 6)}) using first(score) group by model)"""
)
def series_score_table(spark, sf_dir):
    """One series: score by model and fold (Q15)."""
    prim = primary(spark, sf_dir)
    fc = cv_forecast(prim)
    cutoffs = [str(c) for c in C.cutoff_list(fc)]
    return rounded(dashboard.series_scores(fc, prim, "15-0-65", cutoffs))


@query(
    """select 'actual' as kind, date, null::date as cutoff_date, 'sales' as model, sales as value
         from prim where id = '15-0-65'
       union all select 'cv', date, cutoff_date, model, prediction from fclong where id = '15-0-65'
       union all select 'live', date, null::date, replace(name, 'prediction_', ''), value from (
         unpivot livefc on prediction_ZeroModel, prediction_WindowAverage, prediction_SeasonalNaive,
         prediction_HistoricAverage into name name value value) where id = '15-0-65'""",
    "value",
)
def series_lines(spark, sf_dir):
    """One series: actuals, fold and live forecasts (Q16)."""
    prim = primary(spark, sf_dir)
    return rounded(
        dashboard.series_lines(prim, cv_forecast(prim), naive.live_forecast(prim), "15-0-65")
    )


@query(
    """select id, sum(abs(error)) as error from errors where model = 'SeasonalNaive'
         group by 1 order by 2 desc, 1 limit 50"""
)
def worst_series(spark, sf_dir):
    """Series with the largest absolute error of one model over all folds (Q17)."""
    return dashboard.worst_series(_errors(spark, sf_dir), "SeasonalNaive", 50)


@query("select id from scale where sales_scale > 12")
def vip_ids(spark, sf_dir):
    """Ids of the important series (Q18)."""
    prim = primary(spark, sf_dir)
    return dashboard.vip_ids(prim, scale.vip_series(scale.scale_categories(prim), 12))


def flagship(spark, sf_dir):
    """Eight-fold baselines, scored and ranked."""
    prim = primary_series(spark, sf_dir)
    return dashboard.leaderboard(scores.calc_cv_scores(cv_forecast(prim, actual=True), None)[2])
