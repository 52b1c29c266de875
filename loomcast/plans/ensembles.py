"""Ensembles: rules, mixes, overrides, optimised weights, stacking, gating."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomcast.config import DEFAULT_CV, PRED
from loomcast.operators import batches, classes, dashboard, features, gating, gram, joins, naive
from loomcast.operators import panel as P
from loomcast.operators import rules, scores, stacking, weights
from loomcast.operators.cv import cutoff_list
from loomcast.operators.smoothing import STAT_KERNELS
from loomcast.plans.base import MIX, cv_forecast, primary, primary_series, rounded, thin_series, with_mix
from loomcast.plans.registry import query
from loomcast.plans.sqltext import register
from loomcast.sources import panels
from loomcast.sources.lineage import materialize

# Class rules over the models of these queries; `small_sales` stays unmapped on purpose.
_RULE = {
    "all_zero": "ZeroModel",
    "trailing_zero": "ZeroModel",
    "regular": "WindowAverage",
    "sparse": "HistoricAverage",
    "seasonal": "SeasonalNaive",
}
_PICK = "case " + " ".join(f"when {{c}} = '{k}' then prediction_{m}" for k, m in _RULE.items()) + " end"


@query(
    f"""select f.id, f.date, f.cutoff_date, {_PICK.format(c='class')} as prediction_ClassificationEnsemble
        from cvfc f join clsf c on c.id = f.id and c.cutoff_date = f.cutoff_date""",
    "prediction_ClassificationEnsemble",
)
def class_rule_folds(spark, sf_dir):
    """Model chosen by demand class, per fold."""
    prim = materialize(primary_series(spark, sf_dir), "panel")
    cls = classes.classify_panel(prim)
    return rounded(rules.class_ensemble(naive.cross_validate(prim), cls, _RULE))


register(
    slstat="""
  select p.id, max(mx) as mx, count(*) as n, avg(sales) as ha,
         avg(case when date > mx - 91 then sales end) as wa
  from sprim p join (select id, max(date) as mx from sprim group by 1) b on b.id = p.id group by 1""",
    slive="""
  select s.id, cast(s.mx + 7 * h as date) as date, 0.0::double as prediction_ZeroModel,
         case when n >= 13 then wa else 0 end as prediction_WindowAverage,
         case when n >= 52 then y.sales else 0 end as prediction_SeasonalNaive,
         ha as prediction_HistoricAverage
  from slstat s cross join (select cast(unnest(range(1, 14)) as integer) as h)
  left join sprim y on y.id = s.id and y.date = s.mx + 7 * h - 364""",
)


@query(
    f"""select f.id, f.date, {_PICK.format(c='class')} as prediction_ClassificationEnsemble
        from slive f join clsl c on c.id = f.id""",
    "prediction_ClassificationEnsemble",
)
def class_rule_live(spark, sf_dir):
    """Model chosen by demand class on all data of thin series."""
    prim = materialize(thin_series(spark, sf_dir), "panel")
    cls = classes.classify_panel(prim, live=True)
    return rounded(rules.class_ensemble(naive.live_forecast(prim), cls, _RULE))


@query(
    """select id, date, cutoff_date, prediction_MixerWigeSeveEnsemble,
         (prediction_ZeroModel + prediction_HistoricAverage) / 2 as prediction_MixerZeelHigeEnsemble
       from mixfc""",
    "prediction_MixerWigeSeveEnsemble prediction_MixerZeelHigeEnsemble",
    9,
)
def mixer_folds(spark, sf_dir):
    """Means of listed models, named after them."""
    fc = naive.cross_validate(primary_series(spark, sf_dir))
    mixes = [["WindowAverage", "SeasonalNaive"], ["ZeroModel", "HistoricAverage"]]
    return rounded(rules.mixer_ensemble(fc, mixes), 9)


def _id_models(spark, prim):
    """Override table: the largest series take the seasonal model (a list given by hand in practice)."""
    top = dashboard.top_series(prim, 20).select("id")
    return top.withColumn("model", F.lit("SeasonalNaive"))


register(
    idmodel="""select id, 'SeasonalNaive' as model from (
      select id from prim group by 1 order by avg(sales) desc, id limit 20)""",
    sidmodel="""select id, 'SeasonalNaive' as model from (
      select id from sprim group by 1 order by avg(sales) desc, id limit 20)""",
)


@query(
    """select f.id, f.date, f.cutoff_date,
         case when i.model is not null then prediction_SeasonalNaive
              when c.class in ('all_zero', 'trailing_zero') then prediction_ZeroModel
              when c.class = 'seasonal' then prediction_SeasonalNaive
              else prediction_MixerWigeSeveEnsemble end as prediction_DivineMixerWigeSeveEnsemble
       from mixfc f join clsf c on c.id = f.id and c.cutoff_date = f.cutoff_date
       left join idmodel i on i.id = f.id""",
    "prediction_DivineMixerWigeSeveEnsemble",
)
def override_folds(spark, sf_dir):
    """Base ensemble overridden by class and by single series, per fold."""
    prim = materialize(primary_series(spark, sf_dir), "panel")
    fc = materialize(cv_forecast(prim), "forecast")
    cls = classes.classify_panel(prim)
    single = fc.drop(MIX)
    return rounded(
        rules.divine_ensemble(
            cls, single, fc.select("id", "date", "cutoff_date", MIX),
            id_models=_id_models(spark, prim), candidates=["MixerWigeSeveEnsemble"],
        )
    )


@query(
    """select f.id, f.date,
         case when i.model is not null then prediction_SeasonalNaive
              when c.class in ('all_zero', 'trailing_zero') then prediction_ZeroModel
              when c.class = 'seasonal' then prediction_SeasonalNaive
              else prediction_HistoricAverage end as prediction_DivineHistoricAverage
       from slive f join clsl c on c.id = f.id left join sidmodel i on i.id = f.id""",
    "prediction_DivineHistoricAverage",
)
def override_live(spark, sf_dir):
    """The same on all data of thin series."""
    prim = materialize(thin_series(spark, sf_dir), "panel")
    live = materialize(naive.live_forecast(prim), "forecast")
    cls = classes.classify_panel(prim, live=True)
    base = live.select("id", "date", PRED + "HistoricAverage")
    rest = live.drop(PRED + "HistoricAverage")
    return rounded(
        rules.divine_ensemble(
            cls, rest, base, id_models=_id_models(spark, prim), candidates=["HistoricAverage"]
        )
    )


register(
    invw="""
  select id, model, 1 / (1 + a) / sum(1 / (1 + a)) over (partition by id) as weight from (
    select id, model, avg(abs(error)) as a from errors group by 1, 2)"""
)


@query(
    """select id, date, cutoff_date, sum(prediction * weight) as prediction_WeightedEnsemble
       from fclong join invw using (id, model) group by 1, 2, 3""",
    "prediction_WeightedEnsemble",
)
def weighted_sum(spark, sf_dir):
    """Forecasts times per-series weights, summed over models."""
    fc = materialize(cv_forecast(primary_series(spark, sf_dir), actual=True), "forecast")
    err = scores.calc_errors(fc, None).groupBy("id", "model").agg(F.avg(F.abs("error")).alias("a"))
    inv = 1 / (1 + F.col("a"))
    total = F.sum(inv).over(P.W.partitionBy("id"))
    w = err.select("id", "model", (inv / total).alias("weight"))
    long = P.forecast_to_long(fc)
    return rounded(rules.weighted_ensemble_long(long, w, "WeightedEnsemble"))


@query(
    """select model from totscore where model not in ('WindowAverage', 'ZeroModel', 'CrostonOptimized')"""
)
def select_ensemble_models(spark, sf_dir):
    """Models by total score without the censored ones."""
    prim = primary_series(spark, sf_dir)
    names = rules.select_models(scores.calc_cv_scores(cv_forecast(prim, actual=True), None)[2])
    return spark.createDataFrame([(n,) for n in names], "model string")


register(
    kern="""select f.*, s.sales from cvfc f join prim s on s.id = f.id and s.date = f.date"""
)


_Z = ["prediction_WindowAverage", "prediction_SeasonalNaive", "prediction_HistoricAverage", "sales", "1.0::double"]


@query(
    "select * from ("
    + " union all ".join(
        f"select cutoff_date, cast({i} as integer) as i, cast({j} as integer) as j, sum({a} * {b}) as v "
        f"from kern group by 1"
        for i, a in enumerate(_Z)
        for j, b in enumerate(_Z)
    )
    + ")",
    "v",
    3,
)
def gram_sums(spark, sf_dir):
    """Second moments of forecasts and sales per fold, the base of all fits."""
    prim = primary(spark, sf_dir)
    models = ["WindowAverage", "SeasonalNaive", "HistoricAverage"]
    kernel = materialize(gram.make_kernel(naive.cross_validate(prim), prim, models), "kernel")
    folds = cutoff_list(kernel)
    g = gram.gram_by_fold(kernel, models, folds)
    rows = [
        (f, i, j, float(g[k, i, j]))
        for k, f in enumerate(folds)
        for i in range(g.shape[1])
        for j in range(g.shape[2])
    ]
    return rounded(spark.createDataFrame(rows, "cutoff_date date, i int, j int, v double"), 3)


def _candidates(spark, sf_dir, live: bool = False):
    """The series, the sales of their fold weeks, baselines plus fitted models, wide, written once; and their total scores."""
    prim = materialize(primary_series(spark, sf_dir), "series")
    sales = panels.rows(prim, last=(DEFAULT_CV.n_windows - 1) * DEFAULT_CV.step + DEFAULT_CV.h)
    # each input is written once; the check of their lengths reads row counts only
    base = materialize(naive.cross_validate(prim), "baselines")
    stat = materialize(batches.kernel_forecast(prim, STAT_KERNELS).drop("fold"), "fitted")
    fc = materialize(joins.join_cv_preds(base, stat), "forecast")
    total = materialize(scores.calc_cv_scores(fc, sales)[2], "scores")
    if not live:
        return prim, sales, fc, total
    lb = materialize(naive.live_forecast(prim), "baselines")
    ls = batches.kernel_forecast(prim, STAT_KERNELS, folds=False, live=True).drop("fold", "cutoff_date")
    return prim, sales, fc, total, materialize(joins.join_live_preds(lb, materialize(ls, "fitted")), "live")


@query()
def optimized_weights_folds(spark, sf_dir):
    """Weights fitted on the other folds, all folds solved together."""
    _, sales, fc, total = _candidates(spark, sf_dir)
    return weights.cross_validate(fc, sales, total)


@query()
def optimized_weights_live(spark, sf_dir):
    """Weights fitted on all folds, applied to the live forecast."""
    _, sales, fc, total, live = _candidates(spark, sf_dir, live=True)
    return weights.live_forecast(fc, sales, live, total)


@query()
def stacking_folds(spark, sf_dir):
    """Three lasso-path stackings, leave-one-fold-out."""
    _, sales, fc, total = _candidates(spark, sf_dir)
    return stacking.cross_validate(fc, sales, total)


@query()
def stacking_live(spark, sf_dir):
    """The same fitted on all folds."""
    _, sales, fc, total, live = _candidates(spark, sf_dir, live=True)
    return stacking.live_forecast(fc, sales, live, total)


@query()
def gating_folds(spark, sf_dir):
    """Feature-based gating, leave-one-fold-out."""
    prim, sales, fc, total = _candidates(spark, sf_dir)
    feats = features.calculate_cv_tsfeatures(prim)
    return gating.cross_validate(fc, feats, scores.clipped_scores(fc, sales), total)


@query()
def gating_live(spark, sf_dir):
    """Gate trained on all folds, applied to the live features."""
    prim, sales, fc, total, live = _candidates(spark, sf_dir, live=True)
    feats = features.calculate_cv_tsfeatures(prim)
    now = features.calculate_live_tsfeatures(prim)
    return gating.live_forecast(feats, scores.clipped_scores(fc, sales), live, now, total)


@query()
def full_leaderboard(spark, sf_dir):
    """Single models and ensembles joined, scored and ranked: the whole evaluation."""
    prim, sales, fc, total = _candidates(spark, sf_dir)
    ow = materialize(weights.cross_validate(fc, sales, total), "ow")
    st = materialize(stacking.cross_validate(fc, sales, total), "st")
    feats = features.calculate_cv_tsfeatures(prim)
    gate = materialize(gating.cross_validate(fc, feats, scores.clipped_scores(fc, sales), total), "gate")
    cls = materialize(classes.classify_panel(prim), "classes")
    rule = rules.class_ensemble(fc, cls, {**rules.CLASS_MODELS, "regular": "AutoETS", "small_sales": "AutoETS"})
    divine = rules.divine_ensemble(cls, fc, ow)
    parts = [materialize(p, "part") for p in (rule, divine)]
    everything = joins.join_cv_preds(with_mix(fc), ow, st, gate, *parts)
    return dashboard.leaderboard(scores.calc_cv_scores(everything, sales)[2])
