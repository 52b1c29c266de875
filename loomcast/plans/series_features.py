"""Window functions, calendar features, per-series features and classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomcast.config import KEYS, TSF
from loomcast.functions import dates as D
from loomcast.functions import windows as Wf
from loomcast.functions.expr import float_div
from loomcast.operators import classes, dashboard, features, prefix, scores
from loomcast.operators.cv import DEFAULT_CV, fold_series
from loomcast.plans.base import cv_forecast, primary, primary_series, rounded, thin, thin_series
from loomcast.plans.registry import query
from loomcast.plans.sqltext import register
from loomcast.sources.lineage import materialize

# ---- windows -----------------------------------------------------------------------------

# A series by all its key columns: the trimmed panel is already hashed on the keys, so
# windows over these columns need no further shuffle.
BY = [*KEYS, "id"]

# Lag sets of the two lag-feature models.
RECURSIVE_LAGS = [1, 2, 3, 6, 13, 26, 52]
DIRECT_LAGS = list(range(4, 53, 4))


@query(
    """select id, date, max(date) over (partition by id) as last_date,
         min(date) over (partition by id) as first_date,
         cast(count(*) over (partition by id) as bigint) as n from prim"""
)
def partition_stats(spark, sf_dir):
    """Series maximum, minimum and length on every row."""
    w = Wf.W.partitionBy(*BY)
    return primary(spark, sf_dir).select(
        "id", "date", F.max("date").over(w).alias("last_date"),
        F.min("date").over(w).alias("first_date"), F.count("*").over(w).alias("n"),
    )


@query("select id, date, sum(sales) over (partition by id order by date) as cum_sales from prim")
def running_sum(spark, sf_dir):
    """Running total."""
    return primary(spark, sf_dir).select("id", "date", Wf.running_sum("sales", BY).alias("cum_sales"))


@query(
    "select distinct id, avg(ff) over (partition by id) as price_group from filled", "price_group"
)
def price_group(spark, sf_dir):
    """Series mean of the forward-filled price."""
    return rounded(Wf.price_group(primary(spark, sf_dir), BY).select("id", "price_group").distinct())


@query(
    """select id, date, sales from (select *, row_number() over (partition by id order by date desc) as rn
       from prim) where rn <= 13"""
)
def tail_rows(spark, sf_dir):
    """Last thirteen rows of each series."""
    return Wf.tail_rows(primary(spark, sf_dir).select(*BY, "date", "sales"), 13, BY).drop(*KEYS)


_LAGS = sorted(set(RECURSIVE_LAGS + DIRECT_LAGS))


@query(
    f"""select id, date, {', '.join(f'lag(sales, {k}) over w as lag{k}' for k in _LAGS)}
        from prim window w as (partition by id order by date)"""
)
def lag_features(spark, sf_dir):
    """All lags of both lag models."""
    lags = Wf.lag_columns("sales", _LAGS, BY)
    return primary(spark, sf_dir).select("id", "date", *[c.alias(k) for k, c in lags.items()])


def _frame(stat, w, need, lag, name):
    over = f"(partition by id order by date rows between {w + lag - 1} preceding and {lag} preceding)"
    return f"case when count(sales) over {over} >= {need} then {stat} over {over} end as {name}"


@query(
    "select id, date, "
    + ", ".join(
        [
            _frame("avg(sales)", 13, 3, 1, "rolling_mean13"),
            _frame("avg(sales)", 52, 13, 1, "rolling_mean52"),
            _frame("min(sales)", 52, 13, 1, "rolling_min52"),
            _frame("max(sales)", 52, 13, 1, "rolling_max52"),
            _frame("stddev_samp(sales)", 52, 13, 1, "rolling_std52"),
            _frame("avg(sales)", 52, 1, 52, "rolling_mean52_lag52"),
        ]
    )
    + " from prim",
    "rolling_mean13 rolling_mean52 rolling_std52 rolling_mean52_lag52",
    9,
)
def rolling_features(spark, sf_dir):
    """Rolling mean, min, max and standard deviation of lagged sales."""
    cols = {
        "rolling_mean13": Wf.rolling("mean", "sales", 13, 3, 1, BY),
        "rolling_mean52": Wf.rolling("mean", "sales", 52, 13, 1, BY),
        "rolling_min52": Wf.rolling("min", "sales", 52, 13, 1, BY),
        "rolling_max52": Wf.rolling("max", "sales", 52, 13, 1, BY),
        "rolling_std52": Wf.rolling("std", "sales", 52, 13, 1, BY),
        "rolling_mean52_lag52": Wf.rolling("mean", "sales", 52, 1, 52, BY),
    }
    return rounded(
        primary(spark, sf_dir).select("id", "date", *[c.alias(k) for k, c in cols.items()]), 9
    )


@query(
    "select id, date, "
    + ", ".join(_frame(f"quantile_cont(sales, {q})", 52, 13, 1, f"rolling_q{int(q * 100)}") for q in (0.25, 0.5, 0.75))
    + " from prim"
)
def rolling_quantiles(spark, sf_dir):
    """Rolling quartiles of lagged sales."""
    rows = primary(spark, sf_dir).select(*BY, "date", "sales")
    out = Wf.with_rolling_quantiles(
        rows, "sales", [0.25, 0.5, 0.75], 52, 13, 1, by=BY, prefix="rolling_"
    )
    return out.drop(*KEYS, "sales")


@query(
    """select id, date, case when len(v) > 0 then list_reduce(v, lambda s, x: x * 0.9::double + s * (1 - 0.9::double)) end as ewm from (
         select id, date, list(sales) over (partition by id order by date
           rows between 32 preceding and 1 preceding) as v from prim)"""
)
def ewm_feature(spark, sf_dir):
    """Exponentially weighted mean of lagged sales."""
    return primary(spark, sf_dir).select("id", "date", Wf.ewm_mean("sales", by=BY).alias("ewm"))


_M = "avg(sales) over (partition by id order by date rows between {} preceding and {} preceding)"
_C = "count(sales) over (partition by id order by date rows between {} preceding and {} preceding)"


def _safe(num, den):
    return (
        f"case when {den} is null or {num} is null then null when {den} = 0 then "
        f"(case when {num} = 0 then 'nan'::double when {num} > 0 then 'inf'::double else '-inf'::double end) "
        f"else round({num} / {den}, 6) + 0.0 end"
    )


@query(
    f"""select id, date, {_safe('sales', 'm1')} as trend13, {_safe('m0', 'm13')} as momentum13 from (
         select id, date, sales,
           case when {_C.format(12, 0)} >= 13 then {_M.format(12, 0)} end as m0,
           case when {_C.format(13, 1)} >= 13 then {_M.format(13, 1)} end as m1,
           case when {_C.format(25, 13)} >= 13 then {_M.format(25, 13)} end as m13 from sprim)"""
)
def trend_momentum(spark, sf_dir):
    """Value over the previous rolling mean; mean over the mean a window ago."""
    df = thin(spark, sf_dir).select(
        "id", "date", Wf.trend("sales", 13, BY).alias("trend13"), Wf.momentum("sales", 13, BY).alias("momentum13")
    )
    keep = [
        F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.col(c)).otherwise(F.round(c, 6)).alias(c)
        for c in ("trend13", "momentum13")
    ]
    return df.select("id", "date", *keep)


@query(
    """select id, date, case when rn > 7 then round(share, 6) else 'nan'::double end as zero_share from (
         select id, date, row_number() over (partition by id order by date) as rn,
           sum(case when sales = 0 then 1 else 0 end) over
             (partition by id order by date rows between 6 preceding and current row) / 7.0::double as share
         from prim)"""
)
def rolling_zero_share(spark, sf_dir):
    """Share of zero weeks in a window; the first full window stays NaN."""
    z = Wf.rolling_zero_share("sales", 7, BY)
    return primary(spark, sf_dir).select(
        "id", "date", F.when(F.isnan(z), z).otherwise(F.round(z, 6)).alias("zero_share")
    )


@query(
    """select id, date, case when rn > 7 then round(a, 6) + 0.0 else 'nan'::double end as intercept,
              case when rn > 7 then round(b, 6) + 0.0 else 'nan'::double end as slope from (
         select id, date, rn, regr_slope(sales, rn) over w as b,
           avg(sales) over w - 3 * regr_slope(sales, rn) over w * 7 / 6 as a
         from (select *, cast(row_number() over (partition by id order by date) as double) as rn from prim)
         window w as (partition by id order by date rows between 6 preceding and current row))"""
)
def rolling_lines(spark, sf_dir):
    """Rolling line: the intercept with the narrow divisor, and the true slope."""
    df = primary(spark, sf_dir).select(*BY, "date", "sales")
    df = Wf.rolling_intercept(df, "sales", 7, "intercept", BY)
    df = Wf.rolling_slope(df, "sales", 7, "slope", BY)
    keep = [
        F.when(F.isnan(c), F.col(c)).otherwise(F.round(c, 6)).alias(c) for c in ("intercept", "slope")
    ]
    return df.select("id", "date", *keep)


# ---- calendar ------------------------------------------------------------------------------


@query(
    "select id, date, "
    + ", ".join(
        f"{f}(weekofyear(date) / 52.0::double * {2 * k} * pi()) as fourier_term_{k}{f}"
        for f in ("sin", "cos")
        for k in (1, 2, 4)
    )
    + " from prim",
    " ".join(f"fourier_term_{k}{f}" for f in ("sin", "cos") for k in (1, 2, 4)),
)
def fourier_features(spark, sf_dir):
    """Fourier terms of the ISO week."""
    cols = [c.alias(k) for k, c in D.fourier_columns("date").items()]
    return rounded(primary(spark, sf_dir).select("id", "date", *cols))


def _nth_sql(month, n, dow):
    first = f"make_date(y, {month}, 1)"
    return f"{first} + cast((({dow} - dayofweek({first}) + 7) % 7) + {7 * (n - 1)} as integer)"


_MAY = "make_date(y, 5, 25)"
_RULES = [
    ("New Year''s Day", "make_date(y, 1, 1)", 1),
    ("Martin Luther King Jr. Day", _nth_sql(1, 3, 1), 0),
    ("Washington''s Birthday", _nth_sql(2, 3, 1), 0),
    ("Memorial Day", f"{_MAY} + cast((1 - dayofweek({_MAY}) + 7) % 7 as integer)", 0),
    ("Independence Day", "make_date(y, 7, 4)", 1),
    ("Labor Day", _nth_sql(9, 1, 1), 0),
    ("Columbus Day", _nth_sql(10, 2, 1), 0),
    ("Veterans Day", "make_date(y, 11, 11)", 1),
    ("Thanksgiving", _nth_sql(11, 4, 4), 0),
    ("Christmas Day", "make_date(y, 12, 25)", 1),
]
register(
    hyears="select cast(unnest(range(1995, 2002)) as integer) as y",
    hbase=" union all ".join(
        f"select '{n}' as name, cast({r} as date) as day, {m} as moves from hyears" for n, r, m in _RULES
    ),
    hdays="""select name, day from hbase
      union all select name || ' (observed)', cast(day - 1 as date) from hbase where moves = 1 and dayofweek(day) = 6
      union all select name || ' (observed)', cast(day + 1 as date) from hbase where moves = 1 and dayofweek(day) = 0""",
)


@query(
    """select p.id, p.date, coalesce(h.n, 0) as n_holidays from prim p left join (
         select w.date, cast(count(distinct name) as integer) as n
         from (select distinct date from prim) w join hdays on day between w.date and w.date + 6
         group by 1) h using (date)"""
)
def holiday_counts(spark, sf_dir):
    """Distinct US holidays in each week, for the years of the panel."""
    df = primary(spark, sf_dir).select("id", "date")
    return D.with_holiday_count(df, range(1995, 2002)).select("id", "date", "n_holidays")


@query(
    """select id, date, cast(make_date(year(date), 12, 24) between date and date + 6 as integer) as n_eves
       from prim"""
)
def christmas_weeks(spark, sf_dir):
    """Number of Christmas eves in the week."""
    return primary(spark, sf_dir).select("id", "date", D.christmas_eves("date").alias("n_eves"))


@query(
    f"""select id, date, 1 + hit as size, hit as flag from (
         select id, date, cast(({_nth_sql(11, 4, 4)}) between date + 1 and date + 7 as integer) as hit
         from (select *, cast(year(date) as integer) as y from prim))"""
)
def thanksgiving_weeks(spark, sf_dir):
    """Thanksgiving in the next seven days: set size (1 or 2) and plain flag."""
    years = range(1995, 2002)
    return primary(spark, sf_dir).select(
        "id", "date", D.black_friday_size("date", years).alias("size"),
        D.has_thanksgiving("date", years).alias("flag"),
    )


# ---- features and classes ----------------------------------------------------------------------

_SHORT = list(range(1, 11))


def _acf_ctes(src: str, value: str, tag: str, lags) -> dict[str, str]:
    over = "(partition by id, fold order by date)"
    z = (
        f"select id, fold, date, {value} - avg({value}) over (partition by id, fold) as z "
        f"from {src} where {value} is not null"
    )
    lagged = ", ".join(f"lag(z, {k}) over {over} as l{k}" for k in lags)
    ratio = ", ".join(f"sum(z * l{k}) / nullif(sum(z * z), 0) as {tag}r{k}" for k in lags)
    return {
        f"{tag}acf": f"select id, fold, {ratio} from (select *, {lagged} from ({z})) group by 1, 2"
    }


def _feature_ctes(suffix: str, source: str) -> dict[str, str]:
    """Brute-force features per fold on a relation id, fold, cutoff_date, date, sales."""
    ctes = {
        f"tr{suffix}": f"""
  select id, fold, cutoff_date, date, sales,
         sales - lag(sales) over (partition by id, fold order by date) as d1,
         row_number() over (partition by id, fold order by date) as rn from {source}""",
        f"trd{suffix}": f"""
  select *, d1 - lag(d1) over (partition by id, fold order by date) as d2 from tr{suffix}""",
        f"tiles{suffix}": f"""
  select id, fold, var_samp(tm) as stab, var_samp(tv) as lump from (
    select id, fold, (rn - 1) // 52 as tile, avg(sales) as tm, var_samp(sales) as tv, count(*) as c
    from tr{suffix} group by 1, 2, 3) where c = 52 group by 1, 2""",
        f"base{suffix}": f"""
  select id, fold, cutoff_date, count(*) as n, var_samp(sales) as v, median(sales) as med,
         min(sales) as lo, max(sales) as hi from tr{suffix} group by 1, 2, 3""",
        f"cross{suffix}": f"""
  select id, fold, cast(sum(case when low <> prev then 1 else 0 end) as double) as crossing_points from (
    select id, fold, low, lag(low) over (partition by id, fold order by date) as prev from (
      select t.id, t.fold, t.date, t.sales <= b.med as low
      from tr{suffix} t join base{suffix} b using (id, fold))) group by 1, 2""",
        f"flat{suffix}": f"""
  select id, fold, cast(max(c) as double) as flat_spots from (
    select id, fold, b, island, count(*) as c from (
      select id, fold, b, rn - row_number() over (partition by id, fold, b order by rn) as island from (
        select t.id, t.fold, t.rn, least(greatest(case when hi = lo then 1 else
          cast(ceil((sales - lo) / ((hi - lo) / 10.0::double)) as integer) end, 1), 10) as b
        from tr{suffix} t join base{suffix} s using (id, fold)))
    group by 1, 2, 3, 4) group by 1, 2""",
    }
    for src, value, tag in (
        (f"tr{suffix}", "sales", f"x{suffix}"),
        (f"tr{suffix}", "d1", f"da{suffix}"),
        (f"trd{suffix}", "d2", f"db{suffix}"),
    ):
        lags = _SHORT + [52] if tag.startswith("x") else _SHORT
        ctes.update(_acf_ctes(src, value, tag, lags))
    ten = {t: " + ".join(f"{t}{suffix}r{k} * {t}{suffix}r{k}" for k in _SHORT) for t in ("x", "da", "db")}
    ctes[f"feat{suffix}"] = f"""
  select b.id, b.fold, b.cutoff_date, cast(n as double) as series_length,
    x{suffix}r1 as x_acf1, {ten['x']} as x_acf10,
    da{suffix}r1 as diff1_acf1, {ten['da']} as diff1_acf10,
    db{suffix}r1 as diff2_acf1, {ten['db']} as diff2_acf10,
    x{suffix}r52 as seas_acf1,
    case when n >= 104 then stab / v else 0 end as stability,
    case when n >= 104 then lump / (v * v) else 0 end as lumpiness,
    crossing_points, flat_spots
  from base{suffix} b left join tiles{suffix} using (id, fold)
    join cross{suffix} using (id, fold) join flat{suffix} using (id, fold)
    join x{suffix}acf using (id, fold) join da{suffix}acf using (id, fold) join db{suffix}acf using (id, fold)"""
    return ctes


register(
    strain="""
  select p.id, p.date, p.sales, cast(f as integer) as fold, cast(mx - 7 * (f * 6 + 13) + 7 as date) as cutoff_date
  from sprim p join (select id, max(date) as mx from sprim group by 1) using (id),
       (select cast(unnest(range(0, 8)) as integer) as f)
  where p.date <= mx - 7 * (f * 6 + 13)""",
    livetrain="select id, date, sales, -1 as fold, mx as cutoff_date from prim join bounds using (id)",
    slivetrain="""
  select id, date, sales, -1 as fold, cast(mx + 7 as date) as cutoff_date
  from sprim join (select id, max(date) as mx from sprim group by 1) using (id)""",
)
register(**_feature_ctes("f", "train"), **_feature_ctes("l", "livetrain"))

_FEATS = [
    "series_length", "x_acf1", "x_acf10", "diff1_acf1", "diff1_acf10", "diff2_acf1", "diff2_acf10",
    "seas_acf1", "stability", "lumpiness", "crossing_points", "flat_spots",
]


def _feature_select(rel: str, keys: str) -> str:
    cols = ", ".join(f"round({c}, 6) + 0.0 as tsfeatures_{c}" for c in _FEATS)
    return f"select {keys}, {cols} from {rel}"


@query(_feature_select("featf", "id, cutoff_date"))
def fold_features(spark, sf_dir):
    """Sum-like and array features of every fold."""
    return rounded(features.calculate_cv_tsfeatures(primary_series(spark, sf_dir), fitted=False))


@query(_feature_select("featl", "id"))
def live_features(spark, sf_dir):
    """The same features on all data."""
    return rounded(features.calculate_live_tsfeatures(primary_series(spark, sf_dir), fitted=False))


@query(
    """select id, case when b = 0 then 'nan'::double else round(a / b, 6) end as tsfeatures_peak from (
         select id, max(sales) as a, min(sales) as b from sprim group by 1)"""
)
def infinite_to_nan(spark, sf_dir):
    """Prefixing, and infinities turned into NaN (F2)."""
    ends = thin_series(spark, sf_dir).select("id", F.array_max("y").alias("hi"), F.array_min("y").alias("lo"))
    peak = ends.groupBy("id").agg(float_div(F.max("hi"), F.min("lo")).alias("peak"))
    out = features.postprocess(peak, ["id"])
    c = F.col(TSF + "peak")
    return out.select("id", F.when(F.isnan(c), c).otherwise(F.round(c, 6)).alias(TSF + "peak"))


@query(
    """select s.id, f.fold, cast(max(s.cutoff_date) over (partition by f.fold) as date) as cutoff_date
       from (select distinct id, fold, cutoff_date from strain) s join (select distinct fold from strain) f using (fold)"""
)
def global_cutoffs(spark, sf_dir):
    """Fold stamp shared by all series."""
    folded = fold_series(thin_series(spark, sf_dir), DEFAULT_CV).select("id", "fold", "cutoff_date")
    folded = materialize(folded, "folds")
    return features.cutoff_global(folded).select("id", "fold", "cutoff_date")


def _streak_ctes(suffix: str, source: str) -> dict[str, str]:
    """Class inputs per (id, fold) by gaps and islands."""
    return {
        f"isl{suffix}": f"""
  select *, sum(case when sales = 0 then 1 else 0 end) over w as zi,
         sum(case when sales <> 0 then 1 else 0 end) over w as si,
         row_number() over (partition by id, fold order by date desc) as back
  from {source} window w as (partition by id, fold order by date)""",
        f"srun{suffix}": f"""
  select id, fold, max(len) as sale_streak from (
    select id, fold, zi, sum(case when sales <> 0 then 1 else 0 end) - case when zi = 0 then 1 else 0 end as len
    from isl{suffix} group by 1, 2, 3) group by 1, 2""",
        f"zrun{suffix}": f"""
  select id, fold, max(len) as zero_streak from (
    select id, fold, si, sum(case when sales = 0 then 1 else 0 end) - case when si = 0 then 1 else 0 end as len
    from isl{suffix} group by 1, 2, 3) group by 1, 2""",
        f"flag{suffix}": f"""
  select i.id, i.fold, i.cutoff_date,
         bool_and(sales = 0) filter (back <= 52) or bool_and(sales = 0) as class_all_zero,
         bool_and(sales = 0) filter (back <= 13) as class_trailing_zero,
         max(sale_streak) <= 4 and avg(case when sales = 0 then 1.0 else 0.0 end) > 0.4 as class_sparse,
         max(sales) < 4 as class_small_sales, count(*) as n,
         greatest(max(sale_streak), 0) as sale_streak, greatest(max(zero_streak), 0) as zero_streak
  from isl{suffix} i join srun{suffix} using (id, fold) join zrun{suffix} using (id, fold) group by 1, 2, 3""",
    }


_CLASS = """case when class_all_zero then 'all_zero' when class_trailing_zero then 'trailing_zero'
  when class_sparse then 'sparse' when class_small_sales then 'small_sales'
  when class_seasonal then 'seasonal' else 'regular' end as class"""


def _class_cte(suffix: str) -> str:
    return f"""
  select *, {_CLASS} from (
    select f.id, f.cutoff_date, class_all_zero, class_trailing_zero, class_sparse, class_small_sales,
           coalesce(r, 'nan'::double) > 0.55 and n > 52 as class_seasonal, sale_streak, zero_streak,
           zero_streak >= 13 and not class_trailing_zero and not class_sparse as class_gaps
    from flag{suffix} f left join (select id, fold, case when l < 53 then 'nan'::double else r end as r
      from seas{suffix}) using (id, fold))"""


def _seas_cte(source: str) -> str:
    return f"""
  select id, fold, sum(z * l52) / nullif(sum(z * z), 0) as r, count(*) as l from (
    select id, fold, z, lag(z, 52) over (partition by id, fold order by date) as l52 from (
      select id, fold, date, sales - avg(sales) over (partition by id, fold) as z from {source}))
  group by 1, 2"""


register(
    **_streak_ctes("f", "train"), seasf=_seas_cte("train"), clsf=_class_cte("f"),
    **_streak_ctes("s", "strain"), seass=_seas_cte("strain"), clss=_class_cte("s"),
    **_streak_ctes("l", "slivetrain"), seasl=_seas_cte("slivetrain"), clsl=_class_cte("l"),
)

_FLAGS = "class_all_zero, class_trailing_zero, class_sparse, class_small_sales, class_seasonal, class"


@query(
    """select id, fold, cast(sale_streak as integer) as sale_streak,
              cast(zero_streak as integer) as zero_streak from flags"""
)
def longest_streaks(spark, sf_dir):
    """Longest runs of sales and of zeros; a run that opens the series is one short."""
    stats = prefix.fold_stats(thin_series(spark, sf_dir))
    return stats.select("id", "fold", "sale_streak", "zero_streak")


@query(f"select id, cutoff_date, {_FLAGS} from clsf")
def fold_classes(spark, sf_dir):
    """Flags and class of every series and fold."""
    prim = primary_series(spark, sf_dir)
    return classes.classify_panel(prim)


@query(f"select id, cutoff_date, {_FLAGS} from clss")
def fold_classes_sparse(spark, sf_dir):
    """Classes of thin series, where the zero classes occur; features as a table."""
    inputs = materialize(prefix.fold_class_inputs(thin_series(spark, sf_dir)), "classes")
    return classes.classify_stats(inputs.drop("seas_acf1"), features.seasonal_acf_table(inputs))


@query(f"select id, {_FLAGS} from clsl")
def live_classes(spark, sf_dir):
    """Classes on all data."""
    return classes.classify_panel(thin_series(spark, sf_dir), live=True)


@query("select id, class_gaps from clsl")
def gap_flag(spark, sf_dir):
    """Long interior zero streaks (C7, off by default)."""
    out = classes.classify_panel(thin_series(spark, sf_dir), live=True, with_gaps=True)
    return out.select("id", "class_gaps")


@query("select class, cast(count(*) as bigint) as len from clsl group by 1")
def class_share(spark, sf_dir):
    """Number of series per class."""
    return dashboard.share(live_classes(spark, sf_dir), "class")


_ALL_CLASSES = [*classes.CLASSES, "regular"]


def _class_errors(spark, sf_dir):
    prim = materialize(primary_series(spark, sf_dir), "panel")
    cls = classes.classify_panel(prim)
    return scores.class_errors(scores.calc_errors(cv_forecast(prim, actual=True), None), cls)


register(
    clserr="""
  select e.cutoff_date, c.class, e.model, avg(abs(error)) as mae, avg(error) as bias,
         avg(abs(error)) + abs(avg(error)) as score
  from errors e left join clsf c
    on c.id = e.id and c.cutoff_date = e.cutoff_date group by 1, 2, 3"""
)


@query("select * from clserr", "mae bias score")
def class_error_report(spark, sf_dir):
    """Errors per fold, class and model (M10); a series without a class would report under null."""
    return rounded(_class_errors(spark, sf_dir))


@query(
    "select model, " + ", ".join(f"avg(score) filter (class = '{c}') as {c}" for c in _ALL_CLASSES) + " from clserr group by 1",
    " ".join(_ALL_CLASSES),
)
def class_model_table(spark, sf_dir):
    """Mean score by model and class (Q7, RS8)."""
    return rounded(dashboard.class_model_table(_class_errors(spark, sf_dir), _ALL_CLASSES))


@query(
    """select class, model, score,
         cast(row_number() over (partition by class order by score, model) as integer) as place
       from (select class, model, round(avg(score), 6) + 0.0 as score from clserr group by 1, 2)"""
)
def class_model_order(spark, sf_dir):
    """Models ordered within each class (Q7)."""
    return rounded(dashboard.class_model_order(_class_errors(spark, sf_dir)))


@query()
def fitted_features(spark, sf_dir):
    """All features including the fitted ones, every fold."""
    return features.calculate_cv_tsfeatures(primary_series(spark, sf_dir))
