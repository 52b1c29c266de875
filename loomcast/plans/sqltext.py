"""Shared SQL fragments for the DuckDB cross-check of the registered queries.

`sql(body)` prefixes `body` with the common table expressions it names,
followed through their own references.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {
    "cell": """
  select s_nationkey as Client, s_suppkey as Warehouse, ascii(l_returnflag) as Product,
         cast(date_trunc('week', l_shipdate) as date) as date,
         sum(l_quantity) as qty, sum(l_extendedprice) / sum(l_quantity) as price
  from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2, 3, 4""",
    "keys": "select distinct Client, Warehouse, Product from cell",
    "weeks": "select distinct date from cell",
    "panel": """
  select k.Client, k.Warehouse, k.Product, w.date, coalesce(c.qty, 0) as sales, c.price as price,
         case when w.date >= date '2001-08-06' then 1 else 0 end as phase,
         concat(k.Client, '-', k.Warehouse, '-', k.Product) as id
  from keys k cross join weeks w
  left join cell c on c.Client = k.Client and c.Warehouse = k.Warehouse
                  and c.Product = k.Product and c.date = w.date""",
    "prim": """
  select * exclude (cum) from (
    select *, sum(case when sales > 0 then 1 else 0 end) over
      (partition by Client, Warehouse, Product order by date) as cum from panel) where cum >= 1""",
    # thin series
    "scell": """
  select s_nationkey as Client, s_suppkey as Warehouse, l_partkey % 40 as Product,
         cast(date_trunc('week', l_shipdate) as date) as date,
         sum(l_quantity) as qty, sum(l_extendedprice) / sum(l_quantity) as price
  from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2, 3, 4""",
    "skeys": "select distinct Client, Warehouse, Product from scell",
    "sweeks": "select distinct date from scell",
    "spanel": """
  select k.Client, k.Warehouse, k.Product, w.date, coalesce(c.qty, 0) as sales, c.price as price,
         case when w.date >= date '2001-08-06' then 1 else 0 end as phase,
         concat(k.Client, '-', k.Warehouse, '-', k.Product) as id
  from skeys k cross join sweeks w
  left join scell c on c.Client = k.Client and c.Warehouse = k.Warehouse
                   and c.Product = k.Product and c.date = w.date""",
    "sprim": """
  select * exclude (cum) from (
    select *, sum(case when sales > 0 then 1 else 0 end) over
      (partition by Client, Warehouse, Product order by date) as cum from spanel) where cum >= 1""",
    # folds of the dense panel (8 folds, horizon 13, step 6)
    "bounds": "select id, max(date) as mx, min(date) as mn from prim group by id",
    "fold": """
  select id, f as fold, mx, cast(mx - 7 * (f * 6 + 13) as date) as train_end,
         cast(mx - 7 * (f * 6 + 13) + 7 as date) as cutoff_date, cast(mx - 7 * f * 6 as date) as test_end
  from bounds, (select cast(unnest(range(0, 8)) as integer) as f) where mn <= mx - 7 * (f * 6 + 13)""",
    "train": """
  select p.id, p.date, p.sales, p.price, p.Client, p.Warehouse, p.Product, f.fold, f.cutoff_date, f.train_end
  from prim p join fold f on p.id = f.id and p.date <= f.train_end""",
    "stat": """
  select id, fold, cutoff_date, train_end, count(*) as n, avg(sales) as ha,
         avg(case when date > train_end - 91 then sales end) as wa
  from train group by 1, 2, 3, 4""",
    "cvfc": """
  select s.id, cast(s.train_end + 7 * h as date) as date, s.cutoff_date,
         0.0::double as prediction_ZeroModel,
         case when n >= 13 then wa else 0 end as prediction_WindowAverage,
         case when n >= 52 then y.sales else 0 end as prediction_SeasonalNaive,
         ha as prediction_HistoricAverage
  from stat s cross join (select cast(unnest(range(1, 14)) as integer) as h)
  left join prim y on y.id = s.id and y.date = s.train_end + 7 * h - 364""",
    "lstat": """
  select p.id, max(mx) as mx, count(*) as n, avg(sales) as ha,
         avg(case when date > mx - 91 then sales end) as wa
  from prim p join bounds b on b.id = p.id group by 1""",
    "livefc": """
  select s.id, cast(s.mx + 7 * h as date) as date,
         0.0::double as prediction_ZeroModel,
         case when n >= 13 then wa else 0 end as prediction_WindowAverage,
         case when n >= 52 then y.sales else 0 end as prediction_SeasonalNaive,
         ha as prediction_HistoricAverage
  from lstat s cross join (select cast(unnest(range(1, 14)) as integer) as h)
  left join prim y on y.id = s.id and y.date = s.mx + 7 * h - 364""",
    "mixfc": """
  select *, (prediction_WindowAverage + prediction_SeasonalNaive) / 2 as prediction_MixerWigeSeveEnsemble
  from cvfc""",
    "fclong": """
  select id, date, cutoff_date, replace(name, 'prediction_', '') as model, value as prediction from (
    unpivot mixfc on prediction_ZeroModel, prediction_WindowAverage, prediction_SeasonalNaive,
      prediction_HistoricAverage, prediction_MixerWigeSeveEnsemble into name name value value)""",
    "errors": """
  select f.id, f.date, f.cutoff_date, f.model, f.prediction, s.sales, f.prediction - s.sales as error
  from fclong f left join prim s on s.id = f.id and s.date = f.date""",
    "idscore": """
  select model, id, cutoff_date, abs(sum(error)) as b, sum(abs(error)) as a, sum(abs(sales)) as s
  from errors group by 1, 2, 3""",
    "cutscore": """
  select model, cutoff_date, (abs(sum(error)) + sum(abs(error))) / sum(abs(sales)) as score
  from errors group by 1, 2""",
    "totscore": """
  select model, (abs(sum(error)) + sum(abs(error))) / sum(abs(sales)) as score from errors group by 1""",
    "scored": """
  select model, id, cutoff_date,
         case when s = 0 then (case when a = 0 then 'nan'::double else 'inf'::double end)
              else b / s + a / s end as score
  from idscore""",
    "toterr": """
  select model, cutoff_date, avg(error) as bias, avg(abs(error)) as mae,
         avg(abs(error)) + abs(avg(error)) as score from errors group by 1, 2""",
    "horerr": """
  select cast((date - cutoff_date) // 7 + 1 as integer) as horizon, model, avg(error) as bias,
         avg(abs(error)) as mae, avg(abs(error)) + abs(avg(error)) as score
  from errors group by 1, 2""",
    "scale": "select id, avg(abs(sales)) as sales_scale from prim group by id",
    "qbreaks": """
  select list_distinct(quantile_cont(sales_scale, [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45,
    0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])) as qs from scale""",
    "binned": """
  select id, sales_scale, sales_scale / (select sum(sales_scale) from scale) as weight,
         len(list_filter(qs, lambda q: q < sales_scale)) as k,
         concat('(', case when k = 0 then '-inf' else cast(round(list_sort(qs)[k], 6) as varchar) end, ', ',
                case when k = len(qs) then 'inf' else cast(round(list_sort(qs)[k + 1], 6) as varchar) end,
                ']') as bin
  from scale, qbreaks""",
}


def _names_in(text: str) -> list[str]:
    words = set(re.findall(r"[A-Za-z_]+", text))
    return [n for n in CTES if n in words]


def register(**ctes: str) -> None:
    CTES.update(ctes)


def sql(body: str) -> str:
    """`body` with every common table expression it needs, in dependency order."""
    order: list[str] = []

    def visit(text: str, path: tuple[str, ...]) -> None:
        for name in _names_in(text):
            if name not in order and name not in path:
                visit(CTES[name], (*path, name))
                order.append(name)

    visit(body, ())
    if not order:
        return body.strip()
    head = ",\n".join(f"{n} as ({CTES[n]})" for n in order)
    recursive = "recursive " if any(re.search(rf"\b{n}\b", CTES[n]) for n in order) else ""
    return f"with {recursive}{head}\n{body.strip()}"
