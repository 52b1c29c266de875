"""Weekly panels derived from the star-schema tables.

`weekly_panel` is the cube `Client, Warehouse, Product, date, sales, price,
phase, id` on a dense weekly grid.  Cells are summed before anything is spread
over the calendar, so a hot series shrinks to at most one row per week before
the shuffle by series.  Only cells are shuffled and sorted: `weekly_series` fills
the grid inside one row per series, and `rows` spreads it as the last, narrow step.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcast.config import KEYS

# Fixed value: first week of the second phase in the test tables.
PHASE_1_START = "2001-08-06"


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last week `lo`, `hi`: straight from one column of the fact table, one row per supplier before the join."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    week = F.trunc(F.col("l_shipdate").cast("date"), "week")
    spans = lineitem.groupBy("l_suppkey").agg(F.min(week).alias("lo"), F.max(week).alias("hi"))
    shipped = spans.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return shipped.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _weeks(spark: SparkSession, sf_dir: str, product: Column) -> DataFrame:
    """One row per series: keys, `by_week` (week -> sold quantity and price), `first` week with a positive sale and the bounds `lo`, `hi` of the calendar."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    week = F.trunc(F.col("l_shipdate").cast("date"), "week")
    # Sum to (supplier, product, week) first: the join then moves cells, not lines.
    cells = lineitem.groupBy(
        F.col("l_suppkey"),
        product.alias("Product"),
        week.alias("date"),
    ).agg(F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("amount"))
    cells = cells.join(supplier, cells.l_suppkey == supplier.s_suppkey).select(
        F.col("s_nationkey").alias("Client"),
        F.col("s_suppkey").alias("Warehouse"),
        "Product",
        "date",
        "qty",
        (F.col("amount") / F.col("qty")).alias("price"),
    )
    bounds = calendar(spark, sf_dir).select(F.struct("lo", "hi")).scalar()
    per_series = cells.groupBy("Client", "Warehouse", "Product").agg(
        F.map_from_entries(
            F.collect_list(F.struct("date", F.struct(F.col("qty"), F.col("price"))))
        ).alias("by_week"),
        # An aggregate, not a search in the list: lambdas that hold it compare with a value, wherever filters push them.
        F.min(F.when(F.col("qty") > 0, F.col("date"))).alias("first"),
    )
    return per_series.withColumn("_span", bounds).select(
        *KEYS, "by_week", "first", F.col("_span.lo").alias("lo"), F.col("_span.hi").alias("hi")
    )


def _spread(sold: Column, first: Column, hi: Column, value: Callable[[Column], Column], empty: Column) -> Column:
    """Values of every week from `first` to `hi`: each cell of the ordered list, then the empty weeks up to the next one."""

    def gap(a: Column, b: Column) -> Column:
        return F.array_repeat(empty, F.floor(F.datediff(b, a) / 7).cast("int"))

    ends = F.concat(F.slice(F.transform(sold, lambda e: e["key"]), F.lit(2), F.size(sold)), F.array(F.date_add(hi, 7)))
    runs = F.zip_with(sold, ends, lambda e, end: F.concat(F.array(value(e["value"])), gap(F.date_add(e["key"], 7), end)))
    return F.concat(gap(first, F.element_at(sold, 1)["key"]), F.flatten(runs))


def _series(weeks: DataFrame, trimmed: bool) -> DataFrame:
    """One row per series: keys, `id`, `dates`, `y` and `prices` on the weekly grid, from the first positive sale on if `trimmed`."""
    cells = weeks.withColumn("_sold", F.sort_array(F.map_entries("by_week")))  # by week: keys of a map differ
    first = F.col("lo")
    if trimmed:
        first = F.col("first")
        cells = cells.filter(first.isNotNull()).withColumn("_sold", F.filter("_sold", lambda e: e["key"] >= first))
    sold, hi, zero = F.col("_sold"), F.col("hi"), F.lit(0.0)
    return cells.select(
        *KEYS,
        F.concat("Client", F.lit("-"), "Warehouse", F.lit("-"), "Product").alias("id"),
        F.sequence(first, hi, F.expr("interval 7 days")).alias("dates"),
        _spread(sold, first, hi, lambda c: F.coalesce(c["qty"], zero), zero).alias("y"),
        _spread(sold, first, hi, lambda c: c["price"], F.lit(None).cast("double")).alias("prices"),
    )


def rows(series: DataFrame, last: int | None = None) -> DataFrame:
    """The cube of a frame with one row per series; with `last` only that many newest weeks.  Narrow: no shuffle, no sort."""
    if last is not None:
        start = F.greatest(F.size("y") - last, F.lit(0)) + 1
        series = series.withColumns({c: F.slice(c, start, F.lit(last)) for c in ("dates", "y", "prices")})
    # An inner explode has its arrays computed once more in a filter on their size, with every step below copied into it.
    spread = series.select(*KEYS, "id", "dates", "prices", F.posexplode_outer("y").alias("_i", "sales")).filter("_i is not null")
    date = F.get("dates", F.col("_i"))
    return spread.select(
        *KEYS,
        date.alias("date"),
        "sales",
        F.get("prices", F.col("_i")).alias("price"),
        (date >= F.lit(PHASE_1_START).cast("date")).cast("int").alias("phase"),
        "id",
    )


def weekly_series(spark: SparkSession, sf_dir: str, trimmed: bool = True) -> DataFrame:
    """Series = nation x supplier x return flag, one row each."""
    return _series(_weeks(spark, sf_dir, F.ascii("l_returnflag")), trimmed)


def sparse_series(spark: SparkSession, sf_dir: str, trimmed: bool = True) -> DataFrame:
    """Thin series of all suppliers, one row each: product = part key modulo 40."""
    return _series(_weeks(spark, sf_dir, F.col("l_partkey") % 40), trimmed)


def wide(spark: SparkSession, sf_dir: str, phase: int, value: str) -> DataFrame:
    """The raw layout of one phase: keys, then one column of `y` or `prices` per week; cells are picked from the series' arrays."""
    lo, hi = calendar(spark, sf_dir).collect()[0]
    days = range(0, (hi - lo).days + 1 if lo else 0, 7)
    names = [(lo + timedelta(days=d)).isoformat() for d in days]
    cells = [F.get(value, F.lit(i)).alias(d) for i, d in enumerate(names) if (d >= PHASE_1_START) == bool(phase)]
    return weekly_series(spark, sf_dir, trimmed=False).select(*KEYS, *cells)


def weekly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series = nation x supplier x return flag; weeks without a sale are 0 / null price."""
    return rows(weekly_series(spark, sf_dir, trimmed=False))


def sparse_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thin series of all suppliers: product = part key modulo 40."""
    return rows(sparse_series(spark, sf_dir, trimmed=False))
