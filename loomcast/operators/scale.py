"""Sales scale per series, quantile bins, important-series filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomcast.functions.expr import INF
from loomcast.sources.lineage import materialize

N_BUCKETS = 256


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> list[float]:
    """Exact linearly interpolated quantiles without gathering the column anywhere.

    Values collapse to (value, count); approximate quantiles cut them into range
    buckets; one count per bucket tells which buckets hold the wanted ranks, and
    only those few are ranked, each in its own task.  Ties shrink to one row.
    The driver sees bucket totals and the 2 x len(probs) order statistics.
    """
    values = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(
        F.count("*").alias("c")
    )
    edges = sorted(
        set(values.approxQuantile("v", [i / N_BUCKETS for i in range(1, N_BUCKETS)], 1e-3))
    )
    if not edges:
        return [float("nan")] * len(probs)
    bucketizer = Bucketizer(splits=[-INF, *edges, INF], inputCol="v", outputCol="b")
    bucketed = bucketizer.transform(values)
    totals = {r["b"]: r["n"] for r in bucketed.groupBy("b").agg(F.sum("c").alias("n")).collect()}
    n = sum(totals.values())
    wanted: dict[int, tuple[int, int]] = {}
    starts, seen = {}, 0
    for b in sorted(totals):
        starts[b] = seen
        seen += totals[b]
    ordered = sorted(starts.items(), key=lambda kv: kv[1])
    for p in probs:
        pos = p * (n - 1)
        for rank in {int(pos), min(int(pos) + 1, n - 1)}:
            b = max((s, k) for k, s in ordered if s <= rank)[1]
            wanted[rank] = (b, rank - starts[b])

    local = F.sum("c").over(
        W.partitionBy("b").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    need = sorted({b for b, _ in wanted.values()})
    ranked = bucketed.filter(F.col("b").isin(need)).withColumn("hi", local)
    hits = [
        F.when((F.col("b") == b) & (F.col("hi") > r) & (F.col("hi") - F.col("c") <= r), F.lit(rank))
        for rank, (b, r) in wanted.items()
    ]
    found = ranked.select("v", F.explode(F.array_compact(F.array(*hits))).alias("rank")).collect()
    at = {r["rank"]: r["v"] for r in found}

    out = []
    for p in probs:
        pos = p * (n - 1)
        lo = int(pos)
        hi = min(lo + 1, n - 1)
        out.append(at[lo] + (at[hi] - at[lo]) * (pos - lo))
    return out


def interval_label(x: Column, breaks: Sequence[float]) -> Column:
    """Left-open interval holding x, as text, e.g. `(1.5, 2.25]`."""
    edges = ["-inf", *[repr(round(b, 6)) for b in breaks], "inf"]
    labels = [
        f"({a}, {b}]" if b != "inf" else f"({a}, inf]" for a, b in zip(edges, edges[1:])
    ]
    index = F.size(F.filter(F.array(*[F.lit(float(b)) for b in breaks]), lambda b: b < x))
    return F.element_at(F.array(*[F.lit(t) for t in labels]), index + 1)


def series_scale(sales: DataFrame) -> DataFrame:
    return sales.groupBy("id").agg(F.avg(F.abs("sales")).alias("sales_scale"))


def scale_categories(sales: DataFrame, n_bins: int = 20) -> DataFrame:
    """`id, sales_scale, bin, weight`: quantile bin and share of the total scale."""
    scale = materialize(series_scale(sales), "scale")
    breaks = exact_quantiles(scale, "sales_scale", [i / n_bins for i in range(1, n_bins)])
    total = scale.agg(F.sum("sales_scale")).scalar()
    return scale.select(
        "id",
        "sales_scale",
        interval_label(F.col("sales_scale"), sorted(set(breaks))).alias("bin"),
        (F.col("sales_scale") / total).alias("weight"),
    )


def vip_series(categories: DataFrame, threshold: float = 100) -> DataFrame:
    return categories.filter(F.col("sales_scale") > threshold)
