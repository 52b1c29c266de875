"""URL verdicts: host and path rules first, logistic regression on hashed character n-grams for the rest.

The regression learns from a small labelled table of URLs.  Features are JVM expressions
and fitting is distributed; nothing is shuffled but the labelled table.

Defined cases: a null URL or one without `://` has an empty host and path, fits no rule and
is judged on empty features; without labels of both kinds the one kind seen, or else `default`, is the
verdict; repeated rows get equal verdicts; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str]  # "host/path prefix", "allow" or "block"
GRAMS = (3, 4, 5)
FEATURES = 1 << 16
LABELLED = 5000  # rows of each label that a derived labelled table holds at most

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits; of equally long ones the first."""
    out = F.when(F.lit(False), F.lit(""))
    for text, _ in sorted(rules, key=lambda r: -len(r[0])):
        at = text.index("/")
        domain, prefix = text[:at], text[at:]
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(prefix))
        out = out.when(fits, F.lit(text))
    return out


def verdict_of(rule: Column, rules: Sequence[Rule]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for text, verdict in rules:
        out = out.when(rule == text, F.lit(verdict))
    return out


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, each marked with its part."""

    def of(part: Column, mark: str, n: int) -> Column:
        framed = F.concat(F.lit("^"), part, F.lit("$"))
        at = F.sequence(F.lit(1), F.greatest(F.length(framed) - (n - 1), F.lit(1)))
        return F.transform(at, lambda i: F.concat(F.lit(mark), F.substring(framed, i, F.lit(n))))

    return F.flatten(F.array(*[of(part, mark, n) for part, mark in ((host, "h"), (path, "p")) for n in GRAMS]))


def _features(rows: DataFrame) -> DataFrame:
    with_grams = rows.withColumn("grams", grams(F.col("host"), F.col("path")))
    return HashingTF(numFeatures=FEATURES, inputCol="grams", outputCol="features", binary=True).transform(with_grams)


def train(labelled: DataFrame) -> LogisticRegressionModel | str | None:
    """`labelled`: (url, label); a model, or the only label there is, or None."""
    kinds = sorted(r[0] for r in labelled.select("label").where("label in ('allow', 'block')").distinct().collect())
    if len(kinds) < 2:
        return kinds[0] if kinds else None
    rows = labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), (F.col("label") == "block").cast("double").alias("label"))
    return LogisticRegression(regParam=0.01, maxIter=40).fit(_features(rows))


def labelled_by_rules(urls: DataFrame, rules: Sequence[Rule], limit: int = LABELLED) -> DataFrame:
    """(url, label) of URLs that rules decide, at most `limit` of each label, least hashes first."""
    rows = urls.select("url", verdict_of(rule_of(host_of(F.col("url")), path_of(F.col("url")), rules), rules).alias("label")).distinct()
    part = lambda label: rows.where(F.col("label") == label).orderBy(F.xxhash64("url"), "url").limit(limit)
    return part("allow").unionByName(part("block"))


def judge(
    pages: DataFrame,
    labelled: DataFrame,
    rules: Sequence[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule, verdict, block_score (null where a rule decides)."""
    model = train(labelled)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    if isinstance(model, LogisticRegressionModel):
        scored = model.transform(_features(rows)).withColumn("score", vector_to_array("probability")[1])
    else:
        scored = rows.withColumn("score", F.lit(1.0 if (model or default) == "block" else 0.0))
    by_score = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce(verdict_of(F.col("rule"), rules), by_score).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("score")).alias("block_score"),
    )
