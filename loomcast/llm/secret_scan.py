"""Secrets in texts: three patterns, then runs of characters that look drawn at random.

Two first-order character Markov models are trained from labelled samples, one of random
strings and one of ordinary identifiers.  A run of token characters outside the
patterns' hits is a secret if the log-likelihood ratio of the two models favours the random one.
Everything is DataFrame expressions.  Work on a text stays in its row; what is shuffled
is counts of character pairs, summed before the exchange, so no hot source matters.

Labelled samples: values of assignments, access keys, and one digest of each text in base 64, are
random (hits of the hex pattern are not: long numbers and filler are among them); runs of
token characters outside the hits, without a digit or a small letter between two capitals, are ordinary.

Defined cases: a null or empty text has no span; positions are code points, ends are
exclusive; equal rows give equal results; very long texts are scanned whole; an empty
table gives an empty table; without samples both models are uniform and nothing is
added; columns other than the id and the text are neither read nor returned.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcast.llm.quality import let
from loomcast.sources.lineage import materialize

# fixed values: the patterns, and the least length of what they must hold
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
KINDS = ("assign", "access", "hex", "markov")

RUN = r"[A-Za-z0-9+/_=-]"
FIRST, SYMBOLS = ord("+"), ord("z") - ord("+") + 1  # codes of the characters of runs
PRIOR = 8.0  # weight of the symbol's own share beside the counts that follow a symbol
BLOCK = 256  # hits whose places are summed together


@dataclass(frozen=True)
class ScanRules:
    """Lengths and thresholds of the added spans."""

    min_sample: int = 12  # shorter runs are no samples of ordinary identifiers
    min_run: int = 20  # shorter runs are not judged
    min_ratio: float = 12.0  # natural logarithm of the likelihood ratio
    min_mean: float = 0.5  # the same per character


def _sums(sizes: Column) -> Column:
    """Sum of all elements before each one, in blocks so that long arrays stay cheap."""
    pair = lambda a, t: F.struct(a.alias("a"), t.alias("t"))
    none = F.array().cast("array<int>")
    before = lambda xs, t: F.aggregate(xs, pair(none, t), lambda s, x: pair(F.concat(s["a"], F.array(s["t"])), s["t"] + x), lambda s: s["a"])
    starts = F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1)), F.lit(BLOCK))
    blocks = F.transform(starts, lambda i: F.slice(sizes, i, F.lit(BLOCK)))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
    return let(
        blocks,
        lambda bs: let(
            before(F.transform(bs, total), F.lit(0)),
            lambda offs: F.flatten(F.transform(bs, lambda b, i: before(b, F.get(offs, i)))),
        ),
    )


def hits(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches: array of (s: start, e: end, v: the match or its group)."""
    empty = F.array().cast("array<struct<s:int,e:int,v:string>>")
    matched = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matched
    sizes = F.zip_with(F.split(text, pattern, -1), matched, lambda gap, m: F.struct(F.length(gap).alias("g"), F.length(m).alias("m")))
    # the text after the last match has no match beside it
    sizes = F.filter(sizes, lambda x: x["m"].isNotNull())
    placed = let(
        sizes,
        lambda zs: F.zip_with(_sums(F.transform(zs, lambda z: z["g"] + z["m"])), zs, lambda t, z: F.struct((t + z["g"]).alias("s"), (t + z["g"] + z["m"]).alias("e"))),
    )
    found = F.zip_with(placed, values, lambda p, v: F.struct(p["s"].alias("s"), p["e"].alias("e"), v.alias("v")))
    return F.when(text.rlike(pattern), found).otherwise(empty)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: ScanRules = ScanRules()) -> DataFrame:
    """One row per row: doc_id, `base` (hits of the patterns: s, k, e, v), `runs` outside them, `digest` of the text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    # a maximal run holds a hit of the last two patterns exactly where its rest is long enough
    rows = rows.select(
        "doc_id",
        F.when(text != "", F.base64(F.unhex(F.sha2(text, 256)))).alias("digest"),
        F.filter(hits(text, ASSIGN, 2), lambda x: F.length(x["v"]) >= ASSIGN_CHARS).alias("assign"),
        hits(text, ACCESS.replace("+", "{%d,}" % (ACCESS_CHARS - 4))).alias("access"),
        hits(text, f"(?<![0-9a-f]){HEX[:-1]}{{{HEX_CHARS},}}").alias("hex"),
        hits(text, f"(?<!{RUN}){RUN}{{{rules.min_sample},}}").alias("all_runs"),
    )
    marked = lambda name, k: F.transform(name, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["v"].alias("v")))
    rows = rows.select("doc_id", "digest", "all_runs", F.sort_array(F.concat(*[marked(n, k) for k, n in enumerate(KINDS[:3])])).alias("base"))
    outside = F.filter("all_runs", lambda r: ~F.exists("base", lambda b: (b["s"] < r["e"]) & (r["s"] < b["e"])))
    return rows.select("doc_id", "digest", "base", outside.alias("runs"))


def labelled_samples(found: DataFrame) -> DataFrame:
    """(text, label): random strings and ordinary identifiers of the rows of `find`, each once however often it is copied."""
    random = F.concat(F.transform(F.filter("base", lambda b: b["k"] < 2), lambda b: b["v"]), F.filter(F.array("digest"), lambda d: d.isNotNull()))
    plain = F.filter(F.transform("runs", lambda r: r["v"]), lambda v: ~v.rlike("[0-9]|[A-Z][a-z][A-Z]"))
    tagged = lambda xs, label: F.transform(xs, lambda v: F.struct(v.alias("text"), F.lit(label).alias("label")))
    return found.select(F.inline(F.concat(tagged(random, "random"), tagged(plain, "ordinary")))).distinct()


def symbols(text: Column) -> Column:
    """Numbers of the characters from 1; characters that no run holds are 0."""
    code = lambda c: F.ascii(c) - (FIRST - 1)
    return F.transform(F.split(text, ""), lambda c: F.when((code(c) > 0) & (code(c) <= SYMBOLS), code(c)).otherwise(0))


def train(samples: DataFrame) -> list[float]:
    """Logarithm of the ratio of both models' probabilities, by previous symbol (0 at the start) and symbol."""
    moves = samples.where("text <> ''").select("label", symbols(F.col("text")).alias("at"))
    moves = moves.select("label", F.explode(F.transform("at", lambda c, i: F.when(i > 0, F.get("at", i - 1)).otherwise(0) * (SYMBOLS + 1) + c)).alias("move"))
    width = SYMBOLS + 1
    seen = {kind: [0] * width * width for kind in ("random", "ordinary")}
    for r in moves.groupBy("label", "move").count().where("label in ('random', 'ordinary')").collect():  # at most a row per pair of symbols
        seen[r["label"]][r["move"]] = r["count"]
    least = {k: [(sum(v[b::width]) + 0.5) / (sum(v) + 0.5 * width) for b in range(width)] for k, v in seen.items()}
    p = lambda kind, a, b, n: (seen[kind][a * width + b] + PRIOR * least[kind][b]) / (n + PRIOR)
    out = []
    for a in range(width):
        n = {k: sum(v[a * width : (a + 1) * width]) for k, v in seen.items()}
        out += [math.log(p("random", a, b, n["random"]) / p("ordinary", a, b, n["ordinary"])) for b in range(width)]
    return out


def ratio(text: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string, random against ordinary."""
    table = F.split(F.lit(",".join(f"{x:.9g}" for x in model)), ",").cast("array<double>")
    start = F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("t"))
    step = lambda s, c: F.struct(c.alias("a"), (s["t"] + F.get(table, s["a"] * (SYMBOLS + 1) + c)).alias("t"))
    return F.aggregate(symbols(text), start, step, lambda s: s["t"])


def judge(found: DataFrame, model: list[float], rules: ScanRules = ScanRules()) -> DataFrame:
    """Rows of `find` with all spans: doc_id, base, spans (arrays of s, k, e, v; k numbers KINDS)."""
    asked = F.filter("runs", lambda r: r["e"] - r["s"] >= rules.min_run)
    scored = F.transform(asked, lambda r: F.struct(r.alias("r"), ratio(r["v"], model).alias("x")))
    passed = F.filter(scored, lambda z: z["x"] >= F.greatest(F.lit(rules.min_ratio), rules.min_mean * (z["r"]["e"] - z["r"]["s"])))
    extra = F.transform(passed, lambda z: F.struct(z["r"]["s"].alias("s"), F.lit(3).alias("k"), z["r"]["e"].alias("e"), z["r"]["v"].alias("v")))
    return found.select("doc_id", "base", F.sort_array(F.concat("base", extra)).alias("spans"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: ScanRules = ScanRules(), samples: DataFrame | None = None) -> DataFrame:
    """doc_id, base and spans of every row; the models learn from `samples` (text, label), or from the rows themselves."""
    found = materialize(find(docs, id_col, text_col, rules), "secret-runs")  # texts are scanned once
    return judge(found, train(labelled_samples(found) if samples is None else samples), rules)


def shown(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == KINDS.index(kind))).cast("long")
