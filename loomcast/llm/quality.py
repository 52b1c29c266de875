"""Line-first quality rules, as DataFrame expressions only.

Every line of a text is judged by rules on punctuation, navigation and
boilerplate; lines that fail are removed, and a document that loses too much of
its text is rejected.  Work stays inside one row, so there is no shuffle and no
document, however hot its source, meets another.

Defined cases: a null or empty text has no words and is rejected, its cleaned
text is null or empty; lines without a word pass every rule and are kept as they
are; equal rows give equal results; an empty table gives an empty table; columns
other than the id and the text are neither read nor returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the separators of words and the symbol class of the base counts
SPACES = " \t\n\x0b\f\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOL_CLASS = "#*$%&|<>"

# fixed values: phrases of page furniture, matched in lower case anywhere in a line
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "click here",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "sign in",
    "sign up",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the verdict on documents."""

    max_upper: float = 0.4  # capital letters among the characters of a line
    min_upper: int = 5  # with no more capitals the rule is silent
    max_symbols_per_word: float = 0.25
    max_bars: int = 3  # so many separators make a line a menu or table row
    min_distinct: float = 0.2  # distinct words among the words of a line
    min_repeat_words: int = 10  # shorter lines: the repetition rule is silent
    max_boilerplate_chars: int = 200  # longer lines are prose that may quote a phrase
    min_kept: float = 0.7  # share of word characters that must survive
    min_words: int = 50
    max_repeat_percent: int = 50


def split_words(text: Column) -> Column:
    """Words between ASCII blanks; an empty array for null and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))


def solid(text: Column) -> Column:
    """The text without its blanks."""
    return F.regexp_replace(text, WORD_GAP, "")


def only(text: Column, chars: str) -> Column:
    """The characters of a regular-expression class that the text holds."""
    return F.regexp_replace(text, f"[^{chars}]+", "")


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once, also inside a lambda over its elements."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def line_failures(line: Column, repeats: Column, rules: LineRules = LineRules()) -> dict[str, Column]:
    """Rule name -> true if the line fails it; `repeats`: the text has a repeated 3-word window.

    punctuation: no sentence ends in the line.  capitals: mostly upper case.  symbols:
    too many per word.  navigation: a menu or table row.  repetition: few
    distinct words, looked for in texts with repeated windows only.  boilerplate: a short
    line with a phrase of page furniture.
    """
    n_words = F.length(only(line, " ")) + 1
    n_symbols = F.length(only(line, SYMBOL_CLASS))
    n_bars = F.length(only(line, "|"))
    upper = F.length(only(line, r"\p{Lu}"))
    equal = let(
        split_words(line),
        lambda words: (F.size(words) >= rules.min_repeat_words)
        & (F.size(F.array_distinct(words)) < rules.min_distinct * F.size(words)),
    )
    phrase = F.lit(False)
    for text in BOILERPLATE:
        phrase = phrase | F.contains(F.lower(line), F.lit(text))
    return {
        "punctuation": ~line.rlike(r"[.!?…。！？][\"'”’»)\]]*(\s|$)"),
        "capitals": upper > F.greatest(rules.max_upper * (F.length(line) - n_words), F.lit(rules.min_upper)),
        "symbols": n_symbols > rules.max_symbols_per_word * n_words,
        "navigation": n_bars >= rules.max_bars,
        "repetition": F.when(repeats, equal).otherwise(False),
        "boilerplate": F.when(F.length(line) <= rules.max_boilerplate_chars, phrase).otherwise(False),
    }


def _covered(hashes: Column) -> Column:
    """Words that lie in a 3-word window found at least twice in the text.

    Windows are compared by 64-bit hashes inside one text, where a chance match is
    a matter of 1e-11 even for 20,000 words.  Few repeated hashes are looked up one
    by one; with many, the windows are sorted.
    """
    index = F.sequence(F.lit(0), F.size(hashes) - 1)

    def by_lookup(again: Column) -> Column:
        return F.filter(index, lambda i: F.array_contains(again, F.get(hashes, i)))

    def by_order(ordered: Column) -> Column:
        same = F.transform(
            ordered,
            lambda s, k: F.when(
                ((k > 0) & (s["h"] == F.get(ordered, k - 1)["h"])) | (s["h"] == F.get(ordered, k + 1)["h"]), s["i"]
            ),
        )
        return F.sort_array(F.filter(same, lambda i: i.isNotNull()))

    repeated = let(
        F.sort_array(hashes),
        lambda o: F.array_distinct(F.filter(o, lambda h, i: (i > 0) & (h == F.get(o, i - 1)))),
    )
    pairs = F.transform(index, lambda i: F.struct(F.get(hashes, i).alias("h"), i.alias("i")))
    places = let(
        repeated,
        lambda again: F.when(F.size(again) <= 16, by_lookup(again)).otherwise(let(F.sort_array(pairs), by_order)),
    )
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"))
    return F.aggregate(places, start, step, lambda acc: acc["n"])


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, the text, whether a 3-word window repeats, and the counts of the base rules."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    full = F.coalesce(F.col("text"), F.lit(""))
    rows = rows.select("*", split_words(F.col("text")).alias("words"))
    words, n = F.col("words"), F.size("words")
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    rows = rows.select("*", F.when(n >= 3, hashes).alias("hashes"))
    again = F.coalesce(F.size("hashes") != F.size(F.array_distinct("hashes")), F.lit(False))
    lines = F.filter(F.split(full, "\n"), has_word)
    rows = rows.select("doc_id", "text", "words", "hashes", again.alias("again"), lines.alias("full_lines"))
    return rows.select(
        "doc_id",
        "text",
        "again",
        n.cast("long").alias("n_words"),
        F.length(solid(full)).cast("long").alias("word_chars"),
        F.length(only(full, SYMBOL_CLASS)).cast("long").alias("n_symbols"),
        (F.size("full_lines") - F.size(F.array_distinct("full_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("again"), _covered(F.col("hashes"))).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def clean_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules()
) -> DataFrame:
    """Base counts, the cleaned text, failures by rule, and the verdict, one row per row of `docs`.

    Columns: doc_id, text (as given), clean_text, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, n_lines, n_failed_<rule>, kept_chars, kept.
    """
    rows = base_counts(docs, id_col, text_col)
    names = list(line_failures(F.lit(""), F.lit(False)))

    def judged(line: Column) -> Column:
        flags = line_failures(line, F.col("again"), rules)
        flags = {k: has_word(line) & v for k, v in flags.items()}
        return F.struct(line.alias("line"), *[v.alias(k) for k, v in flags.items()])

    rows = rows.select("*", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), judged).alias("judged"))
    fails = lambda x: F.array_contains(F.array(*[x[k] for k in names]), True)
    kept = F.transform(F.filter("judged", lambda x: ~fails(x)), lambda x: x["line"])
    rows = rows.select("*", F.when(F.col("text").isNotNull(), F.array_join(kept, "\n")).alias("clean_text"))
    kept_chars = F.length(solid(F.coalesce("clean_text", F.lit("")))).cast("long")
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )
    count = lambda k: F.size(F.filter("judged", lambda x: x[k])).cast("long")
    return rows.select(
        "doc_id",
        "text",
        "clean_text",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.size("judged").cast("long").alias("n_lines"),
        *[count(k).alias(f"n_failed_{k}") for k in names],
        kept_chars.alias("kept_chars"),
        (~failed & (kept_chars >= rules.min_kept * F.col("word_chars"))).alias("kept"),
    )


def kept_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules()
) -> DataFrame:
    """The rows of `docs` that pass, all columns, with the cleaned text; other columns ride along in one struct."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    judged = clean_lines(whole.select("row", F.col(f"row.`{id_col}`").alias("id"), F.col(f"row.`{text_col}`").alias("t")), "row", "t", rules)
    parts = [F.col("clean_text").alias(c) if c == text_col else F.col(f"doc_id.`{c}`").alias(c) for c in docs.columns]
    # a term the optimizer takes for undetermined keeps the filter above the projections; pushed
    # below them it would repeat the whole rule set inside its condition
    passed = judged.withColumn("passed", F.col("kept") & (F.spark_partition_id() >= 0))
    return passed.where("passed").select(*parts)
