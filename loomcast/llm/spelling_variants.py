"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters.

A word's letters with their running numbers (the second `e` is another element than the first) are a
binary vector.  One edit changes at most two elements, so vectors of near words have Hamming distance at most
two.  The elements are dealt to `PARTS` parts; leaving out each pair of parts in turn gives the signatures, and
near words share one.  An edit leaves the first or the last `END` letters of a word as they are, so
each signature is keyed by either.  An equi-join on keys gives candidates, and an edit distance of one verifies them.
Of the keys that a pair shares the join keeps one, so that a pair comes once and nothing needs to be made distinct.

Only distinct words meet, never their occurrences: counts are summed before the exchange, and a frequent word is one row.

Defined cases: a null text has no words, a null id counts as an empty one; equal rows count as often as they occur; very
long texts are read whole; words shorter than 2 * END + 1 letters have no near words; an empty
table gives an empty table; columns other than the id and the text are neither read nor returned.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcast.sources.lineage import materialize

LETTERS = r"[A-Za-zÀ-ÿ]"
PARTS, END = 5, 3
# fixed value: letters by falling frequency in English text; neighbours go to different parts
FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and each maximal run of at least `min_chars` letters, A-Z in lower case."""
    found = docs.select(
        F.col(id_col).alias("doc_id"),
        F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"{LETTERS}{{{min_chars},}}+"), F.lit(0))).alias("run"),
    )
    # most runs have no capital
    lowered = F.when(F.col("run") == F.lower("run"), F.col("run")).otherwise(F.translate("run", _UPPER, _LOWER))
    return found.select("doc_id", lowered.alias("run"))


def without_letter(word: Column, at: Column) -> Column:
    """The word without its code point number `at` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), at.cast("int")), F.substring(word, at.cast("int") + 2, F.length(word)))


def counted(words: DataFrame, min_chars: int, min_count: int) -> DataFrame:
    """Distinct words of at least `min_chars` code points with at least `min_count` occurrences: word, n."""
    return words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def parts_of(word: Column) -> Column:
    """Hashes of the `PARTS` parts of a word's letters."""
    rank = lambda c: F.when(F.instr(F.lit(FREQUENT), c) > 0, F.instr(F.lit(FREQUENT), c)).otherwise(F.ascii(c))

    def placed(letters: Column) -> Column:
        def element(c: Column, i: Column) -> Column:
            number = i + 1 - F.array_position(letters, c)
            return F.struct(F.pmod(rank(c) + 3 * number, F.lit(PARTS)).cast("int").alias("part"), c.alias("c"), number.alias("number"))

        return F.transform(letters, element)

    def hashed(elements: Column) -> Column:
        of = lambda part: F.xxhash64(F.filter(elements, lambda e: e["part"] == part))
        return F.array(*[of(p) for p in range(PARTS)])

    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    return once(once(F.array_sort(F.split(word, "")), placed), hashed)


def signatures(words: DataFrame) -> DataFrame:
    """key, x, y (hashes of the parts left out), mark and the word's columns, a row per signature and end.

    A pair of words shares several keys: where one part differs, all that leave it out.  `mark` has the
    end in its lowest bit and whether the key stands for a pair that differs in x or in y alone.
    """
    rows = words.where(F.length("word") > 2 * END).withColumn("parts", parts_of(F.col("word")))
    ends = (F.substring("word", 1, END), F.substring("word", -END, END))
    out = []
    for i, (p, q) in enumerate(combinations(range(PARTS), 2)):
        kept = [F.get("parts", F.lit(k)) for k in range(PARTS) if k not in (p, q)]
        for kind, end in enumerate(ends):
            mark = kind + 2 * (p == 0 and q == 1) + 4 * (p == 0)
            out.append(F.struct(F.xxhash64(F.lit(2 * i + kind), end, *kept).alias("key"), F.get("parts", F.lit(p)).alias("x"), F.get("parts", F.lit(q)).alias("y"), F.lit(mark).cast("tinyint").alias("mark")))
    return rows.select("word", "n", F.inline(F.array(*out)))


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs of words exactly one inserted, deleted or replaced code point apart, each once: a, n_a, b, n_b."""
    rows = signatures(words)
    a, b = rows.alias("a"), rows.alias("b")
    x, y = F.col("a.x") != F.col("b.x"), F.col("a.y") != F.col("b.y")
    bit = lambda k: F.col("a.mark").bitwiseAND(F.lit(k).cast("tinyint")) > 0
    first_key = (x & y) | (x & bit(2)) | (y & bit(4))
    first_end = ~bit(1) | (F.substring("a.word", 1, END) != F.substring("b.word", 1, END))
    close = (F.col("a.word") < F.col("b.word")) & (F.abs(F.length("a.word") - F.length("b.word")) <= 1)
    near = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    # `mark` follows from the key; asked for on both sides, it lets them share one exchange
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.mark") == F.col("b.mark"))
    joined = a.join(b, same & close & first_key & first_end & near)
    return joined.select(F.col("a.word").alias("a"), F.col("a.n").alias("n_a"), F.col("b.word").alias("b"), F.col("b.n").alias("n_b"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) followed to the last form: word, root.  Each round doubles the steps taken."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if not moved.where("moved").take(1):
            return at


def group_variants(words: DataFrame, times: int = 10) -> DataFrame:
    """Per word of (word, n): its form (the most frequent near word, if `times` as frequent), root, and counts.

    Columns: word, n, form, root, n_near, form_n.  Forms grow by a factor at each step, so chains are short.
    """
    words = materialize(words.select("word", "n"), "vocabulary")
    pairs = near_pairs(words)
    way = lambda word, other, m: F.struct(F.col(word).alias("word"), F.col(other).alias("other"), F.col(m).alias("m"))
    both = pairs.select(F.inline(F.array(way("a", "b", "n_b"), way("b", "a", "n_a"))))
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("other")))  # of equally frequent words the smallest
    most = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    most = most.select("word", "n_near", (-F.col("best.m")).alias("m"), F.col("best.other").alias("best"))
    rows = words.join(most, "word", "left")
    has = F.col("m") >= times * F.col("n")
    rows = materialize(rows.select("word", "n", F.when(has, F.col("best")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("m")).alias("form_n")), "forms")
    ends = roots(rows.where("form is not null").select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")

