"""Exact Jaccard join of documents on word n-grams by T-occurrence search.

*Order.*  A count sketch of fixed size ranks shingles by frequency (rare first).  Any order
is exact; this one keeps frequent lines and passages out of the prefixes.
*Prefixes.*  Two sets that link share at least T shingles within their prefixes of
n - ceil(t n) + T shingles, so only these are spread into inverted lists.
*Equal sets* are one class, whatever their number.
*Stars.*  In every inverted list each document is checked against one pivot, the one whose
prefix is shared most (in a group of near copies, the original).  That is linear in the
lists and links a group without its pairs.
*DivideSkip.*  Lists that still hold several components are searched: a query merges its short
lists with a heap, keeps what occurs T - L times, and probes the L longest lists by
bisection.  Candidates of another component are checked on their whole sets.

Every pair that links is either inside one component already or found by the search, so
components are exact.  Defined cases: null, empty and blank texts have no shingle and link with
nothing; with fewer than k words the whole sequence is one shingle; a null id ranks
before all others; rows that repeat an id are one node; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomcast.llm import textkit as T
from loomcast.llm.key_filter import key_filter
from loomcast.sources.lineage import materialize
from loomcast.sources.shipping import ship_package

LEAST_ID = -(1 << 63)
SKETCH_BITS = 20  # counters of the frequency sketch: 4 MB, whatever the input
SLICES = 32
BLOCK = 1024  # ids in one piece of an inverted list
MAX_T = 4


def need(n, percent: int):
    """Least overlap of a set of n shingles with any set it links with."""
    return (percent * n + 99) // 100


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of lower-cased texts, one text after another, and the offsets."""
    _, _, _, words, first = T.words_and_hashes(T.ascii_lower(texts))
    n_words = np.diff(first)
    grams = T.gram_hashes(words, k, 3)
    text_of = np.repeat(np.arange(len(texts)), n_words)
    inside = text_of[: len(grams)] == text_of[len(words) - len(grams) :] if len(grams) else np.empty(0, bool)
    hashes, owner = grams[inside], text_of[: len(grams)][inside]
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        whole = [T.gram_hashes(words[first[i] : first[i + 1]], int(n_words[i]), 11)[0] for i in short]
        hashes, owner = np.concatenate((hashes, np.array(whole, np.uint64))), np.concatenate((owner, short))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))[: len(hashes)]
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


class _Sketch:
    def __init__(self, k: int):
        self.k = k

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for _, texts in T.text_groups(batches, 1):
            hashes, _ = shingle_sets(texts, self.k)
            counts += np.bincount((hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
        for i, part in enumerate(np.split(np.minimum(counts, 2**31 - 1).astype(np.int32), SLICES)):
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "counts"])


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, np.int32).astype(np.int64) for c in rows["counts"])
    return pd.DataFrame({"slice": rows["slice"].iloc[:1], "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})


class _Sets:
    """Arrow job: size, signature and prefix of each set."""

    def __init__(self, k: int, percent: int, sketch):
        self.k, self.percent, self.sketch = k, percent, sketch

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(self.sketch.value, np.int32)
        for rows, texts in T.text_groups(batches, 1):
            hashes, first = shingle_sets(texts, self.k)
            n = np.diff(first)
            owner = np.repeat(np.arange(len(texts)), n)
            signs = []
            for seed in (1, 2):
                sums = np.concatenate(([np.uint64(0)], np.cumsum(T.mix(hashes + np.uint64(seed)))))
                signs.append(T.as_long(sums[first[1:]] - sums[first[:-1]]))
            order = np.lexsort((hashes, counts[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], owner))
            size = np.minimum(n - need(n, self.percent) + MAX_T, n)
            rank = np.arange(len(order)) - np.repeat(first[:-1], n)
            prefix = hashes[order][rank < np.repeat(size, n)]
            offsets = np.concatenate(([0], np.cumsum(size)))
            yield pa.record_batch(
                [
                    rows.column(0),
                    pa.array(n, pa.int64()),
                    *[pa.array(s) for s in signs],
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(T.as_long(prefix))),
                ],
                ["key", "n", "s1", "s2", "prefix"],
            )


class _Check:
    """Arrow job: pairs with their packed texts -> the pairs whose whole sets link."""

    def __init__(self, k: int, percent: int):
        self.k, self.percent = k, percent

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, left in T.text_groups(batches, 2, 1 << 19):
            hashes, first = shingle_sets(T.unzipped(left + rows.column(3).to_pylist()), self.k)
            sets = [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
            good = []
            for x, y in zip(sets[: len(left)], sets[len(left) :]):
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= self.percent * (len(x) + len(y) - common))
            yield rows.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def divide_skip(lists: list[list[int]], t: int, n_long: int) -> dict[int, int]:
    """Ids in at least t of the sorted lists, with their numbers of lists.

    The `n_long` longest lists (fewer than t) are only probed.
    """
    lists = sorted(lists, key=len)
    n_long = max(0, min(n_long, t - 1, len(lists) - 1))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    found: dict[int, int] = {}
    last, count = None, 0

    def settle() -> None:
        if last is None or count < t - len(long):
            return
        total = count
        for probed in long:
            at = bisect.bisect_left(probed, last)
            total += at < len(probed) and probed[at] == last
        if total >= t:
            found[last] = total

    for x in heapq.merge(*short):
        if x == last:
            count += 1
        else:
            settle()
            last, count = x, 1
    settle()
    return found


def prefix_size(n, percent: int):
    return np.minimum(n - need(n, percent) + MAX_T, n)


def sure_common(n, m, percent: int):
    """Prefix shingles that two sets of n and m shingles share if they link.

    An overlap of o leaves n - o and m - o shingles outside it, so at least this many of
    either prefix lie inside, and the prefixes follow one order.
    """
    o = -(-percent * (n + m) // (100 + percent))
    return np.minimum(prefix_size(n, percent) - (n - o), prefix_size(m, percent) - (m - o))


class _Search:
    """Arrow job: the lists of queries, sorted by query -> candidates that reach T occurrences."""

    def __init__(self, percent: int):
        self.percent = percent

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # columns a, n, token, id, m of the last query, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("ids")
            long = np.repeat(np.arange(len(ids)), pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False))
            flat = np.stack([batch.column(c).to_numpy()[long] for c in ("a", "n", "token")] + [batch.column(c).flatten().to_numpy() for c in ("ids", "sizes")])
            cut = int(np.searchsorted(flat[0], flat[0, -1]))
            if cut or (held and held[0][0, 0] != flat[0, 0]):
                yield self._found(np.concatenate([*held, flat[:, :cut]], axis=1))
                held = []
            held.append(flat[:, cut:])
        if held:
            yield self._found(np.concatenate(held, axis=1))

    def _found(self, rows: np.ndarray) -> pa.RecordBatch:
        # one search for each size of partner, as the sizes decide how many lists must agree
        a, n, token, ids, m = rows[:, np.lexsort((rows[3], rows[2], rows[4], rows[0]))]
        search = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (m[1:] != m[:-1]))))
        starts = np.concatenate(([True], token[1:] != token[:-1]))
        starts[search] = True
        t = np.maximum(1, sure_common(n[search], m[search], self.percent))
        ends = np.append(search[1:], len(a))
        enough = np.add.reduceat(starts, search, dtype=np.int64) >= t
        asking, kept = [], []
        for begin, end, least in zip(search[enough].tolist(), ends[enough].tolist(), t[enough].tolist()):
            cuts = [*(np.flatnonzero(starts[begin:end]) + begin).tolist(), end]
            found = divide_skip([ids[x:y].tolist() for x, y in zip(cuts[:-1], cuts[1:])], least, least - 1)
            kept += found
            asking += [a[begin]] * len(found)
        return pa.record_batch([pa.array(asking, pa.int64()), pa.array(kept, pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): least reachable id; edges (a, b) need not be distinct.  Alternating stars."""
    cur = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.least("u", F.min("v").over(Window.partitionBy("u")))
        large = both.select("u", "v", least.alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        m = F.min("v").over(Window.partitionBy("u"))
        small = large.select("u", "v", m.alias("m"))
        nxt = small.select(F.col("u"), F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v"), F.col("m"))).distinct()
        nxt = materialize(nxt, "links")
        if nxt.exceptAll(cur).isEmpty() and cur.exceptAll(nxt).isEmpty():
            break
        cur = nxt
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _checked(pairs: DataFrame, base: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link by their whole sets."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    # the texts in question travel: fewer bytes than their sets, and than the texts of all documents
    texts = base.where(key_filter(nodes)("key")).mapInArrow(T.zipped, "key long, z binary").dropDuplicates(["key"])
    left = texts.select(F.col("key").alias("a"), F.col("z").alias("text_a"))
    right = texts.select(F.col("key").alias("b"), F.col("z").alias("text_b"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(_Check(k, percent), "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (least id reachable by links)."""
    spark = docs.sparkSession
    ship_package(spark)
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID)).alias("key"), F.col(text_col).cast("string").alias("text")
    )
    slices = base.mapInArrow(_Sketch(k), "slice int, counts binary").groupBy("slice").applyInPandas(_add, "slice int, counts binary")
    parts = {r["slice"]: bytes(r["counts"]) for r in slices.collect()}  # 4 MB in all
    sketch = spark.sparkContext.broadcast(b"".join(parts.get(i, b"") for i in range(SLICES)) or bytes(4 << SKETCH_BITS))
    sets = materialize(base.mapInArrow(_Sets(k, percent, sketch), "key long, n long, s1 long, s2 long, prefix array<long>"), "sets")

    # equal sets are one class
    full = sets.where("n > 0")
    classes = materialize(
        full.groupBy("n", "s1", "s2").agg(F.min("key").alias("rep"), F.min_by("prefix", "key").alias("prefix")), "classes"
    )
    postings = classes.select(F.explode("prefix").alias("token"), "rep", "n")
    by_token = Window.partitionBy("token")
    shared = materialize(postings.withColumn("m", F.count("*").over(by_token)).where("m > 1").drop("m"), "lists")

    # stars: every list against the document whose prefix is shared most
    score = shared.groupBy("rep").agg((F.count("*") / F.first("n")).alias("score"))
    pivot = F.first("rep").over(by_token.orderBy(F.desc("score"), "rep").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    pivot_n = F.first("n").over(by_token.orderBy(F.desc("score"), "rep").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    fits = lambda x, y: (100 * x >= percent * y) & (100 * y >= percent * x)
    stars = (
        shared.join(score, "rep")
        .select("rep", "n", pivot.alias("p"), pivot_n.alias("pn"))
        .where(F.col("rep") != F.col("p"))
        .where(fits(F.col("n"), F.col("pn")))
        .select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b"))
        .distinct()
    )
    links = materialize(_checked(materialize(stars, "stars"), base, k, percent), "star-links")
    so_far = components(links)

    # lists with several components are searched; of two components the smaller one asks, in all lists they share
    of = materialize(so_far.union(so_far.select("component", "component")).distinct(), "components")
    sized = of.withColumn("members", F.count("*").over(Window.partitionBy("component")))
    member = shared.join(sized, F.col("rep") == F.col("node"), "left").select(
        "token",
        "rep",
        "n",
        F.coalesce("component", "rep").alias("component"),
        F.struct((-F.coalesce("members", F.lit(1))).alias("rank"), F.coalesce("component", "rep").alias("c")).alias("place"),
    )
    member = member.withColumns({"top": F.min("place").over(by_token), "low": F.max("place").over(by_token)}).where("top <> low")
    member = materialize(member.select("token", "rep", "n", (F.col("place") != F.col("top")).alias("asks")), "open-lists")
    ranked = member.withColumn("block", F.floor(F.row_number().over(by_token.orderBy("rep")) / BLOCK))
    ordered = F.array_sort(F.collect_list(F.struct("rep", "n")))
    blocks = ranked.groupBy("token", "block").agg(ordered.alias("list")).select("token", "list")
    asked = member.where("asks").select("token", F.col("rep").alias("a"), "n")
    partners = F.filter("list", lambda x: fits(x["n"], F.col("n")) & (x["rep"] != F.col("a")))
    lists = asked.join(blocks, "token").select("a", "n", "token", partners.alias("list")).where(F.size("list") > 0)
    lists = lists.select("a", "n", "token", F.col("list.rep").alias("ids"), F.col("list.n").alias("sizes"))
    found = lists.repartition("a").sortWithinPartitions("a").mapInArrow(_Search(percent), "a long, b long")
    a, b = (of.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    open_pairs = (
        found.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
        .join(a, "a", "left")
        .join(b, "b", "left")
        .where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        .select("a", "b")
    )
    more = materialize(_checked(materialize(open_pairs, "pairs"), base, k, percent), "more-links")

    # copies hang on their class, classes on their component
    same = full.select("key", "n", "s1", "s2").join(classes.drop("prefix"), ["n", "s1", "s2"])
    ids = same.where("key <> rep").select(F.col("key").alias("a"), F.col("rep").alias("b"))
    final = components(links.union(more).union(ids))
    out = sets.select("key", "n").join(final, F.col("key") == F.col("node"), "left")
    shown = lambda c: F.when(c != LEAST_ID, c)
    return out.select(
        shown(F.col("key")).alias("doc_id"), F.col("n").alias("n_shingles"), shown(F.coalesce("component", "key")).alias("component_id")
    )
