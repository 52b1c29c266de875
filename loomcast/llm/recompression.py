"""Exact removal of repeated 20-word windows by recompression.

*Parse.*  Words are renamed in rounds: runs of one symbol, and pairs of a left-class
symbol with a right-class one, become one symbol.  A name is a hash of what it stands
for and of the round, so all tasks give equal content equal names without a naming
table.  Whether two neighbours join depends on these two alone, so a symbol is fixed by
a bounded context; that context is carried along as an interval of words.

*Reveal.*  Every window picks, among the interior symbols whose whole context it holds,
the one with the least hash, from the highest round that has any; a window without one
(a long run) stands for itself.  Equal windows pick equal symbols, wherever they are.  Spark
counts the picked symbols; one that occurs once proves its windows unique.

*Verify.*  Only windows of shared symbols are compared, by 128-bit hashes of their words,
and each is judged against the earliest (id, start).

Texts of equal words are joined into one class first, so a group of exact copies costs
one row per copy whatever its size.

Defined cases: null, empty and short texts have no window and lose nothing; a null id
ranks before all others; rows that repeat id and text get equal results (neither is
earlier); rows that share only the id are judged as parts of equal rank; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomcast.llm import textkit as T
from loomcast.llm.key_filter import key_filter
from loomcast.sources.lineage import materialize
from loomcast.sources.shipping import ship_package

ROUNDS = 3
_INVERSE = np.uint64(pow(int(T._BASE), -1, 1 << 64))
_inverse_powers = np.ones(1, np.uint64)
Symbols = tuple[np.ndarray, np.ndarray, np.ndarray]


def _inverse(n: int) -> np.ndarray:
    global _inverse_powers
    if len(_inverse_powers) < n:
        size = 1 << max(8, (n - 1).bit_length())
        _inverse_powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, _INVERSE))))
    return _inverse_powers[:n]


def _interval_hashes(words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of words[lo:hi] for each interval, from prefix sums."""
    n = len(words)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(words * T.powers(n))))
    return T.mix((sums[hi] - sums[lo]) * _inverse(n)[lo] + (hi - lo).astype(np.uint64))


def parse_rounds(words: np.ndarray, text_of: np.ndarray, rounds: int = ROUNDS) -> list[Symbols]:
    """From the last round to the first: names and contexts [lo, hi) of the symbols of many texts.

    `text_of`: the text of each word, ascending.  Symbols whose context reaches past an
    end of their text are left out.
    """
    n = len(words)
    sym, lo, hi, text = words, np.arange(n), np.arange(1, n + 1), text_of
    out = []
    for r in range(rounds):
        side = (T.mix(sym + np.uint64(r + 1)) & np.uint64(1)).astype(bool)  # True: right class
        same = text[:-1] == text[1:]
        joins = same & ((sym[:-1] == sym[1:]) | (~side[:-1] & side[1:]))
        first = np.flatnonzero(np.concatenate(([True], ~joins)))
        last = np.concatenate((first[1:], [len(sym)])) - 1
        local = np.arange(len(sym)) - np.repeat(first, last - first + 1)
        named = np.add.reduceat(sym * T.powers(int(local.max()) + 1)[local], first)
        name = np.where(first == last, sym[first], T.mix(named + np.uint64(r + 1)))
        # a block is fixed by its neighbours of the round before; at an end of the text it has none
        before, after = np.concatenate(([False], same))[first], np.concatenate((same, [False]))[last]
        lo, hi = np.where(before, lo[first - 1], -1), np.where(after, hi[(last + 1) % len(hi)], n + 1)
        sym, text = name, text[first]
        inside = (lo >= 0) & (hi <= n)
        out.append((sym[inside], lo[inside], hi[inside]))
    return out[::-1]


def pick_symbols(words: np.ndarray, first_word: np.ndarray, width: int, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """(hash, text, first window in the text, number of windows) of the symbols that windows pick."""
    n = len(words) - width + 1
    text_of = np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))
    if n <= 0:
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    start = np.flatnonzero(text_of[:n] == text_of[width - 1 :])
    picked = np.zeros(len(start), np.uint64)
    place = -1 - start  # which occurrence: a window for itself, or a symbol of a round
    todo = np.ones(len(start), bool)
    for level, (sym, lo, hi) in enumerate(parse_rounds(words, text_of, rounds)[:-1]):
        if not len(sym):
            continue
        # a symbol counts together with its context
        full = T.mix(_interval_hashes(words, lo, hi) ^ (sym + np.uint64(level)))
        begin, end = np.searchsorted(lo, start), np.searchsorted(hi, start + width, "right")
        best_at = np.minimum(begin, len(full) - 1)
        for k in range(1, int((end - begin).max(initial=0))):
            at = np.minimum(begin + k, len(full) - 1)
            best_at = np.where((begin + k < end) & (full[at] < full[best_at]), at, best_at)
        here = todo & (end > begin)
        picked[here] = full[best_at[here]]
        place[here] = (level * len(words)) + best_at[here]
        todo &= ~here
    if todo.any():
        picked[todo] = T.gram_hashes(words, width, 5)[start[todo]]
    text = text_of[start]
    change = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(np.concatenate(([True], change))[: len(start)])
    count = np.diff(np.concatenate((head, [len(start)])))
    return picked[head], text[head], start[head] - first_word[text[head]], count

LEAST_ID = -(1 << 63)
_PARSED = (
    "key long, sha string, n_words long, symbols array<long>, twice array<boolean>, "
    "starts array<int>, counts array<int>"
)
_WINDOWS = "key long, tag int, start int, n int, w1 long, w2 long, known boolean"


def _joined(text: bytes) -> bytes:
    return b" ".join(text.split())


def _tag32(sha: str) -> int:
    return int.from_bytes(bytes.fromhex(sha[:8]), "little", signed=True)


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


class _Parser:
    """Arrow job: texts to fingerprints and picked symbols."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in T.text_groups(batches, 1):
            shas = [hashlib.sha256(_joined(t)).hexdigest() for t in texts]
            _, _, _, words, first = T.words_and_hashes(texts)
            hashed, text, start, count = pick_symbols(words, first, self.width)
            order = np.lexsort((hashed, text))
            same = (hashed[order][1:] == hashed[order][:-1]) & (text[order][1:] == text[order][:-1])
            twice = np.zeros(len(hashed), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            at = np.searchsorted(text, np.arange(len(texts) + 1))
            yield pa.record_batch(
                [
                    rows.column(0),
                    pa.array(shas, pa.string()),
                    pa.array(np.diff(first), pa.int64()),
                    _lists(T.as_long(hashed), at, pa.int64()),
                    _lists(twice, at, pa.bool_()),
                    _lists(start, at, pa.int32()),
                    _lists(count, at, pa.int32()),
                ],
                ["key", "sha", "n_words", "symbols", "twice", "starts", "counts"],
            )


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            yield part, T.unzipped(part.column("z").to_pylist())


class _Windows:
    """Arrow job: windows of shared symbols; those that repeat inside the block are decided here."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _blocks(batches):
            keys, shas = np.array(rows.column("key")), rows.column("sha").to_pylist()
            spans = rows.column("spans").to_pylist()
            _, _, _, words, first = T.words_and_hashes(texts)
            w1, w2 = T.gram_hashes(words, self.width, 1), T.gram_hashes(words, self.width, 2)
            place, text = [], []
            for i, (begin, end) in enumerate(zip(first[:-1], first[1:])):
                if hashlib.sha256(_joined(texts[i])).hexdigest() != shas[i]:
                    continue  # another row with this id
                take = [np.arange(s >> 32, (s >> 32) + (s & 0xFFFFFFFF)) for s in spans[i]]
                take = np.unique(np.concatenate(take)) if take else np.empty(0, np.int64)
                take = take[take <= end - begin - self.width]
                place.append(take + begin)
                text.append(np.full(len(take), i))
            if not place or not sum(map(len, place)):
                continue
            place, text = np.concatenate(place), np.concatenate(text)
            key, start = keys[text], place - first[text]
            h1, h2 = w1[place], w2[place]
            order = np.lexsort((start, key, h2, h1))
            o1, o2 = h1[order], h2[order]
            again = np.concatenate(([False], (o1[1:] == o1[:-1]) & (o2[1:] == o2[:-1])))
            # later than the first of its group in (id, start): decided
            head = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
            later = (key[order] != key[order][head]) | (start[order] != start[order][head])
            known = np.zeros(len(order), bool)
            known[order] = again & later
            new_run = np.concatenate(([True], (place[1:] != place[:-1] + 1) | ~known[1:] | ~known[:-1] | (text[1:] != text[:-1])))
            at = np.flatnonzero(new_run)
            size = np.diff(np.concatenate((at, [len(place)])))
            spread = T.mix(place.astype(np.uint64) + h1)
            yield pa.record_batch(
                [
                    pa.array(key[at], pa.int64()),
                    pa.array([_tag32(shas[i]) for i in text[at]], pa.int32()),
                    pa.array(start[at], pa.int32()),
                    pa.array(size, pa.int32()),
                    pa.array(T.as_long(np.where(known[at], spread[at], h1[at])), pa.int64()),
                    pa.array(T.as_long(h2[at]), pa.int64()),
                    pa.array(known[at]),
                ],
                ["key", "tag", "start", "n", "w1", "w2", "known"],
            )


class _Cutter:
    """Arrow job: removed word ranges and what is left of each text."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _blocks(batches):
            out = []
            for key, tag, cuts, text in zip(
                rows.column("key").to_pylist(), rows.column("tag").to_pylist(), rows.column("cuts").to_pylist(), texts
            ):
                words = text.split()
                sha = hashlib.sha256(b" ".join(words)).hexdigest()
                if _tag32(sha) != tag:
                    continue
                edge = np.zeros(len(words) + self.width + 1, np.int64)
                s = np.array([c["start"] for c in cuts])
                np.add.at(edge, s, 1)
                np.add.at(edge, s + np.array([c["n"] for c in cuts]) - 1 + self.width, -1)
                gone = np.cumsum(edge)[: len(words)] > 0
                turn = np.flatnonzero(np.diff(gone, prepend=False, append=False))
                left = [w for w, g in zip(words, gone.tolist()) if not g]
                ranges = [{"from": int(a), "to": int(b)} for a, b in zip(turn[0::2], turn[1::2])]
                out.append((key, sha, int(gone.sum()), hashlib.sha256(b" ".join(left)).hexdigest(), ranges))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))]
            yield pa.record_batch(
                [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["key", "sha", "n_removed", "kept_sha", "removed"]
            )


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept_sha256, removed (word ranges), words_sha256."""
    ship_package(docs.sparkSession)
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID)).alias("key"), F.col(text_col).cast("string").alias("text")
    )
    parsed = materialize(base.mapInArrow(_Parser(width), _PARSED), "repeats-parsed")
    light = parsed.select("key", "sha", "n_words")
    classes = light.groupBy("sha").agg(F.min("key").alias("first_key"))

    # one row per symbol of a text; where in the text is packed beside it
    each = parsed.select("key", F.explode(F.arrays_zip("symbols", "twice", "starts", "counts")).alias("s"))
    where = F.shiftleft(F.col("s.starts").cast("long"), 32) + F.col("s.counts")
    each = each.select("key", F.col("s.symbols").alias("symbol"), F.col("s.twice").alias("twice"), where.alias("at"))
    shared = (
        each.groupBy("symbol")
        .agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.max("twice").alias("twice"))
        .where("lo <> hi or twice")
        .select("symbol")
    )
    spans = each.select("symbol", "key", "at").join(shared, "symbol").groupBy("key").agg(F.collect_set("at").alias("spans"))
    to_see = materialize(classes.select(F.col("first_key").alias("key"), "sha").join(spans, "key"), "repeats-spans")
    # texts without a shared symbol stay where they are
    zipped = base.where(key_filter(to_see)("key")).mapInArrow(T.zipped, "key long, z binary")
    seen = zipped.join(to_see, "key").dropDuplicates(["key", "sha", "z"]).select("key", "z", "sha", "spans")
    seen = materialize(seen, "repeats-seen")
    windows = seen.mapInArrow(_Windows(width), _WINDOWS)

    place = F.struct("key", "start")
    first = F.min(place).over(Window.partitionBy("w1", "w2"))
    late = windows.select("*", (F.col("known") | (place > first)).alias("late")).where("late")
    cuts = late.groupBy("key", "tag").agg(F.collect_list(F.struct("start", "n")).alias("cuts"))
    cut = seen.dropDuplicates(["key", "sha"]).join(cuts, "key").select("key", "z", "tag", "cuts").mapInArrow(
        _Cutter(width), "key long, sha string, n_removed long, kept_sha string, removed array<struct<from:int,to:int>>"
    )
    cut = cut.dropDuplicates(["key", "sha"])

    copy = (F.col("first_key") < F.col("key")) & (F.col("n_words") >= width)
    whole = F.array(F.struct(F.lit(0).alias("from"), F.col("n_words").cast("int").alias("to")))
    none = F.array().cast("array<struct<from:int,to:int>>")
    out = light.join(classes.select("sha", "first_key"), "sha").join(cut, ["key", "sha"], "left")
    return out.select(
        F.when(F.col("key") != LEAST_ID, F.col("key")).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("removed", none)).alias("removed"),
        F.col("sha").alias("words_sha256"),
    )


def cut_words(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The text without word ranges; a removed word takes the blanks behind it along."""
    _, starts, _, _, _ = T.words_and_hashes([text])
    edges = np.concatenate((starts, [len(text)]))
    out, at = [], 0
    for a, b in sorted(ranges):
        out.append(text[at : edges[a]])
        at = edges[b]
    return b"".join([*out, text[at:]])


def _cut_job(text_at: int):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in T.text_groups(batches, text_at):
            cuts = rows.column(rows.num_columns - 1).to_pylist()
            given = rows.column(text_at).to_pylist()
            out = []
            for old, text, entries in zip(given, texts, cuts):
                sha = hashlib.sha256(_joined(text)).hexdigest() if entries else ""
                ranges = next((e["removed"] for e in entries or [] if e["words_sha256"] == sha), None)
                out.append(cut_words(text, [(r["from"], r["to"]) for r in ranges]).decode() if ranges else old)
            columns = [pa.array(out, pa.string()) if i == text_at else rows.column(i) for i in range(rows.num_columns - 1)]
            yield pa.record_batch(columns, rows.schema.names[:-1])

    return job


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """`docs`, all columns, with the repeated windows cut out of the texts."""
    found = repeated_windows(docs, id_col, text_col, width).where("n_removed > 0")
    cuts = found.groupBy(F.coalesce("doc_id", F.lit(LEAST_ID)).alias("key")).agg(F.collect_set(F.struct("words_sha256", "removed")).alias("cuts"))
    names = [f"c{i}" for i in range(len(docs.columns))]  # names of the library's own, whatever the columns are called
    rows = docs.toDF(*names)
    key = F.coalesce(F.col(names[docs.columns.index(id_col)]).cast("long"), F.lit(LEAST_ID))
    cuts = materialize(cuts, "repeats-cuts")
    # rows that lose nothing stay where they are
    cut = key_filter(cuts)
    keyed = rows.withColumn("row_key", key)
    asked = keyed.where(cut("row_key")).join(cuts, F.col("row_key") == F.col("key"), "left").select(*names, "cuts")
    text_at = docs.columns.index(text_col)
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    done = asked.mapInArrow(_cut_job(text_at), schema)
    return keyed.where(~cut("row_key")).select(*names).unionByName(done).toDF(*docs.columns)
