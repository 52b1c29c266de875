"""Hard negatives of anchors among labelled vectors, read from Hilbert-ordered blocks by their zone maps.

*Layout.*  Rows are range-sorted by label and place on a Hilbert curve and cut into blocks of at
most `BLOCK` rows of one label, one Parquet row each: ids, packed integer vectors, and the least and greatest
value of every dimension (the zone map).  Reading zone maps leaves the vectors on disk.

*Search.*  A window asks for the first k rows whose score (integer inner product with the
anchor) lies in an interval.  Interval arithmetic on a zone map bounds the scores of a block.  Blocks that lie
inside a window raise its lower end to what they guarantee; only blocks whose bounds then meet a
window of some anchor are read, and a task drops a block again once its running k-th score is above
the bound.  Positives are windows on the anchor's own label, negatives windows on all others.

A task meets one group of blocks (`GROUP_ROWS` rows) and one slot of anchors (about `SLOT`), whatever the label, so a label
with a third of all rows is many groups.  Each task passes on at most k rows of a window.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no
part, nor do rows with a component of 2^19 or more, whose scores would not fit a long; equal rows count once; rows of one id
that differ are different rows; vectors of unlike length have no score; ties go to the smaller id; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcast.sources.lineage import materialize
from loomcast.sources.shipping import ship_package

BLOCK = 512
GROUP_ROWS = 65536
SLOT = 4096
BITS = 4  # of each dimension in the place on the curve
LARGEST = float(1 << 19)
LOWEST, HIGHEST = -(1 << 62), 1 << 62

_BLOCKS = (
    "group int, block int, label long, dim int, n int, lo array<long>, hi array<long>, "
    "ids array<long>, vectors array<long>"
)
_FOUND = "a_id long, a_sig long, w int, id long, score long"


def prepare(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label and v (floor of 256 times each component) of the rows that take part."""
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)
    out = rows.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("long").alias("label"),
        F.col(vec_col).cast("array<double>").alias("v"),
    ).where("vec_id is not null and label is not null and v is not null")
    return out.where(F.forall("v", usable)).withColumn("v", F.transform("v", lambda x: F.floor(256 * x).cast("long")))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of `cells` (values below 2^bits), as bytes that sort alike."""
    x = np.ascontiguousarray(cells.T).astype(np.uint8)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(len(x)):
            flip = (x[i] & q) > 0
            t = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1)).astype(np.uint8)
            x[0] ^= np.where(flip, q - 1, t).astype(np.uint8)
            x[i] ^= t
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint8)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        t ^= np.where((x[-1] & q) > 0, q - 1, 0).astype(np.uint8) if len(x) else 0
    x ^= t
    levels = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(levels).T, axis=1)


def _matrix(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists and their sizes."""
    return lists.flatten().to_numpy(zero_copy_only=False), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)


def _with_keys(low: int, high: int):
    scale = max(1, high - low + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes = _matrix(batch.column("v"))
            at = np.concatenate(([0], np.cumsum(sizes)))
            keys: list[bytes] = [b""] * len(sizes)
            for d in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero(sizes == d)
                block = values[at[rows][:, None] + np.arange(d)]
                for i, key in zip(rows, hilbert_keys(((block - low) << BITS) // scale, BITS)):
                    keys[i] = key.tobytes()
            columns = [batch.column(n) for n in ("vec_id", "label", "v")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int32()), pa.array(keys, pa.binary())], ["vec_id", "label", "v", "dim", "key"])

    return run


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at most `most` consecutive rows of one label and dimension; equal neighbours once."""
    context = TaskContext.get()
    group, number, last = context.partitionId() if context else 0, 0, None
    kept: list[tuple] = []

    def block() -> pa.RecordBatch:
        nonlocal number, kept
        kept.sort(key=lambda r: r[2])
        label, dim = kept[0][:2]
        v = np.array([r[3] for r in kept], np.int64).reshape(len(kept), dim)
        row = {"group": group, "block": number, "label": label, "dim": dim, "n": len(kept)}
        row |= {"lo": v.min(axis=0).tolist(), "hi": v.max(axis=0).tolist(), "ids": [r[2] for r in kept], "vectors": v.ravel().tolist()}
        number, kept = number + 1, []
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 4]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row.values(), kinds)], list(row))

    for batch in batches:
        values, sizes = _matrix(batch.column("v"))
        at = np.concatenate(([0], np.cumsum(sizes)))
        ids, labels = batch.column("vec_id").to_pylist(), batch.column("label").to_pylist()
        for i, (a, z) in enumerate(zip(at, at[1:])):
            row = (labels[i], int(z - a), ids[i], values[a:z])
            if last is not None and row[:3] == last[:3] and np.array_equal(row[3], last[3]):
                continue
            if kept and (len(kept) == most or row[:2] != kept[0][:2]):
                yield block()
            kept.append(row)
            last = row
    if kept:
        yield block()


def write_blocks(rows: DataFrame, most: int = BLOCK, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Blocks of the rows of `prepare`, written and read back."""
    span = rows.agg(F.count("*").alias("n"), F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi")).first()
    parts = max(1, -(-span["n"] // group_rows), min(-(-span["n"] // 8192), 128))
    keyed = rows.mapInArrow(_with_keys(span["lo"] or 0, span["hi"] or 0), "vec_id long, label long, v array<long>, dim int, key binary")
    order = ["label", "dim", "key", "vec_id", "v"]
    return materialize(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(lambda rows: _cut(rows, most), _BLOCKS), "hilbert-blocks")


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integers: in doubles where all sums fit, else in 64-bit integers."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if float(most) < 2.0**52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def bounds(vectors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that rows of each zone can have with each vector."""
    up, down = np.maximum(vectors, 0), np.minimum(vectors, 0)
    return _product(up, lo) + _product(down, hi), _product(up, hi) + _product(down, lo)


class _Asks:
    """Anchors of one dimension in a task, and their windows one after another."""

    def __init__(self, frame: pd.DataFrame):
        self.frame = frame
        self.vectors = np.stack(frame["v"].to_numpy()).astype(np.int64)
        self.labels = frame["label"].to_numpy()
        sizes = np.array([len(x) for x in frame["low"]], np.int64)
        self.of = np.repeat(np.arange(len(frame)), sizes)  # anchor of each window
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        join = lambda name: np.concatenate([np.asarray(x, np.int64) for x in frame[name]]) if len(frame) else np.empty(0, np.int64)
        self.w, self.low, self.high = join("w"), join("low"), join("high")

    def met(self, zones: pd.DataFrame, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of all anchors and zones, and whether their labels suit."""
        lo, hi = (np.stack(zones[c].to_numpy()).astype(np.int64) for c in ("lo", "hi"))
        least, most = bounds(self.vectors, lo, hi)
        return least, most, (self.labels[:, None] == zones["label"].to_numpy()[None, :]) == same

    def keys(self, windows: np.ndarray) -> dict[str, np.ndarray]:
        at = self.of[windows]
        return {"a_id": self.frame["a_id"].to_numpy()[at], "a_sig": self.frame["a_sig"].to_numpy()[at], "w": self.w[windows]}


def _by_dimension(zones: pd.DataFrame, asks: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, _Asks]]:
    sizes = asks["v"].map(len).to_numpy() if len(asks) else np.empty(0, np.int64)
    for d, part in zones.groupby("dim"):
        if (sizes == d).any():
            yield part, _Asks(asks[sizes == d])


def _guarantees(same: bool, k: int):
    """Per window, a score that k rows of this group of blocks reach inside it."""

    def run(zones: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, ask in _by_dimension(zones, asks):
            least, most, suits = ask.met(part, same)
            inside = suits[ask.of] & (least[ask.of] >= ask.low[:, None]) & (most[ask.of] <= ask.high[:, None])
            value = np.where(inside, least[ask.of], LOWEST)
            order = np.argsort(-value, axis=1, kind="stable")
            value = np.take_along_axis(value, order, axis=1)
            rows = np.cumsum(np.where(value > LOWEST, part["n"].to_numpy()[order], 0), axis=1)
            enough = rows >= k + same  # the anchor itself may be one of them
            hit = np.flatnonzero(enough.any(axis=1))
            out.append(pd.DataFrame(ask.keys(hit) | {"t": value[hit, enough[hit].argmax(axis=1)]}))
        return pd.concat(out) if out else pd.DataFrame({"a_id": [], "a_sig": [], "w": [], "t": []}).astype("int64")

    return run


def _wanted(same: bool):
    """Blocks that some window of the slot may take a row from."""

    def run(key: tuple, zones: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = [np.empty(0, np.int64)]
        for part, ask in _by_dimension(zones, asks):
            least, most, suits = ask.met(part, same)
            hit = suits[ask.of] & (most[ask.of] >= ask.low[:, None]) & (least[ask.of] <= ask.high[:, None])
            out.append(part["block"].to_numpy()[hit.any(axis=0)])
        return pd.DataFrame({"group": key[0], "slot": key[1], "block": np.concatenate(out).astype(np.int64)})

    return run


def _first_rows(same: bool, k: int):
    """First k rows of every window in this group of blocks, best-bounded blocks first."""

    def run(blocks: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a_id": [], "a_sig": [], "w": [], "id": [], "score": []}).astype("int64")]
        for part, ask in _by_dimension(blocks, asks):
            least, most, suits = ask.met(part, same)
            low, none = ask.low.copy(), np.empty(0, np.int64)
            got = (none, none, none)  # window, score, id
            a_ids = ask.frame["a_id"].to_numpy()
            for b in np.argsort(-np.where(suits, most, LOWEST).max(axis=0), kind="stable"):
                open_ = suits[ask.of, b] & (most[ask.of, b] >= low) & (least[ask.of, b] <= ask.high)
                anchors = np.unique(ask.of[open_])
                if not len(anchors):
                    continue
                row = part.iloc[int(b)]
                ids, vectors = np.asarray(row["ids"], np.int64), np.asarray(row["vectors"], np.int64).reshape(row["n"], row["dim"])
                scores = _product(ask.vectors[anchors], vectors)
                windows = np.flatnonzero(open_)
                of = np.searchsorted(anchors, ask.of[windows])
                floor, ceiling = (np.full(len(anchors), x) for x in (HIGHEST, LOWEST))
                np.minimum.at(floor, of, low[windows])
                np.maximum.at(ceiling, of, ask.high[windows])
                a, j = np.nonzero((scores >= floor[:, None]) & (scores <= ceiling[:, None]))
                if same:
                    own = ids[j] == a_ids[anchors[a]]
                    own[own] = (vectors[j[own]] == ask.vectors[anchors[a[own]]]).all(axis=1)
                    a, j = a[~own], j[~own]
                # every hit beside the windows of its anchor
                sizes = np.diff(ask.first)[anchors[a]]
                at = np.repeat(ask.first[anchors[a]] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
                score, ident = np.repeat(scores[a, j], sizes), np.repeat(ids[j], sizes)
                fits = (score >= low[at]) & (score <= ask.high[at])
                w, s, i = (np.concatenate(x) for x in zip(got, (at[fits], score[fits], ident[fits])))
                order = np.lexsort((i, -s, w))
                w, s, i = w[order], s[order], i[order]
                rank = np.arange(len(w)) - np.searchsorted(w, w)
                low[w[rank == k - 1]] = s[rank == k - 1]
                got = tuple(x[rank < k] for x in (w, s, i))
            out.append(pd.DataFrame(ask.keys(got[0]) | {"id": got[2], "score": got[1]}))
        return pd.concat(out)

    return run


def first_in_windows(blocks: DataFrame, asks: DataFrame, slots: int, same: bool, k: int) -> DataFrame:
    """The first k rows of every window, by falling score, then id.

    `asks`: slot, a_id, a_sig, label, v, and the arrays w, low, high (number and ends of each window).  `same`:
    rows of the anchor's label, else rows of other labels.  Returns a_id, a_sig, w, rank, id, score.
    """
    groups = (blocks.agg(F.max("group")).first()[0] or 0) + 1  # at most GROUP_ROWS rows each
    zones = blocks.select("group", "block", "label", "dim", "n", "lo", "hi")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))

    def meet(left: DataFrame, right: DataFrame):
        sides = left.withColumn("slot", everywhere) if "slot" not in left.columns else left
        return sides.groupBy("group", "slot").cogroup(right.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).groupBy("group", "slot"))

    sure = meet(zones, asks).applyInPandas(_guarantees(same, k), "a_id long, a_sig long, w int, t long")
    sure = sure.groupBy("a_id", "a_sig", "w").agg(F.max("t").alias("t")).groupBy("a_id", "a_sig").agg(F.map_from_entries(F.collect_list(F.struct("w", "t"))).alias("sure"))
    raised = F.zip_with("w", "low", lambda w, low: F.greatest(low, F.coalesce(F.try_element_at("sure", w), low)))
    asks = materialize(asks.join(sure, ["a_id", "a_sig"], "left").withColumn("low", raised).drop("sure"), "windows")
    wanted = materialize(meet(zones, asks).applyInPandas(_wanted(same), "group int, slot int, block int"), "wanted-blocks")
    read = blocks.join(wanted, ["group", "block"])
    found = meet(read, asks).applyInPandas(_first_rows(same, k), _FOUND)
    best = Window.partitionBy("a_id", "a_sig", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _down(x: Column) -> Column:
    """x / 100 rounded down, in integers."""
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    block_rows: int = BLOCK,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """For each anchor (`is_anchor`, of vec_id) and each of its first positives, the first negatives in the window.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank.
    """
    ship_package(rows.sparkSession)
    usable = prepare(rows, id_col, vec_col, label_col)
    blocks = write_blocks(usable, block_rows, group_rows)
    anchors = usable.where(is_anchor).dropDuplicates(["vec_id", "label", "v"])
    anchors = materialize(anchors.select(F.col("vec_id").alias("a_id"), F.xxhash64("label", "v").alias("a_sig"), "label", "v"), "anchors")
    slots = max(1, -(-anchors.count() // SLOT))
    anchors = anchors.withColumn("slot", F.pmod(F.xxhash64("a_id", "a_sig"), F.lit(slots)).cast("int"))
    of = lambda value, kind: F.array(F.lit(value).cast(kind))
    asks = anchors.select("*", of(1, "int").alias("w"), of(LOWEST + 1, "long").alias("low"), of(HIGHEST, "long").alias("high"))
    near = materialize(first_in_windows(blocks, asks, slots, True, positives).select("a_id", "a_sig", F.col("rank").alias("w"), F.col("id").alias("p"), F.col("score").alias("p_score")), "positives")
    ends = near.select(
        "a_id", "a_sig", F.struct("w", (-_down(-low_percent * F.col("p_score"))).alias("low"), _down(high_percent * F.col("p_score")).alias("high")).alias("x")
    ).where("x.low <= x.high")
    windows = ends.groupBy("a_id", "a_sig").agg(F.array_sort(F.collect_list("x")).alias("x"))
    asks = anchors.join(windows, ["a_id", "a_sig"]).select("*", "x.w", "x.low", "x.high").drop("x")
    far = first_in_windows(blocks, asks, slots, False, negatives)
    return far.join(near, ["a_id", "a_sig", "w"]).select(
        F.col("a_id").alias("anchor_id"),
        F.col("p").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        F.col("p_score").alias("positive_score"),
        F.col("score").alias("negative_score"),
        F.col("w").alias("positive_rank"),
    )
