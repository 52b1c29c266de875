"""Best-fit packing of token sequences after dominance reduction.

Documents longer than a sequence are cut; the first piece takes the remainder.  Only the
number of pieces of each length decides how to pack, at most `capacity` numbers whatever
the size of the corpus, so the plan is made from the histogram: Martello and Toth's
dominance rules fix sets of one, two or three pieces that no other set around
their largest piece can beat, and what is left is packed best-fit, longest first.  The plan
is a short list of fillings with multiplicities; each piece finds its place from
its rank among the pieces of its length, which needs no global sort.

Defined cases: a null or empty text is its end id; equal rows are pieces of their own; a
null id is kept; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomcast.llm.textkit import text_groups
from loomcast.llm.tokens import encoder
from loomcast.sources.lineage import materialize
from loomcast.sources.shipping import ship_package

Filling = tuple[int, ...]  # lengths in one sequence, longest first
_PIECE_SQL = "task int, doc_id long, piece int, start long, length int, rank long, ids_crc32 long"


def _best_pair(have: list[int], counts: dict[int, int], room: int) -> tuple[int, int] | None:
    """Two pieces (a >= b) of the largest sum within `room`."""
    best, j = None, len(have) - 1
    for a in have:
        while j >= 0 and a + have[j] > room:
            j -= 1
        if j < 0:
            break
        b = have[j]
        if a == b and counts[a] < 2:
            if j == 0:
                continue
            b = have[j - 1]
        if best is None or a + b > sum(best):
            best = (max(a, b), min(a, b))
    return best


def _smallest(have: list[int], counts: dict[int, int], k: int) -> list[int]:
    out: list[int] = []
    for w in have:
        out += [w] * min(counts[w], k - len(out))
        if len(out) == k:
            break
    return out


def _dominating(j: int, counts: dict[int, int], capacity: int) -> Filling | None:
    """A filling around a piece of length j that dominates all others, if one of up to three pieces does."""
    room = capacity - j
    left = dict(counts)
    left[j] -= 1
    have = sorted(w for w, n in left.items() if n and w <= room)
    if not have:
        return (j,)
    top = have[-1]
    low = _smallest(have, left, 3)
    if top == room or len(low) < 2 or low[0] + low[1] > room:
        return (j, top)
    if len(low) == 3 and sum(low) <= room:
        return None
    pair = _best_pair(have, left, room)
    if pair is None or top >= sum(pair):
        return (j, top)
    a, b = pair
    above = _smallest([w for w in have if w > b], left, 2)
    if a == top and (len(above) < 2 or sum(above) > room):
        return (j, a, b)
    return None


def dominance_reduction(counts: dict[int, int], capacity: int) -> tuple[Counter, dict[int, int]]:
    """Fillings fixed for good, with multiplicities, and the counts that are left."""
    left = {w: n for w, n in counts.items() if n}
    fixed: Counter = Counter()
    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                filling = _dominating(j, left, capacity)
                if filling is None:
                    break
                need = Counter(filling)
                times = min(left[w] // n for w, n in need.items())
                fixed[filling] += times
                for w, n in need.items():
                    left[w] -= n * times
                changed = True
        left = {w: n for w, n in left.items() if n}
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Fillings of best-fit, longest pieces first, in steps of equal sequences."""
    open_by_room: dict[int, Counter] = {capacity: Counter()}
    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            room = min((r for r, bins in open_by_room.items() if r >= w and bins), default=capacity)
            if room == capacity:
                filling, bins = (), n
            else:
                filling, bins = next(iter(open_by_room[room].items()))
            fit = room // w
            full = min(bins, n // fit)
            put = fit if full else n
            times = full or 1
            if filling:
                open_by_room[room][filling] -= times
                if not open_by_room[room][filling]:
                    del open_by_room[room][filling]
            open_by_room.setdefault(room - put * w, Counter())[filling + (w,) * put] += times
            n -= put * times
    out: Counter = Counter()
    for bins in open_by_room.values():
        out.update(bins)
    return out


def plan(counts: dict[int, int], capacity: int) -> Counter:
    """Fillings with multiplicities that hold every counted piece."""
    fixed, left = dominance_reduction(counts, capacity)
    return fixed + best_fit(left, capacity)


class _Places:
    """Rank among the pieces of a length -> sequence and offset."""

    def __init__(self, fillings: Counter, capacity: int):
        parts: dict[int, list[tuple[int, int, int, int]]] = {}
        base = 0
        for filling, times in sorted(fillings.items(), reverse=True):
            offset = 0
            for w, n in sorted(Counter(filling).items(), reverse=True):
                parts.setdefault(w, []).append((times * n, base, n, offset))
                offset += n * w
            base += times
        self.tables = {w: np.array(rows, np.int64) for w, rows in parts.items()}

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.array(batch.column("length")), np.array(batch.column("place"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for w in np.unique(length):
                here = np.flatnonzero(length == w)
                size, base, each, first = self.tables[int(w)].T
                ends = np.cumsum(size)
                k = np.searchsorted(ends, rank[here], "right")
                inner = rank[here] - (ends[k] - size[k])
                sequence[here] = base[k] + inner // each[k]
                offset[here] = first[k] + (inner % each[k]) * w
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch(
                [*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )


class _Cutter:
    def __init__(self, path: str, spaced: bool, end_id: int, capacity: int):
        self.path, self.spaced, self.end_id, self.capacity = path, spaced, end_id, capacity

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(self.path, self.spaced)
        end = np.array([self.end_id], "<u4").tobytes()
        seen: Counter = Counter()
        for rows, texts in text_groups(batches, 2):
            out = []
            for doc_id, ids in zip(rows.column(1).to_pylist(), encode([t.decode() for t in texts])):
                ids += end
                total = len(ids) // 4
                start, piece = 0, 0
                size = total % self.capacity or min(total, self.capacity)
                while start < total:
                    crc = zlib.crc32(ids[4 * start : 4 * (start + size)])
                    out.append((doc_id, piece, start, size, seen[size], crc))
                    seen[size] += 1
                    start, piece, size = start + size, piece + 1, self.capacity
            task = rows.column(0)[0].as_py()
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]
            yield pa.record_batch(
                [pa.array([task] * len(out), pa.int32()), *columns],
                ["task", "doc_id", "piece", "start", "length", "rank", "ids_crc32"],
            )


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    spaced: bool = True,
    end_id: int = 2,
    capacity: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    ship_package(docs.sparkSession)
    rows = docs.select(
        F.spark_partition_id().alias("task"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    pieces = materialize(rows.mapInArrow(_Cutter(tokenizer, spaced, end_id, capacity), _PIECE_SQL), "pieces")
    by_task = materialize(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    bases = by_task.select("task", "length", before.alias("before"))
    ranked = pieces.join(bases, ["task", "length"]).withColumn("place", F.col("before") + F.col("rank"))
    return ranked.mapInArrow(
        _Places(plan(counts, capacity), capacity),
        "doc_id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset long",
    ).withColumns({"length": F.col("length").cast("long"), "offset": F.col("offset").cast("long")})
