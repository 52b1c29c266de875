"""Token ids of a corpus as blocks of compressed planes, with a chunk index.

Ids run in ascending doc_id order through shards (ranges of doc_id).  A shard's stream is
cut into blocks of a fixed number of ids; a block is transposed into bit or byte planes,
each compressed with zstandard.  Blocks are rows of a Parquet container, so Spark's
committer makes the files whole and safe against lost executors on any shared store, and
its small columns are the chunk index: shard, block, first id, number of ids, bytes,
and the documents inside.

Defined cases: a null text is empty and has the end id only; a null id comes before all
others; rows that repeat an id follow each other in the order of their texts; an
empty table gives a container without blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomcast.llm.textkit import text_groups
from loomcast.llm.tokens import encoder
from loomcast.sources.shipping import ship_package

_SEGMENT = pa.struct(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("total", pa.int64()), ("done", pa.int64()), ("at", pa.int32()), ("n", pa.int32())]
)
_SEGMENT_SQL = "struct<doc_id:long,start:long,total:long,done:long,at:int,n:int>"
_BLOCK_SQL = f"shard int, block int, first long, n int, kind string, bytes long, planes array<binary>, segments array<{_SEGMENT_SQL}>"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of a block, lowest first; planes above the highest set bit are left out."""
    top = int(ids.max(initial=0)).bit_length()
    if kind == "byte":
        return [np.ascontiguousarray(p).tobytes() for p in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T[: (top + 7) // 8]]
    return [np.packbits((ids >> np.uint32(b)) & np.uint32(1)).tobytes() for b in range(top)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    for i, plane in enumerate(planes):
        raw = np.frombuffer(plane, np.uint8)
        bits = raw[:n] if kind == "byte" else np.unpackbits(raw, count=n)
        ids |= bits.astype(np.uint32) << np.uint32(i * (8 if kind == "byte" else 1))
    return ids


class _Writer:
    def __init__(self, path: str, spaced: bool, end_id: int, block_ids: int, kind: str):
        self.path, self.spaced, self.end_id, self.block_ids, self.kind = path, spaced, end_id, block_ids, kind

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        encode = encoder(self.path, self.spaced)
        end = np.array([self.end_id], "<u4").tobytes()
        held, held_n, segments = [], 0, []
        block = first = position = 0
        shard = None

        def row():
            ids = np.frombuffer(b"".join(held), "<u4")
            planes = [pack.compress(p) for p in to_planes(ids, self.kind)]
            return pa.record_batch(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([first], pa.int64()),
                    pa.array([len(ids)], pa.int32()),
                    pa.array([self.kind]),
                    pa.array([sum(map(len, planes))], pa.int64()),
                    pa.array([planes], pa.list_(pa.binary())),
                    pa.array([segments], pa.list_(_SEGMENT)),
                ],
                ["shard", "block", "first", "n", "kind", "bytes", "planes", "segments"],
            )

        for rows, texts in text_groups(batches, 2):
            shard = rows.column(0)[0].as_py()
            for doc_id, ids in zip(rows.column(1).to_pylist(), encode([t.decode() for t in texts])):
                ids += end
                total, done = len(ids) // 4, 0
                while done < total:
                    take = min(total - done, self.block_ids - held_n)
                    segments.append({"doc_id": doc_id, "start": position, "total": total, "done": done, "at": held_n, "n": take})
                    held.append(ids[4 * done : 4 * (done + take)])
                    held_n, done = held_n + take, done + take
                    if held_n == self.block_ids:
                        yield row()
                        block, first, held, held_n, segments = block + 1, first + held_n, [], 0, []
                position += total
        if held_n:
            yield row()


def write_ids(
    docs: DataFrame,
    out: str,
    tokenizer: str,
    spaced: bool = False,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_ids: int = 65_536,
    kind: str = "byte",
) -> None:
    """Encode every whole text, append `end_id`, and write the container at `out`."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered = ordered.select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    ordered.mapInArrow(_Writer(tokenizer, spaced, end_id, block_ids, kind), _BLOCK_SQL).write.parquet(out)


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """The container's index columns; plane bytes are not read."""
    return spark.read.parquet(path).select("shard", "block", "first", "n", "bytes", "segments")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for row in batch.to_pylist():
            ids = from_planes([unpack.decompress(p) for p in row["planes"]], row["n"], row["kind"])
            segments = row["segments"]
            parts = [ids[s["at"] : s["at"] + s["n"]].astype("<u4").tobytes() for s in segments]
            columns = [pa.array([row["shard"]] * len(segments), pa.int32())]
            columns += [pa.array([s[k] for s in segments], pa.int64()) for k in ("doc_id", "start", "total", "done")]
            yield pa.record_batch([*columns, pa.array(parts, pa.binary())], ["shard", "doc_id", "start", "total", "done", "ids"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    ship_package(spark)
    blocks = spark.read.parquet(path)
    ends = blocks.groupBy("shard").agg(F.max(F.col("first") + F.col("n")).alias("ids"))
    # one row per shard
    before = ends.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before"))

    def decoded(keep) -> DataFrame:
        wanted = blocks.select("shard", "n", "kind", "planes", F.filter("segments", keep).alias("segments")).where(F.size("segments") > 0)
        return wanted.mapInArrow(_decode, "shard int, doc_id long, start long, total long, done long, ids binary")

    whole = decoded(lambda s: s["n"] == s["total"]).select("shard", "doc_id", "start", "total", "ids")
    # documents cut by a block's end are put together again
    parts = decoded(lambda s: s["n"] < s["total"]).groupBy("shard", "start", "doc_id", "total")
    joined = parts.agg(F.array_sort(F.collect_list(F.struct("done", "ids"))).alias("parts")).select(
        "shard",
        "doc_id",
        "start",
        "total",
        F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"),
    )
    rows = whole.unionByName(joined).join(before, "shard")
    return rows.select("doc_id", (F.col("before") + F.col("start")).alias("start"), F.col("total").alias("n_tokens"), "ids")
