"""Hidden Markov language model with exact sequence likelihoods.

Tokens are lower-cased words and an end token.  A state emits a token class, and a class
emits its tokens: the most frequent tokens are classes of their own, the others share a
class by their last letters, inside which a token has its add-half probability from the
counts of the whole training corpus.  So every token, seen or not, has a probability, and the
model's size is fixed while its counts are those of the corpus.

Baum-Welch runs over all training texts: tasks turn forward-backward posteriors into expected
counts, which Spark sums.  The starting point comes from all training texts too: tasks count
the classes before and after each class, and classes of like neighbours, a cluster, share
a state.  Scores are scaled forward recursions.

Texts are cut into chunks by task; a chunk lists its distinct tokens once, so counts travel to
and from the corpus table per chunk and token, and not per token of text.

Defined cases: a null or empty text is its end token; a null id is in no held-out fold; repeated rows are
trained and scored each; without training texts every token is unseen; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcast.llm import chains
from loomcast.llm import textkit as T
from loomcast.sources.lineage import materialize
from loomcast.sources.shipping import ship_package

FREQUENT = 4096  # tokens with a class of their own
ENDINGS = 4096  # classes of the other tokens
CLASSES = FREQUENT + ENDINGS
STATES = 8
BUCKETS = 64  # neighbouring classes told apart for the starting point; the most frequent ones have a bucket of their own
OWN = 24
CHUNK = 12 << 20  # bytes of text in one chunk
PART = 200_000  # tokens taken through a recursion at once
END = np.uint64(0x5EED0FE4D0C0FFEE)
_NATS = np.log(10.0)


def ending_class(texts: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class of a token by its last three bytes."""
    h = np.zeros(len(ends), np.uint64)
    for k in (1, 2, 3):
        at = ends - k
        h = h * np.uint64(257) + np.where(at >= starts, texts[np.maximum(at, 0)], 0).astype(np.uint64) + np.uint64(1)
    return (T.mix(h) % np.uint64(ENDINGS)).astype(np.uint16)


class _Encode:
    """Arrow job: texts to chunk-local codes, and one row per chunk with its distinct tokens."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        held, size = [], 0
        for rows, texts in T.text_groups(batches, 2, 2 << 20):
            texts = T.ascii_lower(texts)
            buf, starts, ends, words, first = T.words_and_hashes(texts)
            n = np.diff(first)
            tokens = np.insert(words, first[1:], END)
            kinds = np.insert(ending_class(buf, ends, starts), first[1:], 0)
            held.append((rows.select(["doc_id", "held"]), n + 1, tokens, kinds))
            size += len(buf)
            if size >= CHUNK:
                yield from self.chunk(held, pack)
                held, size = [], 0
        if held:
            yield from self.chunk(held, pack)

    @staticmethod
    def chunk(held, pack) -> Iterator[pa.RecordBatch]:
        name = uuid.uuid4().hex
        tokens, sizes = np.concatenate([h[2] for h in held]), np.concatenate([h[1] for h in held])
        train = ~np.concatenate([np.array(h[0].column("held"), bool) for h in held])
        distinct, at, codes = np.unique(tokens, return_index=True, return_inverse=True)
        counts = np.bincount(codes, minlength=len(distinct))
        seen = np.bincount(codes[np.repeat(train, sizes)], minlength=len(distinct))
        order = np.argsort(-counts, kind="stable")  # frequent tokens get small codes
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        codes = rank[codes].astype("<u4")
        kinds = np.concatenate([h[3] for h in held])[at][order]
        ends = np.cumsum(sizes)
        packed = [
            pack.compress(np.ascontiguousarray(codes[b - n : b].view(np.uint8).reshape(-1, 4).T[:3]).tobytes()) for b, n in zip(ends, sizes)
        ]
        ids = pa.concat_arrays([h[0].column("doc_id") for h in held])
        m = len(sizes)
        fields = ["chunk", "doc_id", "held", "n", "codes", "tokens", "kinds", "seen"]
        none = pa.nulls(m, pa.binary())
        yield pa.record_batch(
            [pa.array([name] * m), ids, pa.array(~train), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary()), none, none, none], fields
        )
        yield pa.record_batch(
            [
                pa.array([name]),
                pa.nulls(1, pa.int64()),
                pa.nulls(1, pa.bool_()),
                pa.array([len(distinct)], pa.int64()),
                pa.nulls(1, pa.binary()),
                *[pa.array([x.tobytes()], pa.binary()) for x in (distinct[order], kinds, seen[order].astype("<i4"))],
            ],
            fields,
        )


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow job: a chunk's tokens as rows."""
    for batch in batches:
        for row in batch.to_pylist():
            tokens = np.frombuffer(row["tokens"], np.int64)
            yield pa.record_batch(
                [
                    pa.array([row["chunk"]] * len(tokens)),
                    pa.array(np.arange(len(tokens)), pa.int32()),
                    pa.array(tokens),
                    pa.array(np.frombuffer(row["kinds"], np.uint16).astype(np.int32)),
                    pa.array(np.frombuffer(row["seen"], "<i4").astype(np.int64)),
                ],
                ["chunk", "code", "token", "kind", "seen"],
            )


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes x states: P(class | state)


def _add_half(c: np.ndarray, total, kinds) -> np.ndarray:
    return np.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))


def _decode(docs: pa.Table, tokens: pa.Table, total: int, distinct: int, class_log: np.ndarray) -> pa.Table:
    """Cogrouped job, one chunk: class sequences and the sums that need no states."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    order = np.argsort(np.array(tokens.column("code")))
    c, kind = np.array(tokens.column("c"))[order], np.array(tokens.column("class"))[order]
    base = _add_half(c, total, distinct)
    inside = np.log10(c + 0.5) - class_log[kind]
    out = []
    for z in docs.column("codes").to_pylist():
        planes = np.frombuffer(unpack.decompress(z), np.uint8).reshape(3, -1).astype(np.int64)
        codes = planes[0] | (planes[1] << 8) | (planes[2] << 16)
        out.append((int((c[codes] > 0).sum()), float(base[codes].sum()), float(inside[codes].sum()), kind[codes].astype("<u2").tobytes()))
    columns = [pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.float64(), pa.float64(), pa.binary()))]
    kept = [docs.column(n) for n in ("doc_id", "held", "n")]
    return pa.table([*kept, *columns], ["doc_id", "held", "n", "n_known", "base", "inside", "classes"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with about `PART` tokens, their classes one after another, and the chains' bounds.

    The rows of a batch come longest first: a part takes as many steps as its longest chain has.
    """
    for batch in batches:
        batch = batch.take(pa.array(np.argsort(-np.array(batch.column("n")), kind="stable")))
        sizes = np.array(batch.column("n"))
        ends, begin = np.cumsum(sizes), 0
        while begin < len(sizes):
            used = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, used + PART, "right")))
            rows = batch.slice(begin, end - begin)
            classes = np.frombuffer(b"".join(rows.column("classes").to_pylist()), "<u2").astype(np.int64)
            yield rows, classes, np.concatenate(([0], np.cumsum(sizes[begin:end])))
            begin = end


def _expected(model: Model, classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and emissions, and the log-likelihood."""
    steps = chains.Steps(first)
    emit = model.emit[classes].astype(np.float32)
    start, move = model.start.astype(np.float32), model.move.astype(np.float32)
    alpha, scale = chains.forward(steps, emit, start, move)
    post, moves = chains.backward(steps, emit, move, alpha, scale)
    del emit, alpha
    emitted = np.stack([np.bincount(classes, post[:, k], CLASSES) for k in range(post.shape[1])], axis=1)
    return post[first[:-1]].sum(axis=0), moves, emitted, float(np.log(scale).sum())


def _maximised(start: np.ndarray, moves: np.ndarray, emitted: np.ndarray) -> Model:
    s, m, e = start + 1.0, moves + 1.0, emitted + 0.01
    return Model(s / s.sum(), m / m.sum(axis=1, keepdims=True), e / e.sum(axis=0))


def _expect_job(model: Model):
    """Arrow job: a task's expected counts in slices of rows."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(model.start)
        total = np.zeros((1 + n + CLASSES, n))
        for _, classes, first in _parts(batches):
            start, moves, emitted, _ = _expected(model, classes, first)
            total += np.concatenate((start[None], moves, emitted))
        at = range(0, len(total), 512)
        yield pa.record_batch([pa.array(list(at), pa.int32()), pa.array([total[i : i + 512].tobytes() for i in at], pa.binary())], ["at", "data"])

    return job


def _sum(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(d) for d in rows["data"])
    return pd.DataFrame({"at": rows["at"].iloc[:1], "data": [total.tobytes()]})


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow job: a task's counts of each class, and of the buckets of classes after and before it, in slices of rows."""
    every = np.arange(CLASSES)
    bucket = np.where(every < OWN, every, OWN + (T.mix(every.astype(np.uint64)) % np.uint64(BUCKETS - OWN)).astype(np.int64))
    total = np.zeros((CLASSES, 1 + 2 * BUCKETS), np.int64)
    for _, classes, first in _parts(batches):
        total[:, 0] += np.bincount(classes, minlength=CLASSES)
        inside = np.ones(len(classes), bool)
        inside[first[1:] - 1] = False  # the last of a chain has none after it
        a = np.flatnonzero(inside)
        here, ahead = classes[a], classes[a + 1]
        size = CLASSES * BUCKETS
        total[:, 1 : 1 + BUCKETS] += np.bincount(here * BUCKETS + bucket[ahead], minlength=size).reshape(CLASSES, BUCKETS)
        total[:, 1 + BUCKETS :] += np.bincount(ahead * BUCKETS + bucket[here], minlength=size).reshape(CLASSES, BUCKETS)
    at = range(0, CLASSES, 512)
    yield pa.record_batch([pa.array(list(at), pa.int32()), pa.array([total[i : i + 512].tobytes() for i in at], pa.binary())], ["at", "data"])


def _sum_counts(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(d, np.int64) for d in rows["data"])
    return pd.DataFrame({"at": rows["at"].iloc[:1], "data": [total.tobytes()]})


def _first_model(counts: np.ndarray) -> Model:
    """States from classes of like neighbours: k-means of the square roots of their shares, weighted by the classes' counts."""
    n, sides = counts[:, 0].astype(np.float64), counts[:, 1:].reshape(CLASSES, 2, BUCKETS).astype(np.float64)
    everywhere = sides.sum(axis=0) + 1.0
    sides += 200.0 * everywhere / everywhere.sum(axis=1, keepdims=True)  # a rare class looks like the average
    points = np.sqrt(sides / sides.sum(axis=2, keepdims=True)).reshape(CLASSES, -1)
    rng = np.random.default_rng(5)
    distance = lambda c: np.maximum((points**2).sum(axis=1)[:, None] - 2 * points @ c.T + (c**2).sum(axis=1), 0)
    least, owner = np.inf, np.zeros(CLASSES, np.int64)
    for _ in range(24):  # the best of some random starts
        centres = points[rng.choice(CLASSES, 1, p=n / n.sum())]
        while len(centres) < STATES:
            far = n * distance(centres).min(axis=1) + 1e-12
            centres = np.concatenate((centres, points[rng.choice(CLASSES, 1, p=far / far.sum())]))
        for _ in range(20):
            away = distance(centres)
            found = away.argmin(axis=1)
            member = (found[:, None] == np.arange(STATES)) * n[:, None]
            size = member.sum(axis=0)[:, None]
            centres = np.where(size > 0, member.T @ points / np.maximum(size, 1), centres)
        loss = float((n * away.min(axis=1)).sum())
        if loss < least:
            least, owner = loss, found
    emit = (n[:, None] + 0.1) * np.where(owner[:, None] == np.arange(STATES), 1.0, 0.05)
    move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
    return Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))


def _unpack(total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return total[0], total[1 : 1 + STATES], total[1 + STATES :]


def _score_job(model: Model):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, classes, first in _parts(batches):
            _, scale = chains.forward(chains.Steps(first), model.emit[classes], model.start, model.move)
            sums = np.concatenate(([0.0], np.cumsum(np.log(scale))))
            score = (sums[first[1:]] - sums[first[:-1]]) / _NATS + np.array(rows.column("inside"))
            yield pa.record_batch(
                [*[rows.column(c) for c in ("doc_id", "held", "n", "n_known", "base")], pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    return job


def language_model_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Rows for which `held_out` is false are learned from, `rounds` full Baum-Welch rounds.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("text"))
    coded = materialize(
        rows.mapInArrow(_Encode(), "chunk string, doc_id long, held boolean, n long, codes binary, tokens binary, kinds binary, seen binary"), "hmm-codes"
    )
    each = coded.where("tokens is not null").select("chunk", "tokens", "kinds", "seen").mapInArrow(
        _distinct, "chunk string, code int, token long, kind int, seen long"
    )
    by_token = Window.partitionBy("token")
    counted = each.select(
        "chunk", "code", "token", "kind", F.sum("seen").over(by_token).alias("c"), F.row_number().over(by_token.orderBy("chunk")).alias("k")
    )
    counted = materialize(counted, "hmm-counts")
    corpus = counted.where("k = 1 and c > 0")
    sums = corpus.agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()[0]
    total, distinct = int(sums["n"] or 0), int(sums["v"])
    end = int(T.as_long(np.array([END], np.uint64))[0])
    top = corpus.where(F.col("token") != end).orderBy(F.desc("c"), "token").limit(FREQUENT - 1).select("token", "c").collect()
    frequent = spark.createDataFrame(
        pd.DataFrame({"token": [end] + [r["token"] for r in top], "own": range(len(top) + 1)}, dtype="int64"), "token long, own long"
    )
    classed = counted.join(F.broadcast(frequent), "token", "left").withColumn(  # FREQUENT rows at most
        "class", F.coalesce(F.col("own").cast("int"), F.col("kind") + FREQUENT)
    )
    class_log = np.log10(np.full(CLASSES, 0.5))
    for r in classed.where("k = 1 and c > 0").groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # CLASSES rows at most
        class_log[r["class"]] = np.log10(r["n"] + 0.5 * (r["v"] + 1))

    def decode(left: pa.Table, right: pa.Table) -> pa.Table:
        return _decode(left, right, total, distinct, class_log)

    sequences = coded.where("codes is not null").select("chunk", "doc_id", "held", "n", "codes").groupBy("chunk").cogroup(
        classed.select("chunk", "code", "c", "class").groupBy("chunk")
    ).applyInArrow(decode, "doc_id long, held boolean, n long, n_known long, base double, inside double, classes binary")
    sequences = materialize(sequences, "hmm-classes")

    training = sequences.where("not held")
    around = training.select("n", "classes").mapInArrow(_neighbours, "at int, data binary").groupBy("at").applyInPandas(_sum_counts, "at int, data binary")
    slices = sorted(around.collect(), key=lambda r: r["at"])  # the model's own size
    counts = np.concatenate([np.frombuffer(bytes(r["data"]), np.int64) for r in slices] or [np.empty(0, np.int64)]).reshape(-1, 1 + 2 * BUCKETS)
    if counts.any():
        model = _first_model(counts)
        for _ in range(rounds):
            parts = training.select("n", "classes").mapInArrow(_expect_job(model), "at int, data binary").groupBy("at").applyInPandas(_sum, "at int, data binary")
            got = sorted(parts.collect(), key=lambda r: r["at"])  # the model's own size
            model = _maximised(*_unpack(np.concatenate([np.frombuffer(bytes(r["data"])).reshape(-1, STATES) for r in got])))
    else:
        model = Model(np.full(STATES, 1 / STATES), np.full((STATES, STATES), 1 / STATES), np.full((CLASSES, STATES), 1 / CLASSES))
    scored = sequences.mapInArrow(
        _score_job(model), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
