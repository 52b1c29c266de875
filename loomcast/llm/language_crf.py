"""Language of every word, and of every text, by a linear-chain conditional random field.

Words carry hashed features: the word in the lexicon of the training lines, prefixes, suffixes,
character n-grams and its shape.  Labels are the languages of the training rows, and
transitions between them are learned, so that a word that several languages share follows its
neighbours and a switch inside a text is followed.  Posteriors come from the forward-backward
recursion; a text gets the language with the largest sum of posteriors over its words with a
letter, and as score their share.

The field is fitted on a bounded sample of labelled lines, `SAMPLE` of them, by stochastic gradient
steps in one task; prediction covers whole texts.  Lines of over `LONGEST` words are cut into runs of that
many, equal lines of a language count once, and every language has a share of the sample: rare ones
give all their lines, the others share the rest equally.

Defined cases: null texts and texts without a letter are `und` with score 0; rows
without a language are not learned from; without any labelled row every text is
`und`; repeated rows get equal results; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import io
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcast.llm import chains
from loomcast.llm import textkit as T
from loomcast.sources.shipping import ship_package

SAMPLE = 8000  # labelled lines that the field is fitted on
LONGEST = 200  # words in such a line; longer ones are cut
BUCKETS = 1 << 16
EPOCHS = 3
_KEPT = 400_000  # words whose scores are kept in a worker


_OUTER = ".,;:!?\"'()[]|*#%&$<>"  # taken off both ends of a word
_SMALL = 0x800  # characters below have at most two bytes
_ALPHA, _DIGIT = (np.array([f(chr(i)) for i in range(_SMALL)]) for f in (str.isalpha, str.isdigit))
_CRC = np.array([zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)], np.uint32)  # the usual table of a byte's step
_SHAPES = np.array([zlib.crc32(f"s{u}{a}{d}".encode()) % BUCKETS for u in (False, True) for a in (False, True) for d in (False, True)])


def _state(text: str) -> np.uint32:
    return np.uint32(zlib.crc32(text.encode()) ^ 0xFFFFFFFF)


def _behind(state: np.ndarray | np.uint32, char: np.ndarray) -> np.ndarray:
    """CRC states after one more character each, of one or two bytes."""
    two = char >= 128
    lead = np.where(two, 0xC0 | char >> 6, char)
    after = _CRC[(state ^ lead) & 255] ^ (state >> np.uint32(8))
    return np.where(two, _CRC[(after ^ (0x80 | char & 63)) & 255] ^ (after >> np.uint32(8)), after)


def _bucket(state: np.ndarray) -> np.ndarray:
    return (state ^ np.uint32(0xFFFFFFFF)) % BUCKETS


def feature_lists(words: list[str], bare: list[str], lexicon: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """`features` of many words, one after another, and the number of each; all characters of `bare`, the
    lower-cased words without `_OUTER`, are below `_SMALL`."""
    chars = np.frombuffer("".join(f"^{w}$" for w in bare).encode("utf-32-le"), np.uint32)
    size = np.array([len(w) for w in bare])
    begin = np.cumsum(size + 2) - size - 1  # of each word, behind its mark
    known = np.array([w in lexicon for w in bare])
    count = 2 * size + 10 + known
    at = np.cumsum(count) - count
    out = np.empty(count.sum(), np.int64)
    out[at] = zlib.crc32(b"b") % BUCKETS
    sums = [np.concatenate(([0], np.cumsum(kind[chars]))) for kind in (_ALPHA, _DIGIT)]
    letters, digits = (c[begin + size] - c[begin] for c in sums)
    upper = np.array([w[:1].isupper() for w in words])
    out[at + 1] = _SHAPES[4 * upper + 2 * ((letters == size) & (size > 0)) + (digits > 0)]
    out[at[known] + 2] = [zlib.crc32(b"w" + w.encode()) % BUCKETS for w, ok in zip(bare, known) if ok]
    at += 2 + known
    last = len(chars) - 1
    states = np.full(len(bare), _state("p"), np.uint32)
    for k in range(3):
        states = np.where(size > k, _behind(states, chars[np.minimum(begin + k, last)]), states)
        out[at + k] = _bucket(states)
    for k in range(1, 5):
        states, long = np.full(len(bare), _state("e"), np.uint32), np.minimum(size, k)
        for i in range(k):
            states = np.where(long > i, _behind(states, chars[np.minimum(begin + size - long + i, last)]), states)
        out[at + 2 + k] = _bucket(states)
    two = _behind(_behind(_state("g"), chars)[:-1], chars[1:])
    three = _behind(two[:-1], chars[2:])
    at += 7
    for grams, n in ((two, size + 1), (three, size)):
        local = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(at, n) + local] = _bucket(grams[np.repeat(begin - 1, n) + local])
        at = at + n
    return out, count


def features(word: str, lexicon: frozenset[str]) -> list[int]:
    """Hashed features of one word."""
    w = word.lower().strip(_OUTER)
    framed = f"^{w}$"
    names = ["b", f"s{word[:1].isupper()}{w.isalpha()}{any(c.isdigit() for c in w)}"]
    if w in lexicon:
        names.append("w" + w)
    names += [f"p{w[:k]}" for k in (1, 2, 3)] + [f"e{w[-k:]}" for k in (1, 2, 3, 4)]
    names += [f"g{framed[i : i + n]}" for n in (2, 3) for i in range(len(framed) - n + 1)]
    return [zlib.crc32(x.encode()) % BUCKETS for x in names]


def _joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.array(x) for x in lists]), np.array([len(x) for x in lists])


class Field:
    def __init__(self, labels: list[str], lexicon: frozenset[str]):
        self.labels, self.lexicon = labels, lexicon
        n = len(labels)
        self.weights = np.zeros((BUCKETS, n), np.float32)
        self.start, self.moves = np.zeros(n, np.float32), np.zeros((n, n), np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        """Label scores of each word, by its features alone."""
        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        bare = [w.lower().strip(_OUTER) for w in words]
        small = np.array([w.isascii() or max(w) < chr(_SMALL) for w in bare])
        out = np.empty((len(words), len(self.labels)), np.float32)
        for together in (True, False):
            rows = np.flatnonzero(small == together)
            if not len(rows):
                continue
            mine = [words[i] for i in rows]
            if together:
                found, count = feature_lists(mine, [bare[i] for i in rows], self.lexicon)
            else:
                found, count = _joined([features(w, self.lexicon) for w in mine])
            out[rows] = np.add.reduceat(self.weights[found], np.cumsum(count) - count, axis=0)
        return out

    def posteriors(self, scores: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        emit = np.exp(scores - scores.max(axis=1, keepdims=True))
        steps, move = chains.Steps(first), np.exp(self.moves)
        alpha, scale = chains.forward(steps, emit, np.exp(self.start), move)
        return chains.backward(steps, emit, move, alpha, scale)

    def fit(self, lines: list[list[str]], gold: list[int], epochs: int = EPOCHS, rate: float = 0.2, l2: float = 1e-4) -> None:
        """AdaGrad on the conditional log-likelihood."""
        known = {w: np.array(features(w, self.lexicon)) for w in {w for ws in lines for w in ws}}
        squares = [np.full_like(x, 1e-3) for x in (self.weights, self.start, self.moves)]
        order = np.random.default_rng(11)
        for _ in range(epochs):
            turn = order.permutation(len(lines))
            for i in range(0, len(turn), 128):
                part = [p for p in turn[i : i + 128] if lines[p]]
                if not part:
                    continue
                first = np.concatenate(([0], np.cumsum([len(lines[p]) for p in part])))
                feats = [known[w] for p in part for w in lines[p]]
                size = np.array([len(f) for f in feats])
                flat = np.concatenate(feats)
                scores = np.add.reduceat(self.weights[flat], np.cumsum(size) - size, axis=0)
                post, moves = self.posteriors(scores, first)
                truth = np.repeat([gold[p] for p in part], np.diff(first))
                grad = -post
                grad[np.arange(len(truth)), truth] += 1
                used, inverse = np.unique(flat, return_inverse=True)
                total = np.zeros((len(used), post.shape[1]), np.float32)
                np.add.at(total, inverse, np.repeat(grad, size, axis=0))
                total -= l2 * len(part) * self.weights[used]
                squares[0][used] += total**2
                self.weights[used] += rate * total / np.sqrt(squares[0][used])
                seen = np.zeros_like(moves)
                np.add.at(seen, (truth[:-1][np.diff(np.repeat(part, np.diff(first))) == 0],) * 2, 1)
                start = grad[first[:-1]].sum(axis=0)
                for k, (x, g) in enumerate(((self.start, start), (self.moves, seen - moves - 0.1 * self.moves)), 1):
                    squares[k] += g**2
                    x += rate * g / np.sqrt(squares[k])

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(
            out, weights=self.weights, start=self.start, moves=self.moves, labels=np.array(self.labels), lexicon=np.array(sorted(self.lexicon), dtype=str)
        )
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Field:
        data = np.load(io.BytesIO(raw))
        out = cls([str(x) for x in data["labels"]], frozenset(str(x) for x in data["lexicon"]))
        out.weights, out.start, out.moves = data["weights"], data["start"], data["moves"]
        return out


def _fit(rows: pa.Table) -> pa.Table:
    """Grouped job: the bounded sample -> one fitted field."""
    rows = rows.sort_by([("label", "ascending"), ("line", "ascending")])
    lines, names = [x.split() for x in rows.column("line").to_pylist()], rows.column("label").to_pylist()
    labels = sorted(set(names))
    counts = Counter(w.lower().strip(_OUTER) for ws in lines for w in ws)
    field = Field(labels, frozenset(w for w, n in counts.most_common(8192) if n > 2 and w))
    field.fit(lines, [labels.index(x) for x in names])
    return pa.table({"model": pa.array([field.dump()], pa.binary())})


def labelled_lines(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`label, line, h`: the lettered lines, long ones in runs of `LONGEST` words, and their hashes."""
    lines = labelled.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("label"), F.explode(F.split(F.col(text_col).cast("string"), "\n")).alias("line")
    )
    words = F.filter(F.split("line", r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    runs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("words") - 1) / LONGEST).cast("int")),
        lambda i: F.array_join(F.slice("words", i * LONGEST + 1, LONGEST), " "),
    )
    lines = lines.where(F.col("line").rlike(r"\p{L}")).select("label", words.alias("words"))
    lines = lines.select("label", F.explode(runs).alias("line")).where(F.col("line").rlike(r"\p{L}"))
    return lines.withColumn("h", F.xxhash64("line", "label"))


def shares(counts: dict[str, int], sample: int) -> dict[str, int]:
    """Lines of each label: rare labels give all, the rest of the sample is shared equally; one line at least."""
    out, room = {}, sample
    for i, (label, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[label] = max(1, min(n, room // (len(counts) - i)))
        room = max(0, room - out[label])
    return out


def chosen_lines(lines: DataFrame, sample: int) -> DataFrame:
    """`label, line`: the share of each label, least hashes first, equal lines once.

    Estimated counts bound the hashes first, so that only about the sample is shuffled.
    """
    counts = {r["label"]: r["n"] for r in lines.groupBy("label").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    # a tenth more than counted: the estimate may be low
    quota = shares({k: n + n // 10 + 10 for k, n in counts.items()}, sample)
    bounds = [
        (k, q, min((1 << 63) - 1, int(-(1 << 63) + (1 << 64) * min(1.0, 1.5 * (q + 10) / max(counts[k], 1))))) for k, q in quota.items()
    ]
    if not bounds:
        return lines.select("label", "line")
    # a literal per label: the filter comes before any exchange, and nothing is joined
    quotas, tops = (F.create_map(*[x for b in bounds for x in (F.lit(b[0]), F.lit(b[k]).cast("long"))]) for k in (1, 2))
    kept = lines.where(F.col("h") <= F.try_element_at(tops, F.col("label"))).groupBy("label", "line", "h").agg(F.lit(1).alias("one"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("h", "line"))
    within = F.col("place") <= F.try_element_at(quotas, F.col("label"))
    return kept.withColumn("place", place).where(within).select("label", "line")


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> bytes | None:
    """Field fitted on about `sample` different lines of the labelled rows, with lines of every label."""
    ship_package(labelled.sparkSession)
    chosen = chosen_lines(labelled_lines(labelled, text_col, lang_col), sample)
    model = chosen.groupBy(F.lit(1).alias("one")).applyInArrow(_fit, "model binary").collect()
    return bytes(model[0]["model"]) if model else None


class _Predict:
    def __init__(self, model: bytes):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field.load(self.model)
        place: dict[str, int] = {}
        table = np.zeros((0, len(field.labels)), np.float32)
        lettered = np.zeros(0, bool)
        for rows, texts in T.text_groups(batches, 1, 8 << 20):
            words = [t.decode().split() for t in texts]
            if len(place) > _KEPT:
                place.clear()
                table, lettered = table[:0], lettered[:0]
            flat = list(chain.from_iterable(words))
            new = [w for w in dict.fromkeys(flat) if w not in place]
            if new:
                place.update(zip(new, range(len(place), len(place) + len(new))))
                table = np.concatenate([table, *[field.scores(new[i : i + 20_000]) for i in range(0, len(new), 20_000)]])
                lettered = np.concatenate((lettered, [any(map(str.isalpha, w)) for w in new]))
            first = np.concatenate(([0], np.cumsum([len(ws) for ws in words])))
            at = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            if len(at):
                post, _ = field.posteriors(table[at], first)
                post = post * lettered[at][:, None]
                sums = np.concatenate((np.zeros((1, post.shape[1])), np.cumsum(post, axis=0, dtype=np.float64)))
                sums = sums[first[1:]] - sums[first[:-1]]
                total = sums.sum(axis=1)
                for i in np.flatnonzero(total > 1e-6):
                    best = int(sums[i].argmax())
                    langs[i], scores[i] = field.labels[best], min(1.0, float(sums[i, best] / total[i]))
            yield pa.record_batch([rows.column(0), pa.array(langs), pa.array(scores)], ["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, model: bytes | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, lang_pred, score.  No shuffle."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_Predict(model), "doc_id long, lang_pred string, score double")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is in no held-out fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1))
