"""Words and their hashes on whole Arrow batches, shared by the corpus operators.

Words are what lies between ASCII blanks (0x20, 0x09-0x0D) in UTF-8 text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (all bits depend on all bits)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = U64(0xD6E8FEB86659FD93)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    """1, b, b^2, ... modulo 2^64; grows by doubling and is kept in the worker."""
    global _powers
    if len(_powers) < n:
        size = 1 << max(8, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _powers = np.concatenate(([U64(1)], np.cumprod(np.full(size - 1, _BASE, U64))))
    return _powers[:n]


def words_and_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buffer of all texts; start and end of each word in it; word hashes; index of each text's first word."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    gap = _BLANK[buf]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    if not len(starts):
        return buf, starts, ends, np.empty(0, U64), first
    lens = ends - starts
    at = np.concatenate(([0], np.cumsum(lens)[:-1]))
    local = np.arange(lens.sum()) - np.repeat(at, lens)
    hashed = np.add.reduceat(_BYTE[buf[~gap]] * powers(int(lens.max()))[local], at)
    return buf, starts, ends, mix(hashed + lens.astype(U64)), first


def gram_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of k words (shorter input: none)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.full(n, U64(seed * 2 + 1))
    base = mix(np.array([seed + 77], U64))[0] | U64(1)
    for i in range(k):
        out = out * base + words[i : i + n]
    return mix(out)


def ascii_lower(texts: list[bytes]) -> list[bytes]:
    return [t.lower() for t in texts]


def text_groups(
    batches: Iterator[pa.RecordBatch], text: int, max_bytes: int = 2 << 20
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with at most `max_bytes` of text (one text at least); null texts are empty."""
    for batch in batches:
        texts = [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]
        sizes = np.cumsum([len(t) + 1 for t in texts])
        begin = 0
        while begin < len(texts):
            used = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, used + max_bytes, "right")))
            yield batch.slice(begin, end - begin), texts[begin:end]
            begin = end
    pa.default_memory_pool().release_unused()  # a worker that waits for its next task holds no batches


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow job: (key, text) packed for the shuffle as (key, z)."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    for rows, texts in text_groups(batches, 1):
        yield pa.record_batch([rows.column(0), pa.array([pack.compress(t) for t in texts], pa.binary())], ["key", "z"])


def unzipped(packed: list[bytes]) -> list[bytes]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(z) if z else b"" for z in packed]
