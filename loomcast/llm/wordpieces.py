"""Greedy longest-match token counts in linear time, without building pieces.

A trie of the vocabulary has a failure link and a popped-token count at every node: where
the next byte has no child, the automaton adds the count of the tokens that the longest-match
split of the node's string would emit and goes on from what those tokens leave over.
No byte is read twice.  Words are split from each other at ASCII blanks, and each is
matched with the word-start mark of the vocabulary before it.

Defined cases: a null, empty or blank text has no words and no tokens; every single byte
is a token of the vocabulary, so no word fails; equal rows give equal results; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.llm.textkit import text_groups
from loomcast.sources.shipping import ship_package

_KEPT = 1_000_000  # word counts kept in a worker


class Automaton:
    """`vocabulary`: tokens as bytes, all single bytes among them."""

    def __init__(self, vocabulary: Iterable[bytes]):
        child: dict[int, int] = {}
        parent, byte, token = [0], [0], [False]
        for piece in vocabulary:
            node = 0
            for c in piece:
                key = node * 256 + c
                nxt = child.get(key)
                if nxt is None:
                    nxt = child[key] = len(parent)
                    parent.append(node)
                    byte.append(c)
                    token.append(False)
                node = nxt
            token[node] = bool(piece)
        n = len(parent)
        depth = np.zeros(n, np.int64)
        for v in range(1, n):  # a parent is older than its children
            depth[v] = depth[parent[v]] + 1
        fail, popped = [-1] * n, [0] * n
        for v in np.argsort(depth, kind="stable").tolist()[1:]:
            if token[v]:
                fail[v], popped[v] = 0, 1
                continue
            u, c = parent[v], byte[v]
            count, z = popped[u], fail[u]
            while z >= 0 and z * 256 + c not in child:
                count, z = count + popped[z], fail[z]
            if z < 0:
                raise ValueError("every single byte must be a token")
            fail[v], popped[v] = child[z * 256 + c], count
        self.child, self.fail, self.popped = child, fail, popped

    def count(self, word: bytes) -> int:
        """Tokens of the greedy longest-match split."""
        child, fail, popped = self.child, self.fail, self.popped
        node = total = 0
        for c in word:
            nxt = child.get(node * 256 + c)
            while nxt is None:
                total += popped[node]
                node = fail[node]
                nxt = child.get(node * 256 + c)
            node = nxt
        while node:
            total += popped[node]
            node = fail[node]
        return total


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_level_vocabulary(path: str) -> list[bytes]:
    """Tokens of a byte-level tokenizer file; a leading blank marks the start of a word."""
    alphabet = byte_alphabet()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return [bytes(alphabet[c] for c in t) for t in spec["model"]["vocab"] if t not in special]


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(byte_level_vocabulary(path))


class _Counter:
    def __init__(self, path: str):
        self.path = path

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = automaton(self.path).count
        known: dict[bytes, int] = {}
        for rows, texts in text_groups(batches, 1):
            words = [t.split() for t in texts]
            if len(known) > _KEPT:
                known.clear()
            for w in {w for ws in words for w in ws}.difference(known):
                known[w] = count(b" " + w)
            yield pa.record_batch(
                [
                    rows.column(0),
                    pa.array([len(ws) for ws in words], pa.int64()),
                    pa.array([sum([known[w] for w in ws]) for ws in words], pa.int64()),
                ],
                ["doc_id", "n_words", "n_tokens"],
            )


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_tokens; no shuffle."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_Counter(vocabulary), "doc_id long, n_words long, n_tokens long")
