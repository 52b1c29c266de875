"""Bloom filter of keys, so that rows without a partner in a join are not shuffled for it.

The filter lets every wanted key pass and a few others, which the join behind it drops.
It has a fixed size: 256 slices by hash, 8 MB in all; beyond some 10 million keys it lets more
of the others pass, and the results stay the same.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICES = 256
BITS = 18  # of the number of bits in a slice


def _places(h: np.ndarray) -> list[np.ndarray]:
    """Two places of each hash in the bits of its slice."""
    return [(h >> (8 + i * BITS)) & ((1 << BITS) - 1) for i in range(2)]


def _mark(rows: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(1 << BITS, np.uint8)
    for at in _places(rows["h"].to_numpy()):
        bits[at] = 1
    return pd.DataFrame({"slice": rows["slice"].iloc[:1], "bits": [np.packbits(bits).tobytes()]})


def passes(bits: bytes, h: np.ndarray) -> np.ndarray:
    table = np.frombuffer(bits, np.uint8).reshape(SLICES, -1)
    inside = np.ones(len(h), bool)
    for at in _places(h):
        inside &= (table[h & (SLICES - 1), at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return inside


def key_filter(keys: DataFrame) -> Callable[[str], Column]:
    """Function of the name of a long column: true where it holds a value of the column `key`, and in a few other rows."""
    hashed = keys.select(F.xxhash64("key").alias("h")).withColumn("slice", F.pmod("h", F.lit(SLICES)).cast("int"))
    parts = {r["slice"]: bytes(r["bits"]) for r in hashed.groupBy("slice").applyInPandas(_mark, "slice int, bits binary").collect()}
    marked = keys.sparkSession.sparkContext.broadcast(b"".join(parts.get(i, bytes(1 << BITS - 3)) for i in range(SLICES)))

    @F.pandas_udf("boolean")
    def asked(h: pd.Series) -> pd.Series:
        return pd.Series(passes(marked.value, h.to_numpy()))

    return lambda name: asked(F.xxhash64(name))
