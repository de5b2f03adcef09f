"""Sharding by a Feistel permutation of global row numbers.

Row r of n goes to position p = permute(r); its shard is p mod shards and its slot p div shards. The permutation
is a bijection on [0, n): a balanced Feistel network works on the next power of four, and values that fall outside
[0, n) walk their cycle until they are back. Both ways are closed formulas, so that any worker can compute where a
row went and which row sits in a slot, without a table.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlens.llm.common import numbered, ship

ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiplications and shifts that spread every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 1) - 1).bit_length() + 1) // 2)


def _keys(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % 2**64))


def _network(values: np.ndarray, bits: int, keys: np.ndarray, back: bool) -> np.ndarray:
    shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    left, right = values >> shift, values & mask
    with np.errstate(over="ignore"):
        if back:
            for key in keys[::-1]:
                left, right = right ^ (_mix(left + key) & mask), left
        else:
            for key in keys:
                left, right = right, left ^ (_mix(right + key) & mask)
    return (left << shift) | right


def permute(rows: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """Positions of row numbers in [0, n), or with back the row numbers of positions."""
    bits, keys = _half_bits(n), _keys(seed)
    out = _network(np.asarray(rows).astype(np.uint64), bits, keys, back)
    outside = np.flatnonzero(out >= np.uint64(n))
    while outside.size:
        out[outside] = _network(out[outside], bits, keys, back)
        outside = outside[out[outside] >= np.uint64(n)]
    return out.astype(np.int64)


def locate(row: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of a global row number."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The global row number that sits in a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 20_240_117) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, row_number, shard, slot.

    Only the key and two numbers of each text are sorted, never the text. Rows are numbered by doc_id (null last),
    then checksum and size; rows equal in all three get neighbouring numbers, and which of them gets which does not
    show in the result. A null text counts as no bytes: size 1, checksum 0. Shard counts differ by one at most and
    slots have no gaps. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = numbered(base, "doc_id", "text_crc32", "size")
    n = rows.count()

    @F.pandas_udf("long")
    def position(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    placed = rows.withColumn("__p", position("row_number"))
    return placed.select("doc_id", "size", "text_crc32", "row_number", (F.col("__p") % shards).cast("int").alias("shard"), F.floor(F.col("__p") / shards).cast("long").alias("slot"))
