"""A bit table of fixed size that lets pass every hash it was built from, and few others.

It goes to every task in place of a table whose size is not bounded: whatever it lets
pass meets that table in a join, so it decides how much is shuffled and never what is
found.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The table has two to the power of this many bits: 4 MB.
BITS = 25


def sieve(hashes: DataFrame, column: str, bits: int | None = None) -> Broadcast:
    """The words of the bit table of ``column`` (bigint); at most 2 ** (bits - 6) rows come to the driver."""
    bits = max(6, BITS if bits is None else bits)
    h = F.col(column)
    words = hashes.select(F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(2 ** (bits - 6) - 1)).alias("w"), F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    table = np.zeros(2 ** (bits - 6), dtype=np.uint64)
    table[got["w"].to_numpy(dtype=np.int64)] = got["b"].to_numpy(dtype=np.int64).view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(table)


def passes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes (uint64) the table lets pass."""
    return table[(h >> np.uint64(6)) & np.uint64(len(table) - 1)] >> (h & np.uint64(63)) & np.uint64(1) != 0
