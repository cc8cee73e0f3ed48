"""Bit tables that spare rows a shuffle: false for a key means that it is not in the set.

A table has 16 bits a key, and never more than ``2 ** MAX_BITS`` bits (16 MB), so it can be sent to
tasks whatever the number of keys. Where it is full it only spares less; what passes is always
decided by an exact join or sum later.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BITS = 27


def bit_table(keys: DataFrame, column: str) -> np.ndarray:
    """Bits set for all values of a column of 64-bit hashes."""
    bits = min(MAX_BITS, max(16, (16 * keys.count()).bit_length()))
    spot = F.col(column).bitwiseAND((1 << bits) - 1)
    bit = F.expr(f"shiftleft(1L, cast(`{column}` & 31 AS int))")
    rows = keys.groupBy(F.shiftright(spot, 5).cast("int").alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 5), dtype=np.uint32)
    table[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint32)
    return table


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    spot = keys.view(np.uint64) & np.uint64(32 * len(table) - 1)
    return (table[spot >> np.uint64(5)] >> (spot & np.uint64(31)).astype(np.uint32)) & 1 > 0
