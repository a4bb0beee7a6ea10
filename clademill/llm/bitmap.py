"""A set of keys as a bitmap, small enough to broadcast at any scale.

Its size follows the number of keys, from 2**LEAST_BITS to 2**MOST_BITS bits (128 MB); beyond some 10**8 keys it fills up and spares less work. It may hold keys that were
never put in, and so only serves to leave work out, never to decide."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT_BITS = 18
LEAST_BITS, MOST_BITS = 20, 30
#: Slots for each key, so that one in so many of the others is let through.
SLOTS = 16


@dataclass
class Bitmap:
    bits: int
    packed: np.ndarray

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes may have been put in."""
        slots = hashes & ((1 << self.bits) - 1)
        return (self.packed[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1).astype(bool)


def bitmap(keys: DataFrame, *, hashed: bool = False) -> Bitmap:
    """From a written DataFrame of one long column: the driver gets the bits in packed segments, 2**MOST_BITS / 8 bytes at most.

    hashed: the column is a hash already; otherwise holds() wants what hash_of() makes of it."""
    name = keys.columns[0]
    bits = min(MOST_BITS, max(LEAST_BITS, (SLOTS * keys.count()).bit_length()))
    slots = keys.select((F.col(name) if hashed else hash_of(name)).bitwiseAND(F.lit((1 << bits) - 1)).alias("slot")).distinct().withColumn("segment", F.shiftright("slot", SEGMENT_BITS))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(1 << SEGMENT_BITS, bool)
        out[rows["slot"].to_numpy() & ((1 << SEGMENT_BITS) - 1)] = True
        return pd.DataFrame({"segment": rows["segment"].iloc[:1], "packed": [np.packbits(out).tobytes()]})

    size = 1 << SEGMENT_BITS - 3
    out = np.zeros(1 << bits - 3, np.uint8)
    for r in slots.groupBy("segment").applyInPandas(pack, "segment long, packed binary").collect():
        out[r.segment * size : (r.segment + 1) * size] = np.frombuffer(r.packed, np.uint8)
    return Bitmap(bits, out)


def hash_of(column: str) -> Column:
    return F.xxhash64(column)
