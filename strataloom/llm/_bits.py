"""A broadcast bit map of hashes, whose size is bounded whatever their number."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .decontaminate import MOST_BITS, bit_map


class BitMap:
    """Says of a hash whether it may be one of a table's.

    It never denies a hash that is there.  Beyond its bound (``most_bits``) it
    fills up and lets more pass, which costs time but no result: whoever asks
    compares what passes with the table itself.
    """

    def __init__(self, hashes: DataFrame, most_bits: int = MOST_BITS):
        """``hashes`` has a column ``gram`` of longs (the hashes' bits)."""
        self.cells = hashes.sparkSession.sparkContext.broadcast(bit_map(hashes, most_bits))

    def passes(self, h: np.ndarray) -> np.ndarray:
        cells = self.cells.value
        bits = len(cells).bit_length() - 1 + 6

        def is_set(place):
            return (cells[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1

        out = is_set(h >> np.uint64(64 - bits))
        hit = np.flatnonzero(out)
        out[hit] = is_set((h[hit] >> np.uint64(8)) & np.uint64((1 << bits) - 1))
        return out
