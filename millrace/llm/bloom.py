"""A bounded filter on 64-bit hashes, for passing over what cannot match before anything is shuffled.

Its words are made by a grouped aggregation and broadcast. Its size follows the number of hashes up to
``MOST_BYTES`` and never goes beyond: with more hashes than that pays for, no filter is built and
everything passes, so that the exact join behind it does all the work. Either way results are the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 1 << 25
#: Bits for each hash where there is room, and the fewest that still make a useful filter.
BITS_PER_HASH, FEWEST_BITS = 64, 8
_WORD = 64


class Filter:
    """Four bits in one 64-bit word for each hash."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes (int64 or uint64) may be among those it was built from."""
        hashes = hashes.view(np.uint64)
        word = self.words[(hashes & np.uint64(len(self.words) - 1)).astype(np.int64)]
        mask = np.zeros(len(hashes), np.uint64)
        for shift in (40, 46, 52, 58):
            mask |= np.uint64(1) << ((hashes >> np.uint64(shift)) & np.uint64(63))
        return (word & mask) == mask


def build(hashes: DataFrame):
    """A broadcast Filter for the distinct hashes in the one column of ``hashes``; None if they are too many.

    They are read once, so they need not be a table: words are made for the greatest size, and words that are
    one at the size that the count of hashes asks for are joined here.
    """
    column = F.col(hashes.columns[0])
    most = 1 << max(10, (MOST_BYTES * 8 // _WORD).bit_length() - 1)
    bits = F.lit(0).cast("bigint")
    for shift in (40, 46, 52, 58):
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(column, shift).bitwiseAND(F.lit(63)).cast("int")))
    words = hashes.select(column.bitwiseAND(F.lit(most - 1)).cast("int").alias("at"), bits.alias("bits"))
    table = words.groupBy("at").agg(F.bit_or("bits").alias("bits"), F.count("*").alias("n")).toArrow()  # at most MOST_BYTES / 8 rows
    n = pc.sum(table["n"]).as_py() or 0
    if n * FEWEST_BITS > MOST_BYTES * 8:
        return None
    size = 1 << max(10, min((n * BITS_PER_HASH // _WORD).bit_length(), most.bit_length() - 1))
    out = np.zeros(size, np.int64)
    np.bitwise_or.at(out, table["at"].to_numpy() & (size - 1), table["bits"].to_numpy())
    return hashes.sparkSession.sparkContext.broadcast(Filter(out.view(np.uint64)))


def maybe(hash_: Column, built) -> Column:
    """Whether a hash may be in the filter; true if there is none."""
    if built is None:
        return F.lit(True)

    def run(values: pa.Array) -> pa.Array:
        return pa.array(built.value.contains(pc.fill_null(values, 0).to_numpy(zero_copy_only=False)))

    return F.arrow_udf(run, "boolean").asNondeterministic()(hash_)
