"""A Bloom filter of whole numbers as one array of longs, tested inside generated code.

The bits are set by a grouped `bit_or`, so the filter of a large column is put together where the
rows are; only its array, of a fixed largest size, is one row.  A filter that is too small for its
column lets more rows pass and loses none.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.scratch import stored

#: Bits for each number, up to the largest filter: 8 MB, enough for about 8 million numbers.
BITS_EACH, LEAST, MOST = 16, 10, 26
PROBES = 3


def _positions(value: Column, bits: int) -> list[Column]:
    mask = F.lit((1 << bits) - 1).cast("long")
    first = F.xxhash64(value).bitwiseAND(mask)
    step = F.xxhash64(value, F.lit(1)).bitwiseAND(mask).bitwiseOR(F.lit(1).cast("long"))
    return [(first + step * i).bitwiseAND(mask) for i in range(PROBES)]


class Bloom:
    """The filter of a column of longs; NULLs are not in it."""

    def __init__(self, rows: DataFrame, column: str):
        values = rows.select(F.col(column).alias("value")).filter("value is not null")
        self.count = values.count()
        self.bits = min(MOST, max(LEAST, ceil(log2(BITS_EACH * max(1, self.count)))))
        set_bits = values.select(F.explode(F.array(*_positions(F.col("value"), self.bits))).alias(
            "at")).groupBy(F.shiftright("at", 6).alias("id")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        longs = rows.sparkSession.range(1 << (self.bits - 6)).join(set_bits, "id", "left")
        told = F.sort_array(F.collect_list(F.struct(
            "id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
        self.table = stored(
            longs.agg(told.alias("told")).select(F.col("told.bits").alias("longs")), "bloom")

    def may_have(self, value: Column) -> Column:
        """False only for NULL and numbers that the column does not have."""
        longs = self.table.scalar()
        hit = value.isNotNull()
        for at in _positions(value, self.bits):
            block = F.get(longs, F.shiftright(at, 6).cast("int"))
            hit &= F.getbit(block, at.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1
        return hit
