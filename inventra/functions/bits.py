"""64-bit descriptors as signed longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def median_bits(values: str) -> Column:
    """Bit i is 1 where value i is above the median of all values but the first; 64 values."""
    ordered = f"sort_array(transform(slice({values}, 2, 63), x -> cast(x as double)))"
    return F.expr(f"transform(array({ordered}[31]), m -> aggregate(sequence(0, 63), 0L, (b, i) -> b | if({values}[i] > m, shiftleft(1L, i), 0L)))[0]")


def bands(bits: str, count: int) -> Column:
    """array<struct<band, value>>: the 64 bits cut into so many bands."""
    cuts = [64 * i // count for i in range(count + 1)]
    return F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(bits, a).bitwiseAND(F.lit((1 << (z - a)) - 1).cast("long")).alias("value")) for i, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))])


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
