"""Column functions: rarefaction by falling factorials, sums and moments that don't depend on an order, and merging moments with zeros."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Sample sizes that are put together at a time.
CHUNK = 32


def absent_by_size(n: Column, size: Column, max_g: int) -> Column:
    """Array whose element g is the chance that a sample of g of ``size`` calls misses an allele with ``n`` of them.

    One pass by the recurrence q(g + 1) = q(g) * (size - n - g) / (size - g); elements beyond ``size`` are 0 and must
    not be read. It stays exactly 0 once it is 0. Elements are appended to a chunk, and chunks to a list, so that what is
    copied for a row grows with the sizes times their square root at most.
    """
    length = max(CHUNK, int(max_g**0.5))

    def further(q: Column, u: Column) -> Column:
        ratio = F.when(size > u, F.greatest(size - n - u, F.lit(0)).cast("double") / F.greatest(size - u, F.lit(1))).otherwise(0.0)
        return F.array_append(q, F.element_at(q, -1) * ratio)

    def chunk(done: Column, c: Column) -> Column:
        steps = F.sequence(c * length, F.least((c + 1) * length, F.lit(max_g)) - 1)
        last = F.element_at(F.element_at(done, -1), -1)
        return F.array_append(done, F.slice(F.aggregate(steps, F.array(last), further), 2, length))

    if max_g <= length:
        return F.aggregate(F.sequence(F.lit(0), F.lit(max_g - 1)), F.array(F.lit(1.0)), further)
    return F.flatten(F.aggregate(F.sequence(F.lit(0), F.lit((max_g - 1) // length)), F.array(F.array(F.lit(1.0))), chunk))


def mean_with_zeros(total: Column, loci: int) -> Column:
    return F.coalesce(total, F.lit(0.0)) / F.lit(float(loci))


def variance_with_zeros(count: Column, mean: Column, m2: Column, loci: int) -> Column:
    """Sample variance of ``loci`` values of which ``count`` are known by their mean and sum of squared deviations and the
    rest are 0; null for one locus."""
    if loci < 2:
        return F.lit(None).cast("double")
    merged = m2 + mean * mean * count * (F.lit(float(loci)) - count) / F.lit(float(loci))
    return F.coalesce(merged, F.lit(0.0)) / F.lit(float(loci - 1))


#: Bits of a digit of an exact sum, and digits after the point; a group of 2**33 values can't overflow.
DIGIT, DIGITS = 30, 6


def exact_sum(x: Column) -> Column:
    """The sum of values of 0 or more, with the same bits however the rows are ordered and partitioned.

    Each value is cut into a whole part and digits of 30 bits, which loses nothing above 2**-180; the digits are summed as whole
    numbers, map-side as any sum, and put together at the end. A sum under 2**-120 is the plain one, so that no small part is lost.
    """
    total = F.lit(0.0)
    for i in range(DIGITS, 0, -1):
        digit = ((x * F.lit(float(2 ** (DIGIT * i)))) % F.lit(float(2**DIGIT))).cast("long")
        total = total + F.sum(digit).cast("double") * F.lit(2.0 ** (-DIGIT * i))
    total = total + F.sum(F.floor(x)).cast("double")
    return F.when(total < F.lit(2.0**-120), F.sum(x)).otherwise(total)


def sorted_moments(values: Column) -> Column:
    """Count n, sum s, mean m and sum of squared deviations m2 of an array, taken in ascending order."""

    def more(a: Column, x: Column) -> Column:
        n, d = a["n"] + 1, x - a["m"]
        return F.struct(n.alias("n"), (a["s"] + x).alias("s"), (a["m"] + d / n).alias("m"), (a["m2"] + d * d * (a["n"] / n)).alias("m2"))

    return F.aggregate(F.sort_array(values), F.struct(*[F.lit(0.0).alias(c) for c in ("n", "s", "m", "m2")]), more)


def merged_moments(parts: Column) -> Column:
    """The moments of all in an array of (place, moments), merged by ascending place."""

    def more(a: Column, p: Column) -> Column:
        b = p["moments"]
        n, d = a["n"] + b["n"], b["m"] - a["m"]
        return F.struct(n.alias("n"), (a["s"] + b["s"]).alias("s"), (a["m"] + d * (b["n"] / n)).alias("m"), (a["m2"] + b["m2"] + d * d * (a["n"] * b["n"] / n)).alias("m2"))

    return F.aggregate(F.sort_array(parts), F.struct(*[F.lit(0.0).alias(c) for c in ("n", "s", "m", "m2")]), more)
