"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Maximal runs of ASCII letters and digits, lower-cased, each cut to 255 bytes."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda x: F.lower(F.substring(x, 1, 255)))


#: The hash's multiplier, a fixed value, and the size of the halves its 64 bits are kept in.
FACTOR, HALF = 131, 1 << 32


def _halves(text: Column) -> Column:
    """(hi, lo) of h = h * 131 + byte in 64 bits, wrapping; bytes count unsigned."""
    digits = F.regexp_extract_all(F.hex(text.cast("binary")), F.lit(".."), F.lit(0))
    start = F.struct(F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"))

    def step(h: Column, d: Column) -> Column:
        low = h["lo"] * FACTOR + F.conv(d, 16, 10).cast("long")
        high = F.pmod(h["hi"] * FACTOR + F.shiftright(low, 32), F.lit(HALF))
        return F.struct(high.alias("hi"), F.pmod(low, F.lit(HALF)).alias("lo"))

    return F.aggregate(digits, start, step)


def poly_bucket(text: Column, buckets: int) -> Column:
    """The bucket of a string by h = h*131 + byte in unsigned 64 bits, modulo any number of buckets."""
    if buckets & (buckets - 1) == 0:  # folding keeps h small, which is exact for powers of two
        digits = F.regexp_extract_all(F.hex(text.cast("binary")), F.lit(".."), F.lit(0))
        return F.aggregate(digits, F.lit(0).cast("long"), lambda h, d: (h * FACTOR + F.conv(d, 16, 10).cast("long")) % buckets).cast("int")
    return _modulo(_halves(text), buckets)


def _modulo(h: Column, buckets: int) -> Column:
    return (((h["hi"] % buckets) * (HALF % buckets) + h["lo"] % buckets) % buckets).cast("int")


def poly_bucket_pair(first: Column, second: Column, buckets: int) -> Column:
    """The bucket of two strings' combined hash, h1*131 + h2 in unsigned 64 bits."""
    if buckets & (buckets - 1) == 0:
        return ((poly_bucket(first, buckets).cast("long") * FACTOR + poly_bucket(second, buckets)) % buckets).cast("int")
    both = F.array(_halves(first), _halves(second))

    def add(pair: Column) -> Column:
        a, b = F.element_at(pair, 1), F.element_at(pair, 2)
        low = a["lo"] * FACTOR + b["lo"]
        high = F.pmod(a["hi"] * FACTOR + b["hi"] + F.shiftright(low, 32), F.lit(HALF))
        return F.struct(high.alias("hi"), F.pmod(low, F.lit(HALF)).alias("lo"))

    return F.element_at(F.transform(F.array(both), lambda x: _modulo(add(x), buckets)), 1)


def id_bucket(key: Column, buckets: int) -> Column:
    return F.pmod(key, F.lit(buckets)).cast("int")
