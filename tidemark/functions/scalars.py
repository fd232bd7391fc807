"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_any(s: Column, delimiters: str) -> Column:
    """Parts between any of the delimiters, without empty ones."""
    return F.filter(F.split(s, "[" + "".join("\\" + c for c in delimiters) + "]"), lambda x: x != "")


def from_sql_array(s: Column) -> Column:
    return split_any(s, ", {}")


def string_range(s: Column) -> Column:
    """Integers of "a..b" (both ends included) or "a,b,c"."""
    ends = F.split(s, "\\.\\.")
    return F.when(s.contains(".."), F.sequence(ends[0].cast("long"), ends[1].cast("long"))).otherwise(F.transform(split_any(s, ","), lambda x: x.cast("long")))


def rounded_down(t: Column, unit: int) -> Column:
    """Time down to a whole unit, both in microseconds."""
    return t - F.pmod(t, F.lit(unit))


def duration_seconds(s: Column) -> Column:
    """Seconds of "days,hours:minutes:seconds" or "hours:minutes:seconds"."""
    parts = F.split(s, ",")
    days = F.when(F.size(parts) > 1, parts[0].cast("long")).otherwise(F.lit(0))
    clock = F.split(F.element_at(parts, -1), ":")
    return days * 86400 + clock[0].cast("long") * 3600 + clock[1].cast("long") * 60 + clock[2].cast("long")


def aligned_end(start: Column, end: Column, frame: Column | int) -> Column:
    """The end, moved on so that the length is a multiple of the frame."""
    frame = frame if isinstance(frame, Column) else F.lit(frame)
    return end + F.pmod(frame - F.pmod(end - start, frame), frame)


def sln(v: Column) -> Column:
    """sign(v) * ln(1 + |v|): a logarithm for values of either sign."""
    return F.signum(v) * F.log1p(F.abs(v))


def sexp(v: Column) -> Column:
    """The inverse of sln."""
    return F.signum(v) * F.expm1(F.abs(v))


def abs_diff_ratio(a: Column, b: Column) -> Column:
    size = F.abs(a) + F.abs(b)
    return F.when(size == 0, 0.0).otherwise(F.abs(a - b) / size)


def ceil_div(a: Column, b: int) -> Column:
    return F.ceil(a / F.lit(b)).cast("long")


def bounce(v: Column, limit: float) -> Column:
    """v reflected at 0 and at the limit."""
    m = F.pmod(v, F.lit(2 * limit))
    return F.when(m <= limit, m).otherwise(2 * limit - m)


def constrain(v: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), v))


def next_power_of_two(n: Column) -> Column:
    return F.when(n <= 1, F.lit(1)).otherwise(F.expr("1").cast("long") * F.round(F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")) - 1e-12)))).cast("long")


def is_power_of_two(n: Column) -> Column:
    return (n > 0) & (F.bit_count(n) == 1)


def vector(op, a: Column, b: Column) -> Column:
    """Element-wise result of two arrays."""
    return F.zip_with(a, b, op)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def mean_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a)


def permuted(i: Column, n: Column | int) -> Column:
    """A fixed permutation of 0..n-1 for n without the multiplier's factors."""
    return F.pmod(i * 6700417 + 42, n if isinstance(n, Column) else F.lit(n))
