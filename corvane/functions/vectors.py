"""Vector functions on array columns, in double precision: distances, codes, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12
#: Levels of a four-bit code.
TOP_CODE = 15


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """The length by the components that are there; NULL if none is."""
    there = F.filter(v, lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.sqrt(F.aggregate(there, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """NULL where a vector has no direction."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = F.array_repeat(F.greatest(norm(v), F.lit(TINY)), F.size(v))  # once a vector, not for each component
    return F.zip_with(v, n, lambda x, y: x.cast("double") / y)


def is_zero(v: Column) -> Column:
    return ~F.exists(v, lambda x: F.abs(x) > TINY)


def sign_words(v: str) -> Column:
    """Sign bits as 64-bit words: bit set where a component is above zero; ``v`` is a column name."""
    return F.expr(f"transform(sequence(0, (size({v}) - 1) div 64), w -> aggregate(slice({v}, w * 64 + 1, 64), 0L, (a, x) -> shiftleft(a, 1) | if(x > 0, 1L, 0L)))")


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def encode(v: Column, lo: Column, hi: Column) -> Column:
    """Four-bit codes: the nearest of 16 levels from lo to hi in each dimension, halves to even, ends clipped."""
    scaled = F.zip_with(F.arrays_zip(v.alias("x"), lo.alias("l")), hi, lambda p, h: F.rint((p["x"].cast("double") - p["l"]) / ((h - p["l"]) / TOP_CODE)))
    return F.transform(scaled, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(float(TOP_CODE))).cast("int"))


def decode(codes: Column, lo: Column, hi: Column) -> Column:
    return F.zip_with(codes, F.arrays_zip(lo.alias("l"), hi.alias("h")), lambda c, p: c * ((p["h"] - p["l"]) / TOP_CODE) + p["l"])


def pack(codes: str) -> Column:
    """Two codes a byte, the even dimension in the high half, as hex digits."""
    return F.expr(f"array_join(transform({codes}, c -> lower(hex(c))), '')")


def unpack(packed: Column) -> Column:
    return F.transform(F.filter(F.split(packed, ""), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("int"))


def parse(text: Column) -> Column:
    """A vector from its text form ``[x,...]``."""
    return F.from_json(text, "array<double>")


def as_text(v: Column) -> Column:
    """The text form, with six decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.format_number(x.cast("double"), "0.000000")), ","), F.lit("]"))


def permuted(v: str, shift: int = 17, dims: int | None = None) -> Column:
    """Another coordinate system of the same lengths: rolled by ``shift``, even dimensions negated.

    ``dims``: of this many dimensions whatever is stored; components that aren't there are NULL.
    """
    n = f"size({v})" if dims is None else str(dims)
    at = f"{v}[cast(pmod(i - {shift}, {n}) as int)]" if dims is None else f"get({v}, cast(pmod(i - {shift}, {n}) as int))"
    return F.expr(f"transform(sequence(0, {n} - 1), i -> if(i % 2 = 0, -1.0D, 1.0D) * {at})")


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, with the sign of what became zero, as in SQL."""
    return F.abs(F.round(x, digits)) * F.signum(x)
