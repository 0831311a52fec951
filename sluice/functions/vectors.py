"""Vectors as arrays: dot product, unit length, and an encoder that needs no model file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def unit(v: Column) -> Column:
    """``v`` at length 1; a null or zero vector stays as it is."""

    def scaled(held: Column) -> Column:
        length = F.sqrt(dot(held, held))
        return F.when(length > 0, F.transform(held, lambda x: x / length)).otherwise(held)

    # ``v`` once for a row, however often it is named
    return F.get(F.transform(F.array(v), scaled), F.lit(0))


def hashed_ngrams(text: Column, dim: int = 64, width: int = 3) -> Column:
    """A unit vector of signed, hashed character n-grams; zeros for a text without any. Deterministic, in the JVM.

    The first 32 bits of a gram's MD5 give its place (modulo ``dim``) and its sign (bit 20), so any engine can repeat it.
    """
    padded = F.concat(F.lit(" "), F.coalesce(F.lower(text), F.lit("")), F.lit(" "))
    starts = F.sequence(F.lit(1), F.length(padded) - (width - 1))
    grams = F.when(F.length(padded) >= width, F.transform(starts, lambda i: F.substr(padded, i, F.lit(width))))
    grams = F.coalesce(grams, F.array().cast("array<string>"))
    marks = F.transform(grams, lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 1, 8), 16, 10).cast("long"))
    # the hashes once for a row, whatever the number of dimensions
    held = F.array(marks)

    def place(hashes: Column) -> Column:
        sign = lambda h: F.when(F.pmod(F.shiftright(h, 20), F.lit(2)) == 0, 1.0).otherwise(-1.0)
        at = lambda d: F.filter(hashes, lambda h: F.pmod(h, F.lit(dim)) == d)
        each = F.sequence(F.lit(0), F.lit(dim - 1))
        return F.transform(each, lambda d: F.aggregate(at(d), F.lit(0.0), lambda s, h: s + sign(h)))

    return unit(F.get(F.transform(held, place), F.lit(0)))
