"""Picture metrics over grey values held as arrays (rows one after another), and difference hashes.

A null array, or one that is not width * height long, gives nulls; an empty one counts as
stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whole(gray: Column, width: Column, height: Column) -> Column:
    return (F.size(gray) == width * height) & (width > 0) & (height > 0)


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(total, F.size(values))


def brightness(gray: Column) -> Column:
    """The mean grey value; null without one."""
    return F.when(F.size(gray) > 0, _mean(gray))


def blur_score(gray: Column, width: Column, height: Column) -> Column:
    """The variance of the Laplacian (four neighbours, mirrored at the border without repeating it); 0 for an empty picture."""
    at = lambda r, c: F.get(gray, (r * width + c).cast("int"))
    low = lambda i, n: F.when(i == 0, F.least(F.lit(1), n - 1)).otherwise(i - 1)
    high = lambda i, n: F.when(i == n - 1, F.greatest(F.lit(0), n - 2)).otherwise(i + 1)

    def laplace(_: Column, i: Column) -> Column:
        r, c = F.floor(i / width).cast("int"), i % width
        return (at(low(r, height), c) + at(high(r, height), c) + at(r, low(c, width)) + at(r, high(c, width)) - 4 * at(r, c)).cast("double")

    once = lambda c, f: F.transform(F.array(c), f)[0]
    variance = once(F.transform(gray, laplace), lambda v: once(_mean(v), lambda m: _mean(F.transform(v, lambda x: (x - m) * (x - m)))))
    return F.when(F.size(gray) == 0, 0.0).when(_whole(gray, width, height), variance)


def black_border_ratio(gray: Column, width: Column, height: Column, *, band: float = 0.12, threshold: int = 20) -> Column:
    """The part of the border band (at least one pixel wide) that is at most ``threshold`` bright; 1 for an empty picture."""
    by, bx = F.greatest(F.lit(1), F.floor(height * band).cast("int")), F.greatest(F.lit(1), F.floor(width * band).cast("int"))

    def outer(i: Column) -> Column:
        r, c = F.floor(i / width), i % width
        return (r < by) | (r >= height - by) | (c < bx) | (c >= width - bx)

    border = F.filter(gray, lambda _, i: outer(i))
    dark = F.filter(border, lambda x: x <= threshold)
    return F.when(F.size(gray) == 0, 1.0).when(_whole(gray, width, height), F.coalesce(F.try_divide(F.size(dark), F.size(border)), F.lit(0.0)))


def difference_hash(gray: Column, width: int, height: int) -> Column:
    """Hex digits of one bit for each pair of neighbours in a row (set where the right one is brighter), the first the highest.

    gray: a picture already reduced to width x height (9 x 8 gives the usual 64 bits).
    """
    bits = (width - 1) * height
    places = [r * width + c for r in range(height) for c in range(width - 1)]
    text = F.concat(*[F.when(F.get(gray, F.lit(p + 1)) > F.get(gray, F.lit(p)), "1").otherwise("0") for p in places])
    digits = -(-bits // 4)
    padded = F.lpad(text, 4 * digits, "0")
    pieces = [F.lower(F.lpad(F.conv(F.substring(padded, 1 + k, 32), 2, 16), min(8, digits - k // 4), "0")) for k in range(0, 4 * digits, 32)]
    return F.when(F.size(gray) == width * height, F.concat(*pieces))
