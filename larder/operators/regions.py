"""Boxes: normalisation, polygons, label lines, reading order, template grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The relative cells of the two tray templates (name, x, y, width, height).
LANDSCAPE_CELLS = (
    ("top_left", 0.05, 0.06, 0.30, 0.36),
    ("bottom_left", 0.05, 0.48, 0.30, 0.38),
    ("center", 0.38, 0.18, 0.24, 0.50),
    ("top_right", 0.66, 0.06, 0.28, 0.36),
    ("bottom_right", 0.66, 0.48, 0.28, 0.38),
)
PORTRAIT_CELLS = (
    ("top_left", 0.05, 0.07, 0.36, 0.25),
    ("middle_left", 0.05, 0.34, 0.36, 0.24),
    ("bottom_left", 0.05, 0.61, 0.36, 0.30),
    ("top_right", 0.43, 0.07, 0.52, 0.43),
    ("bottom_right", 0.43, 0.59, 0.52, 0.32),
)


def _clamp(x: Column, top: Column | float) -> Column:
    top = top if isinstance(top, Column) else F.lit(top)
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(top, x)))  # least and greatest pass over nulls


def normalized_box(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column, *, min_area: float = 0.005) -> Column:
    """struct(xc, yc, width, height) in 0..1 of corners clamped to the picture; null if empty, too small, or without a size."""
    w, h = width.cast("double"), height.cast("double")
    l, r, t, b = _clamp(left, w), _clamp(right, w), _clamp(top, h), _clamp(bottom, h)
    bw, bh = F.try_divide(r - l, w), F.try_divide(b - t, h)
    box = F.struct((F.try_divide((l + r) / 2, w)).alias("xc"), (F.try_divide((t + b) / 2, h)).alias("yc"), bw.alias("width"), bh.alias("height"))
    return F.when((w > 0) & (h > 0) & (r > l) & (b > t) & (bw * bh >= min_area), box)


def box_of_values(values: Column, *, min_area: float = 0.005) -> Column:
    """The box of 4 values (centre and size) or the bounding box of a polygon (6 or more, an even number); null otherwise."""
    at = lambda i: F.try_element_at(values, F.lit(i))
    xs = F.filter(values, lambda _, i: i % 2 == 0)
    ys = F.filter(values, lambda _, i: i % 2 == 1)
    one = F.lit(1.0)
    centre = normalized_box(at(1) - at(3) / 2, at(2) - at(4) / 2, at(1) + at(3) / 2, at(2) + at(4) / 2, one, one, min_area=min_area)
    bounds = normalized_box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys), one, one, min_area=min_area)
    n = F.size(values)
    return F.when(n == 4, centre).when((n >= 6) & (n % 2 == 0), bounds)


def remapped_line(values: Column, class_id: Column) -> Column:
    """A label line of centre and size, each clamped to 0..1 by itself, six digits; null if flat, unknown or of a wrong number of values."""
    at = lambda i: F.try_element_at(values, F.lit(i))
    xs, ys = F.filter(values, lambda _, i: i % 2 == 0), F.filter(values, lambda _, i: i % 2 == 1)
    n, l, r, t, b = F.size(values), F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    poly = (n >= 6) & (n % 2 == 0)
    pick = lambda four, many: _clamp(F.when(n == 4, four).when(poly, many), 1.0)
    xc, yc, w, h = pick(at(1), (l + r) / 2), pick(at(2), (t + b) / 2), pick(at(3), r - l), pick(at(4), b - t)
    return F.when((w > 0) & (h > 0) & class_id.isNotNull(), F.format_string("%d %.6f %.6f %.6f %.6f", class_id, xc, yc, w, h))


def parse_label_text(text: Column, *, min_area: float = 0.005) -> tuple[Column, Column]:
    """(boxes, raw_count) of a label file: lines of a class and numbers; lines with fewer than 5 parts are not counted, unreadable numbers counted but skipped."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.split(F.trim(x), r"\s+"))
    lines = F.filter(parts, lambda p: F.size(p) >= 5)
    boxes = F.transform(lines, lambda p: F.transform(F.slice(p, 2, F.size(p) - 1), lambda v: v.try_cast("double")))
    good = F.filter(boxes, lambda v: F.forall(v, lambda x: x.isNotNull()))
    return F.array_compact(F.transform(good, lambda v: box_of_values(v, min_area=min_area))), F.size(lines)


def reading_order(boxes: DataFrame, ident: str, *, min_area: float = 0.005, padding: float = 0.05, max_regions: int = 8) -> DataFrame:
    """(id, fallback, name, x, y, w, h, confidence): padded whole-pixel regions in reading order (centre down, then across).

    boxes: id, image_width, image_height, candidates: array of struct(confidence, left,
    top, right, bottom).  Without a valid candidate the fallback is no_regions, with more
    than max_regions too_many_regions, and there is one row without a region.  Equal
    centres keep the order of the array.  Rounding is half to even.
    """
    w, h = F.col("image_width").cast("double"), F.col("image_height").cast("double")
    area = F.greatest(F.lit(1.0), w * h)

    def clamp(c: Column, i: Column) -> Column:
        l, r, t, b = _clamp(c["left"], w), _clamp(c["right"], w), _clamp(c["top"], h), _clamp(c["bottom"], h)
        ok = (r > l) & (b > t) & ((r - l) * (b - t) / area >= min_area)
        return F.when(ok, F.struct(((t + b) / 2).alias("cy"), ((l + r) / 2).alias("cx"), i.alias("i"), l.alias("l"), t.alias("t"), r.alias("r"), b.alias("b"), c["confidence"].alias("confidence")))

    empty = F.array().cast("array<struct<confidence:double,left:double,top:double,right:double,bottom:double>>")
    valid = F.array_sort(F.array_compact(F.transform(F.coalesce(F.col("candidates"), empty), clamp)))
    d = boxes.select(ident, "image_width", "image_height", valid.alias("v"))
    n = F.size("v")
    fallback = F.when(n == 0, "no_regions").when(n > max_regions, "too_many_regions").otherwise("")
    d = d.withColumn("fallback", fallback).withColumn("v", F.when(F.col("fallback") == "", F.col("v")))
    d = d.select(ident, "image_width", "image_height", "fallback", F.posexplode_outer("v").alias("k", "c"))
    pad_x, pad_y = (F.col("c.r") - F.col("c.l")) * padding, (F.col("c.b") - F.col("c.t")) * padding
    whole = lambda c: F.bround(c).cast("bigint")
    x, y = F.greatest(F.lit(0), whole(F.col("c.l") - pad_x)), F.greatest(F.lit(0), whole(F.col("c.t") - pad_y))
    right, bottom = F.least(F.col("image_width"), whole(F.col("c.r") + pad_x)), F.least(F.col("image_height"), whole(F.col("c.b") + pad_y))
    got = F.col("c").isNotNull()
    return d.select(
        ident, "fallback", F.when(got, F.format_string("auto_%02d", F.col("k") + 1)).alias("name"), F.when(got, x).alias("x"), F.when(got, y).alias("y"),
        F.when(got, F.greatest(F.lit(1), right - x)).alias("w"), F.when(got, F.greatest(F.lit(1), bottom - y)).alias("h"), F.col("c.confidence").alias("confidence"))


def grid_template(pictures: DataFrame, ident: str) -> DataFrame:
    """(id, name, x, y, w, h): five template cells of each picture, landscape if at least as wide as high, fractions cut off."""
    cells = lambda rows: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x).alias("rx"), F.lit(y).alias("ry"), F.lit(w).alias("rw"), F.lit(h).alias("rh")) for n, x, y, w, h in rows])
    w, h = F.col("image_width"), F.col("image_height")
    d = pictures.select(ident, "image_width", "image_height", F.explode(F.when(w >= h, cells(LANDSCAPE_CELLS)).otherwise(cells(PORTRAIT_CELLS))).alias("c"))
    cut = lambda r, s: F.floor(F.col(f"c.{r}") * s).alias
    return d.select(ident, "c.name", cut("rx", w)("x"), cut("ry", h)("y"), cut("rw", w)("w"), cut("rh", h)("h"))


def annotation_counts(records: DataFrame, split: str, boxes: str) -> DataFrame:
    """(split, images, objects, empty): labels by split; a null array counts as empty."""
    n = F.greatest(F.coalesce(F.size(boxes), F.lit(0)), F.lit(0))
    return records.groupBy(split).agg(F.count("*").alias("images"), F.sum(n).cast("bigint").alias("objects"), F.count_if(n == 0).alias("empty"))
