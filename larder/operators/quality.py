"""Picture quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quality_reasons(width: Column, height: Column, blur: Column, brightness: Column, *, min_size: int = 180, max_aspect: float = 3.0, min_blur: float = 20.0, min_brightness: float = 20.0, max_brightness: float = 238.0) -> Column:
    """The failed tests, in fixed order, as an array; a null metric fails none."""
    one = F.lit(1)
    aspect = F.greatest(width / F.greatest(height, one), height / F.greatest(width, one))
    return F.array_compact(F.array(
        F.when(F.least(width, height) < min_size, "too_small"),
        F.when(aspect > max_aspect, "odd_aspect_ratio"),
        F.when(blur < min_blur, "too_blurry"),
        F.when(brightness < min_brightness, "too_dark"),
        F.when(brightness > max_brightness, "too_bright"),
    ))


def annotate(items: DataFrame, reasons: Column) -> DataFrame:
    """All rows with ``reasons`` (joined by ;) and ``status`` accepted or rejected: nothing is dropped unseen."""
    r = F.concat_ws(";", reasons)
    return items.withColumn("reasons", r).withColumn("status", F.when(r == "", "accepted").otherwise("rejected"))


def reason_counts(annotated: DataFrame) -> DataFrame:
    """(status, reason, n): rows by status and by each single reason."""
    each = annotated.select("status", F.explode_outer(F.when(F.col("reasons") != "", F.split("reasons", ";"))).alias("reason"))
    return each.groupBy("status", "reason").agg(F.count("*").alias("n"))
