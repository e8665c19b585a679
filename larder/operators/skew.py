"""Joins and ranks that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def hot_salted_join(left: DataFrame, right: DataFrame, keys: list[str], *, spread: Column, hot_rows: int = 100_000) -> DataFrame:
    """Inner equi-join whose hot keys are spread over several tasks.

    Keys with more than ``hot_rows`` rows on the right get one salt per
    ``hot_rows`` rows: right rows take the salt of ``spread`` (a column that
    differs within a key), left rows are repeated once per salt.  The table of hot
    keys has at most rows/hot_rows rows.  Nothing is dropped; null keys match nothing.
    """
    hot = right.dropna(subset=keys).groupBy(*keys).count().where(F.col("count") > hot_rows)
    hot = hot.select(*keys, F.ceil(F.col("count") / hot_rows).cast("int").alias("_salts"))
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    r = right.withColumn("_spread", F.xxhash64(spread)).join(hot, keys, "left").withColumn("_salt", F.pmod(F.col("_spread"), salts).cast("int"))
    l = left.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return l.drop("_salts").join(r.drop("_salts", "_spread"), [*keys, "_salt"]).drop("_salt")


def spread_rank(df: DataFrame, groups: list[str], order: Column, tie: str, *, bits: int = 10, name: str = "rank") -> DataFrame:
    """Exact 1-based rank within each group by a 64-bit order value, then ``tie``.

    A group is cut into 2**bits ranges of the (hash-like) order value; counts of the
    ranges give offsets, and only the rows of one range are sorted together, so a
    group that holds all rows is still ranked in parallel.
    """
    d = df.withColumn("_order", order).withColumn("_range", F.shiftrightunsigned(F.col("_order"), 64 - bits))
    keys = [*groups, "_range"]
    sizes = d.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*groups).orderBy("_range") if groups else W.orderBy("_range")
    offsets = sizes.withColumn("_before", F.sum("_n").over(before) - F.col("_n")).drop("_n")
    for g in groups:  # null groups are groups too
        offsets = offsets.withColumnRenamed(g, f"_o_{g}")
    offsets = offsets.withColumnRenamed("_range", "_o_range")
    on = F.col("_range") == F.col("_o_range")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    local = F.row_number().over(W.partitionBy(*keys).orderBy("_order", tie))
    ranked = d.withColumn("_local", local).join(offsets, on)
    return ranked.withColumn(name, F.col("_local") + F.col("_before")).drop("_order", "_range", "_local", "_before", "_o_range", *[f"_o_{g}" for g in groups])
