"""Sinks: reports of fixed columns, append-only logs, a keyed cache, a summary document, class names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(rows: DataFrame, path: str, fields: list[str]) -> None:
    """CSV with exactly these columns: unknown ones dropped, missing ones and nulls empty."""
    known = set(rows.columns)
    out = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in known else F.lit("").alias(f) for f in fields]
    rows.select(*out).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_cache(rows: DataFrame, path: str, key: str) -> None:
    """The whole cache, sorted by key over all files."""
    rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def summary_document(counts: DataFrame, dimension: str, value: str, n: str) -> DataFrame:
    """(json): {dimension: {value: n}} of a table of counts, sorted; a null value is named 'none'."""
    pair = F.struct(F.coalesce(value, F.lit("none")), F.col(n))
    by = counts.groupBy(dimension).agg(F.array_sort(F.collect_list(pair)).alias("m"))
    entries = F.array_sort(F.collect_list(F.struct(dimension, "m")))
    return by.agg(F.to_json(F.map_from_entries(F.transform(entries, lambda e: F.struct(e[dimension], F.map_from_entries(e["m"]))))).alias("json"))


def class_names_document(names: DataFrame, index: str, name: str) -> DataFrame:
    """(json): the array of class names in order of their index; a list of classes, one short row each."""
    return names.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(index, name))), lambda r: r[name])).alias("json"))
