"""The queries of the training-data problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import values as V
from larder.llm import history, leakage, mixing, overlap, packing, splits, subjects, survivors
from larder.session import Scratch, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.RelatedSets(table(spark, d, "source_record")).straddling()


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.grouped_splits(table(spark, d, "source_record"), table(spark, d, "split_ratio"))


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_shares(table(spark, d, "source_record"), table(spark, d, "split_ratio"))


def p1_totals(spark: SparkSession, d: str) -> DataFrame:
    return p1_shares(spark, d).select("split", "records")


def p1_split_faults(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "source_record")
    return splits.split_faults(records, splits.grouped_splits(records, table(spark, d, "split_ratio")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.cross_split_pairs(table(spark, d, "audit_item"))
    return pairs.select(F.least("eval_id", "train_id").alias("item_a"), F.greatest("eval_id", "train_id").alias("item_b"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "audit_item"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return history.known_candidates(table(spark, d, "recipe_candidate"), table(spark, d, "image_item"))


def _survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "image_item"), sources=table(spark, d, "source_spec"), classes=table(spark, d, "price_row"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.supplied_fields(_survivors(spark, d))


def p4_survivors(spark: SparkSession, d: str) -> DataFrame:
    return _survivors(spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.short_sources(table(spark, d, "image_item"), table(spark, d, "source_spec"), "item_id")


def p5_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "image_item"), table(spark, d, "source_spec"), "item_id")


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(table(spark, d, "image_item"), table(spark, d, "source_spec"), "item_id")


def p5_exact_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(table(spark, d, "image_item"), table(spark, d, "source_spec"), "item_id", exact_shares=True)


def _token_mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The documents with their token lengths and a source_name, and a spec in which each source has the same weight and may come twice."""
    scratch = Scratch(spark, "mixing")
    documents = table(spark, d, "documents")
    sizes = packing.measured(documents.dropDuplicates(["doc_id"])).select("doc_id", "tokens")
    rows = scratch.keep(sizes.join(documents.dropDuplicates(["doc_id"]).select("doc_id", F.col("source").alias("source_name")), "doc_id"), "sized")
    spec = rows.select(V.read_name("source_name").alias("name")).where("name is not null").distinct()
    return rows, spec.select("name", F.lit("").alias("root"), F.lit(1).alias("train_weight"), F.lit(1).alias("priority"), F.lit(2).alias("max_repeats"))


def p5_token_mix(spark: SparkSession, d: str) -> DataFrame:
    rows, spec = _token_mix(spark, d)
    return mixing.mix_sources(rows, spec, "doc_id", size=F.col("tokens"), exact_shares=True)


def p5_token_shares(spark: SparkSession, d: str) -> DataFrame:
    rows, spec = _token_mix(spark, d)
    return mixing.mix_report(rows, spec, "doc_id", size=F.col("tokens"), exact_shares=True)


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_containers(table(spark, d, "documents"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_containers(spark, d))


def p6_locality(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "packing")
    sizes = scratch.keep(packing.measured(table(spark, d, "documents")), "sizes")
    return packing.locality_report(packing.packed(sizes), sizes)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The leaks within the edit budget, and of these the ones that are word for word."""
    return leakage.word_for_word(_leaks(spark, d))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(_leaks(spark, d), table(spark, d, "documents"), table(spark, d, "eval_item"))


def _subjects(spark: SparkSession, d: str) -> subjects.SubjectModel:
    return subjects.SubjectModel(table(spark, d, "documents"), table(spark, d, "subject_area"), table(spark, d, "doc_label"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).found()


def p8_makeup(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).makeup()


def p8_labels(spark: SparkSession, d: str) -> DataFrame:
    return subjects.label_agreement(_subjects(spark, d).found(), table(spark, d, "doc_label"))


def p8_heldout(spark: SparkSession, d: str) -> DataFrame:
    return subjects.held_out_agreement(table(spark, d, "documents"), table(spark, d, "subject_area"), table(spark, d, "doc_label"))


QUERIES = {f.__name__: f for f in (p1_found, p1_splits, p1_shares, p1_totals, p1_split_faults, p2_found, p2_report, p3_found, p4_found, p4_survivors, p5_found, p5_mix, p5_shares, p5_exact_shares, p5_token_mix, p5_token_shares, p6_containers, p6_fill, p6_locality, p7_found, p7_leaks, p7_report, p8_found, p8_makeup, p8_labels, p8_heldout)}
