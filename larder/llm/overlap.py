"""Same or near-same pictures across splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import values as V
from larder.operators.hamming import hamming_cross_pairs
from larder.operators.skew import hot_salted_join
from larder.session import Scratch

NEAR = 5


def canonical_items(items: DataFrame) -> DataFrame:
    """(item_id, split, source, sha, ph), read into one notation; rows without a split or an id are left out.

    The split is that of ``split``, or where that is null or blank, that of a folder of
    rel_path.
    """
    split = F.when(V.is_blank("split"), V.split_of_folders("rel_path")).otherwise(V.read_split("split"))
    return items.select(
        "item_id", split.alias("split"), V.read_name("source").alias("source"),
        F.unhex(V.sha256_text("sha256")).alias("sha"), V.phash_bits("phash").alias("ph"),
    ).where("split is not null and item_id is not null")


def cross_split_pairs(items: DataFrame, *, max_distance: int = NEAR) -> DataFrame:
    """(eval_id, train_id, split, source, exact): every pair of an evaluation row and a train row of the same or near-same picture, once.

    ``split`` and ``source`` are those of the evaluation row; ``exact`` says whether
    the files are equal.  Canonical digests are joined by equality; different picture
    hashes by a banded Hamming join over distinct values, whose links are then carried
    back to the rows.  Hot digests and hashes are salted.
    """
    scratch = Scratch(items.sparkSession, "overlap")
    rows = scratch.keep(canonical_items(items), "items")
    train = rows.where("split = 'train'").select(F.col("item_id").alias("train_id"), F.col("sha").alias("t_sha"), F.col("ph").alias("t_ph"))
    held = rows.where("split != 'train'").select(F.col("item_id").alias("eval_id"), "split", "source", F.col("sha").alias("e_sha"), F.col("ph").alias("e_ph"))

    same = hot_salted_join(held.select("eval_id", "split", "source", F.col("e_sha").alias("k")), train.select("train_id", F.col("t_sha").alias("k")), ["k"], spread=F.col("train_id"))
    same = same.select("eval_id", "train_id", "split", "source", F.lit(True).alias("exact"))

    e_values = held.select(F.col("e_ph").alias("h")).where("h is not null").distinct()
    t_values = train.select(F.col("t_ph").alias("h")).where("h is not null").distinct()
    near = hamming_cross_pairs(e_values, t_values, "h", max_distance, n_distinct=rows.select("ph").distinct().count())
    both = e_values.join(t_values, "h", "left_semi").select(F.col("h").alias("a"), F.col("h").alias("b"))
    links = scratch.keep(near.unionByName(both), "links")
    left = hot_salted_join(links, held.withColumnRenamed("e_ph", "a").where("a is not null"), ["a"], spread=F.col("eval_id"))
    pairs = hot_salted_join(left, train.withColumnRenamed("t_ph", "b").where("b is not null"), ["b"], spread=F.col("train_id"))
    pairs = pairs.where(~F.coalesce(F.col("e_sha") == F.col("t_sha"), F.lit(False)))
    return same.unionByName(pairs.select("eval_id", "train_id", "split", "source", F.lit(False).alias("exact")))


def overlap_report(items: DataFrame, *, max_distance: int = NEAR) -> DataFrame:
    """(split, source, items, leaked_items, exact_pairs, near_pairs) for valid and test; a null source is one of its own.

    Counted without expanding pairs: links between distinct values times the number of
    train rows with each value.
    """
    scratch = Scratch(items.sparkSession, "overlap")
    rows = scratch.keep(canonical_items(items), "items")
    train, held = rows.where("split = 'train'"), rows.where("split != 'train'")
    by_sha = train.where("sha is not null").groupBy("sha").agg(F.count("*").alias("n_same"))
    by_ph = train.where("ph is not null").groupBy("ph").agg(F.count("*").alias("n"))
    by_both = train.where("sha is not null and ph is not null").groupBy("sha", "ph").agg(F.count("*").alias("n_both"))
    e_values = held.select(F.col("ph").alias("h")).where("h is not null").distinct()
    t_values = by_ph.select(F.col("ph").alias("h"))
    near = hamming_cross_pairs(e_values, t_values, "h", max_distance, n_distinct=rows.select("ph").distinct().count())
    both = e_values.join(t_values, "h", "left_semi").select(F.col("h").alias("a"), F.col("h").alias("b"))
    links = scratch.keep(near.unionByName(both), "links")
    near_n = links.join(by_ph, links.b == by_ph.ph).groupBy("a").agg(F.sum("n").alias("n_near"))
    kinds = held.groupBy("split", "source", "sha", "ph").agg(F.count("*").alias("items"))
    # pairs that are near by phash and the same file as well count as exact only
    dup = kinds.where("sha is not null and ph is not null").select("sha", F.col("ph").alias("a")).distinct().join(links, "a")
    dup = dup.join(by_both, (dup.sha == by_both.sha) & (dup.b == by_both.ph)).groupBy(dup.sha, "a").agg(F.sum("n_both").alias("n_dup"))
    k = kinds.join(by_sha, "sha", "left").join(near_n, kinds.ph == near_n.a, "left").drop("a")
    k = k.join(dup.withColumnsRenamed({"sha": "_sha", "a": "_a"}), (k.sha == F.col("_sha")) & (k.ph == F.col("_a")), "left").na.fill(0, ["n_same", "n_near", "n_dup"])
    n_near = F.col("n_near") - F.col("n_dup")
    return k.groupBy("split", "source").agg(
        F.sum("items").alias("items"),
        F.sum(F.when(F.col("n_same") + n_near > 0, F.col("items")).otherwise(0)).alias("leaked_items"),
        F.sum(F.col("items") * F.col("n_same")).alias("exact_pairs"),
        F.sum(F.col("items") * n_near).alias("near_pairs"),
    )
