"""Best representative of each group of duplicates, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import values as V
from larder.operators.components import connected_components, star_links
from larder.operators.hamming import hamming_pairs
from larder.session import Scratch

NEAR = 5
FIELDS = ("source_name", "class_name", "train_weight")


def trust_order(priority: str = "priority", at: str = "accepted_at", ident: str = "item_id") -> list[Column]:
    """Columns whose greatest struct is the most trusted row: priority 1..9 ascending (others last), latest, least id."""
    p = F.when(F.col(priority).between(1, 9), F.col(priority)).otherwise(10)
    return [(-p).alias("p"), F.col(at).alias("at"), (-F.col(ident)).alias("neg_id")]


def survivors(items: DataFrame, *, sources: DataFrame, classes: DataFrame, max_distance: int = NEAR) -> DataFrame:
    """One row for each group of at least two rows of the same or near-same picture.

    (group_id, rows, and for each field <field> and <field>_item): group_id is the
    least item_id, each field the value of the most trusted row with a usable value and
    that row's id, both null if no row has one.  Usable: a listed source, a listed
    class, a weight of at least 1.

    Rows with equal digest and hash are folded first, with the greatest trust struct of
    each field; the folded rows are linked (stars over equal values, a banded Hamming
    join over distinct hashes), and a last aggregation takes the greatest structs of
    each component.  Rows with neither value, or without an id, belong to no group.
    """
    scratch = Scratch(items.sparkSession, "survivors")
    listed = sources.select(V.read_name("name").alias("source")).where("source is not null").distinct()
    valid = classes.select(V.read_name("class_name").alias("class")).where("class is not null").distinct()
    rows = items.select(
        "item_id", "priority", "accepted_at", "train_weight", V.read_name("source_name").alias("source"), V.read_name("class_name").alias("class"),
        F.unhex(V.sha256_text("sha256")).alias("sha"), V.phash_bits("phash").alias("ph"),
    ).where("item_id is not null and (sha is not null or ph is not null)")
    rows = rows.join(listed.withColumn("source_ok", F.lit(True)), "source", "left").join(valid.withColumn("class_ok", F.lit(True)), "class", "left")
    usable = {
        "source_name": (F.col("source_ok"), F.col("source")),
        "class_name": (F.col("class_ok"), F.col("class")),
        "train_weight": (F.col("train_weight") >= 1, F.col("train_weight")),
    }
    best = [F.max(F.when(ok, F.struct(*trust_order(), value.alias("value")))).alias(f) for f, (ok, value) in usable.items()]
    folded = scratch.keep(rows.groupBy("sha", "ph").agg(F.min("item_id").alias("node"), F.count("*").alias("rows"), *best), "folded")

    hashes = folded.where("ph is not null").groupBy("ph").agg(F.min("node").alias("node"))
    hashes = scratch.keep(hashes, "hashes")
    near = hamming_pairs(hashes, "ph", max_distance, n_distinct=hashes.count()).select("a", "b")
    ends = near.join(hashes.select(F.col("ph").alias("a"), F.col("node").alias("u")), "a").join(hashes.select(F.col("ph").alias("b"), F.col("node").alias("v")), "b")
    links = ends.select("u", "v").unionByName(star_links(folded, "sha", "node")).unionByName(star_links(folded, "ph", "node"))
    roots = connected_components(scratch.keep(links, "links"), scratch)
    grouped = folded.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    out = grouped.groupBy("root").agg(F.min("node").alias("group_id"), F.sum("rows").alias("rows"), *[F.max(f).alias(f) for f in FIELDS]).where("rows >= 2")
    fields = [c for f in FIELDS for c in (F.col(f"{f}.value").alias(f), (-F.col(f"{f}.neg_id")).alias(f"{f}_item"))]
    return out.select("group_id", "rows", *fields)


def supplied_fields(survived: DataFrame) -> DataFrame:
    """(group_id, field_name, item_id): the row that supplies each field."""
    each = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{f}_item").alias("item_id")) for f in FIELDS])
    return survived.select("group_id", F.explode(each).alias("f")).select("group_id", "f.*").where("item_id is not null")
