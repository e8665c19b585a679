"""Splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import values as V
from larder.llm.subset import closest_subset
from larder.operators.components import connected_components, star_links
from larder.operators.skew import hot_salted_join, spread_rank
from larder.session import Scratch

_FLAGS = {"train": 1, "valid": 2, "test": 4}


class RelatedSets:
    """Records of one capture or one picture, linked directly or through others.

    ``units`` has a row for each capture (or record without one): unit, root, records,
    weight, flags, capture_key.  ``sets`` has a row for each linked set: root, records,
    weight, flags, group_key.

    Records without a capture (group and path blank) are linked by sha256 alone; a null
    data set counts as one named ''.  A variant_count that is null or below 1 weighs 1.
    A set none of whose records has a capture takes ``dataset/`` as its group_key.
    Rows without a record_id are left out; repeated rows count as often as they come.
    """

    def __init__(self, records: DataFrame, scratch: Scratch | None = None):
        scratch = scratch or Scratch(records.sparkSession, "splits")
        self.scratch = scratch
        data_set = F.coalesce("dataset", F.lit(""))
        capture = V.read_capture("source_group", "image_path")
        sha = V.sha256_text("sha256")
        split = V.read_split("split")
        flag = F.lit(0)
        for name, bit in _FLAGS.items():
            flag = F.when(split == name, bit).otherwise(flag)
        r = records.where("record_id is not null").select(
            "record_id",
            F.concat(data_set, F.lit("/"), capture).alias("capture_key"),
            F.concat(data_set, F.lit("/")).alias("bare_key"),
            F.when(sha != V.empty_file_sha256(), F.unhex(sha)).alias("sha"),
            flag.alias("flag"),
            F.greatest(F.coalesce(F.col("variant_count"), F.lit(1)), F.lit(1)).cast("bigint").alias("weight"),
        )
        r = r.withColumn("unit", F.coalesce("capture_key", F.concat(F.lit("\0"), F.col("record_id").cast("string"))))
        self.records = scratch.keep(r.select("record_id", "unit", "capture_key", "bare_key", "sha", "flag", "weight"), "records")
        r = self.records
        units = r.groupBy("unit").agg(
            F.min("record_id").alias("node"), F.count("*").alias("records"), F.sum("weight").alias("weight"),
            F.bit_or("flag").alias("flags"), F.min("capture_key").alias("capture_key"), F.min("bare_key").alias("bare_key"),
        )
        units = scratch.keep(units, "units")
        pictures = r.where("sha is not null").select("unit", "sha").distinct()
        shared = pictures.groupBy("sha").agg(F.count("*").alias("_n")).where("_n > 1").select("sha")
        pairs = pictures.join(shared, "sha").join(units.select("unit", "node"), "unit").select("sha", "node")
        links = scratch.keep(star_links(pairs, "sha", "node"), "links")
        roots = connected_components(links, scratch)
        found = units.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        self.units = scratch.keep(found.select("unit", "root", "records", "weight", "flags", "capture_key", "bare_key"), "sets")
        self.sets = self.units.groupBy("root").agg(
            F.sum("records").alias("records"), F.sum("weight").alias("weight"), F.bit_or("flags").alias("flags"),
            F.coalesce(F.min("capture_key"), F.min("bare_key")).alias("group_key"),
        )

    def straddling(self) -> DataFrame:
        """(record_id, group_key): every record of each set whose splits differ now."""
        cases = self.sets.where(F.bit_count("flags") > 1).select("root", "group_key")
        units = self.units.select("unit", "root").join(cases, "root").select("unit", "group_key")
        return self.carried(units).select("record_id", "group_key")

    def carried(self, units: DataFrame) -> DataFrame:
        """The records with what ``units`` (a row for each unit) says of theirs; a hot unit is spread over several tasks."""
        return hot_salted_join(units, self.records.select("record_id", "unit"), ["unit"], spread=F.col("record_id"))

    def assign(self, ratios: dict[str, float], *, seed: int = 7) -> DataFrame:
        """(root, split, records, weight): a split for each set, totals as near as possible to the shares.

        Set sizes with their multiplicities (at most about sqrt(2 * records) rows) are
        planned by subset sums, smallest share first; the last and largest share takes
        the rest.  Each total is the closest of all that the sets left allow, made of sizes
        as they come in the whole.  Which sets of a size go where is drawn by a seeded hash.
        """
        spark = self.records.sparkSession
        sets = self.scratch.keep(self.sets.select("root", "records", "weight"), "sized")
        counts = {r["records"]: r["n"] for r in sets.groupBy("records").agg(F.count("*").alias("n")).collect()}
        total, order = sum(s * c for s, c in counts.items()), sorted(ratios, key=lambda s: (ratios[s] or 0, s))
        whole = sum(ratios[s] or 0 for s in order) or 1
        used, quotas = dict.fromkeys(counts, 0), []
        for k, split in enumerate(order):
            left = {s: c - used[s] for s, c in counts.items()}
            take = left if k == len(order) - 1 else closest_subset(left, round(total * (ratios[split] or 0) / whole), seed=seed + k)
            for size, n in take.items():
                if n:
                    quotas.append((size, split, used[size], used[size] + n))
                    used[size] += n
        q = spark.createDataFrame(quotas, "size bigint, split string, low bigint, high bigint")
        ranked = spread_rank(sets, ["records"], F.xxhash64(F.lit(seed), "root"), "root")
        on = (F.col("records") == F.col("size")) & (F.col("rank") > F.col("low")) & (F.col("rank") <= F.col("high"))
        return ranked.join(q, on).select("root", "split", "records", "weight")


def split_ratios(table: DataFrame) -> dict[str, float]:
    """The shares by split; the table has one row for each split."""
    rows = table.select(V.read_split("split").alias("s"), F.col("ratio").alias("r")).where("s is not null").groupBy("s").agg(F.max("r").alias("r")).collect()
    return {r["s"]: float(r["r"] or 0) for r in rows}


def grouped_splits(records: DataFrame, ratio: DataFrame, *, seed: int = 7) -> DataFrame:
    """(record_id, split): the new split of every record."""
    sets = RelatedSets(records)
    given = sets.assign(split_ratios(ratio), seed=seed).select("root", "split")
    units = sets.units.select("unit", "root").join(given, "root").select("unit", "split")
    return sets.carried(units).select("record_id", "split")


def split_shares(records: DataFrame, ratio: DataFrame, *, seed: int = 7) -> DataFrame:
    """(split, target_share, records, record_share, weight, weight_share, sets), the weight being variant_count."""
    sets = RelatedSets(records)
    given = sets.assign(split_ratios(ratio), seed=seed)
    got = given.groupBy("split").agg(F.sum("records").alias("records"), F.sum("weight").alias("weight"), F.count("*").alias("sets"))
    target = ratio.select(V.read_split("split").alias("split"), F.col("ratio").alias("target_share")).where("split is not null")
    total = got.agg(F.sum("records").alias("_r"), F.sum("weight").alias("_w"))
    joined = target.join(got, "split", "left").na.fill(0, ["records", "weight", "sets"]).join(F.broadcast(total))  # one row
    return joined.select(
        "split", "target_share", "records", F.try_divide("records", "_r").alias("record_share"),
        "weight", F.try_divide("weight", "_w").alias("weight_share"), "sets",
    )


def split_faults(records: DataFrame, assigned: DataFrame) -> DataFrame:
    """(kind, key, splits): captures and files whose records were given more than one split; empty for a right assignment.

    assigned: record_id, split.  Read from the records themselves, not from the sets.
    """
    capture = F.concat(F.coalesce("dataset", F.lit("")), F.lit("/"), V.read_capture("source_group", "image_path"))
    sha = V.sha256_text("sha256")
    each = F.array_compact(F.array(
        F.when(capture.isNotNull(), F.struct(F.lit("capture").alias("kind"), capture.alias("key"))),
        F.when(sha != V.empty_file_sha256(), F.struct(F.lit("file").alias("kind"), sha.alias("key")))))
    rows = records.select(F.col("record_id"), F.explode(each).alias("k")).select("record_id", "k.kind", "k.key")
    by = rows.join(assigned.select("record_id", "split"), "record_id").groupBy("kind", "key").agg(F.count_distinct("split").alias("splits"))
    return by.where("splits > 1")
