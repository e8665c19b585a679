"""Building a data set: representatives, splits, caps, quotas, repeats, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from larder.operators.skew import spread_rank


def seeded(seed: int, *keys: str) -> Column:
    """A hex digest that stands for a seeded shuffle; the same wherever SHA-256 is."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 256)


def seeded_bits(digest: Column) -> Column:
    """The first 64 bits of a hex digest, in the order of the digest when read as unsigned."""
    half = lambda k: F.conv(F.substring(digest, k, 8), 16, 10).cast("bigint")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def shuffled_rank(df: DataFrame, groups: list[str], seed: int, ident: str) -> DataFrame:
    """``rank`` (1-based) in seeded order and ``n``, the size of the group; a hot group is ranked in parallel."""
    sizes = df.groupBy(*[F.col(g).alias(f"_g_{g}") for g in groups]).agg(F.count("*").alias("n"))
    ranked = spread_rank(df, groups, seeded_bits(seeded(seed, ident)), ident)
    on = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups] or [F.lit(True)]
    joined = ranked.join(sizes if groups else F.broadcast(sizes), on)  # without groups one row
    return joined.drop(*[f"_g_{g}" for g in groups])


def representatives(records: DataFrame) -> DataFrame:
    """(dataset, capture, record_id, variants): of each capture the row with the least black border, then the sharpest, then the least path and id.

    A null border or sharpness comes last.
    """
    border = F.coalesce(F.col("black_border_ratio"), F.lit(float("inf")))
    blur = -F.coalesce(F.col("blur_score"), F.lit(float("-inf")))
    best = F.min(F.struct(border, blur, F.coalesce("image_path", F.lit("")), F.col("record_id").alias("id")))
    return records.groupBy("dataset", "capture").agg(best.alias("b"), F.count("*").alias("variants")).select("dataset", "capture", F.col("b.id").alias("record_id"), "variants")


def group_sizes(records: DataFrame) -> DataFrame:
    """(dataset, group_size, groups, records): histogram of captures by their number of records."""
    sizes = records.groupBy("dataset", "capture").agg(F.count("*").alias("group_size"))
    return sizes.groupBy("dataset", "group_size").agg(F.count("*").alias("groups"), F.sum("group_size").alias("records"))


def split_counts(n: Column, train: float, val: float, test: float) -> tuple[Column, Column]:
    """(val, test) out of n: rounded half to even, at least one each from three rows on, cut back so that train keeps a row.

    While both together leave nothing, the larger (val on a tie) gives one up: with
    excess x, val first falls to test's level, then both by turns.
    """
    whole = train + val + test
    v, t = F.bround(n * F.lit(val / whole)).cast("bigint"), F.bround(n * F.lit(test / whole)).cast("bigint")
    if val > 0:
        v = F.when(n >= 3, F.greatest(v, F.lit(1))).otherwise(v)
    if test > 0:
        t = F.when(n >= 3, F.greatest(t, F.lit(1))).otherwise(t)
    excess = F.greatest(v + t - n + 1, F.lit(0))
    level_v, level_t = F.least(F.greatest(v - t, F.lit(0)), excess), F.least(F.greatest(t - v, F.lit(0)), excess)
    rest = excess - level_v - level_t
    return v - level_v - F.ceil(rest / 2), t - level_t - F.floor(rest / 2)


def assign_splits(items: DataFrame, ident: str, group: str, *, seed: int = 42, train: float = 0.8, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """(id, group, split): within each group the first rows in seeded order train, the next val, the last test."""
    r = shuffled_rank(items.select(ident, group), [group], seed, ident)
    v, t = split_counts(F.col("n"), train, val, test)
    split = F.when(F.col("rank") <= F.col("n") - v - t, "train").when(F.col("rank") <= F.col("n") - t, "val").otherwise("test")
    return r.select(ident, group, split.alias("split"))


def positional_split(items: DataFrame, ident: str, *, seed: int = 42) -> DataFrame:
    """(id, split): the first int(0.8 n) rows in seeded order train, up to int(0.9 n) val, the rest test."""
    r = shuffled_rank(items.select(ident), [], seed, ident)
    at, n = F.col("rank") - 1, F.col("n")
    split = F.when(at < F.floor(n * F.lit(0.8)), "train").when(at < F.floor(n * F.lit(0.9)), "val").otherwise("test")
    return r.select(ident, split.alias("split"))


def cap_source(items: DataFrame, ident: str, label: str, source: str, *, capped: str, reference: str, ratio: float = 1.0, least: int = 5, seed: int = 42) -> DataFrame:
    """(id, label, source, status): rows of one source beyond max(least, round(ratio * rows of the reference source)) in each label are skipped.

    Rounding is half to even; with a ratio of 0 or less nothing is skipped.  Which rows
    stay is drawn in seeded order.
    """
    rows = items.select(ident, label, source)
    if ratio <= 0:
        return rows.withColumn("status", F.lit("kept"))
    limit = rows.groupBy(F.col(label).alias("_l")).agg(F.greatest(F.lit(least), F.bround(F.count_if(F.col(source) == reference) * F.lit(ratio)).cast("bigint")).alias("_limit"))
    own = shuffled_rank(rows.where(F.col(source) == capped), [label], seed, ident)
    own = own.join(limit, F.col(label).eqNullSafe(F.col("_l"))).select(ident, label, source, F.when(F.col("rank") <= F.col("_limit"), "kept").otherwise("skipped").alias("status"))
    others = rows.where(~F.coalesce(F.col(source) == capped, F.lit(False))).withColumn("status", F.lit("kept"))
    return own.unionByName(others)


def quota(items: DataFrame, group: str, order: str, accepted: str, *, per_group: int) -> DataFrame:
    """Rows up to the per_group-th accepted one of each group, in the (unique, rising) order; later rows give no row.

    Only the accepted rows below a group's limit are ranked.
    """
    ok = items.where(F.col(accepted)).select(group, order)
    # the limit is pushed below the shuffle: each task hands on per_group rows of a group
    first = ok.withColumn("_larder_k", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("_larder_k") <= per_group)
    nth = first.where(F.col("_larder_k") == per_group).select(F.col(group).alias("_larder_g"), F.col(order).alias("_larder_last"))
    joined = items.join(nth, F.col(group).eqNullSafe(F.col("_larder_g")), "left")
    return joined.where(F.col("_larder_last").isNull() | (F.col(order) <= F.col("_larder_last"))).drop("_larder_g", "_larder_last")


def repeat_rows(items: DataFrame, weight: str, *, when: Column | None = None, keep: list[str]) -> DataFrame:
    """The kept columns and repeat_index 0..weight-1; a weight that is null or below 1 counts as 1, rows outside ``when`` come once."""
    n = F.greatest(F.coalesce(F.col(weight), F.lit(1)), F.lit(1))
    n = n if when is None else F.when(when, n).otherwise(1)
    return items.select(*keep, F.explode(F.sequence(F.lit(0), n - 1)).alias("repeat_index"))


def class_weights(items: DataFrame, label: str, labels: DataFrame, *, boosts: dict[str, float] | None = None) -> DataFrame:
    """(label, n, weight, sample_weight): total / (K * max(n, 1)) and 1 / max(n, 1) times the label's boost for each listed label; others do not count."""
    boost = F.lit(1.0)
    for name, factor in (boosts or {}).items():
        boost = F.when(F.col(label) == name, float(factor)).otherwise(boost)
    counts = labels.join(items.groupBy(label).agg(F.count("*").alias("n")), label, "left").na.fill(0, ["n"])
    sums = counts.agg(F.sum("n").alias("_t"), F.count("*").alias("_k"))
    floor = F.greatest(F.col("n"), F.lit(1))
    return counts.join(F.broadcast(sums)).select(label, "n", (F.col("_t") / (F.col("_k") * floor)).alias("weight"), (F.lit(1.0) / floor * boost).alias("sample_weight"))  # one row


def manifest_counts(items: DataFrame, split: str, label: str, splits: DataFrame, labels: DataFrame, size: str) -> DataFrame:
    """(split, label, n, bytes) over the grid of the listed splits and labels, zeros where nothing lies."""
    grid = splits.join(F.broadcast(labels))  # two short lists
    counts = items.groupBy(split, label).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    return grid.join(counts, [split, label], "left").na.fill(0, ["n", "bytes"])


def count_tree(items: DataFrame, dims: list[str]) -> DataFrame:
    """(dimension, value, n): the total and the counts by each dimension, in one pass."""
    rows = items.groupingSets([[]] + [[d] for d in dims], *dims).agg(F.count("*").alias("n"), *[F.grouping(d).alias(f"_{d}") for d in dims])
    name, value = F.lit("total"), F.lit(None).cast("string")
    for d in dims:
        name = F.when(F.col(f"_{d}") == 0, d).otherwise(name)
        value = F.when(F.col(f"_{d}") == 0, F.col(d).cast("string")).otherwise(value)
    return rows.select(name.alias("dimension"), value.alias("value"), "n")


def manifest_diff(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, only_in ('a' or 'b') and surplus: rows that one side has more often; empty if both are equal as multisets."""
    both = a.select(*columns, F.lit(1).alias("_s")).unionByName(b.select(*columns, F.lit(-1).alias("_s")))
    net = both.groupBy(*columns).agg(F.sum("_s").alias("surplus")).where("surplus != 0")
    return net.select(*columns, F.when(F.col("surplus") > 0, "a").otherwise("b").alias("only_in"), F.abs("surplus").alias("surplus"))


def sync_plan(source: DataFrame, target: DataFrame, *, apply: bool = False, overwrite: bool = False) -> DataFrame:
    """(name, status, bytes): what copying each named file would do.

    source, target: name, sha, bytes.  missing_source, same (equal size and digest),
    target_exists, planned or copied, in this order of tests.
    """
    s = source.select("name", F.col("sha").alias("s_sha"), F.col("bytes").alias("s_bytes"), F.lit(True).alias("s"))
    t = target.select("name", F.col("sha").alias("t_sha"), F.col("bytes").alias("t_bytes"), F.lit(True).alias("t"))
    same = (F.col("s_sha") == F.col("t_sha")) & (F.col("s_bytes") == F.col("t_bytes"))
    status = F.when(F.col("s").isNull(), "missing_source").when(F.col("t").isNotNull() & same, "same")
    if not overwrite:
        status = status.when(F.col("t").isNotNull(), "target_exists")
    status = status.otherwise("copied" if apply else "planned")
    return s.join(t, "name", "full_outer").select("name", status.alias("status"), F.coalesce("s_bytes", F.lit(0)).cast("bigint").alias("bytes"))


def latest_per_kind(runs: DataFrame, kind: str, at: str, name: str) -> DataFrame:
    """(kind, latest, at): the newest run of each kind, of equal times the greatest name."""
    return runs.groupBy(kind).agg(F.max(F.struct(at, name)).alias("m")).select(kind, F.col(f"m.{name}").alias("latest"), F.col(f"m.{at}").alias("at"))


def cache_misses(files: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Files whose (path, size, time) has no row in the cache and must be hashed again; a null key never hits."""
    return files.join(cache.select(*keys).distinct(), keys, "left_anti")


def numbered_names(items: DataFrame, folder: str, name: str, order: str) -> DataFrame:
    """(order, folder, name, target): the first of equal names stays, later ones get _001, _002, ... before the suffix.

    A number whose name another row bears by nature is passed over; the numbers left
    over are given in order, so targets are unique in a folder.
    """
    stem = F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 1)
    suffix = F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 2)
    k = F.row_number().over(W.partitionBy(folder, name).orderBy(order)) - 1
    rows = items.select(order, folder, name, k.alias("_k"), stem.alias("_stem"), suffix.alias("_suffix"))
    taken = items.select(F.col(folder).alias("_f"), F.col(name).alias("_t")).distinct()
    taken = taken.select("_f", F.regexp_extract("_t", r"(?s)^(.+)_(\d{3,})(\.[^.]*)?$", 1).alias("_s"), F.regexp_extract("_t", r"(?s)^(.+)_(\d{3,})(\.[^.]*)?$", 2).alias("_d"), F.regexp_extract("_t", r"(?s)^(.+)_(\d{3,})(\.[^.]*)?$", 3).alias("_x")).where("_d != ''")
    taken = taken.select("_f", "_s", "_x", F.try_to_number("_d", F.lit("999999999")).cast("bigint").alias("_no"), "_d").where("_d = lpad(cast(_no as string), greatest(3, length(cast(_no as string))), '0') and _no > 0")
    used = taken.groupBy("_f", "_s", "_x").agg(F.array_sort(F.collect_set("_no")).alias("_used"))
    on = F.col(folder).eqNullSafe(F.col("_f")) & (F.col("_stem") == F.col("_s")) & (F.col("_suffix") == F.col("_x"))
    got = rows.join(used, on, "left")
    # the k-th free number: pass over each natural number in turn
    no = F.aggregate(F.coalesce("_used", F.expr("array()").cast("array<bigint>")), F.col("_k").cast("bigint"), lambda n, u: F.when(u <= n, n + 1).otherwise(n))
    target = F.when(F.col("_k") == 0, F.col(name)).otherwise(F.concat("_stem", F.lit("_"), F.when(no < 1000, F.lpad(no.cast("string"), 3, "0")).otherwise(no.cast("string")), "_suffix"))
    return got.select(order, folder, name, target.alias("target"))
