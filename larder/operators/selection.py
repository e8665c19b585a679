"""Selections and lookups of picture collections: sources, reports, detections, quotas, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.dedup import greedy_dedup, known_in_base

#: The suffixes and key words of report files.
REPORT_SUFFIXES = (".txt", ".json", ".csv", ".png", ".jpg", ".jpeg")
REPORT_WORDS = ("report", "history", "result", "confusion", "curve", "labels", "pred")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def source_of_name(path: Column) -> Column:
    """old, reviewed or unmanaged, by the beginning of the file name; null for null."""
    name = base_name(path)
    return F.when(name.startswith("old_"), "old").when(name.startswith("reviewed_"), "reviewed").when(path.isNotNull(), "unmanaged")


def is_report(path: Column) -> Column:
    """Whether a file of a run is a report: a known suffix, and a folder named reports or a key word in the name."""
    low = F.lower(path)
    name = base_name(low)
    suffix = name.rlike(r"(?s)^.+(" + "|".join(s.replace(".", r"\.") for s in REPORT_SUFFIXES) + ")$")
    word = F.exists(F.array(*map(F.lit, REPORT_WORDS)), lambda w: F.contains(name, w))
    return F.coalesce(suffix & (F.array_contains(F.split(low, "/"), "reports") | word), F.lit(False))


def operations(flags: DataFrame) -> DataFrame:
    """All rows with what the flags (booleans, null as false) ask for: publish, pull and all imply others, never push_models."""
    f = lambda *names: F.greatest(*[F.coalesce(F.col(n), F.lit(False)) for n in (*names, names[0])])
    inputs, results = ("push_inputs", "publish", "all"), ("pull_results", "pull", "all")
    return flags.withColumns({
        "do_push_packages": f(*inputs, "push_packages"), "do_push_project_files": f(*inputs, "push_project_files"), "do_push_models": f("push_models"),
        "do_pull_models": f(*results, "pull_models"), "do_pull_latest_runs": f(*results, "pull_latest_runs", "pull_latest_run")})


def common_source(rows: DataFrame, group: str, source: str) -> DataFrame:
    """(group, source): the one source of a group, mixed for several, manual for none."""
    named = F.when(F.col(source) != "", F.col(source))
    low, high = F.min(named), F.max(named)
    return rows.groupBy(group).agg(F.when(low.isNull(), "manual").when(low == high, low).otherwise("mixed").alias(source))


def class_name_of(names: Column, class_id: Column) -> Column:
    """The name at the place class_id of an array; its number as text beyond it."""
    return F.coalesce(F.when(class_id >= 0, F.get(names, class_id)), class_id.cast("string"))


def of_class(detections: Column, wanted: str) -> Column:
    """The detections (struct with class_id, class_name) of a class, or of number 0 whatever its name."""
    return F.filter(detections, lambda d: (d["class_name"] == wanted) | (d["class_name"] == "0") | (d["class_id"] == 0))


def count_of(detections: Column, wanted: str) -> Column:
    return F.coalesce(F.size(F.filter(detections, lambda d: d["class_name"] == wanted)), F.lit(0))


def surest(detections: Column, wanted: str) -> Column:
    """The greatest confidence of a class, 0 without a detection."""
    return F.coalesce(F.array_max(F.transform(F.filter(detections, lambda d: d["class_name"] == wanted), lambda d: d["confidence"])), F.lit(0.0))


def completeness(classes: DataFrame, catalogue: DataFrame, name: str) -> DataFrame:
    """(name, issue): classes that the catalogue lacks (missing), and entries of no class (extra); nulls are neither."""
    c, p = (t.select(name).where(F.col(name).isNotNull()).distinct() for t in (classes, catalogue))
    issue = F.when(F.col("_p").isNull(), "missing").when(F.col("_c").isNull(), "extra")
    both = c.withColumn("_c", F.lit(True)).join(p.withColumn("_p", F.lit(True)), name, "full_outer").select(name, issue.alias("issue"))
    return both.where("issue is not null")


def prefix_counts(rows: DataFrame, reason: str) -> DataFrame:
    """(reason, n): rows by the part of the reason before the first colon; a null reason as an empty one."""
    return rows.groupBy(F.split_part(F.coalesce(F.col(reason), F.lit("")), F.lit(":"), F.lit(1)).alias("reason")).agg(F.count("*").alias("n"))


def global_quota(items: DataFrame, order: str, accepted: str, *, goal: int, max_considered: int = 0) -> DataFrame:
    """Rows in the (unique, rising) order up to the goal-th accepted one and at most max_considered (0: no bound) of them.

    The ends are found by top-k selections, never by a running sum over all rows.
    """
    last = lambda rows, k: rows.select(order).orderBy(order).limit(k).agg(F.max(order).alias("_end"), F.count("*").alias("_k")).where(F.col("_k") == k).select("_end")
    out = items
    if max_considered:
        out = _upto(out, order, last(items, max_considered))
    return _upto(out, order, last(out.where(F.col(accepted)), goal))


def _upto(items: DataFrame, order: str, end: DataFrame) -> DataFrame:
    """Rows up to an end (one row, or none: all)."""
    return items.join(F.broadcast(end), F.col(order) > F.col("_end"), "left_anti")


def select_new(candidates: DataFrame, base: DataFrame, ident: str, order: Column, *, max_distance: int = 4) -> DataFrame:
    """(id, status, other): base for candidates that the base holds (same file or near), duplicate for those met by one selected earlier, else selected.

    other: the first base row, or the row selected or dropped that stands for it.
    """
    known = known_in_base(candidates, base, ident, max_distance=max_distance)
    rest = candidates.join(known.select(ident), ident, "left_anti")
    picked = greedy_dedup(rest, ident, order, key="sha", max_distance=max_distance)
    return known.select(ident, F.lit("base").alias("status"), F.col("base_id").alias("other")).unionByName(
        picked.select(ident, F.when(F.col("kept"), "selected").otherwise("duplicate").alias("status"), F.col("rep").alias("other")))


def is_inside(path: Column, root: str) -> Column:
    """Whether a normalised path is the root or lies below it; .. and null never do."""
    bare = root.rstrip("/")
    return F.coalesce(~path.rlike(r"(^|/)\.\.(/|$)") & ((path == bare) | path.startswith(bare + "/")), F.lit(False))


def picture_folders(paths: DataFrame, path: str) -> DataFrame:
    """(folder, depth, pictures): folders that hold a file, the top one as '.'; sort by depth and folder for display."""
    folder = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    d = paths.where(F.col(path).isNotNull()).select(F.when(folder == "", ".").otherwise(folder).alias("folder")).groupBy("folder").agg(F.count("*").alias("pictures"))
    return d.select("folder", (F.size(F.split("folder", "/")) - 1).alias("depth"), "pictures")


def labelled_pictures(pictures: DataFrame, labels: DataFrame, path: str, *, allowed: list[str], excluded: list[str] = ()) -> DataFrame:
    """All columns and (dataset, label_path): pictures below an ``images`` folder of an allowed data set, with their label file.

    The label lies at the same place under ``labels``, else under ``labelTxt``; null where
    there is neither.  labels: path.  The data set is the first folder.
    """
    parts = r"(?s)^(.*?/)images(/.*)\.[^./]*$"
    key = lambda c, kind: F.concat(F.regexp_extract(c, rf"(?s)^(.*?/){kind}(/.*)\.[^./]*$", 1), F.lit("|"), F.regexp_extract(c, rf"(?s)^(.*?/){kind}(/.*)\.[^./]*$", 2))
    dataset = F.split_part(F.col(path), F.lit("/"), F.lit(1))
    p = pictures.withColumn("dataset", dataset).where(dataset.isin(*allowed) & ~dataset.isin(*excluded) & F.col(path).rlike(parts))
    rows = labels.select(F.col("path").alias("_l")).where(F.lower("_l").endswith(".txt"))
    both = rows.select("_l", F.explode(F.array(F.struct(F.lit(0).alias("r"), key("_l", "labels").alias("k")), F.struct(F.lit(1).alias("r"), key("_l", "labelTxt").alias("k")))).alias("x")).where("x.k != '|'")
    best = both.groupBy(F.col("x.k").alias("_key")).agg(F.min(F.struct("x.r", "_l")).alias("_b"))
    return p.join(best, key(path, "images") == F.col("_key"), "left").select(*p.columns, F.col("_b._l").alias("label_path"))
