"""Exact and near duplicates, label conflicts, and the greedy selections built on them.

Rows with equal hash (and class) are folded to their first row before any join, so a
picture copied many times is one node; results give representatives and membership.
Links are between distinct hashes or classes of rows, never between copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.hamming import hamming_pairs
from larder.session import Scratch


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: several such tables just below the broadcast threshold fill the driver."""
    return df.hint("merge")


def short_digest(c: str) -> Column:
    """A value that is equal where the texts are: 33 bytes for 64 lower-case hex digits, else the text's own bytes, marked."""
    digits = F.when(F.col(c).rlike("^[0-9a-f]{64}$"), F.concat(F.unhex(F.lit("01")), F.unhex(c)))
    return F.coalesce(digits, F.concat(F.unhex(F.lit("00")), F.col(c).cast("binary")))


def first_of_key(items: DataFrame, key: str, order: list[str]) -> DataFrame:
    """All columns and ``kept_<first order column>``, ``is_duplicate``: later rows of a key are duplicates of its first.

    Rows with a null key are never duplicates.  The first row is found by an
    aggregation, so a hot key is combined before the shuffle.
    """
    firsts = items.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_larder_key")).agg(F.min(F.struct(*order)).alias("_larder_first"))
    joined = items.join(firsts, items[key] == F.col("_larder_key"), "left")
    own = F.struct(*[items[c] for c in order])
    return joined.select(*[items[c] for c in items.columns], F.coalesce(F.col(f"_larder_first.{order[-1]}"), items[order[-1]]).alias(f"kept_{order[-1]}"), F.coalesce(own != F.col("_larder_first"), F.lit(False)).alias("is_duplicate"))


def class_conflicts(items: DataFrame, key: str, label: str, ident: str) -> DataFrame:
    """(id, key, label, classes, members): every row of a key that has more than one label; null keys and labels conflict with nothing."""
    groups = items.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(label)).alias("_labels"), F.count("*").alias("members"))
    groups = groups.where(F.size("_labels") > 1).select(key, F.concat_ws("|", "_labels").alias("classes"), "members")
    return items.join(groups, key).select(ident, key, label, "classes", "members")


def picture_classes(items: DataFrame, by: list[str], ident: str) -> DataFrame:
    """One row for each combination of ``by``: its least id ``rep`` and number of ``members``."""
    return items.groupBy(*by).agg(F.min(ident).alias("rep"), F.count("*").alias("members"))


def near_links(hashes: DataFrame, value: str, max_distance: int) -> DataFrame:
    """(a, b, distance) over the distinct values of a column.

    From four bits on the buckets of a block are few (some 36,000), so they are searched: 5 rows a hash, no join.
    """
    distinct = hashes.select(value).where(F.col(value).isNotNull()).distinct()
    return hamming_pairs(distinct, value, max_distance, joined=3)


def near_duplicate_counts(items: DataFrame, value: str, ident: str, max_distance: int) -> DataFrame:
    """(id, rep, copies, links): for each row the first row with its hash, how many share it, and how many other hashes are near.

    Rows without a hash are their own representative without links.
    """
    scratch = Scratch(items.sparkSession, "near")
    classes = scratch.keep(picture_classes(items.where(F.col(value).isNotNull()), [value], ident), "classes")
    links = scratch.keep(hamming_pairs(classes, value, max_distance, n_distinct=classes.count()), "links")
    ends = links.select(F.col("a").alias(value)).unionAll(links.select("b")).groupBy(value).agg(F.count("*").alias("links"))
    known = classes.join(shuffled(ends), value, "left").select(F.col(value).alias("_v"), "rep", "members", "links")
    joined = items.select(ident, value).join(shuffled(known), F.col(value) == F.col("_v"), "left")
    return joined.select(ident, F.coalesce("rep", ident).alias("rep"), F.coalesce("members", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))


def audit_conflicts(items: DataFrame, *, max_distance: int = 8) -> DataFrame:
    """(conflict_type, distance, rep_a, rep_b, members_a, members_b, pairs, class_a, class_b, split_a, split_b).

    items: item_id, sha, ph, label, split (read into one notation).  Pairs are between
    classes of rows, named by their least id, rep_a < rep_b: rows with the same file,
    label and split for exact_cross_class (different label) and exact_cross_split (same
    label, different split); rows with the same hash, label and split for
    near_cross_class (hashes within max_distance, different label).  ``pairs`` counts the
    pairs of rows behind a class pair; near ones of the same file are left out of it, and
    a class pair without any other has no row.  Null labels and splits differ from
    nothing.
    """
    scratch = Scratch(items.sparkSession, "audit")
    rows = scratch.keep(items.select("item_id", short_digest("sha").alias("sha"), "ph", "label", "split").where("label is not null"), "rows")
    files = picture_classes(rows.where("sha is not null"), ["sha", "label", "split"], "item_id")
    hashes = scratch.keep(picture_classes(rows.where("ph is not null"), ["ph", "label", "split"], "item_id"), "hashes")
    side = lambda c, v, s: c.select(*[F.col(k).alias(f"{k}_{s}") for k in (v, "label", "split", "rep", "members")])
    ordered, other_label, other_split = F.col("rep_a") < F.col("rep_b"), F.col("label_a") != F.col("label_b"), F.col("split_a") != F.col("split_b")
    out = ["conflict_type", "distance", "rep_a", "rep_b", "members_a", "members_b", "pairs", F.col("label_a").alias("class_a"), F.col("label_b").alias("class_b"), "split_a", "split_b"]
    all_pairs = F.col("members_a") * F.col("members_b")

    a, b = side(files, "sha", "a"), side(files, "sha", "b")
    exact = a.join(shuffled(b), (F.col("sha_a") == F.col("sha_b")) & ordered & (other_label | other_split))
    kind = F.when(other_label, "exact_cross_class").otherwise("exact_cross_split")
    exact = exact.withColumn("conflict_type", kind).withColumn("distance", F.lit(None).cast("int")).withColumn("pairs", all_pairs)

    links = scratch.keep(near_links(hashes, "ph", max_distance), "links")
    both = links.select("a", "b", "distance").unionAll(links.select("b", "a", "distance")).unionAll(
        hashes.select(F.col("ph").alias("a"), F.col("ph").alias("b"), F.lit(0).alias("distance")).distinct())
    a, b = side(hashes, "ph", "a"), side(hashes, "ph", "b")
    near = a.join(shuffled(both), F.col("ph_a") == F.col("a")).join(shuffled(b), (F.col("b") == F.col("ph_b")) & ordered & other_label)
    # pairs of the same file, counted by file and class of hash
    mixed = rows.where("sha is not null and ph is not null").groupBy("sha", "ph", "label", "split").agg(F.count("*").alias("c"))
    multi = mixed.groupBy("sha").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("sha")
    mixed = mixed.join(shuffled(multi), "sha").join(shuffled(hashes.withColumnRenamed("split", "_s")), ["ph", "label"]).where(F.col("split").eqNullSafe(F.col("_s"))).select("sha", "label", "rep", "c")
    x, y = mixed.select("sha", F.col("label").alias("lx"), F.col("rep").alias("rep_a"), F.col("c").alias("cx")), mixed.select("sha", F.col("label").alias("ly"), F.col("rep").alias("rep_b"), F.col("c").alias("cy"))
    same = x.join(shuffled(y), "sha").where("rep_a < rep_b and lx != ly").groupBy("rep_a", "rep_b").agg(F.sum(F.col("cx") * F.col("cy")).alias("same"))
    near = near.join(shuffled(same), ["rep_a", "rep_b"], "left").withColumn("pairs", all_pairs - F.coalesce("same", F.lit(0))).where("pairs > 0").withColumn("conflict_type", F.lit("near_cross_class"))
    return exact.select(*out).unionByName(near.select(*out))


def greedy_keep(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, kept): a node is kept if no kept earlier node is in its group, in a linked group, or has its key.

    nodes: id, ord (unique, sortable), gid and key (null: none).  links: ga, gb (groups,
    both ways).  In each round every undecided node that is the first of all undecided
    nodes it touches is kept, and the others that touch a kept one are dropped.  Firsts
    are found by aggregating over groups, links of groups and keys, never over pairs of
    nodes; the first undecided node of all is always kept, so each round decides some.
    """
    columns = ["id", "ord", "gid", "key"]
    linked = links.select(F.col("ga").alias("gid")).distinct()
    shared = lambda c: nodes.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_n")).where("_n > 1").select(c)
    touching = [nodes.join(shuffled(linked), "gid", "left_semi"), nodes.join(shuffled(shared("gid")), "gid", "left_semi"), nodes.join(shuffled(shared("key")), "key", "left_semi")]
    active = touching[0].select(*columns).unionAll(touching[1].select(*columns)).unionAll(touching[2].select(*columns)).distinct()
    active, links = scratch.keep(active, "active"), scratch.keep(links.select("ga", "gb"), "links")
    decided = []
    while not active.isEmpty():
        first = F.min(F.struct("ord", "id"))
        of_group = active.where("gid is not null").groupBy("gid").agg(first.alias("fg"))
        of_links = links.join(shuffled(of_group.withColumnRenamed("gid", "ga")), "ga").groupBy(F.col("gb").alias("gid")).agg(F.min("fg").alias("fl"))
        of_key = active.where("key is not null").groupBy("key").agg(first.alias("fk"))
        seen = active.join(shuffled(of_group), "gid", "left").join(shuffled(of_links), "gid", "left").join(shuffled(of_key), "key", "left")
        own = F.struct("ord", "id")
        leads = lambda c: F.col(c).isNull() | (own <= F.col(c))
        kept = scratch.keep(seen.where(leads("fg") & leads("fl") & leads("fk")).select(*columns), "kept")
        groups = kept.where("gid is not null").select("gid").distinct()
        met = groups.unionAll(links.join(shuffled(groups.withColumnRenamed("gid", "ga")), "ga").select(F.col("gb").alias("gid"))).distinct()
        keys = kept.where("key is not null").select("key").distinct()
        rest = active.join(shuffled(kept.select("id")), "id", "left_anti").select(*columns)
        marked = rest.join(shuffled(met.withColumn("_g", F.lit(True))), "gid", "left").join(shuffled(keys.withColumn("_k", F.lit(True))), "key", "left")
        marked = scratch.keep(marked.select(*columns, (F.col("_g").isNotNull() | F.col("_k").isNotNull()).alias("out")), "marked")
        decided += [kept.select("id", F.lit(True).alias("kept")), marked.where("out").select("id", F.lit(False).alias("kept"))]
        scratch.drop(active)
        active = marked.where("not out").select(*columns)
    if not decided:
        return nodes.select("id", F.lit(True).alias("kept"))
    out = decided[0]
    for d in decided[1:]:
        out = out.unionAll(d)
    return nodes.select("id").join(shuffled(out), "id", "left").select("id", F.coalesce("kept", F.lit(True)).alias("kept"))


def greedy_dedup(items: DataFrame, ident: str, order: Column, *, value: str = "ph", label: str | None = None, key: str | None = None, max_distance: int = 8) -> DataFrame:
    """(id, rep, kept): greedy selection in the given order.

    A row is kept if no kept earlier row (of the same label, where one is named) has a
    hash within max_distance, or the same ``key``.  Copies (equal hash, key and label)
    follow the first of them: it is ``rep``, and only it can be kept.  ``order`` must be
    unique.  Rows without a hash and key are kept.
    """
    scratch = Scratch(items.sparkSession, "greedy")
    k = F.col(key) if key else F.lit(None).cast("string")
    lab = F.coalesce(F.col(label), F.lit("")) if label else F.lit("")
    rows = scratch.keep(items.select(F.col(ident).alias("id"), order.alias("ord"), F.col(value).alias("v"), lab.alias("label"), k.alias("key")), "rows")
    known = rows.where("v is not null or key is not null")
    nodes = known.groupBy("label", "v", "key").agg(F.min(F.struct("ord", "id")).alias("m"))
    nodes = scratch.keep(nodes.select("label", "v", "key", F.col("m.id").alias("id"), F.col("m.ord").alias("ord")), "nodes")
    groups = scratch.keep(nodes.where("v is not null").groupBy("label", "v").agg(F.min("id").alias("gid")), "groups")
    links = scratch.keep(near_links(groups, "v", max_distance), "links")
    both = links.select("a", "b").unionAll(links.select("b", "a"))
    ga, gb = groups.select(F.col("v").alias("a"), "label", F.col("gid").alias("ga")), groups.select(F.col("v").alias("b"), "label", F.col("gid").alias("gb"))
    pairs = ga.join(shuffled(both), "a").join(shuffled(gb), ["b", "label"]).select("ga", "gb")
    full = nodes.join(shuffled(groups), ["label", "v"], "left").select("id", "ord", "gid", F.when(F.col("key").isNotNull(), F.concat_ws("\0", "label", "key")).alias("key"))
    got = greedy_keep(full, pairs, scratch)
    reps = nodes.join(shuffled(got), "id").select(F.col("label").alias("_l"), F.col("v").alias("_v"), F.col("key").alias("_k"), F.col("id").alias("rep"), "kept")
    r = rows.join(shuffled(reps), (F.col("label") == F.col("_l")) & F.col("v").eqNullSafe(F.col("_v")) & F.col("key").eqNullSafe(F.col("_k")), "left")
    kept = F.when(F.col("rep").isNull(), True).otherwise(F.col("kept") & (F.col("rep") == F.col("id")))
    return r.select(F.col("id").alias(ident), F.coalesce("rep", "id").alias("rep"), kept.alias("kept"))


def hub_exclusion(items: DataFrame, ident: str, order: Column, *, max_distance: int = 8) -> DataFrame:
    """(id, role, partner, distance): rows left out because near pictures bear different labels.

    items: id, sha, ph, label.  Rows whose file has several labels are ``exact`` and take
    no further part.  The others are gone through in order: a row is a hub if no earlier
    near hub of another label exists.  Each other row is ``near`` with its first such hub
    as partner; the hubs so named are ``hub`` with the first row they meet.  A hub whose
    neighbours were all taken by earlier hubs is not left out.
    """
    scratch = Scratch(items.sparkSession, "hubs")
    rows = items.select(F.col(ident).alias("id"), "sha", "ph", "label", order.alias("ord")).where("label is not null")
    bad = rows.where("sha is not null").groupBy("sha").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("sha")
    exact = rows.join(bad, "sha", "left_semi").select("id", F.lit("exact").alias("role"), F.lit(None).cast("bigint").alias("partner"), F.lit(None).cast("int").alias("distance"))
    rest = scratch.keep(rows.join(bad, "sha", "left_anti").where("ph is not null").select("id", "ph", "label", "ord"), "rest")
    nodes = rest.groupBy("ph", "label").agg(F.min(F.struct("ord", "id")).alias("m"))
    nodes = scratch.keep(nodes.select("ph", "label", F.col("m.id").alias("id"), F.col("m.ord").alias("ord")), "nodes")
    links = near_links(nodes, "ph", max_distance)
    same = nodes.select(F.col("ph").alias("a"), F.col("ph").alias("b"), F.lit(0).alias("distance")).distinct()
    both = links.select("a", "b", "distance").unionAll(links.select("b", "a", "distance")).unionAll(same)
    e = nodes.select(F.col("ph").alias("a"), F.col("label").alias("l1"), F.col("id").alias("early"), F.col("ord").alias("o1"))
    l = nodes.select(F.col("ph").alias("b"), F.col("label").alias("l2"), F.col("id").alias("late"), F.col("ord").alias("o2"))
    pairs = scratch.keep(e.join(both, "a").join(l, "b").where("o1 < o2 and l1 != l2").select("early", "late", "distance", "o1", "o2"), "pairs")
    touched = pairs.select(F.col("early").alias("ga"), F.col("late").alias("gb")).unionAll(pairs.select("late", "early"))
    hubs = scratch.keep(greedy_keep(nodes.select("id", "ord", F.col("id").alias("gid"), F.lit(None).cast("string").alias("key")), touched, scratch), "hubs")
    taken = pairs.join(hubs.where("kept").select(F.col("id").alias("early")), "early", "left_semi").join(hubs.where("not kept").select(F.col("id").alias("late")), "late", "left_semi")
    taken = taken.groupBy("late").agg(F.min(F.struct("o1", "early", "distance", "o2")).alias("m")).select("late", "m.*")
    taken = scratch.keep(taken, "taken")
    named = taken.groupBy("early").agg(F.min(F.struct("o2", "late", "distance")).alias("m"))
    hub = named.select(F.col("early").alias("id"), F.lit("hub").alias("role"), F.col("m.late").alias("partner"), F.col("m.distance").alias("distance"))
    lost = nodes.join(taken, nodes.id == taken.late).select(F.col("ph").alias("_p"), F.col("label").alias("_l"), "early", "distance")
    near = rest.join(lost, (F.col("ph") == F.col("_p")) & (F.col("label") == F.col("_l"))).select("id", F.lit("near").alias("role"), F.col("early").alias("partner"), "distance")
    return exact.unionByName(hub).unionByName(near).withColumnRenamed("id", ident)


def known_in_base(candidates: DataFrame, base: DataFrame, ident: str, *, max_distance: int = 4) -> DataFrame:
    """(id, reason, base_id): candidates met by the base, the same file before a near one.

    base: base_id, sha, ph; the first (least base_id) match is named; of near ones as well.
    """
    from larder.operators.hamming import hamming_cross_pairs

    scratch = Scratch(candidates.sparkSession, "base")
    shas = base.where("sha is not null").groupBy("sha").agg(F.min("base_id").alias("exact_id"))
    hashes = scratch.keep(base.where("ph is not null").groupBy("ph").agg(F.min("base_id").alias("near_id")), "hashes")
    own = scratch.keep(candidates.where("ph is not null").select("ph").distinct(), "own")
    near = hamming_cross_pairs(own, hashes, "ph", max_distance, n_distinct=hashes.count() + own.count())
    near = near.unionAll(own.join(hashes, "ph", "left_semi").select(F.col("ph").alias("a"), F.col("ph").alias("b")))
    first = near.join(hashes, near.b == hashes.ph).groupBy("a").agg(F.min("near_id").alias("near_id"))
    c = candidates.select(ident, "sha", "ph").join(shas, "sha", "left").join(first, F.col("ph") == F.col("a"), "left")
    c = c.where("exact_id is not null or near_id is not null")
    return c.select(F.col(ident), F.when(F.col("exact_id").isNotNull(), "exact").otherwise("near").alias("reason"), F.coalesce("exact_id", "near_id").alias("base_id"))
