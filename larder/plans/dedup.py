"""Queries of duplicates and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import values as V
from larder.operators import dedup as D
from larder.operators import text as X
from larder.plans import sql as Q
from larder.session import table


def images(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "image_item").select(
        "item_id", V.sha256_text("sha256").alias("sha"), V.phash_bits("phash").alias("ph"), V.read_name("class_name").alias("label"),
        V.read_name("source_name").alias("source"), "path", "priority", "train_weight", "accepted_at")


def audited(spark: SparkSession, d: str) -> DataFrame:
    split = F.when(V.is_blank("split"), V.split_of_folders("rel_path")).otherwise(V.read_split("split"))
    return table(spark, d, "audit_item").select(
        "item_id", split.alias("split"), V.read_name("class_name").alias("label"), V.read_name("source").alias("source"), "rel_path",
        V.sha256_text("sha256").alias("sha"), V.phash_bits("phash").alias("ph"), "blur_score", "brightness")


def exact_duplicates(spark, d):
    return D.first_of_key(images(spark, d).select("item_id", "sha"), "sha", ["item_id"]).select("item_id", "kept_item_id", "is_duplicate")


def url_duplicates(spark, d):
    rows = table(spark, d, "recipe_candidate").select("candidate_id", V.read_image_url("image_url").alias("url"))
    return D.first_of_key(rows, "url", ["candidate_id"]).select("candidate_id", "kept_candidate_id", "is_duplicate")


def exact_class_conflicts(spark, d):
    return D.class_conflicts(images(spark, d), "sha", "label", "item_id").select("item_id", "label", "classes", "members")


def near_duplicate_counts(spark, d):
    return D.near_duplicate_counts(images(spark, d), "ph", "item_id", 8)


def audit_conflicts(spark, d):
    return D.audit_conflicts(audited(spark, d))


def audit_summary(spark, d):
    return D.audit_conflicts(audited(spark, d)).groupBy("conflict_type", "class_a", "class_b").agg(F.count("*").alias("links"), F.sum("pairs").alias("pairs"))


def quarantine_targets(spark, d):
    c = D.audit_conflicts(audited(spark, d)).where("conflict_type != 'exact_cross_split'")
    folder = X.pair_folder(F.col("class_a"), F.lit("vs"), F.col("class_b"))
    sides = c.select(F.explode(F.array("rep_a", "rep_b")).alias("rep"), F.struct("conflict_type", "rep_a", "rep_b").alias("seq"), folder.alias("folder"))
    return sides.groupBy("rep").agg(F.min_by("folder", "seq").alias("folder"))


def greedy_dedup_within_class(spark, d):
    order = F.struct(F.coalesce("sha", F.lit("")), F.coalesce("path", F.lit("")), F.col("item_id"))
    return D.greedy_dedup(images(spark, d), "item_id", order, label="label", max_distance=8)


def greedy_dedup_exact_near(spark, d):
    return D.greedy_dedup(images(spark, d), "item_id", F.struct("item_id"), key="sha", max_distance=4)


def greedy_dedup_priority(spark, d):
    p = F.when(F.col("priority").between(1, 9), F.col("priority")).otherwise(10)
    return D.greedy_dedup(images(spark, d), "item_id", F.struct(p, F.coalesce("path", F.lit("")), F.col("item_id")), max_distance=4)


def hub_exclusion(spark, d):
    order = F.struct(F.coalesce("sha", F.lit("")), F.coalesce("path", F.lit("")), F.col("item_id"))
    return D.hub_exclusion(images(spark, d), "item_id", order)


def known_in_base(spark, d):
    candidates = table(spark, d, "recipe_candidate").select("candidate_id", V.sha256_text("sha256").alias("sha"), V.phash_bits("phash").alias("ph"))
    return D.known_in_base(candidates, images(spark, d).select(F.col("item_id").alias("base_id"), "sha", "ph"), "candidate_id")


QUERIES = {f.__name__: f for f in (exact_duplicates, url_duplicates, exact_class_conflicts, near_duplicate_counts, audit_conflicts, audit_summary, quarantine_targets, greedy_dedup_within_class, greedy_dedup_exact_near, greedy_dedup_priority, hub_exclusion, known_in_base)}

_I = f"""i AS (SELECT item_id, {Q.sha('sha256')} AS sha, {Q.ph('phash')} AS ph, {Q.name('class_name')} AS label, path,
        CASE WHEN priority BETWEEN 1 AND 9 THEN priority ELSE 10 END AS p FROM image_item)"""
_CONFLICTS = f"""t AS (SELECT item_id, {Q.AUDIT_SPLIT} AS split, {Q.name('class_name')} AS label, {Q.sha('sha256')} AS sha, {Q.ph('phash')} AS ph FROM audit_item),
f AS (SELECT sha, label, split, min(item_id) AS rep, count(*) AS members FROM t WHERE sha IS NOT NULL AND label IS NOT NULL GROUP BY ALL),
h AS (SELECT ph, label, split, min(item_id) AS rep, count(*) AS members FROM t WHERE ph IS NOT NULL AND label IS NOT NULL GROUP BY ALL),
m AS (SELECT t.*, h.rep, h.members FROM t JOIN h ON t.ph = h.ph AND t.label = h.label AND t.split IS NOT DISTINCT FROM h.split),
n AS (SELECT a.rep AS rep_a, b.rep AS rep_b, a.members AS members_a, b.members AS members_b, count(*) AS pairs, a.label AS class_a, b.label AS class_b, a.split AS split_a, b.split AS split_b,
        CAST(bit_count(xor(a.ph, b.ph)) AS INTEGER) AS distance FROM m a JOIN m b ON a.rep < b.rep AND a.label <> b.label AND bit_count(xor(a.ph, b.ph)) <= 8 AND coalesce(a.sha <> b.sha, true) GROUP BY ALL),
k AS (SELECT CASE WHEN a.label <> b.label THEN 'exact_cross_class' ELSE 'exact_cross_split' END AS conflict_type, CAST(NULL AS INTEGER) AS distance, a.rep AS rep_a, b.rep AS rep_b,
        a.members AS members_a, b.members AS members_b, a.members * b.members AS pairs, a.label AS class_a, b.label AS class_b, a.split AS split_a, b.split AS split_b
        FROM f a JOIN f b ON a.sha = b.sha AND a.rep < b.rep AND (a.label <> b.label OR a.split <> b.split)
      UNION ALL SELECT 'near_cross_class', distance, rep_a, rep_b, members_a, members_b, pairs, class_a, class_b, split_a, split_b FROM n)"""


def _greedy(order: str, label: str, key: str, t: int) -> str:
    """Goes through the distinct (label, hash, key) rows in order, carrying the kept ones."""
    met = f"(x.h IS NOT NULL AND bit_count(xor(x.h, o.ph)) <= {t} AND x.l = o.l)" + (" OR x.k = o.k" if key != "NULL" else "")
    return f"""WITH RECURSIVE {_I},
n AS (SELECT coalesce({label}, '') AS l, ph, CAST({key} AS VARCHAR) AS k, item_id, row_number() OVER (ORDER BY {order}) AS pos FROM i),
f AS (SELECT *, min(pos) OVER (PARTITION BY l, ph, k) AS first FROM n),
o AS (SELECT l, ph, k, item_id AS rep, row_number() OVER (ORDER BY pos) AS rk FROM f WHERE pos = first AND (ph IS NOT NULL OR k IS NOT NULL)),
g(rk, kept, keep) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(h UBIGINT, l VARCHAR, k VARCHAR)[]), false
  UNION ALL SELECT o.rk, CASE WHEN ok THEN list_append(kept, {{'h': o.ph, 'l': o.l, 'k': o.k}}) ELSE kept END, ok
  FROM (SELECT o.*, g.kept, len(list_filter(g.kept, lambda x: coalesce({met}, false))) = 0 AS ok FROM g JOIN o ON o.rk = g.rk + 1) o)
SELECT f.item_id, coalesce(o.rep, f.item_id) AS rep, CASE WHEN o.rep IS NULL THEN true ELSE g.keep AND o.rep = f.item_id END AS kept
FROM f LEFT JOIN o ON f.l = o.l AND f.ph IS NOT DISTINCT FROM o.ph AND f.k IS NOT DISTINCT FROM o.k LEFT JOIN g ON g.rk = o.rk"""


_BY_FILE = "coalesce(sha, ''), coalesce(path, ''), item_id"
ORACLE = {
    "exact_duplicates": f"WITH {_I} SELECT item_id, coalesce(m, item_id) AS kept_item_id, coalesce(m <> item_id, false) AS is_duplicate FROM (SELECT *, CASE WHEN sha IS NOT NULL THEN min(item_id) OVER (PARTITION BY sha) END AS m FROM i)",
    "url_duplicates": f"""WITH {Q.URL_PARTS}, u AS (SELECT candidate_id, {Q.URL} AS url FROM u1)
SELECT candidate_id, coalesce(m, candidate_id) AS kept_candidate_id, coalesce(m <> candidate_id, false) AS is_duplicate FROM (SELECT *, CASE WHEN url IS NOT NULL THEN min(candidate_id) OVER (PARTITION BY url) END AS m FROM u)""",
    "exact_class_conflicts": f"""WITH {_I}, k AS (SELECT sha, string_agg(DISTINCT label, '|' ORDER BY label) AS classes, count(*) AS members FROM i WHERE sha IS NOT NULL GROUP BY sha HAVING count(DISTINCT label) > 1)
SELECT item_id, label, classes, members FROM i JOIN k USING (sha)""",
    "near_duplicate_counts": f"""WITH {_I}, h AS (SELECT ph, min(item_id) AS rep, count(*) AS copies FROM i WHERE ph IS NOT NULL GROUP BY ph),
l AS (SELECT a.ph, count(*) AS links FROM h a JOIN h b ON a.ph <> b.ph AND bit_count(xor(a.ph, b.ph)) <= 8 GROUP BY a.ph)
SELECT item_id, coalesce(rep, item_id) AS rep, coalesce(copies, 1) AS copies, coalesce(links, 0) AS links FROM i LEFT JOIN h USING (ph) LEFT JOIN l USING (ph)""",
    "audit_conflicts": f"WITH {_CONFLICTS} SELECT * FROM k",
    "audit_summary": f"WITH {_CONFLICTS} SELECT conflict_type, class_a, class_b, count(*) AS links, CAST(sum(pairs) AS BIGINT) AS pairs FROM k GROUP BY ALL",
    "quarantine_targets": f"""WITH {_CONFLICTS}, s AS (SELECT unnest([rep_a, rep_b]) AS rep, conflict_type, rep_a, rep_b, class_a || '__vs__' || class_b AS folder FROM k WHERE conflict_type <> 'exact_cross_split')
SELECT rep, folder FROM s QUALIFY row_number() OVER (PARTITION BY rep ORDER BY conflict_type, rep_a, rep_b) = 1""",
    "greedy_dedup_within_class": _greedy(_BY_FILE, "label", "NULL", 8),
    "greedy_dedup_exact_near": _greedy("item_id", "NULL", "sha", 4),
    "greedy_dedup_priority": _greedy("p, coalesce(path, ''), item_id", "NULL", "NULL", 4),
    "hub_exclusion": f"""WITH RECURSIVE {_I}, y AS (SELECT * FROM i WHERE label IS NOT NULL),
bad AS (SELECT sha FROM y WHERE sha IS NOT NULL GROUP BY sha HAVING count(DISTINCT label) > 1),
r AS (SELECT *, row_number() OVER (ORDER BY {_BY_FILE}) AS pos FROM y WHERE ph IS NOT NULL AND (sha IS NULL OR sha NOT IN (SELECT sha FROM bad))),
n AS (SELECT ph, label, min(pos) AS pos FROM r GROUP BY ph, label), o AS (SELECT *, row_number() OVER (ORDER BY pos) AS rk FROM n),
g(rk, hubs, hub) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(h UBIGINT, l VARCHAR)[]), false
  UNION ALL SELECT o.rk, CASE WHEN ok THEN list_append(hubs, {{'h': o.ph, 'l': o.label}}) ELSE hubs END, ok
  FROM (SELECT o.*, g.hubs, len(list_filter(g.hubs, lambda x: bit_count(xor(x.h, o.ph)) <= 8 AND x.l <> o.label)) = 0 AS ok FROM g JOIN o ON o.rk = g.rk + 1) o),
m AS (SELECT o.*, g.hub FROM o JOIN g USING (rk)),
tk AS (SELECT b.pos AS late, a.pos AS early, CAST(bit_count(xor(a.ph, b.ph)) AS INTEGER) AS distance, b.ph, b.label FROM m a JOIN m b ON a.hub AND NOT b.hub AND a.pos < b.pos AND a.label <> b.label AND bit_count(xor(a.ph, b.ph)) <= 8
  QUALIFY row_number() OVER (PARTITION BY b.pos ORDER BY a.pos) = 1),
hb AS (SELECT early, late, distance FROM tk QUALIFY row_number() OVER (PARTITION BY early ORDER BY late) = 1)
SELECT item_id, 'exact' AS role, CAST(NULL AS BIGINT) AS partner, CAST(NULL AS INTEGER) AS distance FROM y JOIN bad USING (sha)
UNION ALL SELECT e.item_id, 'hub', l.item_id, hb.distance FROM hb JOIN r e ON e.pos = hb.early JOIN r l ON l.pos = hb.late
UNION ALL SELECT r.item_id, 'near', e.item_id, tk.distance FROM r JOIN tk USING (ph, label) JOIN r e ON e.pos = tk.early""",
    "known_in_base": f"""WITH {_I}, c AS (SELECT candidate_id, {Q.sha('sha256')} AS sha, {Q.ph('phash')} AS ph FROM recipe_candidate),
x AS (SELECT candidate_id, min(CASE WHEN c.sha = i.sha THEN item_id END) AS e, min(CASE WHEN bit_count(xor(c.ph, i.ph)) <= 4 THEN item_id END) AS n
  FROM c JOIN i ON c.sha = i.sha OR bit_count(xor(c.ph, i.ph)) <= 4 GROUP BY 1)
SELECT candidate_id, CASE WHEN e IS NOT NULL THEN 'exact' ELSE 'near' END AS reason, coalesce(e, n) AS base_id FROM x""",
}
