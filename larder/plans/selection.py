"""Queries of picture metrics, selections, lookups and completeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import values as V
from larder.operators import dataset as B
from larder.operators import pictures as P
from larder.operators import review as L
from larder.operators import selection as S
from larder.operators import text as X
from larder.plans import dedup
from larder.plans import sql as Q
from larder.plans.dataset import _records
from larder.plans.dedup import images
from larder.plans.texts import ORACLE as _TEXTS
from larder.plans.texts import text_term_filter
from larder.session import table


def picture_metrics(spark, d):
    """The 64 values of an embedding as the grey values of a picture of 8 by 8."""
    gray = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 0.5) * 255).cast("int"))))
    e = table(spark, d, "embeddings").select("vec_id", gray.alias("g"))
    n = F.lit(8)
    return e.select(
        "vec_id", F.round(P.brightness(F.col("g")), 6).alias("brightness"), P.blur_score(F.col("g"), n, n).alias("blur_score"),
        F.round(P.black_border_ratio(F.col("g"), n, n, threshold=110), 6).alias("black_border"), P.difference_hash(F.col("g"), 8, 8).alias("dhash"))


def label_completeness(spark, d):
    return S.completeness(images(spark, d).select("label"), table(spark, d, "price_row").select(V.read_name("class_name").alias("label")), "label")


def reason_prefixes(spark, d):
    return S.prefix_counts(text_term_filter(spark, d), "reason")


def _considered(spark, d):
    return table(spark, d, "recipe_candidate").select("candidate_id", (V.sha256_text("sha256").isNotNull() & F.col("title").isNotNull()).alias("accepted"))


def global_quota(spark, d):
    return S.global_quota(_considered(spark, d), "candidate_id", "accepted", goal=40, max_considered=100)


def select_new(spark, d):
    c = table(spark, d, "recipe_candidate").select("candidate_id", V.sha256_text("sha256").alias("sha"), V.phash_bits("phash").alias("ph"))
    return S.select_new(c, images(spark, d).where("accepted_at is not null").select(F.col("item_id").alias("base_id"), "sha", "ph"), "candidate_id", F.struct("candidate_id"))


def _detections(spark, d):
    """Boxes as detections: class 0 left above, 1 right, 2 left below, their area the confidence."""
    kind = lambda b: F.when(b["xc"] >= 0.5, 1).when(b["yc"] >= 0.5, 2).otherwise(0)
    names = F.array(F.lit("food_region"), F.lit("egg"))
    one = lambda b: F.struct(kind(b).alias("class_id"), S.class_name_of(names, kind(b)).alias("class_name"), (b["width"] * b["height"]).alias("confidence"))
    return table(spark, d, "source_record").select("record_id", F.transform(F.coalesce("boxes", F.array().cast("array<struct<xc:double,yc:double,width:double,height:double>>")), one).alias("x"))


def detection_evidence(spark, d):
    x = F.col("x")
    return _detections(spark, d).select("record_id", S.count_of(x, "egg").alias("eggs"), S.surest(x, "egg").alias("surest_egg"), F.size(S.of_class(x, "food_region")).alias("regions"), S.count_of(x, "2").alias("unnamed"))


def source_names(spark, d):
    path = F.concat(F.lit("x/"), F.when(F.col("item_id") % 3 == 0, "old_").when(F.col("item_id") % 3 == 1, "reviewed_").otherwise(""), F.coalesce("label", F.lit("a")), F.lit(".jpg"))
    return images(spark, d).groupBy(S.source_of_name(path).alias("source"), "label").agg(F.count("*").alias("n"))


def report_files(spark, d):
    i = images(spark, d).where("path is not null").select("item_id", F.concat(F.when(F.col("item_id") % 5 == 0, "run/Reports/").otherwise("run/"), F.when(F.col("item_id") % 4 == 0, "curve_").otherwise(""), F.regexp_replace("path", r"^.*/", ""), F.when(F.col("item_id") % 7 == 0, ".pt").otherwise("")).alias("path"))
    return i.where(S.is_report(F.col("path")))


def requested_operations(spark, d):
    bit = lambda k: (F.col("_k").bitwiseAND(F.lit(1 << k)) != 0)
    names = ["push_inputs", "publish", "all", "push_packages", "push_project_files", "push_models", "pull_results", "pull", "pull_models", "pull_latest_runs", "pull_latest_run"]
    flags = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 2048).alias("_k")).select("c_custkey", *[bit(k).alias(n) for k, n in enumerate(names)])
    return S.operations(flags).select("c_custkey", "do_push_packages", "do_push_project_files", "do_push_models", "do_pull_models", "do_pull_latest_runs")


def common_sources(spark, d):
    return S.common_source(images(spark, d).withColumn("weight", F.coalesce("train_weight", F.lit(0))), "label", "source")


def manifest_totals(spark, d):
    """Files and bytes of each class and split, and of all (null: over all of them)."""
    a = dedup.audited(spark, d).withColumn("bytes", F.length("rel_path").cast("bigint"))
    rows = a.cube("split", "label").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.grouping_id().cast("int").alias("over"))
    return rows.select("split", "label", "over", "files", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def sampler_weights(spark, d):
    labels = table(spark, d, "price_row").select(V.read_name("class_name").alias("label")).distinct()
    return B.class_weights(images(spark, d), "label", labels, boosts={"rice": 2.0, "com_trang": 2.5}).select("label", "sample_weight")


def file_names(spark, d):
    """Names of the files of a built data set: source, ten digits of the digest, repetition."""
    i = B.repeat_rows(images(spark, d).where("sha is not null"), "train_weight", keep=["item_id", "source", "sha"])
    return i.select("item_id", "repeat_index", F.concat(F.coalesce("source", F.lit("")), F.lit("_"), F.substring("sha", 1, 10), F.format_string("_r%02d.jpg", F.col("repeat_index"))).alias("name"))


def representative_losers(spark, d):
    """Records that another of their capture stands for."""
    r = _records(spark, d)
    best = B.representatives(r).select(F.col("dataset").alias("_d"), F.col("capture").alias("_c"), F.col("record_id").alias("_kept"))
    return r.join(best, F.col("dataset").eqNullSafe(F.col("_d")) & F.col("capture").eqNullSafe(F.col("_c"))).where("record_id != _kept").select("record_id", F.col("_kept").alias("kept"))


def _moves(spark, d):
    """The event log as moves and marks; files: where each user's picture lies."""
    u = F.col("user_id").cast("string")
    e = table(spark, d, "events")
    action = F.when(F.col("event_type") == "click", "mark_done").when(F.col("event_type") == "signup", "undo").otherwise("move")
    log = e.select("event_id", "ts", "user_id", u.alias("item"), action.alias("action"), F.concat(F.lit("in/"), u).alias("source"), F.concat(F.lit("out/"), u).alias("output"))
    place = F.when(F.col("user_id") % 3 == 0, F.array(F.concat(F.lit("out/"), u))).when(F.col("user_id") % 3 == 1, F.array(F.concat(F.lit("in/"), u))).otherwise(F.array(F.concat(F.lit("in/"), u), F.concat(F.lit("out/"), u)))
    return log, e.select(F.explode(place).alias("path")).distinct()


def undo_move(spark, d):
    log, files = _moves(spark, d)
    done = log.where("action = 'mark_done' and user_id % 2 = 0").select("item")
    return L.undo_target_of_files(log, "item", "action", "source", "output", done, files, ["ts", "event_id"])


def batch_moves(spark, d):
    log, files = _moves(spark, d)
    target = F.concat(F.lit("out/"), (F.col("user_id") - F.col("user_id") % 4 + F.col("event_id") % 2).cast("string"))
    return L.plan_moves(log.where("action = 'move'").select(F.col("user_id").alias("item"), "source", target.alias("target")).distinct(), files, "item", "source", "target")


def picture_folders(spark, d):
    return S.picture_folders(images(spark, d), "path")


def _files(spark, d):
    """Pictures of six data sets, two thirds of them with a label file of either kind, some with both."""
    name = F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"\.[^.]*$", "")
    i = images(spark, d).where("path is not null").select("item_id", F.concat(F.lit("set"), (F.col("item_id") % 6).cast("string"), F.lit("/")).alias("s"), F.concat(F.lit("/train/"), F.col("item_id").cast("string"), F.lit("_"), name).alias("n"))
    labels = i.select("item_id", F.explode(F.array(F.when(F.col("item_id") % 3 < 2, F.concat("s", F.lit("labelTxt"), "n", F.lit(".txt"))), F.when(F.col("item_id") % 4 == 0, F.concat("s", F.lit("labels"), "n", F.lit(".txt"))))).alias("path")).where("path is not null")
    return i.select("item_id", F.concat("s", F.lit("images"), "n", F.lit(".jpg")).alias("path")), labels.select("path")


def labelled_pictures(spark, d):
    pictures, labels = _files(spark, d)
    return S.labelled_pictures(pictures, labels, "path", allowed=["set0", "set1", "set2", "set3"], excluded=["set3"])


def inside_project(spark, d):
    return images(spark, d).where("path is not null").groupBy(S.is_inside(F.concat(F.lit("data/"), F.col("label"), F.lit("/"), F.col("path")), "data/rice").alias("inside"), "label").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (picture_metrics, label_completeness, reason_prefixes, global_quota, select_new, detection_evidence, source_names, report_files, requested_operations, common_sources, manifest_totals, sampler_weights, file_names, representative_losers, undo_move, batch_moves, picture_folders, labelled_pictures, inside_project)}

_I, _L = f"i AS (SELECT item_id, {Q.sha('sha256')} AS sha, {Q.name('class_name')} AS label, {Q.name('source_name')} AS source, path, train_weight FROM image_item)", f"l AS (SELECT DISTINCT {Q.name('class_name')} AS label FROM price_row)"
_G = """g AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(greatest(0, least(255, floor((x::DOUBLE + 0.5::DOUBLE) * 255))) AS INTEGER)) AS g FROM embeddings),
x AS (SELECT vec_id, unnest(g) AS v, unnest(range(64)) AS i FROM g),
p AS (SELECT a.vec_id, a.i, a.i // 8 AS r, a.i % 8 AS c, a.v, g[CASE a.i // 8 WHEN 0 THEN 1 ELSE a.i // 8 - 1 END * 8 + a.i % 8 + 1] + g[CASE a.i // 8 WHEN 7 THEN 6 ELSE a.i // 8 + 1 END * 8 + a.i % 8 + 1]
  + g[a.i // 8 * 8 + CASE a.i % 8 WHEN 0 THEN 1 ELSE a.i % 8 - 1 END + 1] + g[a.i // 8 * 8 + CASE a.i % 8 WHEN 7 THEN 6 ELSE a.i % 8 + 1 END + 1] - 4 * a.v AS lap, g[a.i + 2] > a.v AS up FROM x a JOIN g USING (vec_id))"""
_SEL = f"""i AS (SELECT candidate_id AS item_id, c.sha, c.ph, NULL AS label, NULL AS path FROM c WHERE candidate_id NOT IN (SELECT candidate_id FROM k))"""
_BASE = f"""c AS (SELECT candidate_id, {Q.sha('sha256')} AS sha, {Q.ph('phash')} AS ph FROM recipe_candidate), b AS (SELECT item_id, {Q.sha('sha256')} AS sha, {Q.ph('phash')} AS ph FROM image_item WHERE accepted_at IS NOT NULL),
m AS (SELECT candidate_id, min(CASE WHEN c.sha = b.sha THEN item_id END) AS e, min(CASE WHEN bit_count(xor(c.ph, b.ph)) <= 4 THEN item_id END) AS n FROM c JOIN b ON c.sha = b.sha OR bit_count(xor(c.ph, b.ph)) <= 4 GROUP BY 1),
k AS (SELECT candidate_id, coalesce(e, n) AS other FROM m)"""
_GREEDY = dedup._greedy("item_id", "NULL", "sha", 4)

_MOVES = """g AS (SELECT event_id, ts, user_id, CAST(user_id AS VARCHAR) AS item, CASE event_type WHEN 'click' THEN 'mark_done' WHEN 'signup' THEN 'undo' ELSE 'move' END AS action, 'in/' || user_id AS source, 'out/' || user_id AS output FROM events),
f AS (SELECT 'out/' || user_id AS path FROM events WHERE user_id % 3 <> 1 UNION SELECT 'in/' || user_id FROM events WHERE user_id % 3 <> 0)"""

ORACLE = {
    "picture_metrics": f"""WITH {_G} SELECT vec_id, round(avg(v), 6) AS brightness, avg((lap - m) * (lap - m)) AS blur_score,
  round(avg(CASE WHEN r = 0 OR r = 7 OR c = 0 OR c = 7 THEN CASE WHEN v <= 110 THEN 1.0::DOUBLE ELSE 0 END END), 6) AS black_border,
  lower(printf('%014x', CAST(sum(CASE WHEN c < 7 AND up THEN CAST(1 AS BIGINT) << CAST(55 - (r * 7 + c) AS BIGINT) ELSE 0 END) AS BIGINT))) AS dhash FROM (SELECT *, avg(lap) OVER (PARTITION BY vec_id) AS m FROM p) GROUP BY 1""",
    "label_completeness": f"WITH {_I}, {_L}, c AS (SELECT DISTINCT label FROM i WHERE label IS NOT NULL) SELECT coalesce(c.label, l.label) AS label, CASE WHEN l.label IS NULL THEN 'missing' ELSE 'extra' END AS issue FROM c FULL JOIN l ON c.label = l.label WHERE c.label IS NULL OR l.label IS NULL",
    "reason_prefixes": f"SELECT split_part(reason, ':', 1) AS reason, count(*) AS n FROM ({_TEXTS['text_term_filter']}) GROUP BY 1",
    "global_quota": f"""WITH c AS (SELECT candidate_id, ({Q.sha('sha256')}) IS NOT NULL AND title IS NOT NULL AS accepted FROM recipe_candidate),
r AS (SELECT *, row_number() OVER w AS k, sum(CAST(accepted AS INT)) OVER w AS done FROM c WINDOW w AS (ORDER BY candidate_id)) SELECT candidate_id, accepted FROM r WHERE k <= 100 AND (done < 40 OR (done = 40 AND accepted))""",
    "select_new": f"""WITH {_BASE} SELECT candidate_id, 'base' AS status, other FROM k UNION ALL
SELECT item_id, CASE WHEN kept THEN 'selected' ELSE 'duplicate' END, rep FROM ({_GREEDY.replace(dedup._I, _BASE + ', ' + _SEL)})""",
    "detection_evidence": """WITH b AS (SELECT record_id, unnest(boxes) AS b FROM source_record), k AS (SELECT record_id, CASE WHEN b.xc >= 0.5 THEN 1 WHEN b.yc >= 0.5 THEN 2 ELSE 0 END AS c, b.width * b.height AS p FROM b)
SELECT record_id, CAST(count(*) FILTER (c = 1) AS INTEGER) AS eggs, coalesce(max(p) FILTER (c = 1), 0) AS surest_egg, CAST(count(*) FILTER (c = 0) AS INTEGER) AS regions, CAST(count(*) FILTER (c = 2) AS INTEGER) AS unnamed FROM source_record LEFT JOIN k USING (record_id) GROUP BY 1""",
    "source_names": f"WITH {_I} SELECT CASE item_id % 3 WHEN 0 THEN 'old' WHEN 1 THEN 'reviewed' ELSE CASE WHEN starts_with(label, 'old_') THEN 'old' WHEN starts_with(label, 'reviewed_') THEN 'reviewed' ELSE 'unmanaged' END END AS source, label, count(*) AS n FROM i GROUP BY 1, 2",
    "report_files": """WITH r AS (SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'run/Reports/' ELSE 'run/' END || CASE WHEN item_id % 4 = 0 THEN 'curve_' ELSE '' END || regexp_replace(path, '^.*/', '') || CASE WHEN item_id % 7 = 0 THEN '.pt' ELSE '' END AS path FROM image_item WHERE path IS NOT NULL)
SELECT * FROM r WHERE regexp_matches(lower(path), '[^/]\\.(txt|json|csv|png|jpg|jpeg)$') AND (item_id % 5 = 0 OR regexp_matches(lower(path), '(report|history|result|confusion|curve|labels|pred)[^/]*$'))""",
    "requested_operations": """WITH f AS (SELECT c_custkey, list_transform(range(11), lambda k: (c_custkey % 2048) & (1 << k) <> 0) AS f FROM customer)
SELECT c_custkey, f[1] OR f[2] OR f[3] OR f[4] AS do_push_packages, f[1] OR f[2] OR f[3] OR f[5] AS do_push_project_files, f[6] AS do_push_models, f[7] OR f[8] OR f[3] OR f[9] AS do_pull_models, f[7] OR f[8] OR f[3] OR f[10] OR f[11] AS do_pull_latest_runs FROM f""",
    "common_sources": f"WITH {_I} SELECT label, CASE count(DISTINCT source) WHEN 0 THEN 'manual' WHEN 1 THEN min(source) ELSE 'mixed' END AS source FROM i GROUP BY 1",
    "manifest_totals": f"""WITH a AS (SELECT {Q.AUDIT_SPLIT} AS split, {Q.name('class_name')} AS label, length(rel_path) AS bytes FROM audit_item)
SELECT split, label, CAST(grouping(split, label) AS INTEGER) AS over, count(*) AS files, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM a GROUP BY CUBE (split, label)""",
    "sampler_weights": f"WITH {_I}, {_L} SELECT label, 1.0::DOUBLE / greatest(count(i.item_id), 1) * CASE label WHEN 'rice' THEN 2.0::DOUBLE WHEN 'com_trang' THEN 2.5 ELSE 1.0 END AS sample_weight FROM l LEFT JOIN i USING (label) GROUP BY label",
    "file_names": f"WITH {_I}, r AS (SELECT item_id, source, sha, CAST(unnest(range(greatest(coalesce(train_weight, 1), 1))) AS INTEGER) AS repeat_index FROM i WHERE sha IS NOT NULL) SELECT item_id, repeat_index, coalesce(source, '') || '_' || sha[1:10] || printf('_r%02d.jpg', repeat_index) AS name FROM r",
    "undo_move": f"""WITH {_MOVES} SELECT ts, event_id, action, item FROM g WHERE action <> 'undo' AND (CASE WHEN action = 'mark_done' THEN item IN (SELECT item FROM g WHERE action = 'mark_done' AND user_id % 2 = 0) ELSE output IN (SELECT path FROM f) AND source NOT IN (SELECT path FROM f) END) ORDER BY ts DESC, event_id DESC LIMIT 1""",
    "batch_moves": f"""WITH {_MOVES}, r AS (SELECT DISTINCT user_id AS item, source, 'out/' || (user_id - user_id % 4 + event_id % 2) AS target FROM g WHERE action = 'move'),
s AS (SELECT *, source IN (SELECT path FROM f) AS s, target IN (SELECT path FROM f) AS t FROM r), a AS (SELECT *, min(target) OVER (PARTITION BY item) AS first FROM s WHERE s AND NOT t),
b AS (SELECT *, min(CASE WHEN target = first THEN item END) OVER (PARTITION BY target) AS lead FROM a)
SELECT item, source, target, CASE WHEN NOT s THEN 'missing' ELSE 'exists' END AS status FROM s WHERE NOT s OR t UNION ALL SELECT item, source, target, CASE WHEN target <> first THEN 'repeated' WHEN item <> lead THEN 'taken' ELSE 'moved' END FROM b""",
    "picture_folders": """WITH p AS (SELECT coalesce(nullif(regexp_extract(path, '(?s)^(.*)/[^/]*$', 1), ''), '.') AS folder FROM image_item WHERE path IS NOT NULL) SELECT folder, CAST(length(folder) - length(replace(folder, '/', '')) AS INTEGER) AS depth, count(*) AS pictures FROM p GROUP BY 1""",
    "labelled_pictures": """WITH i AS (SELECT item_id, 'set' || item_id % 6 AS dataset, '/train/' || item_id || '_' || regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]*$', '') AS n FROM image_item WHERE path IS NOT NULL)
SELECT item_id, dataset || '/images' || n || '.jpg' AS path, dataset, CASE WHEN item_id % 4 = 0 THEN dataset || '/labels' || n || '.txt' WHEN item_id % 3 < 2 THEN dataset || '/labelTxt' || n || '.txt' END AS label_path FROM i WHERE dataset IN ('set0', 'set1', 'set2')""",
    "inside_project": f"WITH {_I} SELECT coalesce(NOT regexp_matches(path, '(^|/)\\.\\.(/|$)') AND label = 'rice', false) AS inside, label, count(*) AS n FROM i WHERE path IS NOT NULL GROUP BY 1, 2",
    "representative_losers": f"""WITH r AS (SELECT *, {Q.CAPTURE} AS capture FROM source_record),
k AS (SELECT record_id, first_value(record_id) OVER (PARTITION BY dataset, capture ORDER BY coalesce(black_border_ratio, 'infinity'::DOUBLE), coalesce(blur_score, '-infinity'::DOUBLE) DESC, coalesce(image_path, ''), record_id) AS kept FROM r) SELECT record_id, kept FROM k WHERE record_id <> kept""",
}
