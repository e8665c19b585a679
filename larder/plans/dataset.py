"""Queries of data-set building, quality gates and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import values as V
from larder.operators import dataset as B
from larder.operators import quality as G
from larder.operators import regions as R
from larder.plans import sql as Q
from larder.plans.dedup import audited, images
from larder.session import table


def _records(spark, d):
    return table(spark, d, "source_record").withColumn("capture", V.read_capture("source_group", "image_path"))


def representative_variant(spark, d):
    return B.representatives(_records(spark, d))


def group_size_histogram(spark, d):
    return B.group_sizes(_records(spark, d))


def split_assignment(spark, d):
    return B.assign_splits(images(spark, d), "item_id", "label")


def positional_split(spark, d):
    return B.positional_split(images(spark, d), "item_id")


def cap_per_class(spark, d):
    return B.cap_source(images(spark, d), "item_id", "label", "source", capped="recipe_crawl", reference="archive_2022", ratio=0.5)


def quota_per_class(spark, d):
    c = table(spark, d, "recipe_candidate").select("candidate_id", V.read_name("query").alias("query"), (V.sha256_text("sha256").isNotNull() & F.col("title").isNotNull()).alias("accepted"))
    return B.quota(c, "query", "candidate_id", "accepted", per_group=3)


def oversample_repeat(spark, d):
    return B.repeat_rows(images(spark, d), "train_weight", when=F.col("accepted_at").isNotNull(), keep=["item_id"])


def class_weights(spark, d):
    labels = table(spark, d, "price_row").select(V.read_name("class_name").alias("label")).distinct()
    return B.class_weights(images(spark, d), "label", labels)


def manifest_counts(spark, d):
    labels = table(spark, d, "price_row").select(V.read_name("class_name").alias("label")).distinct()
    splits = table(spark, d, "split_ratio").select("split").distinct()
    return B.manifest_counts(audited(spark, d).withColumn("size", F.length("rel_path").cast("bigint")), "split", "label", splits, labels, "size")


def count_tree(spark, d):
    return B.count_tree(audited(spark, d), ["split", "label", "source"])


def manifest_diff(spark, d):
    return B.manifest_diff(images(spark, d), audited(spark, d), ["label"])


def artifact_sync_plan(spark, d):
    by_path = lambda rows: rows.where("path is not null").groupBy(F.col("path").alias("name")).agg(F.min("sha").alias("sha"), F.count("*").alias("bytes"))
    i = images(spark, d)
    return B.sync_plan(by_path(i), by_path(i.where("accepted_at is not null")))


def latest_run_per_kind(spark, d):
    e = table(spark, d, "events").withColumn("kind", F.concat_ws("/", "event_type", (F.col("user_id") % 10).cast("string")))
    return B.latest_per_kind(e, "kind", "ts", "event_id")


def incremental_hash_misses(spark, d):
    files = table(spark, d, "recipe_candidate").select("candidate_id", V.sha256_text("sha256").alias("sha"), V.phash_bits("phash").alias("ph"))
    return B.cache_misses(files, images(spark, d), ["sha", "ph"]).select("candidate_id")


def name_collision_suffix(spark, d):
    i = images(spark, d).select("item_id", F.coalesce("label", F.lit("none")).alias("folder"), F.concat(F.coalesce("source", F.lit("picture")), F.lit(".jpg")).alias("name"))
    return B.numbered_names(i, "folder", "name", "item_id")


def quality_reasons(spark, d):
    a = audited(spark, d)
    w, h = 100 + F.col("item_id") * 37 % 900, 100 + F.col("item_id") * 53 % 900
    return G.annotate(a.select("item_id", "blur_score", "brightness"), G.quality_reasons(w, h, F.col("blur_score"), F.col("brightness"))).select("item_id", "status", "reasons")


def quality_summary(spark, d):
    return G.reason_counts(quality_reasons(spark, d))


_W, _H = 640.0, 480.0


def _boxes(spark, d):
    r = table(spark, d, "source_record").select("record_id", F.posexplode("boxes").alias("k", "b"))
    corner = lambda c, s, e, sign: (F.col(f"b.{c}") + sign * F.col(f"b.{s}") / 2) * e
    return r.select("record_id", "k", corner("xc", "width", _W, -1).alias("l"), corner("yc", "height", _H, -1).alias("t"), corner("xc", "width", _W, 1).alias("r"), corner("yc", "height", _H, 1).alias("bt"))


def normalize_boxes(spark, d):
    box = R.normalized_box(F.col("l"), F.col("t"), F.col("r"), F.col("bt"), F.lit(_W), F.lit(_H))
    rows = _boxes(spark, d).select("record_id", "k", box.alias("x"))
    return rows.select("record_id", "k", *[F.round(f"x.{c}", 6).alias(c) for c in ("xc", "yc", "width", "height")], F.col("x").isNotNull().alias("valid"))


def polygon_to_box(spark, d):
    rows = _boxes(spark, d)
    xs, ys = [F.col("l") / _W, F.col("r") / _W], [F.col("t") / _H, F.col("bt") / _H]
    polygon = F.array(xs[0], ys[0], xs[1], ys[0], xs[1], ys[1], (xs[0] + xs[1]) / 2, ys[1])
    x = R.box_of_values(polygon)
    return rows.select("record_id", "k", *[F.round(x[c], 6).alias(c) for c in ("xc", "yc", "width", "height")])


def region_reading_order(spark, d):
    r = table(spark, d, "source_record")
    box = lambda b: F.struct((b["width"] * b["height"]).alias("confidence"), ((b["xc"] - b["width"] / 2) * _W).alias("left"), ((b["yc"] - b["height"] / 2) * _H).alias("top"), ((b["xc"] + b["width"] / 2) * _W).alias("right"), ((b["yc"] + b["height"] / 2) * _H).alias("bottom"))
    c = r.select("record_id", F.lit(640).alias("image_width"), F.lit(480).alias("image_height"), F.transform("boxes", box).alias("candidates"))
    return R.reading_order(c, "record_id").withColumn("confidence", F.round("confidence", 8))


def grid_template(spark, d):
    r = table(spark, d, "source_record").select("record_id", (600 + F.col("record_id") % 200).alias("image_width"), (500 + F.col("record_id") % 300).alias("image_height"))
    return R.grid_template(r, "record_id")


def annotation_counts(spark, d):
    return R.annotation_counts(table(spark, d, "source_record").withColumn("split", V.read_split("split")), "split", "boxes")


QUERIES = {f.__name__: f for f in (representative_variant, group_size_histogram, split_assignment, positional_split, cap_per_class, quota_per_class, oversample_repeat, class_weights, manifest_counts, count_tree, manifest_diff, artifact_sync_plan, latest_run_per_kind, incremental_hash_misses, name_collision_suffix, quality_reasons, quality_summary, normalize_boxes, polygon_to_box, region_reading_order, grid_template, annotation_counts)}

_I = f"i AS (SELECT item_id, {Q.sha('sha256')} AS sha, {Q.ph('phash')} AS ph, {Q.name('class_name')} AS label, {Q.name('source_name')} AS source, path, train_weight, accepted_at FROM image_item)"
_A = f"a AS (SELECT item_id, {Q.AUDIT_SPLIT} AS split, {Q.name('class_name')} AS label, {Q.name('source')} AS source, {Q.sha('sha256')} AS sha, {Q.ph('phash')} AS ph, rel_path, blur_score, brightness FROM audit_item)"
_R = f"r AS (SELECT *, {Q.CAPTURE} AS capture FROM source_record)"
_L = f"l AS (SELECT DISTINCT {Q.name('class_name')} AS label FROM price_row)"
_SEED = "sha256('42|' || item_id)"
_B = """b0 AS (SELECT record_id, unnest(boxes) AS b, unnest(range(len(boxes))) AS k FROM source_record),
b AS (SELECT record_id, k, (b.xc - b.width / 2) * 640.0 AS l, (b.yc - b.height / 2) * 480.0 AS t, (b.xc + b.width / 2) * 640.0 AS r, (b.yc + b.height / 2) * 480.0 AS bt FROM b0)"""
_Q = """q AS (SELECT item_id, concat_ws(';', CASE WHEN least(w, h) < 180 THEN 'too_small' END, CASE WHEN greatest(w / h, h / w) > 3.0 THEN 'odd_aspect_ratio' END,
  CASE WHEN blur_score < 20 THEN 'too_blurry' END, CASE WHEN brightness < 20 THEN 'too_dark' END, CASE WHEN brightness > 238 THEN 'too_bright' END) AS reasons
  FROM (SELECT *, 100 + item_id * 37 % 900 AS w, 100 + item_id * 53 % 900 AS h FROM audit_item)),
s AS (SELECT item_id, CASE WHEN reasons = '' THEN 'accepted' ELSE 'rejected' END AS status, reasons FROM q)"""


def _box(l: str, t: str, r: str, b: str, w: str, h: str) -> str:
    c = lambda x, m: f"greatest(0, least({m}, {x}))"
    return f"{c(l, w)} AS cl, {c(r, w)} AS cr, {c(t, h)} AS ct, {c(b, h)} AS cb"


_BOX_OUT = "CASE WHEN v THEN round((cl + cr) / 2 / {w}, 6) END AS xc, CASE WHEN v THEN round((ct + cb) / 2 / {h}, 6) END AS yc, CASE WHEN v THEN round((cr - cl) / {w}, 6) END AS width, CASE WHEN v THEN round((cb - ct) / {h}, 6) END AS height"
_CELLS = lambda rows: " UNION ALL ".join(f"SELECT '{n}' AS name, CAST({x} AS DOUBLE) AS rx, CAST({y} AS DOUBLE) AS ry, CAST({w} AS DOUBLE) AS rw, CAST({h} AS DOUBLE) AS rh" for n, x, y, w, h in rows)

ORACLE = {
    "representative_variant": f"""WITH {_R} SELECT dataset, capture, record_id, n AS variants FROM (SELECT dataset, capture, record_id, count(*) OVER w AS n,
  row_number() OVER (w ORDER BY coalesce(black_border_ratio, 'infinity'::DOUBLE), coalesce(blur_score, '-infinity'::DOUBLE) DESC, coalesce(image_path, ''), record_id) AS k FROM r WINDOW w AS (PARTITION BY dataset, capture)) WHERE k = 1""",
    "group_size_histogram": f"WITH {_R}, g AS (SELECT dataset, capture, count(*) AS group_size FROM r GROUP BY 1, 2) SELECT dataset, group_size, count(*) AS groups, CAST(sum(group_size) AS BIGINT) AS records FROM g GROUP BY 1, 2",
    "split_assignment": f"""WITH RECURSIVE {_I}, k AS (SELECT item_id, label, row_number() OVER (PARTITION BY label ORDER BY {_SEED}, item_id) AS rk, count(*) OVER (PARTITION BY label) AS n FROM i),
s(label, n, v, t) AS (SELECT DISTINCT label, n, greatest(CASE WHEN n >= 3 THEN 1 ELSE 0 END, CAST(round_even(n * 0.1 / (0.8 + 0.1 + 0.1), 0) AS BIGINT)), greatest(CASE WHEN n >= 3 THEN 1 ELSE 0 END, CAST(round_even(n * 0.1 / (0.8 + 0.1 + 0.1), 0) AS BIGINT)) FROM k
  UNION ALL SELECT label, n, CASE WHEN v >= t AND v > 0 THEN v - 1 ELSE v END, CASE WHEN v >= t AND v > 0 THEN t ELSE t - 1 END FROM s WHERE v + t >= n AND (v > 0 OR t > 0)),
f AS (SELECT label, n, min(v) AS v, min(t) AS t FROM s GROUP BY 1, 2)
SELECT item_id, k.label, CASE WHEN rk <= k.n - v - t THEN 'train' WHEN rk <= k.n - t THEN 'val' ELSE 'test' END AS split FROM k JOIN f ON k.label IS NOT DISTINCT FROM f.label""",
    "positional_split": f"""WITH k AS (SELECT item_id, row_number() OVER (ORDER BY {_SEED}, item_id) - 1 AS p, count(*) OVER () AS n FROM image_item)
SELECT item_id, CASE WHEN p < floor(n * 0.8::DOUBLE) THEN 'train' WHEN p < floor(n * 0.9::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM k""",
    "cap_per_class": f"""WITH {_I}, m AS (SELECT label, greatest(5, CAST(round_even(count(*) FILTER (source = 'archive_2022') * 0.5, 0) AS BIGINT)) AS lim FROM i GROUP BY label),
k AS (SELECT item_id, label, source, row_number() OVER (PARTITION BY label, source ORDER BY {_SEED}, item_id) AS rk FROM i)
SELECT item_id, k.label, source, CASE WHEN source = 'recipe_crawl' AND rk > lim THEN 'skipped' ELSE 'kept' END AS status FROM k JOIN m ON k.label IS NOT DISTINCT FROM m.label""",
    "quota_per_class": f"""WITH c AS (SELECT candidate_id, {Q.name('query')} AS query, ({Q.sha('sha256')}) IS NOT NULL AND title IS NOT NULL AS accepted FROM recipe_candidate),
k AS (SELECT *, CAST(sum(CAST(accepted AS INT)) OVER (PARTITION BY query ORDER BY candidate_id) AS BIGINT) AS done FROM c) SELECT candidate_id, query, accepted FROM k WHERE done < 3 OR (done = 3 AND accepted)""",
    "oversample_repeat": "SELECT item_id, CAST(unnest(range(CASE WHEN accepted_at IS NULL THEN 1 ELSE greatest(coalesce(train_weight, 1), 1) END)) AS INTEGER) AS repeat_index FROM image_item",
    "class_weights": f"""WITH {_I}, {_L}, c AS (SELECT label, count(i.item_id) AS n FROM l LEFT JOIN i USING (label) GROUP BY 1)
SELECT label, n, (sum(n) OVER ())::DOUBLE / ((count(*) OVER ()) * greatest(n, 1)) AS weight, 1.0::DOUBLE / greatest(n, 1) AS sample_weight FROM c""",
    "manifest_counts": f"""WITH {_A}, {_L}, s AS (SELECT DISTINCT split FROM split_ratio), c AS (SELECT split, label, count(*) AS n, sum(length(rel_path)) AS bytes FROM a GROUP BY 1, 2)
SELECT split, label, coalesce(n, 0) AS n, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes FROM s CROSS JOIN l LEFT JOIN c USING (split, label)""",
    "count_tree": f"""WITH {_A} SELECT CASE WHEN grouping(split) = 0 THEN 'split' WHEN grouping(label) = 0 THEN 'label' WHEN grouping(source) = 0 THEN 'source' ELSE 'total' END AS dimension,
  CASE WHEN grouping(split) = 0 THEN split WHEN grouping(label) = 0 THEN label WHEN grouping(source) = 0 THEN source END AS value, count(*) AS n FROM a GROUP BY GROUPING SETS ((), (split), (label), (source))""",
    "manifest_diff": f"""WITH {_I}, {_A}, b AS (SELECT label, 1 AS s FROM i UNION ALL SELECT label, -1 FROM a), n AS (SELECT label, CAST(sum(s) AS BIGINT) AS net FROM b GROUP BY 1)
SELECT label, CASE WHEN net > 0 THEN 'a' ELSE 'b' END AS only_in, abs(net) AS surplus FROM n WHERE net <> 0""",
    "artifact_sync_plan": f"""WITH {_I}, s AS (SELECT path AS name, min(sha) AS sha, count(*) AS bytes FROM i WHERE path IS NOT NULL GROUP BY 1), t AS (SELECT path AS name, min(sha) AS sha, count(*) AS bytes FROM i WHERE path IS NOT NULL AND accepted_at IS NOT NULL GROUP BY 1)
SELECT name, CASE WHEN s.bytes IS NULL THEN 'missing_source' WHEN s.sha = t.sha AND s.bytes = t.bytes THEN 'same' WHEN t.bytes IS NOT NULL THEN 'target_exists' ELSE 'planned' END AS status, coalesce(s.bytes, 0) AS bytes FROM s FULL JOIN t USING (name)""",
    "latest_run_per_kind": "WITH e AS (SELECT *, event_type || '/' || user_id % 10 AS kind FROM events) SELECT kind, event_id AS latest, ts AS at FROM e QUALIFY row_number() OVER (PARTITION BY kind ORDER BY ts DESC, event_id DESC) = 1",
    "incremental_hash_misses": f"WITH {_I}, c AS (SELECT candidate_id, {Q.sha('sha256')} AS sha, {Q.ph('phash')} AS ph FROM recipe_candidate) SELECT candidate_id FROM c WHERE NOT EXISTS (SELECT 1 FROM i WHERE c.sha = i.sha AND c.ph = i.ph)",
    "name_collision_suffix": f"""WITH {_I}, x AS (SELECT item_id, coalesce(label, 'none') AS folder, coalesce(source, 'picture') AS stem FROM i), k AS (SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY item_id) - 1 AS k FROM x)
SELECT item_id, folder, stem || '.jpg' AS name, CASE WHEN k = 0 THEN stem || '.jpg' WHEN k < 1000 THEN stem || '_' || lpad(k::VARCHAR, 3, '0') || '.jpg' ELSE stem || '_' || k || '.jpg' END AS target FROM k""",
    "quality_reasons": f"WITH {_Q} SELECT item_id, status, reasons FROM s",
    "quality_summary": f"WITH {_Q}, e AS (SELECT status, CASE WHEN reasons = '' THEN NULL ELSE unnest(string_split(reasons, ';')) END AS reason FROM s) SELECT status, reason, count(*) AS n FROM e GROUP BY 1, 2",
    "normalize_boxes": f"WITH {_B}, c AS (SELECT *, {_box('l', 't', 'r', 'bt', '640.0', '480.0')} FROM b), d AS (SELECT *, cr > cl AND cb > ct AND ((cr - cl) / 640.0) * ((cb - ct) / 480.0) >= 0.005 AS v FROM c) SELECT record_id, CAST(k AS INTEGER) AS k, {_BOX_OUT.format(w='640.0', h='480.0')}, v AS valid FROM d",
    "polygon_to_box": f"WITH {_B}, c AS (SELECT *, {_box('l / 640.0', 't / 480.0', 'r / 640.0', 'bt / 480.0', '1.0', '1.0')} FROM b), d AS (SELECT *, cr > cl AND cb > ct AND (cr - cl) * (cb - ct) >= 0.005 AS v FROM c) SELECT record_id, CAST(k AS INTEGER) AS k, {_BOX_OUT.format(w='1.0', h='1.0')} FROM d",
    "region_reading_order": f"""WITH {_B}, c AS (SELECT b.*, round(b0.b.width * b0.b.height, 8) AS confidence, {_box('l', 't', 'r', 'bt', '640.0', '480.0')} FROM b JOIN b0 USING (record_id, k)),
d AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY (ct + cb) / 2, (cl + cr) / 2, k) AS pos, count(*) OVER (PARTITION BY record_id) AS n FROM c WHERE cr > cl AND cb > ct AND (cr - cl) * (cb - ct) / 307200.0 >= 0.005),
e AS (SELECT record_id, n, 'auto_' || lpad(pos::VARCHAR, 2, '0') AS name, greatest(0, round_even(cl - (cr - cl) * 0.05, 0)::BIGINT) AS x, greatest(0, round_even(ct - (cb - ct) * 0.05, 0)::BIGINT) AS y,
  least(640, round_even(cr + (cr - cl) * 0.05, 0)::BIGINT) AS r2, least(480, round_even(cb + (cb - ct) * 0.05, 0)::BIGINT) AS b2, confidence FROM d)
SELECT record_id, '' AS fallback, name, x, y, greatest(1, r2 - x) AS w, greatest(1, b2 - y) AS h, confidence FROM e WHERE n <= 8
UNION ALL SELECT record_id, CASE WHEN m.n IS NULL THEN 'no_regions' ELSE 'too_many_regions' END, NULL, NULL, NULL, NULL, NULL, NULL FROM source_record LEFT JOIN (SELECT DISTINCT record_id, n FROM e) m USING (record_id) WHERE m.n IS NULL OR m.n > 8""",
    "grid_template": f"""WITH p AS (SELECT record_id, 600 + record_id % 200 AS w, 500 + record_id % 300 AS h FROM source_record), land AS ({_CELLS(R.LANDSCAPE_CELLS)}), port AS ({_CELLS(R.PORTRAIT_CELLS)}),
x AS (SELECT p.*, c.* FROM p, land c WHERE w >= h UNION ALL SELECT p.*, c.* FROM p, port c WHERE w < h)
SELECT record_id, name, CAST(floor(rx * w) AS BIGINT) AS x, CAST(floor(ry * h) AS BIGINT) AS y, CAST(floor(rw * w) AS BIGINT) AS w, CAST(floor(rh * h) AS BIGINT) AS h FROM x""",
    "annotation_counts": f"SELECT {Q.split('split')} AS split, count(*) AS images, CAST(sum(coalesce(len(boxes), 0)) AS BIGINT) AS objects, count(*) FILTER (coalesce(len(boxes), 0) = 0) AS empty FROM source_record GROUP BY 1",
}
