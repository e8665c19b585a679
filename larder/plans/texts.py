"""Queries of text filters, pages, classifier evaluation and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import values as V
from larder.operators import evaluate as E
from larder.operators import review as L
from larder.operators import text as X
from larder.plans import sql as Q
from larder.plans.dedup import images
from larder.session import table

_POSITIVE = ["cơm gạo lứt", "trứng", "gà", "cá", "soup", "rice", "nước dùng", "egg"]
_NEGATIVE = ["thịt kho", "pork", "chả"]
_SENSITIVE = {"gà", "cá", "chả"}


def text_term_filter(spark, d):
    c = table(spark, d, "recipe_candidate").select("candidate_id", F.concat_ws(" ", "title", "text").alias("body"))
    return X.text_filter(c, "body", positive=_POSITIVE, negative=_NEGATIVE, sensitive=_SENSITIVE).select("candidate_id", "accepted", "reason")


def slugify_titles(spark, d):
    return table(spark, d, "recipe_candidate").select("candidate_id", X.safe_slug(F.col("title")).alias("slug"), X.safe_label(F.col("title")).alias("label"))


def page_links(spark, d):
    c = table(spark, d, "recipe_candidate").where("recipe_url is not null").groupBy("batch_no").agg(F.array_join(F.array_sort(F.collect_list("recipe_url")), "?ref=1'>x</a><a class=k href='").alias("u"))
    html = F.concat(F.lit("<a href='/vn/7?x=1'>y</a><a href='"), F.col("u"), F.lit("'>z</a>"))
    return c.select("batch_no", F.explode(X.page_links(html, "https://recipes.bepnha.example/vn/search", r"/vn/\d+")).alias("link"))


def recipe_pages(spark, d):
    c = table(spark, d, "recipe_candidate")
    doc = F.to_json(F.struct(F.lit("Recipe").alias("@type"), F.col("title").alias("name"), F.array("image_url").alias("image"), F.col("text").alias("description")))
    page = F.concat(F.lit("<html><script type=\"application/ld+json\">{broken</script><script type=\"application/ld+json\">"), doc, F.lit("</script></html>"))
    r = X.recipe_of_page(page)
    return c.select("candidate_id", r["title"].alias("title"), r["image_url"].alias("image_url"), r["text"].alias("text"))


def search_pages(spark, d):
    return table(spark, d, "recipe_candidate").where("query is not null").select("candidate_id", X.search_address("https://recipes.bepnha.example/tim-kiem", F.col("query"), F.col("batch_no")).alias("address"))


def _softmax(scores):
    return E.softmax(F.transform(scores, lambda x: x.cast("double") * 10))


def _scored(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("label"), E.top_k(_softmax(F.col("embedding")), 5).alias("top"))  # 64 classes, of which the labels name ten


def softmax_topk(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", E.top_k(_softmax(F.col("embedding")), 5).alias("top"))
    return e.select("vec_id", F.posexplode("top").alias("k", "t")).select("vec_id", "k", F.col("t.class_index").alias("class_index"), F.round("t.p", 6).alias("p"))


def review_decision(spark, d):
    s = _scored(spark, d)
    return s.select("vec_id", E.review_decision(F.col("top"), F.col("label"), F.col("label") != 9, threshold=0.45).alias("decision"))


def model_gate(spark, d):
    s = _scored(spark, d)
    ok, reason = E.model_gate(F.col("top"), F.col("label"), F.array((F.col("label") + 1) % 10), min_confidence=0.05)
    return s.select("vec_id", ok.alias("accepted"), reason.alias("reason"))


def _predicted(spark, d):
    t = F.col("top")
    return _scored(spark, d).select("vec_id", F.col("label").alias("truth"), t[0]["class_index"].alias("predicted"), t[0]["p"].alias("confidence"), (t[0]["p"] - t[1]["p"]).alias("margin"))


def _classes(spark):
    return spark.range(64).select(F.col("id").cast("int").alias("label"))


def confusion_matrix(spark, d):
    return E.confusion_matrix(_predicted(spark, d), "truth", "predicted", _classes(spark))


def classification_report(spark, d):
    r = E.classification_report(_predicted(spark, d), "truth", "predicted", _classes(spark).select(F.col("label").cast("string").alias("label")))
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def per_class_accuracy(spark, d):
    return E.per_class_accuracy(_predicted(spark, d), "truth", "predicted")


def mistake_ranking(spark, d):
    p = _predicted(spark, d).withColumns({c: F.round(c, 6) for c in ("confidence", "margin")})
    return E.mistake_ranking(p, "vec_id", "truth", limit=10)


def early_stopping(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_returnflag", F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg((F.sum(F.round(F.col("l_quantity")).cast("bigint")) % 1000 / 1000.0).alias("acc"))
    return E.early_stopping(li, "l_returnflag", "month", "acc", patience=12)


def epoch_means(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", F.col("l_linenumber").cast("double").alias("loss"), (F.round("l_quantity").cast("bigint") % 8).alias("correct"), F.lit(8).alias("size"))
    return E.epoch_means(li, "l_returnflag", "loss", "correct", "size")


_CLASS_WEIGHTS = [1 + k % 4 / 2 for k in range(64)]


def focal_loss(spark, d):
    w = F.array(*map(F.lit, _CLASS_WEIGHTS))
    p = table(spark, d, "embeddings").select("label", _softmax(F.col("embedding")).alias("p"))
    loss = lambda **k: E.focal_loss(F.col("p"), F.col("label"), w, **k)
    s = p.select("label", loss().alias("plain"), loss(smoothing=0.1).alias("smooth"))
    return s.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("plain"), 6).alias("loss"), F.round(F.avg("smooth"), 6).alias("smoothed_loss"))


def _log(spark, d):
    item = F.when(F.col("user_id") % 9 == 0, " ").otherwise(F.col("user_id").cast("string"))
    action = F.when(F.col("event_type") == "click", "mark_done").when(F.col("event_type") == "error", "undo_done").when(F.col("event_type") == "signup", "undo").otherwise("move")
    return table(spark, d, "events").select("event_id", "ts", item.alias("item"), action.alias("action"))


def done_log_replay(spark, d):
    return L.done_items(_log(spark, d).where("action in ('mark_done', 'undo_done')"), "item", "action", ["ts", "event_id"])


def undo_target(spark, d):
    return L.undo_target(_log(spark, d), "item", "action", done_log_replay(spark, d), ["ts", "event_id"])


def browse_page(spark, d):
    done = images(spark, d).where("accepted_at is null").select("item_id")
    i = images(spark, d).select("item_id", F.coalesce("path", F.lit("")).alias("path"))
    return L.browse_page(i, done, "item_id", "path", page=2, size=80)


def browse_counts(spark, d):
    i = images(spark, d)
    return L.browse_counts(i.select("item_id", "label"), i.where("accepted_at is null").select("item_id"), "item_id", "label")


def ledger_balance(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "user_id", F.round(F.col("value") * 100).cast("bigint").alias("delta"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("key"))
    return L.ledger_balance(e, "user_id", "delta", "key", ["ts", "event_id"])


def rating_summary(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", (F.round(F.col("value") * 100).cast("bigint") % 5 + 1).alias("stars"))
    return L.rating_summary(e, "user_id", "event_type", "stars", ["ts", "event_id"])


def phone_digests(spark, d):
    raw = F.concat(F.when(F.col("c_custkey") % 3 == 0, "+84 9").when(F.col("c_custkey") % 3 == 1, "09").otherwise("19"), F.substring("c_name", -8, 2), F.lit("-"), F.substring("c_name", -6, 6))
    c = table(spark, d, "customer").select("c_custkey", L.phone_keys(raw).alias("phone"))
    return c.select("c_custkey", L.hmac_sha256(F.col("phone"), b"not a secret").alias("phone_hmac"), F.concat(F.lit("******"), F.right("phone", F.lit(4))).alias("masked"))


QUERIES = {f.__name__: f for f in (text_term_filter, slugify_titles, page_links, recipe_pages, search_pages, softmax_topk, review_decision, model_gate, confusion_matrix, classification_report, per_class_accuracy, mistake_ranking, early_stopping, epoch_means, focal_loss, done_log_replay, undo_target, browse_page, browse_counts, ledger_balance, rating_summary, phone_digests)}


def _term(t: str) -> str:
    import unicodedata

    low = t.lower()
    key = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
    if " " in t:
        return f"contains(body, '{low}')" if t in _SENSITIVE else f"contains(k, '{key}')"
    if t in _SENSITIVE:
        return f"regexp_matches(body, '(^|[^\\pL\\pN_\\pM]){low}($|[^\\pL\\pN_\\pM])')"
    return f"regexp_matches(k, '(^|[^a-z0-9]){key}($|[^a-z0-9])')"


def _terms(ts: list[str], n: int) -> str:
    return f"list_sort(list_filter([{', '.join(f'CASE WHEN {_term(t)} THEN $${t}$$ END' for t in ts)}], lambda x: x IS NOT NULL))[1:{n}]"


_LOG = """g AS (SELECT event_id, ts, CASE WHEN user_id % 9 = 0 THEN ' ' ELSE user_id::VARCHAR END AS item,
  CASE event_type WHEN 'click' THEN 'mark_done' WHEN 'error' THEN 'undo_done' WHEN 'signup' THEN 'undo' ELSE 'move' END AS action FROM events),
dn AS (SELECT item, arg_max(action, (ts, event_id)) AS action FROM g WHERE action IN ('mark_done', 'undo_done') AND item <> ' ' GROUP BY item HAVING arg_max(action, (ts, event_id)) <> 'undo_done')"""
_S = """z AS (SELECT vec_id, label, list_transform(embedding, lambda x: exp(x::DOUBLE * 10 - list_max(embedding)::DOUBLE * 10)) AS e FROM embeddings),
y AS (SELECT vec_id, label, unnest(list_transform(e, lambda x: x / list_sum(e))) AS p, CAST(unnest(range(64)) AS INTEGER) AS class_index FROM z),
s AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class_index) - 1 AS INTEGER) AS k FROM y),
w AS (SELECT vec_id, label, max(CASE WHEN k = 0 THEN class_index END) AS c1, max(CASE WHEN k = 0 THEN p END) AS p1, max(CASE WHEN k = 1 THEN p END) AS p2,
  bool_or(k < 3 AND class_index = (label + 1) % 10) AS in3, coalesce(max(CASE WHEN k < 5 AND class_index = label THEN p END), 0) AS pt FROM s GROUP BY 1, 2)"""

ORACLE = {
    "text_term_filter": f"""WITH c AS (SELECT candidate_id, lower(concat_ws(' ', title, text)) AS body, lower(strip_accents(concat_ws(' ', title, text))) AS k FROM recipe_candidate),
x AS (SELECT *, {_terms(_NEGATIVE, 99)} AS neg, {_terms(_POSITIVE, 8)} AS pos FROM c)
SELECT candidate_id, len(neg) = 0 AND len(pos) > 0 AS accepted, CASE WHEN len(neg) > 0 THEN 'negative_text:' || array_to_string(neg, '|') WHEN len(pos) = 0 THEN 'missing_positive_text' ELSE 'text_ok:' || array_to_string(pos, '|') END AS reason FROM x""",
    "slugify_titles": """WITH s AS (SELECT candidate_id, title, trim(regexp_replace(lower(strip_accents(translate(coalesce(title, ''), 'đĐ', 'dD'))), '[^a-z0-9]+', '_', 'g'), '_') AS x FROM recipe_candidate)
SELECT candidate_id, rtrim(left(CASE WHEN x = '' THEN 'item' ELSE x END, 80), '_') AS slug, coalesce(nullif(regexp_replace(trim(coalesce(title, '')), '[^\\pL\\pN_\\-]', '_', 'g'), ''), 'item') AS label FROM s""",
    "page_links": "SELECT DISTINCT batch_no, recipe_url AS link FROM recipe_candidate WHERE regexp_matches(recipe_url, '/vn/\\d+') UNION SELECT DISTINCT batch_no, 'https://recipes.bepnha.example/vn/7' FROM recipe_candidate WHERE recipe_url IS NOT NULL",
    "recipe_pages": """WITH c AS (SELECT candidate_id, trim(coalesce(title, '')) AS t, trim(coalesce(image_url, '')) AS u, coalesce(text, '') AS x FROM recipe_candidate)
SELECT candidate_id, CASE WHEN t <> '' AND u <> '' THEN t END AS title, CASE WHEN t <> '' AND u <> '' THEN u END AS image_url, CASE WHEN t <> '' AND u <> '' THEN t || ' ' || x || ' ' END AS text FROM c""",
    "search_pages": "SELECT candidate_id, 'https://recipes.bepnha.example/tim-kiem/' || url_encode(query) || CASE WHEN batch_no > 1 THEN '?page=' || batch_no ELSE '' END AS address FROM recipe_candidate WHERE query IS NOT NULL",
    "softmax_topk": f"WITH {_S} SELECT vec_id, k, class_index, round(p, 6) AS p FROM s WHERE k < 5",
    "review_decision": f"WITH {_S} SELECT vec_id, CASE WHEN label = 9 THEN 'outside_target_classes' WHEN c1 <> label AND p1 >= 0.45 THEN 'high_confidence_disagreement' WHEN p1 < 0.45 THEN 'low_confidence' WHEN p1 - p2 < 0.15 THEN 'small_margin' ELSE 'ok' END AS decision FROM w",
    "model_gate": f"WITH {_S} SELECT vec_id, in3 OR pt >= 0.05 AS accepted, CASE WHEN in3 THEN 'allowed_top3' WHEN pt >= 0.05 THEN 'target_confidence' ELSE 'model_reject' END AS reason FROM w",
    "confusion_matrix": f"WITH {_S}, c AS (SELECT CAST(unnest(range(64)) AS INTEGER) AS label), n AS (SELECT label AS truth, c1 AS predicted, count(*) AS n FROM w GROUP BY 1, 2) SELECT a.label AS truth, b.label AS predicted, coalesce(n, 0) AS n FROM c a CROSS JOIN c b LEFT JOIN n ON n.truth = a.label AND n.predicted = b.label",
    "classification_report": f"""WITH {_S}, c AS (SELECT CAST(unnest(range(64)) AS INTEGER) AS label),
n AS (SELECT c.label, (SELECT count(*) FROM w WHERE w.label = c.label) AS support, (SELECT count(*) FROM w WHERE c1 = c.label) AS said, (SELECT count(*) FROM w WHERE c1 = c.label AND w.label = c.label) AS hit FROM c),
p AS (SELECT label, coalesce(hit / nullif(said, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r, support, hit FROM n), f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM p)
SELECT label::VARCHAR AS label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM f
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""",
    "per_class_accuracy": f"""WITH {_S}, n AS (SELECT label, c1, count(*) AS n FROM w GROUP BY 1, 2)
SELECT label AS truth, CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN c1 = label THEN n ELSE 0 END) AS BIGINT) AS correct, CAST(sum(CASE WHEN c1 = label THEN 0 ELSE n END) AS BIGINT) AS wrong,
  round(sum(CASE WHEN c1 = label THEN n ELSE 0 END)::DOUBLE / sum(n), 4) AS accuracy, arg_max(c1, (n, -c1)) AS most_predicted FROM n GROUP BY 1""",
    "mistake_ranking": f"""WITH {_S}, q AS (SELECT vec_id, label AS truth, c1 = label AS correct, round(p1, 6) AS confidence, round(p1 - p2, 6) AS margin FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY truth, correct ORDER BY CASE WHEN correct THEN confidence ELSE -confidence END, margin, vec_id) AS j FROM q), t AS (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY correct, j) AS rank FROM r WHERE NOT correct OR j <= 4)
SELECT vec_id, truth, CAST(rank AS INTEGER) AS rank, correct FROM t WHERE rank <= 10""",
    "early_stopping": """WITH h AS (SELECT l_returnflag, strftime(l_shipdate, '%Y-%m') AS month, (sum(CAST(round(l_quantity) AS BIGINT)) % 1000)::DOUBLE / 1000.0::DOUBLE AS acc FROM lineitem GROUP BY 1, 2),
a AS (SELECT *, row_number() OVER p AS k, coalesce(max(acc) OVER (PARTITION BY l_returnflag ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS bf, max(acc) OVER p AS best FROM h WINDOW p AS (PARTITION BY l_returnflag ORDER BY month)),
b AS (SELECT *, acc > bf AS improved, k - coalesce(max(CASE WHEN acc > bf THEN k END) OVER (PARTITION BY l_returnflag ORDER BY month), 0) AS waited FROM a),
c AS (SELECT *, min(CASE WHEN waited >= 12 THEN k END) OVER (PARTITION BY l_returnflag) AS stop FROM b)
SELECT l_returnflag, month, acc, best, improved, CAST(waited AS INTEGER) AS waited, coalesce(k = stop, false) AS stopped FROM c WHERE stop IS NULL OR k <= stop""",
    "epoch_means": "SELECT l_returnflag, sum(l_linenumber::DOUBLE * 8) / (count(*) * 8) AS loss, sum(CAST(round(l_quantity) AS BIGINT) % 8)::DOUBLE / (count(*) * 8) AS accuracy FROM lineitem GROUP BY 1",
    "focal_loss": f"""WITH {_S}, v AS (SELECT vec_id, label, -ln(p) AS nl, 1 + class_index % 4 / 2 AS w, CASE WHEN class_index = label THEN 1.0::DOUBLE ELSE 0 END AS one FROM y),
f AS (SELECT vec_id, label, sum(nl * one) AS ce, sum(nl * one * w) AS wce, sum(nl * (0.9::DOUBLE * one + 0.1::DOUBLE / 64)) AS ces, sum(nl * w * (0.9::DOUBLE * one + 0.1::DOUBLE / 64)) AS wces FROM v GROUP BY 1, 2)
SELECT label, count(*) AS n, round(avg(pow(1 - exp(-ce), 2) * wce), 6) AS loss, round(avg(pow(1 - exp(-ces), 2) * wces), 6) AS smoothed_loss FROM f GROUP BY 1""",
    "done_log_replay": f"WITH {_LOG} SELECT item, action FROM dn",
    "undo_target": f"WITH {_LOG} SELECT g.ts, g.event_id, g.action, g.item FROM g LEFT JOIN dn ON dn.item = g.item WHERE g.action <> 'undo' AND (g.action <> 'mark_done' OR dn.item IS NOT NULL) ORDER BY ts DESC, event_id DESC LIMIT 1",
    "browse_page": "SELECT item_id, coalesce(path, '') AS path FROM image_item WHERE accepted_at IS NOT NULL ORDER BY path, item_id LIMIT 80 OFFSET 160",
    "browse_counts": f"SELECT {Q.name('class_name')} AS label, count(*) AS total, count(*) FILTER (accepted_at IS NULL) AS hidden_done, count(*) FILTER (accepted_at IS NOT NULL) AS shown FROM image_item GROUP BY 1",
    "ledger_balance": """WITH e AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS delta, user_id || ':' || event_type || ':' || strftime(ts, '%Y-%m-%d') AS key FROM events), o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts, event_id) = 1)
SELECT user_id, count(*) AS entries, CAST(coalesce(sum(delta), 0) AS BIGINT) AS balance FROM o GROUP BY 1""",
    "rating_summary": "WITH e AS (SELECT *, CAST(round(value * 100) AS BIGINT) % 5 + 1 AS stars FROM events), o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT event_type, count(*) AS n, round(avg(stars), 2) AS average FROM o GROUP BY 1",
    "phone_digests": """WITH c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '849' WHEN 1 THEN '09' ELSE '19' END || right(c_name, 8) AS d FROM customer),
p AS (SELECT c_custkey, CASE WHEN d LIKE '84%' AND length(d) = 11 THEN '0' || substr(d, 3) ELSE d END AS n FROM c), q AS (SELECT c_custkey, CASE WHEN regexp_full_match(n, '0[0-9]{9}') THEN n END AS phone FROM p)
SELECT c_custkey, sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || phone::BLOB))) AS phone_hmac, '******' || right(phone, 4) AS masked FROM q""".replace("{outer}", bytes(b ^ 0x5C for b in b"not a secret".ljust(64, b"\0")).hex()).replace("{inner}", bytes(b ^ 0x36 for b in b"not a secret".ljust(64, b"\0")).hex()),
}
