"""DuckDB equivalents of the queries that SQL can express on whole tables."""

from __future__ import annotations

from larder.plans import sql as Q

_sha, _ph, _name, _split, _CAPTURE = Q.sha, Q.ph, Q.name, Q.split, Q.CAPTURE


def _near(a: str, b: str) -> str:
    return f"({a}.sha = {b}.sha OR bit_count(xor({a}.ph, {b}.ph)) <= 5)"


_RELATED = f"""
r AS (SELECT record_id, coalesce(dataset, '') || '/' || {_CAPTURE} AS ckey, nullif({_sha('sha256')}, sha256('')) AS sha, {_split('split')} AS sp,
        coalesce(dataset, '') || '/' AS bare FROM source_record),
u AS (SELECT *, coalesce(ckey, chr(1) || record_id) AS unit FROM r),
pic AS (SELECT DISTINCT unit, sha FROM u WHERE sha IS NOT NULL),
star AS (SELECT unit, min(unit) OVER (PARTITION BY sha) AS head FROM pic),
e AS (SELECT unit AS a, head AS b FROM star WHERE unit <> head UNION SELECT head, unit FROM star WHERE unit <> head),
reach AS (SELECT DISTINCT a AS x, a AS y FROM e UNION SELECT reach.x, e.b FROM reach JOIN e ON e.a = reach.y),
root AS (SELECT x AS unit, min(y) AS root FROM reach GROUP BY x),
m AS (SELECT u.*, coalesce(root.root, u.unit) AS root FROM u LEFT JOIN root USING (unit))"""

_AUDIT = f"""
t AS (SELECT item_id, {_name('source')} AS source, {_sha('sha256')} AS sha, {_ph('phash')} AS ph,
        {Q.AUDIT_SPLIT} AS sp FROM audit_item),
pairs AS (SELECT e.item_id AS eid, t2.item_id AS tid, e.sp, e.source, coalesce(e.sha = t2.sha, false) AS exact
        FROM t e JOIN t t2 ON e.sp <> 'train' AND t2.sp = 'train' AND {_near('e', 't2')})"""

_CANDIDATE = f"""{Q.URL_PARTS},
c AS (SELECT candidate_id, batch_no, batch_at, {_sha('sha256')} AS sha, {_ph('phash')} AS ph, {Q.URL} AS url FROM u1),
i AS (SELECT accepted_at, {_sha('sha256')} AS sha, {_ph('phash')} AS ph FROM image_item WHERE accepted_at IS NOT NULL)"""

_GROUPED = f"""
f AS (SELECT item_id, {_sha('sha256')} AS sha, {_ph('phash')} AS ph, train_weight, accepted_at,
        CASE WHEN priority BETWEEN 1 AND 9 THEN priority ELSE 10 END AS p, {_name('source_name')} AS src, {_name('class_name')} AS cls FROM image_item),
e AS (SELECT a.item_id AS a, b.item_id AS b FROM f a JOIN f b ON a.item_id <> b.item_id AND {_near('a', 'b')}),
reach AS (SELECT DISTINCT a AS x, a AS y FROM e UNION SELECT reach.x, e.b FROM reach JOIN e ON e.a = reach.y),
g AS (SELECT x AS item_id, min(y) AS group_id FROM reach GROUP BY x),
v AS (SELECT group_id, 'source_name' AS field_name, f.* FROM g JOIN f USING (item_id) WHERE src IN (SELECT {_name('name')} FROM source_spec)
      UNION ALL SELECT group_id, 'class_name', f.* FROM g JOIN f USING (item_id) WHERE cls IN (SELECT {_name('class_name')} FROM price_row)
      UNION ALL SELECT group_id, 'train_weight', f.* FROM g JOIN f USING (item_id) WHERE train_weight >= 1),
w AS (SELECT *, row_number() OVER (PARTITION BY group_id, field_name ORDER BY p, accepted_at DESC NULLS LAST, item_id) AS rn FROM v)"""

_FIELD = lambda f, c, t: f"max(CASE WHEN field_name = '{f}' THEN {c} END) AS {f}, max(CASE WHEN field_name = '{f}' THEN item_id END) AS {f}_item"

_PLAN = f"""
s AS (SELECT {_name('name')} AS name, greatest(coalesce(train_weight, 1), 1) AS w, greatest(coalesce(max_repeats, 1), 1) AS reps FROM source_spec),
n AS (SELECT {_name('source_name')} AS name, count(*) AS n FROM image_item GROUP BY 1),
p AS (SELECT s.*, coalesce(n.n, 0) AS n FROM s LEFT JOIN n USING (name)),
q AS (SELECT *, (SELECT sum(n) FROM p) AS total, (SELECT sum(w) FROM p) AS ws FROM p)"""


def _mixed(total: str, sharing: str) -> str:
    """Rows of unit size: whole targets, the units left over to the largest fractions, each source up to its repeats."""
    return f"""{_PLAN},
o AS (SELECT *, sum(CASE WHEN {sharing} THEN w END) OVER () AS sw FROM q),
t AS (SELECT *, CAST({total} AS BIGINT) AS tot FROM o),
b AS (SELECT *, CASE WHEN {sharing} THEN tot * w // sw ELSE 0 END AS whole, CASE WHEN {sharing} THEN tot * w % sw END AS part FROM t),
r AS (SELECT *, tot - sum(whole) OVER () AS spare, row_number() OVER (ORDER BY part DESC NULLS LAST, name) AS k FROM b),
g AS (SELECT *, CASE WHEN {sharing} THEN whole + CASE WHEN k <= spare THEN 1 ELSE 0 END ELSE 0 END AS budget FROM r),
z AS (SELECT *, least(budget, n * reps) AS used FROM g)
SELECT name, CASE WHEN {sharing} THEN w / sw ELSE 0.0 END AS target_share, CAST(least(used, n) AS BIGINT) AS rows_used, CAST(used AS BIGINT) AS size_used, used / sum(used) OVER () AS share,
  CAST(CASE WHEN n = 0 OR used = 0 THEN 0 ELSE (used + n - 1) // n END AS INTEGER) AS max_copies, (n * reps * sw < tot * w AND {sharing}) OR NOT ({sharing}) AS short FROM z"""


_WORDS = "regexp_extract_all(replace(lower(strip_accents(regexp_replace(text, '[\\x{ad}\\p{Cf}]', '', 'g'))), 'đ', 'd'), '[\\p{L}\\p{N}]+')"

ORACLE = {
    "p1_found": f"""WITH RECURSIVE {_RELATED},
k AS (SELECT root, coalesce(min(ckey), min(bare)) AS group_key FROM m GROUP BY root HAVING count(DISTINCT sp) > 1)
SELECT record_id, group_key FROM m JOIN k USING (root)""",
    "p2_found": f"WITH {_AUDIT} SELECT least(eid, tid) AS item_a, greatest(eid, tid) AS item_b FROM pairs",
    "p2_report": f"""WITH {_AUDIT},
n AS (SELECT eid, count(*) FILTER (exact) AS x, count(*) FILTER (NOT exact) AS y FROM pairs GROUP BY eid)
SELECT sp AS split, source, count(*) AS items, count(n.eid) AS leaked_items, CAST(coalesce(sum(x), 0) AS BIGINT) AS exact_pairs, CAST(coalesce(sum(y), 0) AS BIGINT) AS near_pairs
FROM t LEFT JOIN n ON n.eid = t.item_id WHERE sp <> 'train' GROUP BY 1, 2""",
    "p3_found": f"""WITH {_CANDIDATE}
SELECT candidate_id FROM c WHERE EXISTS (SELECT 1 FROM i WHERE i.accepted_at < c.batch_at AND {_near('c', 'i')})
OR EXISTS (SELECT 1 FROM c o WHERE o.batch_no < c.batch_no AND ({_near('c', 'o')} OR c.url = o.url))""",
    "p4_found": f"WITH RECURSIVE {_GROUPED} SELECT group_id, field_name, item_id FROM w WHERE rn = 1",
    "p4_survivors": f"""WITH RECURSIVE {_GROUPED},
z AS (SELECT group_id, count(*) AS rows FROM g GROUP BY 1), b AS (SELECT * FROM w WHERE rn = 1)
SELECT z.group_id, z.rows, {_FIELD('source_name', 'src', 0)}, {_FIELD('class_name', 'cls', 0)}, {_FIELD('train_weight', 'train_weight', 0)}
FROM z LEFT JOIN b USING (group_id) GROUP BY 1, 2""",
    "p7_found": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), e AS (SELECT eval_id, {_WORDS} AS w FROM eval_item),
di AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13),
ei AS (SELECT eval_id, w, unnest(range(1, len(w) - 11)) AS k FROM e WHERE len(w) >= 13),
dg AS (SELECT doc_id, array_to_string(w[k:k + 12], ' ') AS g FROM di), eg AS (SELECT eval_id, array_to_string(w[k:k + 12], ' ') AS g FROM ei)
SELECT DISTINCT doc_id, eval_id FROM dg JOIN eg USING (g)""",
    # the closest total of all subsets for each smaller share; the largest takes the rest
    "p1_totals": f"""WITH RECURSIVE {_RELATED},
c AS (SELECT size, count(*) AS c, row_number() OVER (ORDER BY size DESC) AS i FROM (SELECT count(*) AS size FROM m GROUP BY root) GROUP BY size),
s AS (SELECT split, CAST(round_even((SELECT count(*) FROM r) * ratio / (SELECT sum(ratio) FROM split_ratio), 0) AS BIGINT) AS target, row_number() OVER (ORDER BY ratio DESC, split DESC) AS k FROM split_ratio),
lim AS (SELECT 2 * max(target) AS lim FROM s WHERE k > 1),
reach2 AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS t UNION SELECT c.i, reach2.t + c.size * n.n FROM reach2 JOIN c ON c.i = reach2.i + 1, lim, LATERAL (SELECT unnest(range(0, least(c.c, (lim.lim - reach2.t) // c.size) + 1)) AS n) n),
best AS (SELECT split, k, arg_min(t, (abs(t - target), t)) AS records FROM s, (SELECT DISTINCT t FROM reach2 WHERE i = (SELECT max(i) FROM c)) WHERE k > 1 GROUP BY split, k)
SELECT split, CAST(records AS BIGINT) AS records FROM best UNION ALL SELECT split, CAST((SELECT count(*) FROM r) - (SELECT sum(records) FROM best) AS BIGINT) FROM s WHERE k = 1""",
    "p1_split_faults": "SELECT CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS key, CAST(NULL AS BIGINT) AS splits WHERE false",
    "p5_shares": f"WITH {_mixed('total', 'true')}",
    "p5_exact_shares": f"WITH {_mixed('least(total, min(CASE WHEN n > 0 THEN n * reps * sw // w END) OVER ())', 'n > 0')}",
    "p5_found": f"WITH {_PLAN} SELECT name FROM q WHERE n * reps * ws < total * w",
}
