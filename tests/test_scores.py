"""Queries of scores against plain SQL over all rows and all scores."""

import duckdb
import pytest

from helpers import SMALL
from larder.plans.queries import QUERIES

EMBEDDINGS = f"read_parquet('{SMALL}/embeddings.parquet')"


def test_focal_loss_has_every_row(spark):
    got = {r["label"]: (r["n"], r["loss"]) for r in QUERIES["focal_loss"](spark, SMALL).collect()}
    want = duckdb.sql(f"""WITH z AS (SELECT label, list_transform(embedding, lambda x: exp(x::DOUBLE * 10)) AS e FROM {EMBEDDINGS}), y AS (SELECT label, e[label + 1] / list_sum(e) AS p FROM z)
SELECT label, count(*), round(avg(pow(1 - p, 2) * (1 + label % 4 / 2) * -ln(p)), 6) FROM y GROUP BY 1""").fetchall()
    assert {k: n for k, (n, _) in got.items()} == dict(duckdb.sql(f"SELECT label, count(*) FROM {EMBEDDINGS} GROUP BY 1").fetchall())
    assert got == {k: (n, pytest.approx(loss, abs=2e-6)) for k, n, loss in want}


def test_softmax_topk_reads_the_whole_vector(spark):
    got = {(r["vec_id"], r["k"]): (r["class_index"], r["p"]) for r in QUERIES["softmax_topk"](spark, SMALL).collect()}
    want = duckdb.sql(f"""WITH z AS (SELECT vec_id, unnest(embedding)::DOUBLE * 10 AS x, unnest(range(len(embedding))) AS i FROM {EMBEDDINGS}),
y AS (SELECT vec_id, i, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM z)
SELECT vec_id, i, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) - 1 AS k FROM y QUALIFY k < 5""").fetchall()
    assert got == {(v, k): (i, pytest.approx(p, abs=2e-6)) for v, i, p, k in want}
    assert max(i for i, _ in got.values()) == 63
