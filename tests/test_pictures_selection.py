"""Picture metrics and selections against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import evaluate, pictures, selection
from larder.operators.components import star_links


def laplacian_variance(g):
    p = np.pad(g.astype(float), 1, mode="reflect") if min(g.shape) > 1 else np.pad(g.astype(float), 1, mode="edge")
    return (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g).var()


def test_metrics_of_grey_arrays(spark):
    rng = np.random.default_rng(1)
    shapes = [(8, 9), (5, 4), (20, 30), (2, 2)]
    rows = [(k, [int(x) for x in rng.integers(0, 60, h * w)], w, h) for k, (h, w) in enumerate(shapes)] + [(90, None, 3, 3), (91, [], 0, 0), (92, [1, 2], 3, 3)]
    df = spark.createDataFrame(rows, "id int, g array<int>, w int, h int")
    got = {r["id"]: r for r in df.select("id", pictures.brightness(F.col("g")).alias("m"), pictures.blur_score(F.col("g"), F.col("w"), F.col("h")).alias("b"), pictures.black_border_ratio(F.col("g"), F.col("w"), F.col("h")).alias("d"), pictures.difference_hash(F.col("g"), 9, 8).alias("x")).collect()}
    for k, flat, w, h in rows[:4]:
        g = np.array(flat).reshape(h, w)
        by, bx = max(1, int(h * 0.12)), max(1, int(w * 0.12))
        edge = np.zeros_like(g, dtype=bool)
        edge[:by], edge[-by:], edge[:, :bx], edge[:, -bx:] = True, True, True, True
        assert got[k]["m"] == pytest.approx(g.mean()) and got[k]["b"] == pytest.approx(laplacian_variance(g)) and got[k]["d"] == pytest.approx((g[edge] <= 20).mean())
    g = np.array(rows[0][1]).reshape(8, 9)
    assert got[0]["x"] == f"{int(''.join('1' if x else '0' for x in (g[:, 1:] > g[:, :-1]).flatten()), 2):016x}" and got[1]["x"] is None
    assert got[90]["m"] is None and got[90]["b"] is None and got[91]["b"] == 0.0 and got[91]["d"] == 1.0 and got[92]["b"] is None


def test_focal_loss_with_weights_and_smoothing(spark):
    p = [0.1, 0.2, 0.7]
    d = spark.createDataFrame([(0, p), (2, p), (7, p), (None, p)], "label int, p array<double>")
    w = F.array(*map(F.lit, [1.0, 2.0, 3.0]))
    got = d.select(evaluate.focal_loss(F.col("p"), F.col("label"), w).alias("a"), evaluate.focal_loss(F.col("p"), F.col("label"), w, smoothing=0.3).alias("s")).collect()
    assert got[0]["a"] == pytest.approx(0.9**2 * -np.log(0.1)) and got[1]["a"] == pytest.approx(0.3**2 * 3 * -np.log(0.7))
    share = np.array([0.1, 0.1, 0.8])
    ce = (share * -np.log(p)).sum()
    assert got[1]["s"] == pytest.approx((1 - np.exp(-ce)) ** 2 * (share * [1, 2, 3] * -np.log(p)).sum())
    assert got[2]["a"] is None and got[3]["s"] is None


@pytest.mark.parametrize("goal,most", [(3, 0), (3, 5), (100, 0), (1, 1)])
def test_global_quota(spark, goal, most):
    rng = random.Random(goal)
    rows = [(i, rng.choice([True, False, None])) for i in range(30)]
    got = sorted(r["id"] for r in selection.global_quota(spark.createDataFrame(rows, "id int, ok boolean"), "id", "ok", goal=goal, max_considered=most).collect())
    want, done = [], 0
    for i, ok in rows:
        if done >= goal or (most and len(want) >= most):
            break
        want.append(i)
        done += bool(ok)
    assert got == want


def test_small_lookups(spark):
    d = spark.createDataFrame([("x/old_a.jpg",), ("reviewed_b.png",), ("run/reports/x.csv",), ("run/curve.PNG",), ("run/weights.pt",), (None,), ("",)], "p string")
    got = [tuple(r) for r in d.select(selection.source_of_name(F.col("p")), selection.is_report(F.col("p"))).collect()]
    assert got == [("old", False), ("reviewed", False), ("unmanaged", True), ("unmanaged", True), ("unmanaged", False), (None, False), ("unmanaged", False)]
    c = spark.createDataFrame([("a",), ("b",), (None,)], "n string")
    k = spark.createDataFrame([("b",), ("c",), ("c",)], "n string")
    assert sorted(map(tuple, selection.completeness(c, k, "n").collect())) == [("a", "missing"), ("c", "extra")]
    assert {r["g"]: r["s"] for r in selection.common_source(spark.createDataFrame([(1, "a"), (1, ""), (2, None), (3, "a"), (3, "b")], "g int, s string"), "g", "s").collect()} == {1: "a", 2: "manual", 3: "mixed"}


def test_stars_link_all_of_a_key(spark):
    rows = [("hot", i) for i in range(200)] + [("b", 1000), ("b", 1001), ("one", 5000), (None, 7), (None, 8)]
    got = [tuple(r) for r in star_links(spark.createDataFrame(rows, "k string, v bigint"), "k", "v", salts=4).collect()]
    assert len(got) == 199 + 1 and {v for _, v in got} == set(range(1, 200)) | {1001}
