"""Readers, sinks and streaming forms on small files."""

import json

import pytest
from pyspark.sql import functions as F

from larder.sources import readers as R
from larder.sources import writers as W
from larder.streaming import logs as S


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_images_and_labels(spark, tmp_path):
    for f, t in (("train/images/a.JPG", "x"), ("train/images/b.png", "y"), ("train/labels/a.txt", "0 0.5 0.5 0.5 0.5\nbad"), ("train/images/n.gif", "z")):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text(t)
    got = R.list_images(spark, str(tmp_path), digest=True).collect()
    assert sorted(r["name"] for r in got) == ["a.JPG", "b.png"] and all(len(r["sha256"]) == 64 for r in got)
    assert R.list_images(spark, str(tmp_path / "none")).count() == 0
    s = {r["name"]: (len(r["boxes"]), r["raw_count"]) for r in R.read_label_pictures(spark, str(tmp_path)).collect()}
    assert s == {"a.JPG": (1, 1), "b.png": (0, 0)}


def test_catalogue_and_names(spark, tmp_path):
    (tmp_path / "p.csv").write_text("﻿class_name,display_name,price_vnd,reward_points,note\na,A,10000,,x\nb,B,900,7,\na,A2,12500,,\n", encoding="utf-8")
    assert rows(R.read_catalogue(spark, str(tmp_path / "p.csv"))) == [("a", "A2", 12500, 13, ""), ("b", "B", 900, 7, "")]
    (tmp_path / "c.json").write_text('["x", "y"]')
    assert rows(R.read_class_names(spark, str(tmp_path / "c.json"))) == [(0, "x"), (1, "y")]
    (tmp_path / "q.txt").write_text("# c\n\n pho \n")
    assert rows(R.read_queries(spark, str(tmp_path / "q.txt"))) == [("pho",)]
    assert R.read_rows(spark, str(tmp_path / "none.csv"), "a int").count() == 0


def test_regions(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"regions": [{"x": 1, "y": 2, "w": 3, "h": 4}, {"name": "n", "x": 1, "y": 2, "w": 3, "h": 4, "label": "l", "confidence": 0.12345678}]}))
    d = R.read_regions(spark, str(tmp_path / "r.json"))
    assert [r["name"] for r in d.orderBy("k").collect()] == ["crop_01", "n"]
    back = json.loads(R.regions_json(d).collect()[0][0])["regions"]
    assert "label" not in back[0] and back[1]["confidence"] == 0.123457 and back[0]["source"] == "template"


def test_coco_and_lines(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.jpg", "width": 100, "height": 100}, {"id": 2, "file_name": "b.jpg", "width": 10, "height": 10}], "annotations": [{"image_id": 1, "bbox": [20, 20, 80, 60]}, {"image_id": 1, "bbox": [0, 0, 0, 5]}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    got = R.read_coco(spark, str(tmp_path / "c.json")).collect()
    assert len(got) == 1 and got[0]["raw_count"] == 2 and [tuple(round(x, 3) for x in b) for b in got[0]["boxes"]] == [(0.6, 0.5, 0.8, 0.6)]
    (tmp_path / "l.txt").write_text("x/a.jpg 0,0,50,50,1 1,2,3 0,0,x,5,1\n\n")
    sizes = spark.createDataFrame([("a.jpg", 100, 100)], "name string, width int, height int")
    got = R.read_box_lines(spark, str(tmp_path / "l.txt"), sizes).collect()
    assert got[0]["raw_count"] == 2 and len(got[0]["boxes"]) == 1


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, None, "x"), (2, "b", "y")], "a int, b string, c string")
    W.write_report(d, str(tmp_path / "r"), ["b", "a", "zz"])
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "r")).na.fill("")) == [("", "1", ""), ("b", "2", "")]
    W.write_cache(d, str(tmp_path / "k"), "a")
    W.append_log(d, str(tmp_path / "k"))
    assert spark.read.parquet(str(tmp_path / "k")).count() == 4
    c = spark.createDataFrame([("s", "x", 1), ("s", None, 2)], "d string, v string, n int")
    assert json.loads(W.summary_document(c, "d", "v", "n").collect()[0][0]) == {"s": {"none": 2, "x": 1}}


@pytest.fixture
def stream(spark, tmp_path):
    src = tmp_path / "src"
    schema = "key string, account string, delta int, at timestamp"

    def feed(data):
        spark.createDataFrame(data, "key string, account string, delta int, s string").withColumn("at", F.to_timestamp("s")).drop("s").coalesce(1).write.mode("append").parquet(str(src))

    feed([("k1", "a", 5, "2024-01-01 10:00:00"), ("k1", "a", 5, "2024-01-01 10:00:00"), ("k2", "b", 1, "2024-01-01 11:00:00"), (None, "b", 9, "2024-01-01 11:00:00")])
    return S.new_files_stream(spark, str(src), schema), feed, tmp_path


def run(df, sink, mode, checkpoint):
    q = df.writeStream.outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True)
    (q.foreachBatch(sink) if callable(sink) else q.format("memory").queryName(sink)).start().awaitTermination()


def test_apply_once_is_idempotent(spark, stream):
    df, feed, tmp = stream
    out = str(tmp / "out")
    run(df, S.apply_once(out, "key"), "append", tmp / "c1")
    feed([("k1", "a", 5, "2023-01-01 10:00:00"), ("k3", "a", -2, "2023-01-01 10:00:00")])
    run(df, S.apply_once(out, "key"), "append", tmp / "c1")
    run(df, S.apply_once(out, "key"), "append", tmp / "c2")  # all over again
    got = spark.read.parquet(out)
    assert sorted(r["key"] for r in got.collect()) == ["k1", "k2", "k3"]


def test_streaming_states(spark, stream):
    df, feed, tmp = stream
    run(S.first_of_key_stream(df, "key", "at"), "firsts", "append", tmp / "f")
    assert spark.table("firsts").where("key = 'k1'").count() == 1
    run(S.balances_stream(df, "account", "delta"), "balances", "complete", tmp / "b")
    assert rows(spark.table("balances")) == [("a", 2, 10), ("b", 2, 10)]
    run(S.latest_stream(df, "account", "at", "delta"), "latest", "complete", tmp / "l")
    assert {r["account"]: r["delta"] for r in spark.table("latest").collect()} == {"a": 5, "b": 9}
    feed([("k9", "z", 1, "2024-01-05 00:00:00")])
    run(S.daily_counts_stream(df, "at", "account"), "days", "append", tmp / "d")
    assert {r["account"]: r["n"] for r in spark.table("days").collect()} == {"a": 2, "b": 2}
