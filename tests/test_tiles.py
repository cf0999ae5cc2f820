"""Joins of boxes by tiles against all pairs, and a page of very many boxes."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.operators import layout

ITEM = "doc_id int, page_id int, item_id string, block_id string, asset_id string, candidate_id string, ord int, kind string, box struct<x0:double,y0:double,x1:double,y1:double>"


def boxes(spark):
    draw, rows = random.Random(1), []
    for i in range(220):
        far = draw.choice([0, 0, 0, -2000, 5000])
        x, y = draw.uniform(-20, 600) + far, draw.uniform(-20, 800) + far
        w, h = draw.choice([0, 5, 60, 128, 400]), draw.choice([0, 5, 64, 300])
        rows.append((0, i % 2, f"i{i}", f"i{i}", f"i{i}", f"i{i}", i, draw.choice(["text", "figure", "table"]), (x, y, x + w, y + h)))
    rows.append((0, 0, "none", "none", "none", "none", 999, "figure", None))
    return rows, spark.createDataFrame(rows, ITEM)


def shared(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    small = min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
    return max(w, 0) * max(h, 0) / small if small > 0 else 0.0


def test_overlaps_and_best(spark):
    rows, df = boxes(spark)
    rows = [r for r in rows if r[-1]]
    got = {(r["first_id"], r["second_id"]) for r in layout.overlaps(df).collect()}
    want = {(a[2], b[2]) for a in rows for b in rows if a[1] == b[1] and a[6] < b[6] and shared(a[-1], b[-1]) >= 0.12}
    assert got == want and len(layout.overlaps(df).collect()) == len(want) > 50
    best = {r["candidate_id"]: r["asset_id"] for r in layout.best_asset(df.where("kind = 'text'"), df.where("kind <> 'text'")).collect()}
    for a in rows:
        if a[7] == "text":
            hits = [(-shared(a[-1], b[-1]), b[2]) for b in rows if b[7] != "text" and a[1] == b[1] and shared(a[-1], b[-1]) >= 0.6]
            assert best.get(a[2]) == (min(hits)[1] if hits else None)


def test_near_assets(spark):
    df = boxes(spark)[1]
    got = {r["item_id"] for r in layout.near_assets(df.where("kind = 'text'"), df).collect()}

    a, b = df.where("kind = 'text'").alias("a"), df.where("kind <> 'text' AND box IS NOT NULL").alias("b")
    near = (g.vertical_distance(F.col("b.box"), F.col("a.box")) <= 90.0) & (g.horizontal_overlap(F.col("b.box"), F.col("a.box")) >= 0.35)
    assert got == {r["item_id"] for r in a.join(b, (F.col("a.page_id") == F.col("b.page_id")) & near, "left_semi").collect()} and got
    with pytest.raises(ValueError):
        layout.overlaps(df, 0.0)


def test_a_page_of_very_many_boxes(spark):
    n = F.col("id")
    x, y = (n * 7919 % 30_000 / 10).cast("double"), (n * 104_729 % 30_000 / 10).cast("double")
    box = F.struct(x.alias("x0"), y.alias("y0"), (x + 8).alias("x1"), (y + 8).alias("y1"))
    page = spark.range(50_000).select(F.lit(0).alias("doc_id"), F.lit(0).alias("page_id"), n.alias("item_id"), n.alias("ord"), box.alias("box"))
    began = time.perf_counter()
    pairs = layout.overlaps(page).count()
    assert pairs > 10_000 and time.perf_counter() - began < 60  # all pairs would be 1.25 billion comparisons


def test_the_tiles_of_a_page_are_shuffled_once(spark):
    """Both sides of the join of overlaps() are the same table, so its exchange is used again."""
    df = spark.createDataFrame([("d", "p", f"i{i}", f"i{i}", (10.0 * i, 0.0, 10.0 * i + 15, 20.0)) for i in range(6)], "doc_id string, page_id string, item_id string, ord string, box struct<x0:double,y0:double,x1:double,y1:double>")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = layout.overlaps(df)
        assert sorted((r["first_id"], r["second_id"]) for r in out.collect()) == [(f"i{i}", f"i{i + 1}") for i in range(5)]
        assert "Reused" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
