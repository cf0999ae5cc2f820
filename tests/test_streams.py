"""Streams against the same rows as a table."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quire.operators.events import keep_last
from quire.streaming import jobs

EVENT = "job_id string, id string, sequence long, ts timestamp, message string"


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, jobs.ROCKSDB)
    yield spark
    spark.conf.set(key, before)


def event(job, i, sequence, minute, message):
    return {"job_id": job, "id": i, "sequence": sequence, "ts": f"2026-01-01T{minute // 60:02d}:{minute % 60:02d}:00", "message": message}


def run(spark, folder, batches, **options):
    (folder / "in").mkdir()
    for n, rows in enumerate(batches):
        (folder / "in" / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
        read = spark.readStream.schema(EVENT).json(str(folder / "in"))
        jobs.run_latest(read, str(folder / "out"), str(folder / "ck"), **options).awaitTermination(120)
    return spark.read.parquet(str(folder / "out"))


def test_a_stream_keeps_the_last_as_a_table_does(rocksdb, tmp_path):
    draw = random.Random(1)
    rows = [event(draw.choice("ab"), draw.choice(["x", "y", "z", None]), draw.randrange(6), draw.randrange(8), draw.choice("pqr")) for _ in range(40)]
    batches = [rows[:15], rows[10:30], rows[30:], rows[:5]]  # repeats, late ones, and older ones behind newer ones
    out = run(rocksdb, tmp_path, batches)
    latest = keep_last(out, ["job_id", "id"], ["version"])
    table = rocksdb.createDataFrame([json.dumps(r) for r in rows], "string").select(F.from_json("value", EVENT).alias("e")).select("e.*")
    want = keep_last(table, ["job_id", "id"], ["sequence", "ts", "message"])
    told = lambda df: sorted(map(str, df.select("job_id", "id", "sequence", "ts", "message").collect()))
    assert told(latest) == told(want)
    versions = out.groupBy("job_id", "id").agg(F.max("version").alias("v"), F.count("*").alias("n")).collect()
    assert all(r["v"] == r["n"] for r in versions)  # each change once, in order; repeats give nothing


def test_state_goes_by_a_timer(rocksdb, tmp_path):
    batches = [[event("a", "x", 5, 0, "old")], [event("a", "y", 1, 300, "later")], [event("a", "z", 1, 301, "more")], [event("a", "x", 1, 302, "new")]]
    out = run(rocksdb, tmp_path, batches, keep="1 hour", late="5 minutes")
    assert {(r["id"], r["message"], r["version"]) for r in out.collect()} == {("x", "old", 1), ("y", "later", 1), ("z", "more", 1), ("x", "new", 1)}
