"""Job logs: events from several sources, merged, without repeats, the last ones first to keep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Where the sources stand in a log.
JOB, WORKFLOW, CHUNK, ARTIFACT = 10, 100, 600, 9000


def event_id(job, *parts):
    """HS02: job id and 16 digits of the SHA-1 of job id and parts, with unit separators between."""
    raw = F.concat_ws("\x1f", job, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(job, F.lit(":"), F.substring(F.sha1(raw.cast("binary")), 1, 16))


def level(state, error=None):
    """The level of an event: error, success, warning or info."""
    bad = state == "failed"
    if error is not None:
        bad = bad | (F.coalesce(error, F.lit("")) != "")
    return F.when(bad, "error").when(state == "completed", "success").when(state.isin("canceled", "skipped", "repaired"), "warning").otherwise("info")


def merge_events(sources: list[DataFrame], key: str, limit: int = 80) -> DataFrame:
    """One log per `key` from sources of (key, `id`, `sequence`, ...): repeated ids keep the first by sequence, and the last `limit` by (sequence, id) stay.

    The limit is the feature: a log's tail. 0 keeps all. Rows are dealt out by key once, which serves both windows.
    """
    both = reduce(DataFrame.unionByName, sources)
    both = both.repartition(key) if limit > 0 else both
    rest = [c for c in both.columns if c not in (key, "id", "sequence")]
    first = W.partitionBy(key, "id").orderBy("sequence", *rest)
    once = both.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    if limit <= 0:
        return once
    return once.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(F.desc("sequence"), F.desc("id")))).where(F.col("_k") <= limit).drop("_k")


def workflow_events(steps: DataFrame) -> DataFrame:
    """Events of workflow steps (`job_id`, `step` from 0, `name`, `status`, `message`, `error`): sequence 100 + 100 step."""
    return steps.select("job_id", event_id(F.col("job_id"), F.lit("workflow"), F.col("step"), F.col("name"), F.col("status"), F.col("message"), F.col("error")).alias("id"), (F.lit(WORKFLOW) + F.col("step") * 100).cast("long").alias("sequence"), F.lit("workflow").alias("source"), level(F.col("status"), F.col("error")).alias("level"), F.col("name").alias("phase"), F.coalesce("error", "message").alias("message"))


def chunk_events(chunks: DataFrame, translate: DataFrame | None = None) -> DataFrame:
    """Events of chunks (`job_id`, `chunk_id`, `index`, `total`, `status`, `message`): one past the translate step's sequence (`job_id`, `sequence`), or 600, and the index."""
    rows = chunks
    if translate is not None:
        rows = rows.join(translate.select("job_id", F.col("sequence").alias("_base")), "job_id", "left")
    else:
        rows = rows.withColumn("_base", F.lit(None).cast("long"))
    base = F.coalesce("_base", F.lit(CHUNK)) + 1
    return rows.select("job_id", event_id(F.col("job_id"), F.lit("chunk"), F.col("chunk_id"), F.col("status"), F.col("message")).alias("id"), (base + F.col("index")).cast("long").alias("sequence"), F.lit("chunk").alias("source"), level(F.col("status")).alias("level"), F.lit("translate").alias("phase"), F.concat(F.lit("Chunk "), "index", F.lit("/"), "total", F.lit(": "), "status").alias("message"))


def keep_last(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """SS10: the last row of each key by `order`."""
    w = W.partitionBy(*key).orderBy(*[F.desc(o) for o in order])
    return events.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def log_tail(lines: DataFrame, key: str, order: str, text: str, limit: int = 9000) -> DataFrame:
    """SL03: rows until `limit` characters have been passed: a row stays if those before it are below the limit."""
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return lines.where(F.length(text) >= 0).withColumn("_before", F.coalesce(F.sum(F.length(text) + 1).over(before), F.lit(0))).where(F.col("_before") < limit).drop("_before")
