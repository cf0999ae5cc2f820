"""Job states and logs from streams of updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.jobs import sticky_status


def job_states(updates: DataFrame) -> DataFrame:
    """SS03 over a stream of (`job_id`, `seq`, `state`): the running state of each job; canceled stays.

    A streaming aggregation, so the state store holds four numbers a job.
    """
    return sticky_status(updates)


def read_updates(spark: SparkSession, path: str, schema: str = "job_id string, seq long, state string") -> DataFrame:
    """A stream of the JSON files that appear in a folder."""
    return spark.readStream.schema(schema).json(path)


def run_states(updates: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Work off what is there, in micro-batches, into an in-memory table; for polling clients (SS10)."""
    return job_states(updates).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest_events(events: DataFrame, keep: str = "1 day", late: str = "10 minutes", time_col: str = "ts") -> DataFrame:
    """SS10 on a stream: the last row of each (`job_id`, `id`) so far, given out again each time that it changes: `job_id`, `id`, `sequence`, `ts`, `message`, `version` (how often, from 1).

    `events`: `job_id` string, `id` string, `sequence` long, `ts` timestamp, `message` string. The last row is the one with the greatest sequence, then time, then message, whatever the order in which rows come, as in operators.events.keep_last(); repeats give nothing. A row
    a key is kept as state, until nothing has come for it for `keep` of event time (a timer); rows with a null id are a key of their own. Rows that come more than `late` behind are dropped. The session needs the state store of ROCKSDB
    (spark.sql.streaming.stateStore.providerClass).
    """
    from pyspark.sql.streaming import StatefulProcessor
    from pyspark.sql.types import StructType

    wait = F.expr(f"cast(interval {keep} as interval day to second)")
    millis = int(events.sparkSession.range(1).select((F.unix_millis(F.timestamp_seconds(F.lit(0)) + wait)).alias("ms")).first()["ms"])
    state = StructType.fromDDL("sequence long, ms long, message string, version long")

    class KeepLast(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.last = handle.getValueState("last", state)

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            held = self.last.get() if self.last.exists() else None
            best, latest = (tuple(held)[:3] if held else None), 0
            for frame in rows:
                times = frame["ts"].astype("datetime64[ms]").astype("int64")
                for sequence, ms, message in zip(frame["sequence"].tolist(), times.tolist(), frame["message"].tolist(), strict=True):
                    row = (int(sequence), int(ms), message or "")
                    latest = max(latest, row[1])
                    best = row if best is None or row > best else best
            changed = held is None or tuple(held)[:3] != best
            version = (tuple(held)[3] if held else 0) + changed
            self.last.update((*best, version))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(best[1], latest) + millis)
            if changed:
                yield pd.DataFrame({"job_id": [key[0]], "id": [key[1]], "sequence": [best[0]], "ts": [pd.Timestamp(best[1], unit="ms")], "message": [best[2]], "version": [version]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.last.clear()
            yield from ()

        def close(self):
            pass

    schema = StructType.fromDDL("job_id string, id string, sequence long, ts timestamp, message string, version long")
    rows = events.withWatermark(time_col, late).select("job_id", "id", F.coalesce("sequence", F.lit(0)).alias("sequence"), F.col(time_col).alias("ts"), "message")
    return rows.groupBy("job_id", "id").transformWithStateInPandas(KeepLast(), schema, "Update", "EventTime")


def run_latest(events: DataFrame, folder: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Work off what is there and append the changes of latest_events() to a Parquet folder, each micro-batch once: its files are named by its number."""

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return latest_events(events, **options).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, time_col: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and hour, final once the watermark has passed."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
