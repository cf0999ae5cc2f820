"""Jobs and workflow steps as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("queued", "parsing", "translating", "rendering", "completed", "failed", "canceled")
RESUMABLE = ("queued", "parsing", "translating", "rendering")
FINAL = ("completed", "failed", "canceled")


def sticky_status(updates: DataFrame, sticky: str = "canceled") -> DataFrame:
    """SS03: the state of each job from its updates (`job_id`, `seq`, `state`): the last one, unless it was canceled before: then that stays.

    An aggregation, so a job with very many updates is combined before the shuffle.
    """
    cut = F.min(F.when(F.col("state") == sticky, F.col("seq")))
    both = updates.groupBy("job_id").agg(cut.alias("_cut"), F.max_by("state", "seq").alias("_last"), F.max("seq").alias("_seq"), F.count(F.lit(1)).alias("n_updates"))
    return both.select("job_id", F.when(F.col("_cut").isNotNull(), sticky).otherwise(F.col("_last")).alias("state"), F.coalesce("_cut", "_seq").alias("seq"), "n_updates")


def matching_workflow(jobs: DataFrame, workflows: DataFrame) -> DataFrame:
    """Jobs (`job_id`, `doc_id`) with the workflow of their document; `stale` if that belongs to another job."""
    side = workflows.select("doc_id", F.col("job_id").alias("_job"), F.lit(True).alias("_has"), "payload")
    out = jobs.join(side, "doc_id", "left")
    mine = F.coalesce(F.col("_job") == F.col("job_id"), F.lit(True))
    return out.select("job_id", "doc_id", F.when(mine, F.col("payload")).alias("payload"), (F.coalesce("_has", F.lit(False)) & ~mine).alias("stale"))


def resume_actions(jobs: DataFrame, uploads: DataFrame, artifacts: DataFrame) -> DataFrame:
    """What to do with unfinished jobs that have a document: continue, restart (the upload is there) or fail.

    `artifacts`: (`doc_id`, `name`). A job continues if it was translating or rendering and both its document (`document-ir`) and its
    `translation-chunks` are there.
    """
    out = jobs.where(F.col("state").isin(*RESUMABLE) & F.col("doc_id").isNotNull() & (F.col("doc_id").cast("string") != ""))
    made = artifacts.groupBy("doc_id").agg(F.bool_or(F.col("name") == "document-ir").alias("_ir"), F.bool_or(F.col("name") == "translation-chunks").alias("_chunks"))
    out = out.join(uploads.select("doc_id").distinct().withColumn("_up", F.lit(True)), "doc_id", "left").join(made, "doc_id", "left")
    goes_on = F.col("state").isin("translating", "rendering") & F.col("_ir") & F.col("_chunks")
    return out.select("job_id", "doc_id", "state", F.when(goes_on, "continue").when(F.col("_up"), "restart").otherwise("fail").alias("action"))


def guard(commands: DataFrame, jobs: DataFrame) -> DataFrame:
    """SS08: commands (`job_id`, `command`) with the code they get: 404 unknown job, 409 wrong state, 400 unknown command, else 200."""
    out = commands.join(jobs.select("job_id", "state"), "job_id", "left")
    wrong = F.when(F.col("command") == "cancel", F.col("state").isin(*FINAL)).when(F.col("command") == "retry", ~F.col("state").isin("failed", "canceled")).when(F.col("command").isin("continue", "retypeset"), F.col("state") != "completed")
    return out.select("job_id", "command", F.when(F.col("state").isNull(), 404).when(~F.col("command").isin("cancel", "retry", "continue", "retypeset"), 400).when(wrong, 409).otherwise(200).alias("code"))


def current_steps(steps: DataFrame) -> DataFrame:
    """SS06: the last step of each workflow (`workflow_id`, `pos`), and how many steps and attempts there were (AG08)."""
    return steps.groupBy("workflow_id").agg(F.max_by(F.struct("name", "status"), "pos").alias("last"), F.count(F.lit(1)).alias("n_steps"), F.count_if(F.col("status") == "failed").alias("n_failed")).select("workflow_id", "last.*", "n_steps", "n_failed")


def catalogue(files: DataFrame, specs: list[tuple[str, str]]) -> DataFrame:
    """IO18: every artifact that a document may have (`specs`: names and file names), and whether its file (`doc_id`, `filename`) exists."""
    every = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(f).alias("filename")) for n, f in specs]))
    docs = files.select("doc_id").distinct().select("doc_id", every.alias("x")).select("doc_id", "x.*")
    return docs.join(files.select("doc_id", "filename", F.lit(True).alias("_has")).distinct(), ["doc_id", "filename"], "left").select("doc_id", "name", "filename", F.coalesce("_has", F.lit(False)).alias("available"))
