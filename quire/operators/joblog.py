"""The log of a job from four sources: its status, the steps of its workflow, the progress of its chunks, and its artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.events import ARTIFACT, CHUNK, JOB, WORKFLOW, event_id, merge_events

# Titles of steps and of states; how a step's title goes on by its status; artifacts and details that are told, and their length.
STEP_TITLES = {
    "read_input": "Read input", "analyze_intent": "Analyze intent", "semantic_recognize": "Recognize document semantics", "build_plan": "Build layout plan", "validate_plan": "Validate layout plan",
    "translate": "Translate chunks", "render": "Render preview", "evaluate_render": "Evaluate rendered layout", "repair": "Repair layout plan", "export_pdf": "Export PDF", "complete": "Complete workflow", "fail": "Workflow failed",
}
JOB_TITLES = {
    "queued": "Job queued", "parsing": "Parsing input", "translating": "Translating content", "rendering": "Rendering output", "completed": "Job completed", "failed": "Job failed", "canceled": "Job canceled",
}
STEP_ENDS = {"running": " started", "completed": " completed", "repaired": " repaired", "failed": " failed", "skipped": " skipped"}
MOST_ARTIFACTS, MOST_LISTED, LENGTH = 12, 6, 240
COLUMNS = ("job_id", "id", "sequence", "source", "level", "phase", "title", "message", "progress", "details")


def _of(table: dict[str, str], key: Column, other: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), other)


def _level(status: Column, error: Column | None = None, warnings: tuple[str, ...] = ("canceled",)) -> Column:
    bad = status == "failed" if error is None else (status == "failed") | (F.coalesce(error, F.lit("")) != "")
    return F.when(bad, "error").when(status == "completed", "success").when(status.isin(*warnings), "warning").otherwise("info")


def _details(values: Column) -> Column:
    """Texts squeezed, without empty ones, LENGTH characters each at the most."""
    squeezed = F.transform(F.filter(values, lambda x: x.isNotNull()), lambda x: F.substring(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), 1, LENGTH))
    return F.filter(squeezed, lambda x: x != "")


def _message(error: Column, message: Column) -> Column:
    return F.when(F.coalesce(error, F.lit("")) != "", error).otherwise(F.coalesce(message, F.lit("")))


def _four(progress: Column) -> Column:
    return F.format_string("%.4f", progress)


def job_event(jobs: DataFrame) -> DataFrame:
    """The state of each job: sequence 10."""
    j = F.col
    told = _message(j("error"), j("message"))
    number = event_id(j("job_id"), F.lit("job"), j("status"), _four(j("progress")), j("message"), j("error"))
    details = _details(F.array(F.concat(F.lit("File: "), "filename"), F.when(F.coalesce("target_lang", F.lit("")) != "", F.concat(F.lit("Target: "), "target_lang"))))
    return jobs.select("job_id", number.alias("id"), F.lit(JOB).cast("long").alias("sequence"), F.lit("job").alias("source"), _level(j("status")).alias("level"), j("status").alias("phase"), _of(JOB_TITLES, j("status"), F.lit("Job status")).alias("title"), told.alias("message"), j("progress").cast("double").alias("progress"), details.alias("details"))


def step_events(steps: DataFrame) -> DataFrame:
    """Steps (`job_id`, `n` from 0, `step_id`, `name`, `status`, `message`, `error`, `progress`, `inputs`, `outputs`, `flags`): sequence 100 + 100 n."""
    s = F.col
    name, status = F.when(F.coalesce("name", F.lit("")) != "", s("name")).otherwise("workflow"), F.when(F.coalesce("status", F.lit("")) != "", s("status")).otherwise("running")
    title = _of(STEP_TITLES, name, F.initcap(F.replace(name, F.lit("_"), F.lit(" "))))
    message = F.when(F.coalesce("message", F.lit("")) != "", s("message")).otherwise(_of(STEP_TITLES, name, name))
    number = event_id(s("job_id"), F.lit("workflow"), F.when(F.coalesce("step_id", F.lit("")) != "", s("step_id")).otherwise(s("n").cast("string")), name, status, message, s("error"))
    listed = lambda c, head: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(F.slice(c, 1, MOST_LISTED), ", ")))
    details = _details(F.array(listed("inputs", "Inputs: "), listed("outputs", "Outputs: "), listed("flags", "Flags: ")))
    progress = F.greatest(F.lit(0.0), F.least(F.lit(1.0), s("progress").cast("double")))
    return steps.select(
        "job_id", number.alias("id"), (F.lit(WORKFLOW) + s("n") * 100).cast("long").alias("sequence"), F.lit("workflow").alias("source"), _level(status, s("error"), ("skipped", "repaired")).alias("level"), name.alias("phase"),
        F.concat(title, _of(STEP_ENDS, status, F.lit(""))).alias("title"), _message(s("error"), message).alias("message"), F.when(s("progress").isNotNull(), progress).alias("progress"), details.alias("details"),
    )


def chunk_events(chunks: DataFrame, steps: DataFrame) -> DataFrame:
    """Chunks (`job_id`, `chunk_id`, `index`, `total`, `status`, `message`, `error`, `progress`, `flags`): behind the first step of translation, or 600, by their index."""
    c = F.col
    first = steps.where("phase = 'translate'").groupBy("job_id").agg(F.min("sequence").alias("_base"))
    status = F.when(F.coalesce("status", F.lit("")) != "", c("status")).otherwise("queued")
    told = _message(c("error"), c("message"))
    number = event_id(c("job_id"), F.lit("chunk"), c("chunk_id"), status, _four(c("progress")), told)
    return chunks.join(first, "job_id", "left").select(
        "job_id", number.alias("id"), (F.coalesce("_base", F.lit(CHUNK)) + 1 + c("index")).cast("long").alias("sequence"), F.lit("chunk").alias("source"), _level(status, c("error")).alias("level"), F.lit("translate").alias("phase"),
        F.concat(F.lit("Chunk "), c("index").cast("string"), F.lit("/"), c("total").cast("string"), F.lit(": "), status).alias("title"), told.alias("message"), c("progress").cast("double").alias("progress"), _details(F.coalesce("flags", F.array().cast("array<string>"))).alias("details"),
    )


def artifact_event(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One event for the artifacts (`doc_id`, `rank`, `name`) of each job's document: sequence 9000."""
    held = artifacts.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("rank", "name"))).alias("_a"))
    rows = jobs.join(held, "doc_id").withColumn("_names", F.transform("_a", lambda x: x["name"]))
    number = F.concat("job_id", F.lit(":"), F.substring(F.sha1(F.concat_ws("\x1f", "job_id", F.lit("artifact"), "_names").cast("binary")), 1, 16))
    return rows.select(
        "job_id", number.alias("id"), F.lit(ARTIFACT).cast("long").alias("sequence"), F.lit("artifact").alias("source"), F.when(F.col("status") == "completed", "success").otherwise("info").alias("level"), F.lit("artifacts").alias("phase"),
        F.lit("Artifacts updated").alias("title"), F.concat(F.size("_names").cast("string"), F.lit(" debug artifact(s) available")).alias("message"), F.col("progress").cast("double").alias("progress"), F.slice("_names", 1, MOST_ARTIFACTS).alias("details"),
    )


def job_logs(jobs: DataFrame, workflows: DataFrame, chunks: DataFrame, progress: DataFrame, artifacts: DataFrame, limit: int = 80) -> DataFrame:
    """The log of each job (COLUMNS) from four sources, by precedence.

    `jobs`: `job_id`, `doc_id`, `status`, `progress`, `message`, `error`, `filename`, `target_lang`. `workflows`: steps by `doc_id` with the `workflow_job` that they were run for (null: any), see step_events(). A workflow of another job
    is stale: then neither its steps, nor the document's chunks, nor its artifacts are the job's. Chunks are the job's own (`chunks`, by `job_id`) or, where it has none, what is known of its document (`progress`, by `doc_id`). Repeated ids keep the first by sequence; the last `limit` by (sequence, id)
    stay (0: all), as the log is a tail.
    """
    owned = workflows.join(jobs.select("job_id", "doc_id"), "doc_id")
    fits = F.coalesce("workflow_job", F.lit("")).isin("") | (F.col("workflow_job") == F.col("job_id"))
    stale = owned.where(~fits).select("job_id").distinct()
    steps = step_events(owned.where(fits).join(stale, "job_id", "left_anti"))
    fresh = jobs.join(stale, "job_id", "left_anti")
    own = chunks.select("job_id").distinct()
    columns = ["job_id", "chunk_id", "index", "total", "status", "message", "error", "progress", "flags"]
    of_docs = progress.join(fresh.join(own, "job_id", "left_anti").select("job_id", "doc_id"), "doc_id").select(*columns)
    told = chunk_events(chunks.select(*columns).unionByName(of_docs), steps)
    return merge_events([x.select(*COLUMNS) for x in (job_event(jobs), steps, told, artifact_event(fresh, artifacts))], "job_id", limit)


