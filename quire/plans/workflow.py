"""A workflow over many documents at once: nodes, routes between them, a bounded repair loop, and a log of steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The nodes of the typesetting workflow and where each leads; a name or, by condition, one of several.
START, END = "read_input", "end"


def edges(max_repairs: int = 2) -> dict[str, Column | str]:
    """SS04: the next node after each: columns over the state (`error`, `has_plans`, `translates`, `repair_recommended`, `attempt`)."""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    return {
        "read_input": F.when(failed, END).otherwise("analyze_intent"),
        "analyze_intent": "semantic_recognize",
        "semantic_recognize": "build_layout_plan",
        "build_layout_plan": "validate_layout_plan",
        "validate_layout_plan": F.when(failed, "fail").when(true("has_plans"), "render_preview").when(true("translates"), "translate_chunks").otherwise("build_source_plans"),
        "build_source_plans": "render_preview",
        "translate_chunks": "render_preview",
        "render_preview": "evaluate_render",
        "evaluate_render": F.when(failed, "fail").when(true("repair_recommended") & (F.col("attempt") < max_repairs), "repair_layout_plan").otherwise("export_pdf"),
        "repair_layout_plan": "validate_layout_plan",
        "export_pdf": "complete",
        "complete": END,
        "fail": END,
    }


def run(documents: DataFrame, nodes: dict[str, Callable[[DataFrame], DataFrame]], write: Callable[[DataFrame, str], DataFrame], max_repairs: int = 2) -> tuple[DataFrame, DataFrame]:
    """SS04, SS05: all documents (`doc_id` and any columns) through the workflow; the final states and the steps (`doc_id`, `step` from 0, `node`, `attempt`, `error`).

    `nodes`: what a node does to the states that stand at it (by name; a missing one does nothing). A document moves one node a round, all documents of a node
    together; repair_layout_plan counts an `attempt`. `write(df, name)` writes a table and reads it back: each round is written once and starts from what the one before wrote, so the
    workflow goes on after a lost executor, and a new driver could go on from the last table. Documents at the end are not carried on: the final states are read from the rounds in which they ended.
    The rounds are bounded by the graph and `max_repairs`.
    """
    to = edges(max_repairs)
    state = documents
    for name, kind, value in (("error", "string", None), ("has_plans", "boolean", False), ("translates", "boolean", False), ("repair_recommended", "boolean", False)):
        if name not in state.columns:
            state = state.withColumn(name, F.lit(value).cast(kind))
    columns = [*state.columns, "node", "attempt"]
    state = write(state.withColumns({"node": F.lit(START), "attempt": F.lit(0)}), "round0")
    steps = state.select("doc_id", F.lit(0).alias("step"), "node", "attempt", "error").where(F.lit(False))
    final = state.where(F.lit(False))
    for turn in range(len(to) + 5 * max_repairs + 1):
        here = [r["node"] for r in state.select("node").distinct().collect()]
        if not here:
            break
        working = [node for node in sorted(here) if node in nodes]
        moved = state.where(~F.col("node").isin(*working)) if working else state
        moved = moved.withColumn("attempt", F.col("attempt") + (F.col("node") == "repair_layout_plan").cast("int")).select(*columns)
        for node in working:
            rows = state.where(F.col("node") == node)
            if node == "repair_layout_plan":
                rows = rows.withColumn("attempt", F.col("attempt") + 1)
            moved = moved.unionByName(nodes[node](rows).select(*columns))
        moved = write(moved, f"step{turn}")
        steps = steps.unionByName(moved.select("doc_id", F.lit(turn).alias("step"), "node", "attempt", "error"))
        following = F.lit(END)
        for node in here:
            value = to[node]
            following = F.when(F.col("node") == node, F.lit(value) if isinstance(value, str) else value).otherwise(following)
        routed = moved.withColumn("node", following)
        final = final.unionByName(routed.where(F.col("node") == END))
        state = routed.where(F.col("node") != END)
    else:
        final = final.unionByName(state)
    return final, steps


def failures_kept(rows: DataFrame, work: Callable[[list[str]], list[str]], text: str = "text") -> DataFrame:
    """SS02: `result` and `failure` of `work` over the texts of each Arrow batch; where a batch fails its texts are tried one by one, so one bad text costs only itself."""

    @F.pandas_udf("struct<result:string,failure:string>")
    def attempt(texts):
        import pandas as pd

        def one(some):
            try:
                return [(r, None) for r in work(some)]
            except Exception as e:  # the row says what happened; the caller decides
                return None if len(some) > 1 else [(None, f"{type(e).__name__}: {e}"[:300])]

        some = texts.tolist()
        out = one(some) or [x for t in some for x in one([t])]
        return pd.DataFrame(out, columns=["result", "failure"])

    return rows.withColumn("_x", attempt(F.col(text))).select("*", "_x.result", "_x.failure").drop("_x")
