"""Sums over diagnostics, and rows without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Providers that look at pictures.
VISUAL = ("pix2text", "openai_vision", "minimax_vision")


def performance(candidates: DataFrame, records: DataFrame, attempts: DataFrame, visual: tuple[str, ...] = VISUAL) -> DataFrame:
    """AG09, DT02: a row per document of timings and counts, milliseconds to 2 digits.

    `candidates`: (`doc_id`, `text_ms`, `validation_ms`, `crop_ms`, `cropped`); `records`: (`doc_id`, `status`); `attempts`: (`doc_id`, `provider`, `elapsed_ms`, `flags`).
    `visual_ms_by_provider` is a map of the visual providers that were asked.
    """
    ms = lambda c: F.bround(F.sum(F.coalesce(c, F.lit(0.0))), 2)
    base = candidates.groupBy("doc_id").agg(F.count(F.lit(1)).alias("candidate_count"), F.count_if("cropped").alias("crop_count"), *[ms(c).alias(c) for c in ("text_ms", "validation_ms", "crop_ms")])
    hits = records.groupBy("doc_id").agg(F.count_if(F.col("status") == "cache_hit").alias("cache_hit_count"))
    seen = F.col("provider").isin(*visual)
    by = attempts.groupBy("doc_id", "provider").agg(F.count_if(seen).alias("n"), F.count_if(F.array_contains("flags", "ocr_visual_candidate_limit_reached")).alias("skipped"), ms(F.when(seen, F.col("elapsed_ms"))).alias("ms"))
    asked = by.groupBy("doc_id").agg(
        F.sum("n").alias("visual_attempt_count"),
        F.sum("skipped").alias("skipped_visual_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(seen, F.struct("provider", "ms"))))).alias("visual_ms_by_provider"),
    )
    out = base.join(hits, "doc_id", "left").join(asked, "doc_id", "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("cache_hit_count", "visual_attempt_count", "skipped_visual_count")}
    return out.withColumns(counts).withColumn("visual_ms_by_provider", F.coalesce("visual_ms_by_provider", F.create_map().cast("map<string,double>")))


# Counters of formula troubles that a page's diagnostics have.
FORMULA_COUNTERS = ("unresolved_count", "raw_tex_unrendered_count", "browser_katex_failed_count", "katex_error_count")
#: Points in a CSS pixel.
POINTS = 0.75


def validation(diagnostics: DataFrame) -> DataFrame:
    """AG19: whether rendered pages passed: `doc_id`, `status`, and the counts of overflowing blocks, figure troubles and formula troubles. Null counters are 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    formula = sum((zero(c) for c in FORMULA_COUNTERS[1:]), zero(FORMULA_COUNTERS[0]))
    out = diagnostics.select("doc_id", zero("block_overflow_count").alias("block_overflow_count"), zero("figure_group_issue_count").alias("figure_group_issue_count"), formula.alias("formula_issue_count"))
    bad = F.col("block_overflow_count") + F.col("figure_group_issue_count") + F.col("formula_issue_count")
    return out.withColumn("status", F.when(bad == 0, "passed").otherwise("failed"))


def in_points(measures: DataFrame, *columns: str) -> DataFrame:
    """AG19: measures in CSS pixels (`..._px`) as points (`..._pt`), to 4 digits."""
    for c in columns:
        measures = measures.withColumn(c.removesuffix("_px") + "_pt", F.bround(F.col(c) * POINTS, 4)).drop(c)
    return measures


def first_rows(rows: DataFrame, order: list[str], key: list[str] | None = None) -> DataFrame:
    """SO02: the first row, by `order`, of those with the same `key` (default: all other columns); null keys are keys like any other."""
    key = [c for c in rows.columns if c not in order] if key is None else key
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")
