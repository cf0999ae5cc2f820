"""Translation by a model that may answer badly: segments and batches, attempts, repair, language check, one revision, fallback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.fence import fenced
from quire.functions.model_answers import first_object
from quire.functions.predicates import chinese_target, reviewable, untranslated
from quire.functions.text import TOKEN, remove_tokens
from quire.plans.repair import repaired
from quire.plans.translation import deterministic, quality_issues
from quire.scratch import free, store

CHUNK = ["doc_id", "chunk_no"]
KEYS = [*CHUNK, "pos"]
ANSWER = "blocks array<struct<pos:int,translated_text:string,role:string,render_intent:string,inline_items:array<struct<kind:string,text:string>>,quality_flags:array<string>>>"
#: A model: prompts and the number of the attempt, to answers (None for none), called for each Arrow batch of prompts.
Model = Callable[[list[str], int], list[str | None]]
REVISED, REVISION_FAILED = "translation_quality_revised", "translation_quality_revision_failed"


# --- segments -----------------------------------------------------------------------------------------------


def segments(sources: DataFrame, most: int) -> DataFrame:
    """Block texts in segments: KEYS, `seg` from 0, `text`, `kept` (not to be translated): put together in order they are the text again.

    Tokens (references, citations, formulas) are kept, and so are blocks that need no translation, whole. Text between tokens is cut behind white space into segments of `most` characters at
    the most, or at `most` characters where there is none.
    """
    text = F.coalesce("text", F.lit(""))
    wanted = F.coalesce("requires_translation", F.lit(True))
    between, tokens = F.split(text, TOKEN, -1), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    pattern = rf"(?s).{{1,{most}}}\z|.{{0,{most - 1}}}\s|.{{1,{most}}}"
    piece = lambda t, kept: F.struct(t.alias("text"), F.lit(kept).alias("kept"))
    cut = lambda t: F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda x: piece(x, False))
    each = F.flatten(F.transform(between, lambda t, i: F.concat(cut(t), F.when(i < F.size(tokens), F.array(piece(F.get(tokens, i), True))).otherwise(F.array().cast("array<struct<text:string,kept:boolean>>")))))
    whole = F.when(text == "", F.array().cast("array<struct<text:string,kept:boolean>>")).otherwise(F.array(piece(text, True)))
    return sources.select(*KEYS, F.posexplode(F.when(wanted, each).otherwise(whole)).alias("seg", "x")).select(*KEYS, "seg", "x.text", "x.kept")


def batches(parts: DataFrame, budget: int) -> DataFrame:
    """Adds `batch` to segments that are to be translated (null for kept ones): consecutive ones of a document, `budget` characters at the most; segments have to have half of it at the most.

    A running sum over the segments before gives the batch: one begins with each half budget, and its last segment takes it over that by half a budget at the most.
    """
    before = W.partitionBy("doc_id").orderBy("chunk_no", "pos", "seg").rowsBetween(W.unboundedPreceding, -1)
    size = F.when(F.col("kept"), 0).otherwise(F.length("text"))
    return parts.withColumn("batch", F.when(~F.col("kept"), F.floor(F.coalesce(F.sum(size).over(before), F.lit(0)) / (budget // 2)).cast("int")))


def reassembled(parts: DataFrame, column: str = "text") -> DataFrame:
    """KEYS, `text`: segments put together by their numbers."""
    return parts.groupBy(*KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", F.col(column).alias("text")))), lambda x: x["text"]), "").alias("text"))


# --- attempts -----------------------------------------------------------------------------------------------


def prompts(sources: DataFrame, lang: str, error: Column | None = None, **more: Column) -> DataFrame:
    """A row per chunk: CHUNK, `prompt`: JSON of the chunk, its language, what went wrong last time, and its blocks in order, with `more` fields a block."""
    block = F.struct("pos", "role", "text", F.col("preserve_tokens").alias("preserve_tokens"), *[c.alias(n) for n, c in more.items()])
    error = F.lit(None).cast("string") if error is None else error
    made = sources.groupBy(*CHUNK).agg(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))).alias("_b"), F.first(error).alias("_e"))
    fields = F.struct(F.col("doc_id").cast("string").alias("doc_id"), "chunk_no", F.lit(lang).alias("target_lang"), F.col("_e").alias("previous_error"), F.transform("_b", lambda x: x["b"]).alias("blocks"))
    return made.select(*CHUNK, F.to_json(fields).alias("prompt"))


def asked(chunks: DataFrame, model: Model, attempt: int) -> DataFrame:
    """Adds `answer`, the model's, null where it raised or gave nothing."""

    @F.pandas_udf("string")
    def ask(given):
        import pandas as pd

        try:
            found = list(model(given.tolist(), attempt))
        except Exception:  # noqa: BLE001  (a model from outside: whatever it raises is an answer that didn't come)
            found = [None] * len(given)
        return pd.Series(found, dtype=object, index=given.index)

    return chunks.select(*CHUNK, ask("prompt").alias("answer"))


def _read(answers: DataFrame) -> DataFrame:
    """CHUNK, `blocks`: the rows of an answer, and `bad`: whether nothing could be read in it. Answers are read as they come, in the same pass of Python."""
    found = fenced(answers, ("_json", first_object(F.col("answer"), "blocks")))
    return found.select(*CHUNK, F.from_json("_json", ANSWER)["blocks"].alias("blocks"), F.col("_json").isNull().alias("bad"))


def _judged(sources: DataFrame, answers: DataFrame, lang: str, attempt: int) -> DataFrame:
    """A plan row per block of the chunks that were asked: repaired answers, with `reason` where the chunk failed: unparseable_response or target_language_mismatch; `leaks`: this block is why."""
    rows = answers.select(*CHUNK, F.posexplode("blocks").alias("n", "b")).select(*CHUNK, "b.pos", "n", "b.translated_text", "b.role", "b.render_intent", "b.inline_items", "b.quality_flags")
    told = {"text": "_source", "role": "_asked", "preserve_tokens": "_kept", "requires_translation": "_wanted"}
    plan = repaired(sources, rows.where("pos IS NOT NULL"), attempt, told)
    chunk = W.partitionBy(*CHUNK)
    own = F.array(F.lit("repaired_layout_plan"), F.lit(f"retry_attempt_{attempt}"))
    mended = F.exists("quality_flags", lambda f: f.endswith("_repaired") | (f == "missing_translation") | (f == "role_mismatch"))
    asked_for = chinese_target(F.lit(lang)) & reviewable(F.col("_asked"), F.col("_wanted"))
    leaks = asked_for & untranslated(F.col("_source"), F.col("_bare"))
    judged = fenced(plan, ("_bare", F.when(asked_for, F.trim(remove_tokens(F.col("translated_text"), F.col("_kept"))))), ("leaks", F.coalesce(leaks, F.lit(False))))
    out = judged.drop("_source", "_asked", "_kept", "_wanted", "_bare").join(answers.select(*CHUNK, F.col("bad").alias("_bad")), CHUNK)
    out = out.withColumn("leaks", F.col("leaks") & ~F.col("_bad")).withColumn("_mended", F.max(mended).over(chunk)).withColumn("_leak", F.max("leaks").over(chunk))
    # A chunk of which no row had to be mended was right as it came.
    flags = F.when(F.col("_mended"), F.col("quality_flags")).otherwise(F.array_except("quality_flags", own))
    reason = F.when(F.col("_bad"), "unparseable_response").when(F.col("_leak"), "target_language_mismatch")
    return out.withColumn("quality_flags", flags).withColumn("reason", reason).drop("_bad", "_mended", "_leak")


def translated(sources: DataFrame, model: Model, lang: str, attempts: int = 3, terms: DataFrame | None = None) -> DataFrame:
    """A plan row per source block: KEYS, `role`, `translated_text`, `inline_items`, `render_intent`, `quality_flags`, `attempt` (0: not asked), `reason` (why a block has its source text; null: it hasn't).

    `sources`: KEYS, `role`, `text`, `preserve_tokens`, `requires_translation`. Blocks that need no translation are copied. The others are asked for by chunk; answers are read from what
    stands around them, repaired (JS03), and checked for the language (PF21). Only chunks that fail are asked again, with the reason, `attempts` times in all; each attempt is a written table, and what is done isn't touched again; these tables are deleted when all attempts have been put together. In the last
    attempt blocks in the wrong language, or all blocks of a chunk without a readable answer, get their source text and the reason. Then quality is reviewed once (J19): chunks with severe issues are asked for a
    revision, with their translations and issues in the prompt; it replaces theirs if it can be read and is in the right language, else it is flagged as failed. Issues are among the flags. Null texts count as empty.
    """
    sources = sources.select(*KEYS, F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("preserve_tokens", F.array().cast("array<string>")).alias("preserve_tokens"), F.coalesce("requires_translation", F.lit(True)).alias("requires_translation"))
    sources = store(sources, "sources")
    plan = ["role", "translated_text", "inline_items", "render_intent", "quality_flags"]
    kept = deterministic(sources.where("NOT requires_translation"), lang).select(*KEYS, *plan, F.lit(0).alias("attempt"), F.lit(None).cast("string").alias("reason"))
    open_ = sources.where("requires_translation").withColumn("_error", F.lit(None).cast("string"))
    done, spent = [], []
    for attempt in range(1, attempts + 1):
        # Answers are written as they come, so that no chunk is asked twice for one attempt, whatever fails after it.
        answers = store(_read(asked(prompts(open_, lang, F.col("_error")), model, attempt)), f"answers{attempt}")
        judged = store(_judged(open_.drop("_error"), answers, lang, attempt), f"attempt{attempt}")
        spent += [answers, judged]
        last = attempt == attempts
        good = judged if last else judged.where("reason IS NULL")
        if last:
            fell = (F.col("reason") == "unparseable_response") | F.col("leaks")
            back = good.join(open_.select(*KEYS, "text"), KEYS)
            failed = F.array_distinct(F.concat(F.when(F.col("leaks"), F.col("quality_flags")).otherwise(F.array().cast("array<string>")), F.array(F.col("reason"), F.lit("missing_translation"), F.lit(f"retry_attempt_{attempt}"))))
            good = back.withColumn("translated_text", F.when(fell, F.col("text")).otherwise(F.col("translated_text"))).withColumn("quality_flags", F.when(fell, failed).otherwise(F.col("quality_flags"))).withColumn("reason", F.when(fell, F.col("reason")))
        done.append(good.select(*KEYS, *plan, F.lit(attempt).alias("attempt"), "reason"))
        if last:
            break
        why = judged.where("reason IS NOT NULL").select(*KEYS, F.col("reason").alias("_error"))
        open_ = store(sources.join(why, KEYS), f"open{attempt + 1}")
        spent.append(open_)
        if not open_.limit(1).count():
            break
    first = done[0]
    for other in done[1:]:
        first = first.unionByName(other)
    first = store(first, "first")
    for table in spent:
        free(table)

    found = store(quality_issues(sources, first, lang, terms), "issues")
    severe = found.where("severity = 'severe'").select(*CHUNK).distinct()
    # Blocks that fell back have had all their attempts.
    again = first.join(severe, CHUNK, "left_semi").join(first.where("reason IS NOT NULL").select(*CHUNK).distinct(), CHUNK, "left_anti")
    said = found.groupBy(*KEYS).agg(F.sort_array(F.collect_set("flag")).alias("issues"))
    wanted = sources.join(again.select(*KEYS, "translated_text", "attempt"), KEYS).join(said, KEYS, "left")
    answers = store(_read(asked(prompts(wanted, lang, translated_text=F.col("translated_text"), issues=F.coalesce("issues", F.array().cast("array<string>"))), model, 0)), "revisions")
    revised = store(_judged(sources.join(wanted.select(*KEYS), KEYS, "left_semi"), answers, lang, 1), "revised")
    applied = revised.where("reason IS NULL").join(wanted.select(*KEYS, "attempt"), KEYS).select(*KEYS, *plan, "attempt", F.lit(None).cast("string").alias("reason"))
    post = quality_issues(sources, applied, lang, terms).groupBy(*KEYS).agg(F.sort_array(F.collect_set("flag")).alias("issues"))
    flagged = lambda rows, issues, extra: rows.join(issues, KEYS, "left").withColumn("quality_flags", F.array_distinct(F.concat("quality_flags", F.coalesce("issues", F.array().cast("array<string>")), extra))).drop("issues")
    none = F.array().cast("array<string>")
    applied = flagged(applied, post, F.array(F.lit(REVISED)))
    left = first.join(revised.where("reason IS NULL").select(*KEYS), KEYS, "left_anti")
    tried = revised.where("reason IS NOT NULL").select(*KEYS, F.lit(True).alias("_tried"))
    left = flagged(left.join(tried, KEYS, "left"), said, F.when(F.col("_tried"), F.array(F.lit(REVISION_FAILED))).otherwise(none)).drop("_tried")
    return kept.unionByName(applied).unionByName(left)
