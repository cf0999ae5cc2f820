"""Translation plans over source blocks, without and with a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.fence import fenced
from quire.functions.predicates import chinese_target, render_intent, reviewable, untranslated
from quire.functions.text import remove_tokens, token_kind


def deterministic(sources: DataFrame, lang: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """A plan row per source block: `translated_text`, `inline_items`, `render_intent`, `quality_flags`, and the columns of `carry`.

    Text to translate gets a mark of the language in front; other text is copied.
    """
    prefix = "【译】" if lang.startswith("zh") else f"[{lang}] "
    wanted = F.col("requires_translation")
    items = F.transform("preserve_tokens", lambda t: F.struct(token_kind(t).alias("kind"), t.alias("text")))
    return sources.select(
        "doc_id",
        "chunk_no",
        "pos",
        "role",
        F.lit(lang).alias("target_lang"),
        F.when(wanted, F.concat(F.lit(prefix), F.col("text"))).otherwise(F.col("text")).alias("translated_text"),
        items.alias("inline_items"),
        render_intent(F.col("role")).alias("render_intent"),
        F.array(F.when(wanted, "mock_translation").otherwise("formula_preserved_without_translation")).alias("quality_flags"),
        *carry,
    )


def translate(sources: DataFrame, lang: str, model: Callable[[list[str]], list[str | None]] | None = None) -> DataFrame:
    """A plan by `model` (a list of texts to their translations, called once per Arrow batch), else deterministic.

    What the model leaves out, or gives without the block's tokens, is repaired: the source text stands in and a flag says so.
    """
    plan = deterministic(sources, lang)
    if model is None:
        return plan

    @F.pandas_udf("string")
    def ask(texts):
        import pandas as pd

        return pd.Series(model(texts.tolist()), dtype=object)

    keys = ["doc_id", "chunk_no", "pos"]
    answers = sources.where("requires_translation").select(*keys, "text", "preserve_tokens", ask("text").alias("_answer"))
    kept = F.forall("preserve_tokens", lambda t: F.col("_answer").contains(t))
    good = F.col("_answer").isNotNull() & (F.trim("_answer") != "") & kept
    answers = answers.select(*keys, F.when(good, F.col("_answer")).otherwise(F.col("text")).alias("_text"), F.when(good, F.array(F.lit("model_translation"))).otherwise(F.array(F.lit("translation_fallback_source"))).alias("_flags"))
    joined = plan.join(answers, keys, "left")
    return joined.withColumn("translated_text", F.coalesce("_text", "translated_text")).withColumn("quality_flags", F.coalesce("_flags", "quality_flags")).drop("_text", "_flags")


def lost_tokens(tokens: Column, translated: Column, items: Column) -> Column:
    """Tokens that a plan row loses: neither in the translation nor among the inline items; a formula reference must be in the translation."""
    names = F.transform(items, lambda i: i["text"])
    return F.filter(tokens, lambda t: ~translated.contains(t) & (t.startswith("{{formula:") | ~F.array_contains(names, t)))


def coverage_issues(sources: DataFrame, plan: DataFrame) -> DataFrame:
    """`doc_id`, `chunk_no`, `pos`, `code`, `detail`: blocks that the plan lacks or makes up, and tokens that it loses.

    A token is kept if it is in the translation or among the inline items; a formula reference must be in the translation.
    """
    keys = ["doc_id", "chunk_no", "pos"]
    given = sources.select(*keys, "preserve_tokens", F.lit(True).alias("_source"))
    both = given.join(plan.select(*keys, "translated_text", "inline_items", F.lit(True).alias("_plan")), keys, "full")
    issue = lambda code, detail: F.struct(F.lit(code).alias("code"), detail.alias("detail"))
    lost = F.transform(lost_tokens(F.col("preserve_tokens"), F.col("translated_text"), F.col("inline_items")), lambda t: issue("missing_token", t))
    found = F.when(F.col("_plan").isNull(), F.array(issue("missing_block", F.lit("")))).when(F.col("_source").isNull(), F.array(issue("unknown_block", F.lit("")))).otherwise(lost)
    return both.select(*keys, F.explode(found).alias("x")).select(*keys, "x.code", "x.detail")


def _reviewed(sources: DataFrame, plan: DataFrame) -> DataFrame:
    """Blocks that J19 and U04 review, with their translations and `_s`, the text without its tokens, which isn't blank."""
    keys = ["doc_id", "chunk_no", "pos"]
    both = sources.select(*keys, "role", "text", "preserve_tokens", "requires_translation").join(plan.select(*keys, "translated_text"), keys).where(reviewable(F.col("role"), F.col("requires_translation")))
    return fenced(both, ("_s", F.trim(remove_tokens(F.col("text"), F.col("preserve_tokens"))))).where("_s <> ''")


def quality_issues(sources: DataFrame, plan: DataFrame, lang: str, terms: DataFrame | None = None) -> DataFrame:
    """`doc_id`, `chunk_no`, `pos`, `flag`, `severity`: empty, too short or long, leaking or missing-term translations.

    `terms`: a glossary (missing_terms), which is broadcast.
    """
    keys = ["doc_id", "chunk_no", "pos"]
    both = fenced(_reviewed(sources, plan), ("_t", F.trim(remove_tokens(F.col("translated_text"), F.col("preserve_tokens")))))
    ratio = F.length("_t") / F.length("_s")
    some, long = F.col("_t") != "", F.length("_s") >= 80
    leak = some & chinese_target(F.lit(lang)) & untranslated(F.col("text"), F.col("_t"))
    rules = (("empty", "severe", ~some), ("suspiciously_short", "severe", some & long & (ratio < 0.18)), ("suspiciously_long", "warning", some & long & (ratio > 2.8)), ("source_leakage", "severe", leak))
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(f"translation_quality_{n}").alias("flag"), F.lit(s).alias("severity"))) for n, s, c in rules]))
    # Fenced, as the explosion would have them all worked out a second time, for its filter of empty arrays.
    out = fenced(both, ("_found", found)).select(*keys, F.explode("_found").alias("x")).select(*keys, "x.flag", "x.severity")
    return out if terms is None else out.unionByName(missing_terms(sources, plan, terms))


#: A glossary of so many terms is looked for term by term, which takes less than the cutting of each text into pieces.
FEW_TERMS = 1000


def missing_terms(sources: DataFrame, plan: DataFrame, terms: DataFrame) -> DataFrame:
    """`doc_id`, `chunk_no`, `pos`, `flag`, `severity` of blocks whose translation lacks a term, each once.

    `terms` (`source_term`, `target_term`): a block that holds a source term (any case) needs its target term; terms that are the same in both languages are passed over. Up to FEW_TERMS terms are all looked for in
    each block. Of a longer glossary, a term is looked up by its first three characters (or all, if it is shorter) among those of the block, so it needs no pairs of blocks and terms; it is
    broadcast: the pieces of the texts, of which there are up to three a character, stay in the tasks that cut them.
    """
    keys = ["doc_id", "chunk_no", "pos"]
    pair = terms.select(F.lower(F.trim("source_term")).alias("_from"), F.lower(F.trim("target_term")).alias("_to")).where((F.col("_from") != "") & (F.col("_to") != "") & (F.col("_from") != F.col("_to"))).distinct()
    both = fenced(_reviewed(sources, plan), ("_low", F.lower("text")), ("_shown", F.lower("translated_text")))
    lacks = lambda source, target: F.col("_low").contains(source) & ~F.col("_shown").contains(target)
    few = pair.limit(FEW_TERMS + 1).collect()
    if len(few) <= FEW_TERMS:
        glossary = F.array(*[F.struct(F.lit(r["_from"]).alias("f"), F.lit(r["_to"]).alias("t")) for r in few]).cast("array<struct<f:string,t:string>>")
        hits = both.where(F.exists(glossary, lambda p: lacks(p["f"], p["t"])))
    else:
        grams = F.array_distinct(F.concat(*[F.regexp_extract_all("_low", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in (1, 2, 3)]))
        # Fenced, as the explosion would have the pieces cut a second time, for its filter of empty arrays.
        each = fenced(both, ("_grams", grams)).select(*keys, "_low", "_shown", F.explode("_grams").alias("_key"))
        hits = each.join(F.broadcast(pair.withColumn("_key", F.substring("_from", 1, 3))), "_key").where(lacks(F.col("_from"), F.col("_to")))
    return hits.select(*keys, F.lit("translation_quality_missing_key_term").alias("flag"), F.lit("severe").alias("severity")).distinct()


def rendered(blocks: DataFrame, plan: DataFrame, intents: DataFrame | None = None) -> DataFrame:
    """Blocks with their translation and layout intent: `shown_text`, `render_intent`, `flags`.

    No plan row: the source text and missing_translation; a blank one: the source text and empty_translation; another role: role_mismatch.
    """
    keys = ["doc_id", "pos"]
    out = blocks.select(*keys, "role", "text").join(plan.select(*keys, F.lit(True).alias("_has"), F.col("role").alias("_role"), "translated_text", F.col("render_intent").alias("_plan_intent")), keys, "left")
    if intents is not None:
        out = out.join(intents.select(*keys, F.col("render_intent").alias("_intent")), keys, "left")
    else:
        out = out.withColumn("_intent", F.lit(None).cast("string"))
    blank = F.trim("translated_text") == ""
    flags: list[tuple[str, Column]] = [("missing_translation", F.col("_has").isNull()), ("empty_translation", F.col("_has").isNotNull() & F.coalesce(blank, F.lit(True))), ("role_mismatch", F.coalesce(F.col("_role") != F.col("role"), F.lit(False)))]
    return out.select(*keys, "role", F.when(F.coalesce(blank, F.lit(True)), F.col("text")).otherwise(F.col("translated_text")).alias("shown_text"), F.coalesce("_intent", "_plan_intent", F.lit("normal")).alias("render_intent"), F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags])).alias("flags"))


def brief(blocks: DataFrame) -> DataFrame:
    """AG20, U10: per document its first title and abstract, and first six headings and three paragraphs."""
    texts = lambda role, n: F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("pos", "text")))), lambda x: x["text"]), 1, n)
    first = lambda role: F.min_by("text", F.when(F.col("role") == role, F.col("pos")))
    return blocks.groupBy("doc_id").agg(first("title").alias("title"), first("abstract").alias("abstract"), texts("heading", 6).alias("headings"), texts("paragraph", 3).alias("paragraphs"))


def reuse(plan: DataFrame, existing: DataFrame, selected: DataFrame) -> DataFrame:
    """The new plan for selected blocks (`doc_id`, `pos`), the existing one, where there is one, for all others."""
    keys = ["doc_id", "pos"]
    old = existing.select(*keys, F.col("translated_text").alias("_old"))
    chosen = selected.select(*keys).distinct().withColumn("_new", F.lit(True))
    out = plan.join(old, keys, "left").join(chosen, keys, "left")
    kept = F.col("_new").isNull() & F.col("_old").isNotNull()
    return out.withColumn("translated_text", F.when(kept, F.col("_old")).otherwise(F.col("translated_text"))).withColumn("reused", kept).drop("_old", "_new")


def cached(sources: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds `cache_key` (SHA-1 of a chunk's canonical JSON) and what the cache (`cache_key`, `plan_json`) has for it, unparsable entries as null."""
    content = F.to_json(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))))
    keyed = sources.groupBy("doc_id", "chunk_no").agg(F.sha1(content.cast("binary")).alias("cache_key"))
    good = cache.where(F.try_parse_json("plan_json").isNotNull()).select("cache_key", "plan_json")
    return keyed.join(good, "cache_key", "left")
