"""Mechanical repair of model answers: every source block gets a plan row, with its tokens, a known role and intent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.fence import fenced
from quire.functions.predicates import formula_like
from quire.functions.text import FORMULA_REF, token_kind
from quire.operators.rollups import first_rows

# The roles, intents and kinds of inline items that a plan may have.
ROLES = ("title", "heading", "abstract", "paragraph", "caption", "figure", "table", "formula", "reference", "footnote", "unknown")
INTENTS = ("normal", "compact", "emphasis", "preserve_asset")
ITEM_KINDS = ("text", "citation", "formula", "reference_marker", "asset_ref")
ITEMS = "array<struct<kind:string,text:string>>"


def repaired(sources: DataFrame, answers: DataFrame, attempt: int = 1, carry: dict[str, str] | None = None) -> DataFrame:
    """JS03: a plan row per source block from the rows of an answer (`doc_id`, `chunk_no`, `pos`, `n`, `translated_text`, `role`, `render_intent`, `inline_items`, `quality_flags`).

    Of several rows for a block the first by `n` counts; rows for blocks that aren't there are dropped. A blank translation becomes the source text; formula references that lost
    a brace are mended if the block has them, missing ones are put at the end; other tokens that are in neither text nor items become items; unknown
    roles, intents and kinds become the source's role, the role's intent and text. What was done is said in `quality_flags`, each once, in order. `carry`: columns of the sources that
    the plan keeps, by the names that they get.
    """
    carry = carry or {}
    keys = ["doc_id", "chunk_no", "pos"]
    side = first_rows(answers, ["n"], keys).select(*keys, F.struct("translated_text", "role", "render_intent", "inline_items", "quality_flags").alias("_a"))
    rows = sources.select(*keys, "role", "text", F.coalesce("preserve_tokens", F.array().cast("array<string>")).alias("_tokens"), "requires_translation", *[F.col(c).alias(n) for c, n in carry.items()]).join(side, keys, "left")
    is_ref = lambda x: x.rlike(f"^{FORMULA_REF}$")
    blank = F.coalesce(F.trim("_a.translated_text"), F.lit("")) == ""
    refs, others = F.filter("_tokens", is_ref), F.filter("_tokens", lambda x: ~is_ref(x))
    lost = lambda ref: F.concat(F.lit(r"(?<!\{)\{\Q"), F.substring(ref, F.lit(3), F.length(ref)), F.lit(r"\E"))
    mended = F.aggregate("_refs", F.col("_text0"), lambda acc, ref: F.regexp_replace(acc, lost(ref), ref))
    ending = lambda acc, ref: F.when(acc.contains(ref), acc).when(F.trim(acc) == "", ref).otherwise(F.concat(F.trim(acc), F.lit(" "), ref))
    items = F.transform(F.coalesce("_a.inline_items", F.array().cast(ITEMS)), lambda i: F.struct(F.when(i["kind"].isin(*ITEM_KINDS), i["kind"]).otherwise("text").alias("kind"), F.coalesce(i["text"], F.lit("")).alias("text")))
    planned = F.transform(F.filter("_items", lambda i: i["kind"] != "text"), lambda i: i["text"])
    known_role = F.coalesce(F.col("_a.role").isin(*ROLES), F.lit(False))
    rows = fenced(
        rows,
        ("_refs", refs),
        ("_text0", F.when(blank, F.col("text")).otherwise(F.col("_a.translated_text"))),
        ("_text1", mended),
        ("_text2", F.aggregate("_refs", F.col("_text1"), ending)),
        ("_items", items),
        ("_added", F.filter(others, lambda x: ~F.col("_text2").contains(x) & ~F.array_contains(planned, x))),
        ("_role", F.when(known_role, F.col("_a.role")).otherwise(F.col("role"))),
    )
    like = (F.col("_role") == "paragraph") & (F.size("_refs") > 0) & formula_like(F.col("_text2"))
    flag = lambda name, when=None: F.lit(name) if when is None else F.when(when, F.lit(name))
    told = F.array(
        flag("repaired_layout_plan"),
        flag(f"retry_attempt_{attempt}", F.lit(attempt > 1)),
        flag("empty_translation_repaired", blank),
        flag("missing_translation", blank),
        flag("formula_placeholder_syntax_repaired", F.col("_text1") != F.col("_text0")),
        flag("role_mismatch", known_role & (F.col("_a.role") != F.col("role"))),
        flag("formula_placeholder_repaired", F.exists("_refs", lambda r: ~F.col("_text1").contains(r))),
        flag("preserve_token_repaired", F.size("_added") > 0),
        flag("formula_like_repaired", like),
        flag("formula_cluster_preserved", ~F.col("requires_translation")),
        flag("missing_block_repaired", F.col("_a").isNull()),
    )
    own = F.filter(F.coalesce("_a.quality_flags", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    intent = F.when(F.col("_a.render_intent").isin(*INTENTS), F.col("_a.render_intent")).when(F.col("role").isin("figure", "table"), "preserve_asset").otherwise("normal")
    return rows.select(
        *keys,
        F.col("_role").alias("role"),
        F.col("_text2").alias("translated_text"),
        F.concat("_items", F.transform("_added", lambda x: F.struct(token_kind(x).alias("kind"), x.alias("text")))).alias("inline_items"),
        intent.alias("render_intent"),
        F.array_distinct(F.concat(own, F.array_compact(told))).alias("quality_flags"),
        *carry.values(),
    )
