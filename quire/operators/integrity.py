"""Referential checks over documents, chunks and plans; each returns its violations as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import formula_refs

ISSUE = ("doc_id", "code", "location", "ref_id")


def _issues(df: DataFrame, code, location, ref) -> DataFrame:
    return df.select("doc_id", (F.lit(code) if isinstance(code, str) else code).alias("code"), location.alias("location"), ref.alias("ref_id"))


def reference_issues(texts: DataFrame, formulas: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """References in texts (`doc_id`, `location`, `text`) to formulas (`doc_id`, `formula_id`) that the document lacks.

    unknown_formula_ref, or stale_legacy_formula_ref for ids of the old kind. `fallback` ids (same columns) count as known.
    """
    refs = texts.select("doc_id", "location", F.explode(formula_refs(F.col("text"))).alias("formula_id"))
    known = formulas.select("doc_id", "formula_id")
    if fallback is not None:
        known = known.unionByName(fallback.select("doc_id", "formula_id"))
    code = F.when(F.col("formula_id").rlike("^F[A-Za-z0-9_]+$"), "stale_legacy_formula_ref").otherwise("unknown_formula_ref")
    return _issues(refs.join(known, ["doc_id", "formula_id"], "left_anti"), code, F.col("location"), F.col("formula_id"))


def legacy_ids(formulas: DataFrame) -> DataFrame:
    """Formulas whose own id is of the old kind."""
    return _issues(formulas.where(F.col("formula_id").rlike("^F[A-Za-z0-9_]+$")), "legacy_formula_id", F.lit("formula_id"), F.col("formula_id"))


def plan_reference_issues(sources: DataFrame, plan: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """References in a block's translation or items that its source text and tokens don't have."""
    keys = ["doc_id", "chunk_no", "pos"]
    allowed = sources.select(*keys, F.explode(formula_refs(F.concat_ws(" ", "text", F.array_join("preserve_tokens", " ")))).alias("formula_id"))
    used = plan.select(*keys, F.explode(formula_refs(F.concat_ws(" ", "translated_text", F.array_join(F.transform("inline_items", lambda i: i["text"]), " ")))).alias("formula_id"))
    left = used.join(allowed, [*keys, "formula_id"], "left_anti")
    if fallback is not None:
        left = left.join(fallback.select("doc_id", "formula_id"), ["doc_id", "formula_id"], "left_anti")
    return _issues(left, "formula_ref_not_in_source_block", F.concat(F.lit("block "), F.col("pos").cast("string")), F.col("formula_id"))


def anchor_issues(formulas: DataFrame, blocks: DataFrame, assets: DataFrame) -> DataFrame:
    """Formulas whose source block, anchor block or asset is on another page. Missing ones are passed over."""
    out = None
    for field, other, key in (("source_block_id", blocks, "block_id"), ("anchor_block_id", blocks, "block_id"), ("asset_id", assets, "asset_id")):
        side = other.select("doc_id", F.col(key).alias(field), F.col("page_id").alias("_page"))
        part = _issues(formulas.join(side, ["doc_id", field]).where(F.col("page_id") != F.col("_page")), "formula_anchor_page_mismatch", F.lit(field), F.col("formula_id"))
        out = part if out is None else out.unionByName(part)
    return out


def range_issues(formulas: DataFrame, blocks: DataFrame) -> DataFrame:
    """Formulas (`source_block_id`, `anchor_block_id`, `span_ids`, `source_text`, `start`, `end`) against their block (`text`, `span_ids`).

    Spans that the block lacks; ranges past its end; ranges whose text differs, white space apart. The block is the source block, or else the anchor block.
    """
    side = lambda c: blocks.select("doc_id", F.col("block_id").alias(c), F.struct("text", "span_ids").alias(f"_{c}"))
    both = formulas.join(side("source_block_id"), ["doc_id", "source_block_id"], "left").join(side("anchor_block_id"), ["doc_id", "anchor_block_id"], "left")
    both = both.withColumn("_b", F.coalesce("_source_block_id", "_anchor_block_id")).where(F.col("_b").isNotNull())
    spans = both.where((F.size("_b.span_ids") > 0) & (F.size(F.array_except("span_ids", "_b.span_ids")) > 0))
    ranged = both.where(F.col("start").isNotNull() & (F.coalesce("source_text", F.lit("")) != "") & (F.col("_b.text") != "") & ~F.col("_b.text").contains("{{formula:"))
    plain = lambda c: F.regexp_replace(c, r"(?U)\s", "")
    cut = F.col("_b.text").substr(F.col("start") + 1, F.col("end") - F.col("start"))
    out_of = F.col("end") > F.length("_b.text")
    code = F.when(out_of, "formula_source_text_range_out_of_bounds").when(plain(cut) != plain(F.col("source_text")), "formula_source_text_range_mismatch")
    found = ranged.withColumn("_code", code).where(F.col("_code").isNotNull())
    return _issues(spans, "formula_unknown_span_ref", F.lit("span_ids"), F.col("formula_id")).unionByName(_issues(found, F.col("_code"), F.lit("source_text_range"), F.col("formula_id")))


def duplicate_keys(rows: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """Keys that stand on more than one row."""
    many = rows.groupBy("doc_id", *keys).count().where("count > 1")
    return _issues(many, f"duplicate_{entity}_id", F.lit(entity), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))


def missing_parents(rows: DataFrame, key: str, parents: DataFrame, entity: str) -> DataFrame:
    """Rows whose `key` no parent has; null keys are fine."""
    lost = rows.where(F.col(key).isNotNull()).select("doc_id", key).join(parents.select("doc_id", key), ["doc_id", key], "left_anti").distinct()
    return _issues(lost, f"unknown_{key}", F.lit(entity), F.col(key).cast("string"))


def layout_plan_issues(blocks: DataFrame, assets: DataFrame, plan_blocks: DataFrame, plan_assets: DataFrame, sections: DataFrame, rules: DataFrame) -> DataFrame:
    """A layout plan against its document.

    `sections`: (`doc_id`, `section_id`, `kind`, `block_ids`); `rules`: (`doc_id`, `section_id`) that numbering and bibliography name.
    Blocks unknown to the document or missing from the plan, unknown assets, sections of unknown blocks, blocks in two body sections, and unknown sections.
    """
    anti = lambda a, b, k: a.select("doc_id", k).distinct().join(b.select("doc_id", k), ["doc_id", k], "left_anti")
    named = sections.select("doc_id", "section_id", "kind", F.explode("block_ids").alias("block_id"))
    twice = named.where(~F.col("kind").isin("figure", "table", "formula")).groupBy("doc_id", "block_id").agg(F.countDistinct("section_id").alias("n")).where("n > 1")
    parts = (
        (anti(plan_blocks, blocks, "block_id"), "unknown_block", "block_id"),
        (anti(blocks, plan_blocks, "block_id"), "missing_block", "block_id"),
        (anti(plan_assets, assets, "asset_id"), "unknown_asset", "asset_id"),
        (anti(named, blocks, "block_id"), "unknown_section_block", "block_id"),
        (twice, "block_in_two_sections", "block_id"),
        (anti(rules, sections, "section_id"), "unknown_section", "section_id"),
    )
    out = None
    for df, code, key in parts:
        part = _issues(df, code, F.lit("layout_plan"), F.col(key))
        out = part if out is None else out.unionByName(part)
    return out


def substitute_refs(texts: DataFrame, formulas: DataFrame, value: str = "latex") -> DataFrame:
    """References in `text` (rows of `doc_id`, `pos`) replaced by a column of their formula; unknown ones stay.

    The text is cut at its references; the pieces look up their formulas in one equi-join and are put together again in order.
    """
    keys = ["doc_id", "pos"]
    pieces = F.split(F.regexp_replace("text", r"(\{\{formula:[A-Za-z0-9_.:-]+\}\})", "\u0000$1\u0000"), "\u0000")
    each = texts.select(*keys, F.posexplode(pieces).alias("_n", "_piece")).withColumn("formula_id", F.regexp_extract("_piece", r"^\{\{formula:([A-Za-z0-9_.:-]+)\}\}$", 1))
    found = each.join(formulas.select("doc_id", "formula_id", F.col(value).alias("_v")), ["doc_id", "formula_id"], "left")
    joined = found.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.coalesce("_v", "_piece").alias("_t")))), lambda x: x["_t"]), "").alias("text"))
    return texts.drop("text").join(joined, keys, "left")


def formula_ref_sets(texts: DataFrame, formulas: DataFrame) -> DataFrame:
    """AG07: per document the referenced, unknown and unused formula ids, sorted, and their counts."""
    used = texts.select("doc_id", F.explode(formula_refs(F.col("text"))).alias("r")).groupBy("doc_id").agg(F.collect_set("r").alias("_used"))
    known = formulas.groupBy("doc_id").agg(F.collect_set("formula_id").alias("_known"))
    none = F.array().cast("array<string>")
    both = used.join(known, "doc_id", "full").select("doc_id", F.coalesce("_used", none).alias("u"), F.coalesce("_known", none).alias("k"))
    return both.select("doc_id", F.sort_array("u").alias("referenced"), F.sort_array(F.array_except("u", "k")).alias("unknown"), F.sort_array(F.array_except("k", "u")).alias("unused"), F.size("u").alias("n_referenced"))
