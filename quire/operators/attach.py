"""Recognised formulas written back into a document's blocks, assets and formulas in one upsert."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Flags of a formula whose id follows them, of one that stays as its successor was refused, and of one with a vector asset.
REPLACES, RETAINED, VECTOR = "legacy_formula_replaced:", "legacy_formula_retained_after_rejection", "formula_source_asset_svg"
PAGE = ["doc_id", "page_id"]


class Document(NamedTuple):
    """The tables that formulas are written into; each with all of its documents."""

    blocks: DataFrame  # doc_id, page_id, block_id, role, text, formula_id, box
    assets: DataFrame  # doc_id, page_id, asset_id, kind, alt_text, formula_id, path, box
    formulas: DataFrame  # doc_id, page_id, formula_id, n, mode, source_block_id, anchor_block_id, start, end, source_text, asset_id, latex, quality_flags


def _ref(formula_id: Column) -> Column:
    return F.concat(F.lit("{{formula:"), formula_id, F.lit("}}"))


def _replaced(formulas: DataFrame) -> DataFrame:
    """Ids that formulas stand in for: `doc_id`, `formula_id`."""
    flags = F.filter("quality_flags", lambda f: f.startswith(REPLACES))
    return formulas.select("doc_id", F.explode(F.transform(flags, lambda f: F.substring(f, F.lit(len(REPLACES) + 1), F.length(f)))).alias("formula_id")).distinct()


def _last(rows: DataFrame, *keys: str) -> DataFrame:
    """Of rows alike in `keys` the last by `n`, then by id."""
    order = W.partitionBy(*keys).orderBy(F.desc("n"), F.desc("formula_id"))
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def _blocks(blocks: DataFrame, new: DataFrame, held: DataFrame) -> DataFrame:
    """A display formula makes its block a formula, whose text is the reference; inline ones take their place in the text, from right to left; other blocks stay.

    Inline ones that stand in `held` (the document's formulas) at the same place have been put already, also where another one's reference was written over theirs since.
    """
    of = ["doc_id", "page_id", "block_id"]
    display = _last(new.where("mode = 'display' AND source_block_id IS NOT NULL").withColumnRenamed("source_block_id", "block_id"), *of).select(*of, F.col("formula_id").alias("_display"))
    place = ["doc_id", "page_id", "formula_id", "mode", "anchor_block_id", "start", "end", "source_text"]
    known = held.where("mode = 'inline' AND anchor_block_id IS NOT NULL").select(*[F.col(c).alias(f"_{c}") for c in place])
    inline = new.where("mode = 'inline' AND anchor_block_id IS NOT NULL")
    inline = inline.join(known, [inline[c].eqNullSafe(known[f"_{c}"]) for c in place], "left_anti")
    inline = inline.select("doc_id", "page_id", F.col("anchor_block_id").alias("block_id"), F.struct(F.coalesce("start", F.lit(-1)).alias("start"), "n", "end", "source_text", _ref(F.col("formula_id")).alias("ref")).alias("f"))
    inline = inline.groupBy(*of).agg(F.sort_array(F.collect_list("f"), asc=False).alias("_inline"))

    def put(text, f):
        first = F.call_function("locate", f["source_text"], text)
        found = F.when(F.coalesce((f["source_text"] != "") & (first > 0), F.lit(False)), F.overlay(text, f["ref"], first, F.length(f["source_text"]))).otherwise(text)
        placed = F.concat(F.substring(text, F.lit(1), f["start"]), f["ref"], F.substring(text, f["end"] + 1, F.length(text)))
        fits = F.coalesce((f["end"] >= f["start"]) & (f["start"] <= F.length(text)), F.lit(False))
        return F.when(text.contains(f["ref"]), text).when(f["start"] < 0, found).when(fits, placed).otherwise(text)

    out = blocks.join(display, of, "left").join(inline, of, "left")
    shown = F.col("_display").isNotNull()
    text = F.when(shown, _ref(F.col("_display"))).when(F.col("_inline").isNull(), F.col("text")).otherwise(F.aggregate("_inline", F.col("text"), put))
    changed = {"text": text, "role": F.when(shown, "formula").otherwise(F.col("role")), "formula_id": F.coalesce("_display", "formula_id")}
    return out.withColumns(changed).select(blocks.columns)


def _assets(assets: DataFrame, blocks: DataFrame, new: DataFrame) -> DataFrame:
    """Assets of formulas become formulas with their LaTeX; ids that no page of the document has become new assets, in the box of the formula's block."""
    owners = _last(new.where("asset_id IS NOT NULL"), *PAGE, "asset_id").select(*PAGE, "asset_id", F.col("formula_id").alias("_f"), F.col("latex").alias("_latex"))
    out = assets.join(owners, [*PAGE, "asset_id"], "left")
    hit = F.col("_f").isNotNull()
    kept = out.withColumns({"kind": F.when(hit, "formula").otherwise(F.col("kind")), "formula_id": F.coalesce("_f", "formula_id"), "alt_text": F.when(hit & (F.coalesce("_latex", F.lit("")) != ""), F.col("_latex")).otherwise(F.col("alt_text"))}).select(assets.columns)
    fresh = new.where("asset_id IS NOT NULL").join(assets.select("doc_id", "asset_id").distinct(), ["doc_id", "asset_id"], "left_anti")
    # An id that several formulas bring is the first one's.
    first = W.partitionBy("doc_id", "asset_id").orderBy("page_id", "n", "formula_id")
    fresh = fresh.withColumn("_k", F.row_number().over(first)).where("_k = 1").withColumn("_block", F.coalesce("source_block_id", "anchor_block_id"))
    fresh = fresh.join(blocks.select(*PAGE, F.col("block_id").alias("_block"), F.col("box").alias("_box")), [*PAGE, "_block"], "left")
    unit = F.struct(*[F.lit(v).cast("double").alias(c) for c, v in (("x0", 0), ("y0", 0), ("x1", 1), ("y1", 1))])
    end = F.when(F.array_contains("quality_flags", VECTOR), "svg").otherwise("png")
    made = fresh.select(*PAGE, "asset_id", F.lit("formula").alias("kind"), F.col("latex").alias("alt_text"), "formula_id", F.concat(F.lit("/api/documents/"), F.col("doc_id").cast("string"), F.lit("/assets/"), "asset_id", F.lit("."), end).alias("path"), F.coalesce("_box", unit).alias("box"))
    return kept.unionByName(made.select(assets.columns))


def _formulas(old: DataFrame, new: DataFrame, refused: DataFrame | None) -> DataFrame:
    """Formulas by id, the new one where both have it; those that a new one replaces go; those that a refused one would have replaced stay, with a flag."""
    kept = old.join(_replaced(new), ["doc_id", "formula_id"], "left_anti")
    if refused is not None:
        kept = kept.join(_replaced(refused).withColumn("_r", F.lit(True)), ["doc_id", "formula_id"], "left")
        kept = kept.withColumn("quality_flags", F.when(F.col("_r"), F.array_distinct(F.concat(F.coalesce("quality_flags", F.array().cast("array<string>")), F.array(F.lit(RETAINED))))).otherwise(F.col("quality_flags")))
    kept = kept.select(old.columns).join(new.select("doc_id", "formula_id").distinct(), ["doc_id", "formula_id"], "left_anti")
    return kept.select(old.columns).unionByName(_last(new, "doc_id", "formula_id").select(old.columns))


def attach(document: Document, new: DataFrame, refused: DataFrame | None = None) -> Document:
    """`new` formulas (columns of Document.formulas) in all three tables at once. Rows that no formula touches stay as they are.

    `refused`: `doc_id`, `quality_flags` of formulas that weren't accepted. Doing it again with the same formulas changes nothing: neither a formula that the document has at the same place nor a reference that a text has is put into it again, and
    a row that a key has is replaced. Of several formulas for one block, asset or id the last by `n` counts. Formulas for blocks and pages that aren't there only stand in the formulas.
    """
    return Document(_blocks(document.blocks, new, document.formulas), _assets(document.assets, document.blocks, new), _formulas(document.formulas, new, refused))
