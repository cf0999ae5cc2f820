"""Assets, spans and signals around formulas and blocks: what is taken, what is left out, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions.text import squeeze


# Words in a picture's description that rule a formula out.
NOT_FORMULAS = ("banner", "header", "logo", "decorative", "placeholder")


def formula_asset(box: Column, alt_text: Column, page_height: Column | None = None) -> Column:
    """PF09: whether a picture has the size, shape and place of a formula and no description that rules it out.

    In the top 12 % of a page low (70 points) or long (4 : 1) pictures are no formulas, nor are low ones that reach into the bottom 8 %. A page without a known height has no bands.
    """
    wide, high = box["x1"] - box["x0"], box["y1"] - box["y0"]
    ratio = F.when(high > 0, wide / high)
    shaped = (wide > 0) & (high > 0) & (wide * high).between(180, 80000) & ratio.between(1.4, 16.0) & (high <= 110)
    other = F.lower(F.coalesce(alt_text, F.lit(""))).rlike("|".join(NOT_FORMULAS))
    if page_height is None:
        return F.coalesce(shaped, F.lit(False)) & ~other
    tall = F.coalesce(page_height, F.lit(0.0))
    top = (box["y0"] <= tall * 0.12) & ((high <= 70) | (ratio >= 4.0))
    foot = (box["y1"] >= tall - tall * 0.08) & (high <= 70)
    return F.coalesce(shaped & ~((tall > 0) & (top | foot)), F.lit(False)) & ~other


def in_scope(blocks: DataFrame, pages: list[int] | None = None, block_ids: list[str] | None = None) -> DataFrame:
    """PF12: blocks of the chosen pages (from 1) or ids; all without a choice."""
    if pages is not None:
        return blocks.where((F.col("page_index") + 1).isin(pages))
    return blocks if block_ids is None else blocks.where(F.col("block_id").isin(block_ids))


def unknown_scope(blocks: DataFrame, chosen: DataFrame) -> DataFrame:
    """PF12: chosen ids (`doc_id`, `block_id`) that the document lacks."""
    return chosen.join(blocks, ["doc_id", "block_id"], "left_anti").select("doc_id", "block_id")


# How boilerplate begins, and the names of mathematical fonts.
COPYRIGHT = r"(?iU)^©\s*(?:(?:the\s+)?author\(s\)|authors?|作者)\b"
SITE_LINKS = ("view online", "export citation", "crossmark")
MATH_FONTS = r"^(?:CM|MSAM|MSBM|STIX|MTEX)"


def suppressed(text: Column, translation_text: Column, role: Column, box: Column, font: Column) -> Column:
    """PF13: whether a block is left out when pages are set: blank, boilerplate of publishers, or a tiny scrap (a number or a Greek letter of a mathematical font) that stands on its own."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+", ""), r"(?U)\s+$", "")
    low, wide, high = F.lower(t), g.width(box), g.height(box)
    begins = F.lit(False)
    for link in SITE_LINKS:
        begins = begins | low.startswith(link)
    plain = F.translate(t, "−–", "--")
    scrap = plain.rlike(r"^[+-]?\d{1,4}$") | (F.upper(F.coalesce(font, F.lit(""))).rlike(MATH_FONTS) & plain.rlike("^[+-]?[α-ωΑ-Ω]$"))
    tiny = role.isin("paragraph", "footnote", "unknown") & (F.trim(F.coalesce(translation_text, F.lit(""))) == "") & (wide <= 16) & (high <= 24) & scrap
    return (
        (t == "")
        | t.rlike(COPYRIGHT)
        | (low.contains("doi:") & t.rlike(r"(?U)\bj\.\s+[A-Za-z]"))
        | ((wide <= 8) & (high >= 40) & t.rlike(r"\d{4}"))
        | ((role == "footnote") & low.rlike(r"(?U)\bdoi:\s*\S+"))
        | begins
        | tiny
    )


def attachment(accepted: Column, source_kind: Column, has_asset: Column, confidence: Column, least: float = 0.5) -> Column:
    """PF23: why a recognised formula is not attached; null if it is."""
    return F.when(accepted, None).when((source_kind == "image") & has_asset, None).when(confidence < least, "low_confidence").when(~has_asset, "no_source_asset").otherwise("not_accepted").cast("string")


def escalates(flags: Column, mode: Column) -> Column:
    """PF24: whether a text result should go to a visual recogniser."""
    bad = F.array(*[F.lit(f"formula_{x}") for x in ("low_confidence", "text_layer_corrupt", "slash_glyph_suspect", "prime_glyph_suspect", "pdf_ligature_corrupt")])
    return (mode == "display") & F.arrays_overlap(flags, bad)


def spans_columns(role: Column, width: Column, page_width: Column) -> Column:
    """PF25: whether a block is set across all columns."""
    return role.isin("title", "abstract") | ((role == "formula") & (width >= page_width * 0.58))


def block_formulas(blocks: DataFrame, formulas: DataFrame) -> DataFrame:
    """Formulas of a block: those it is the source or the anchor of, or whose id it bears; three equi-joins, not one with OR. `formula_ids` sorted."""
    parts = [("source_block_id", "block_id"), ("anchor_block_id", "block_id"), ("formula_id", "formula_id")]
    out = None
    for mine, theirs in parts:
        side = formulas.select("doc_id", F.col("formula_id").alias("_f"), F.col(mine).alias("_key")).where(F.col("_key").isNotNull())
        hit = blocks.select("doc_id", F.col("block_id").alias("_b"), F.col(theirs).alias("_key")).join(side, ["doc_id", "_key"]).select("doc_id", F.col("_b").alias("block_id"), "_f")
        out = hit if out is None else out.unionByName(hit)
    return out.groupBy("doc_id", "block_id").agg(F.sort_array(F.collect_set("_f")).alias("formula_ids"))


def candidate_spans(candidates: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans of a candidate by its ids, or, for those without ids, spans of its block that its box touches and whose text it holds."""
    by_id = candidates.select("doc_id", "candidate_id", F.explode("span_ids").alias("span_id")).join(spans.select("doc_id", "span_id"), ["doc_id", "span_id"])
    rest = candidates.where(F.size("span_ids") == 0).select("doc_id", "block_id", "candidate_id", "source_text", F.col("box").alias("_c"))
    near = rest.join(spans.select("doc_id", "block_id", "span_id", "text", "box"), ["doc_id", "block_id"]).where((g.intersection(F.col("_c"), F.col("box")) > 0) & F.col("source_text").contains(F.trim("text")) & (F.trim("text") != ""))
    return by_id.select("doc_id", "candidate_id", "span_id").unionByName(near.select("doc_id", "candidate_id", "span_id"))


def overflow_heights(overflows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Measured heights by block signature, or by block id where the signature is new: the most needed for each block."""
    by_sig = overflows.groupBy("signature").agg(F.max("height").alias("_s"))
    by_id = overflows.groupBy("block_id").agg(F.max("height").alias("_i"))
    return blocks.join(by_sig, "signature", "left").join(by_id, "block_id", "left").select("block_id", "signature", F.coalesce("_s", "_i").alias("height")).where("height is not null")


def unique_ids(rows: DataFrame, base: str, order: str) -> DataFrame:
    """Ids that are taken get _2, _3, ... in order."""
    n = F.row_number().over(W.partitionBy("doc_id", base).orderBy(order))
    return rows.withColumn("_n", n).withColumn("id", F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), F.col("_n").cast("string")))).drop("_n")


def shifted_ranges(members: DataFrame, formulas: DataFrame) -> DataFrame:
    """Formulas of merged blocks (`cluster_id`, `pos`, `block_id`, `text`) on their cluster's text: ranges moved by what stands before, a space between blocks."""
    before = W.partitionBy("doc_id", "cluster_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    placed = members.withColumn("_off", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))
    return formulas.join(placed.select("doc_id", "block_id", "cluster_id", "_off"), ["doc_id", "block_id"]).withColumns({"start": F.col("start") + F.col("_off"), "end": F.col("end") + F.col("_off")}).drop("_off")


def primary_block(members: DataFrame) -> DataFrame:
    """AG14: the block that stands for a cluster: display formulas first, then the earliest, the widest, and the most signs."""
    rank = F.struct((F.col("mode") == "display").alias("d"), (-F.col("pos")).alias("p"), F.col("width").alias("w"), F.col("signals").alias("s"))
    return members.groupBy("doc_id", "cluster_id").agg(F.max_by("block_id", rank).alias("block_id"))


def mean_confidence(blocks: DataFrame, assets: DataFrame) -> DataFrame:
    """AG10: the mean of block and asset signals' confidence per document, to 4 digits."""
    both = blocks.select("doc_id", "confidence").unionByName(assets.select("doc_id", "confidence"))
    return both.groupBy("doc_id").agg(F.bround(F.avg("confidence"), 4).alias("confidence"))


def column_issues(traces: DataFrame, layouts: DataFrame, start: float = 0.15, underfilled: float = 0.45) -> DataFrame:
    """AG17: what is wrong with the flow of two columns: `doc_id`, `page_id`, `kind`, `left_bottom`, `right_top`, `left_whitespace`.

    `traces`: (`doc_id`, `page_id`, `pos`, `span`, `column`, `box`); those that span one column count. `layouts`: (`doc_id`, `mode`, `column_count`, `height`,
    `margin_top`, `margin_bottom`); only documents of mode continuous_reflow in two columns are looked at. right_column_page_start: the first item of a page, by y, x
    and place, stands in the right column. left_column_underfilled_before_right_column: the right column begins near the top (within `start` of the content's
    height), the left one leaves `underfilled` of it empty, and the right one goes 24 points deeper. Numbers to 4 digits, null for the first kind.
    """
    two = layouts.where((F.col("mode") == "continuous_reflow") & (F.col("column_count") == 2))
    bottom = F.when(F.col("height") > F.col("margin_bottom"), F.col("height") - F.col("margin_bottom")).otherwise(0.0)
    two = two.select("doc_id", F.coalesce("margin_top", F.lit(0.0)).alias("_top"), bottom.alias("_bottom"))
    column = lambda n, f, c: f(F.when(F.col("column") == n, F.col(c)))
    page = traces.where((F.col("span") == "column") & F.col("column").isin(0, 1) & F.col("page_id").isNotNull()).groupBy("doc_id", "page_id").agg(
        F.min_by("column", F.struct("box.y0", "box.x0", "pos")).alias("_first"),
        column(1, F.min, "box.y0").alias("right_top"),
        column(1, F.max, "box.y1").alias("_right"),
        column(0, F.max, "box.y1").alias("_left"),
    )
    page = page.join(two, "doc_id").withColumn("left_bottom", F.coalesce("_left", "_top")).withColumn("_high", F.greatest(F.lit(1.0), F.col("_bottom") - F.col("_top")))
    page = page.withColumn("left_whitespace", F.greatest(F.lit(0.0), F.col("_bottom") - F.col("left_bottom")) / F.col("_high"))
    left = F.col("right_top").isNotNull() & (F.col("right_top") <= F.col("_top") + F.col("_high") * start) & (F.col("left_whitespace") >= underfilled) & (F.col("_right") > F.col("left_bottom") + 24.0)
    number = [F.bround(c, 4).alias(c) for c in ("left_bottom", "right_top", "left_whitespace")]
    none = [F.lit(None).cast("double").alias(c) for c in ("left_bottom", "right_top", "left_whitespace")]
    first = page.where("_first = 1").select("doc_id", "page_id", F.lit("right_column_page_start").alias("kind"), *none)
    return first.unionByName(page.where(left).select("doc_id", "page_id", F.lit("left_column_underfilled_before_right_column").alias("kind"), *number))


# Key phrases: two to five words of three letters and more (four, if the word begins small), but for those that begin so.
PHRASE_WORD = r"(?:[A-Z][A-Za-z0-9-]{2,}|[a-z][A-Za-z0-9-]{3,})"
PHRASE = rf"\b{PHRASE_WORD}(?:\s+{PHRASE_WORD}){{1,4}}\b"
NO_PHRASE = ("this ", "that ", "these ")


def key_phrases(text: Column, most: int = 12) -> Column:
    """SL02: the first distinct key phrases of a text, squeezed, in order."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"(?U){PHRASE}"), F.lit(0)), squeeze))
    kept = F.filter(found, lambda x: ~(F.lower(x).startswith(NO_PHRASE[0]) | F.lower(x).startswith(NO_PHRASE[1]) | F.lower(x).startswith(NO_PHRASE[2])))
    return F.slice(kept, 1, most)


def provider_order(providers: Column, visual: list[str]) -> Column:
    """SL05: visual providers first, else as they were."""
    return F.concat(F.filter(providers, lambda p: p.isin(visual)), F.filter(providers, lambda p: ~p.isin(visual)))


def merged_counts(a: Column, b: Column) -> Column:
    """AG15: two maps of counts added up."""
    keys = F.array_distinct(F.concat(F.map_keys(a), F.map_keys(b)))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(a[k], F.lit(0)) + F.coalesce(b[k], F.lit(0))))


def continuation_ids(ids: DataFrame, column: str) -> DataFrame:
    """SO03: distinct ids with the mark of a continuation taken off."""
    return ids.select(F.element_at(F.split(column, "__cont_"), 1).alias(column)).distinct()


def copied_document(rows: DataFrame, new_id: str, path_col: str = "path") -> DataFrame:
    """Rows of a document as rows of a copy: the id and the id's folder in paths are replaced."""
    return rows.withColumn(path_col, F.replace(path_col, F.concat(F.lit("/"), F.col("doc_id"), F.lit("/")), F.lit(f"/{new_id}/"))).withColumn("doc_id", F.lit(new_id))
