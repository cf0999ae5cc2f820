"""Plain-text sources: paragraphs or lines as blocks, and virtual pages for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.predicates import text_role
from quire.functions.text import squeeze

#: Page size, margin and gap between blocks in points, and font size.
PAGE = {"width": 612.0, "height": 792.0, "margin": 54.0, "gap": 10.0, "font": 10.5}


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: str = "paragraph") -> DataFrame:
    """IO05: `doc_id`, `pos` int from 0, `text`, `role` of each block of a text.

    `by`: "paragraph" splits at blank lines; "line", an extension, at every line feed. Carriage
    returns count as line feeds; blocks are squeezed and blank ones dropped. Null and blank texts have no blocks.
    """
    pattern = {"paragraph": r"\n\s*\n+", "line": r"\n"}[by]
    whole = F.regexp_replace(F.regexp_replace(F.col(text_col), "\r\n", "\n"), "\r", "\n")
    parts = F.filter(F.transform(F.split(whole, pattern), squeeze), lambda t: t != "")
    each = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(parts).alias("pos", "text"))
    return each.withColumn("role", text_role(F.col("text"), F.col("pos")))


def block_height(text: Column, role: Column, font: float = PAGE["font"], width: float = PAGE["width"] - 2 * PAGE["margin"]) -> Column:
    """IO06: the height a block is given on a virtual page."""
    units = max(1, int(width / max(font, 1)))
    lines = F.greatest(F.lit(1), F.floor(F.length(text) / units) + 1)
    return F.greatest(F.lit(24.0), lines * font * F.when(role.isin("title", "heading"), 1.4).otherwise(1.25))


def virtual_pages(blocks: DataFrame, page: dict = PAGE) -> DataFrame:
    """IO06: adds `page_no` int from 1, `y0`, `y1` double to blocks (`doc_id`, `pos`, `text`, `role`).

    A cursor runs down the page; a block that would pass the bottom margin begins a new page, unless the page is
    empty. The break depends on all before it, so it is an ordered fold over the heights of a document's blocks, which keeps
    the starts of pages only; places on a page are running sums.
    """
    top, bottom, gap = page["margin"], page["height"] - page["margin"], page["gap"]
    rows = blocks.withColumn("h", block_height(F.col("text"), F.col("role"), page["font"], page["width"] - 2 * page["margin"]))
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("b"))
    start = F.struct(F.lit(0).alias("n"), F.lit(top).alias("y"), F.array().cast("array<int>").alias("starts"))

    def place(acc, b):
        turn = (acc["n"] == 0) | (acc["y"] + b["h"] > bottom)
        return F.struct((acc["n"] + 1).alias("n"), (F.when(turn, top).otherwise(acc["y"]) + b["h"] + gap).alias("y"), F.when(turn, F.concat(acc["starts"], F.array(b["pos"].cast("int")))).otherwise(acc["starts"]).alias("starts"))

    folded = docs.select("doc_id", F.aggregate("b", start, place, lambda a: a["starts"]).alias("starts"))
    turns = folded.select("doc_id", F.explode("starts").alias("pos"), F.lit(1).alias("_turn"))
    by_doc = W.partitionBy("doc_id").orderBy("pos")
    paged = rows.join(turns, ["doc_id", "pos"], "left").withColumn("page_no", F.count("_turn").over(by_doc.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    before = F.sum(F.col("h") + gap).over(W.partitionBy("doc_id", "page_no").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    placed = paged.withColumn("y0", F.lit(top) + F.coalesce(before, F.lit(0.0)))
    return placed.select("doc_id", "pos", "text", "role", "page_no", "y0", F.least(F.lit(bottom), F.col("y0") + F.col("h")).alias("y1"))
