"""Documents from the JSON that page-layout extractors write: pages of typed items with lines and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.geometry import normalise
from quire.functions.text import repair, strip_tags

SPAN = "struct<type:string,content:string,text:string,latex:string,bbox:array<double>>"
ITEM = f"struct<type:string,index:int,bbox:array<double>,text:string,content:string,html:string,table_body:string,img_path:string,lines:array<struct<bbox:array<double>,spans:array<{SPAN}>>>>"
SCHEMA = f"pdf_info array<struct<page_idx:int,page_size:array<double>,para_blocks:array<{ITEM}>,images:array<{ITEM}>,tables:array<{ITEM}>,interline_equations:array<{ITEM}>,discarded_blocks:array<{ITEM}>>>"
# Item types by what they become.
ROLES = {
    "title": "heading", "text": "paragraph", "list": "paragraph", "index": "paragraph", "interline_equation": "formula", "equation": "formula",
    "image": "figure", "chart": "figure", "table": "table", "image_caption": "caption", "table_caption": "caption", "table_footnote": "footnote", "image_footnote": "footnote",
}
AUXILIARY = ("header", "footer", "page_number", "aside_text", "page_footnote", "discarded")


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """IO02: one row per file: `doc_id` (its folder), `pages`; of a folder's files the newest."""
    rows = spark.read.schema(SCHEMA).option("multiLine", "true").json(path).select("pdf_info", F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_modification_time").alias("m"))
    doc = F.regexp_extract("p", r"([^/]+)/[^/]+$", 1)
    return rows.groupBy(doc.alias("doc_id")).agg(F.max_by("pdf_info", F.struct("m", "p")).alias("pages"))


def items(layout: DataFrame) -> DataFrame:
    """IO03: items in order: `doc_id`, `page_index`, `pos`, `item`; the page's lists are put together, ordered by (index, y, x), and repeats
    (type, box, index, first 80 characters) are dropped after the first."""
    page = layout.select("doc_id", F.explode("pages").alias("p"))
    none = F.array().cast(f"array<{ITEM}>")
    every = F.concat(*[F.coalesce(F.col(f"p.{c}"), none) for c in ("para_blocks", "images", "tables", "interline_equations")])
    each = page.select("doc_id", F.col("p.page_idx").alias("page_index"), F.col("p.page_size").alias("size"), F.posexplode(every).alias("_i", "item"))
    key = [F.col("item.type"), F.col("item.bbox"), F.col("item.index"), F.substring(item_text(F.col("item")), 1, 80)]
    page_w = ["doc_id", "page_index"]
    once = each.withColumn("_k", F.row_number().over(W.partitionBy(*page_w, *key).orderBy("_i"))).where("_k = 1")
    order = W.partitionBy(*page_w).orderBy(F.coalesce("item.index", F.lit(1_000_000)), F.col("item.bbox")[1], F.col("item.bbox")[0], "_i")
    return once.withColumn("pos", F.row_number().over(order) - 1).select(*page_w, "size", "pos", "item")


def item_text(item):
    """IO04: the text of an item: its lines' spans, else its text, content or table."""
    lines = F.transform(item["lines"], lambda x: F.array_join(F.transform(x["spans"], lambda s: F.coalesce(s["content"], s["text"], s["latex"], F.lit(""))), " "))
    joined = F.array_join(lines, " ")
    return repair(F.coalesce(F.when(F.trim(joined) != "", joined), item["text"], item["content"], strip_tags(F.coalesce(item["html"], item["table_body"])), F.lit("")))


def blocks(layout: DataFrame) -> DataFrame:
    """IO20: text blocks, formulas and assets of items: `doc_id`, `page_index`, `pos`, `role`, `text`, `box`, `asset_path`; items without text and picture, or of auxiliary types, are dropped."""
    role = F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), F.col("item.type"))
    out = items(layout).where(~F.col("item.type").isin(*AUXILIARY)).select("doc_id", "page_index", "pos", F.coalesce(role, F.lit("unknown")).alias("role"), item_text(F.col("item")).alias("text"), normalise(F.col("item.bbox"), F.col("size")[0], F.col("size")[1]).alias("box"), F.col("item.img_path").alias("asset_path"))
    return out.where((F.col("text") != "") | F.col("asset_path").isNotNull())


def discarded(layout: DataFrame) -> DataFrame:
    """IO02: how many auxiliary items of each document are left out."""
    page = layout.select("doc_id", F.explode("pages").alias("p"))
    return page.groupBy("doc_id").agg(F.sum(F.coalesce(F.size("p.discarded_blocks"), F.lit(0))).alias("n_discarded"))


def spans(layout: DataFrame) -> DataFrame:
    """IO20: spans of items with their place in the item's text (a space between spans): `doc_id`, `page_index`, `pos`, `n`, `type`, `text`, `start`."""
    each = items(layout).select("doc_id", "page_index", "pos", F.posexplode(F.flatten(F.transform("item.lines", lambda x: x["spans"]))).alias("n", "s"))
    text = F.coalesce("s.content", "s.text", "s.latex", F.lit(""))
    before = W.partitionBy("doc_id", "page_index", "pos").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    return each.select("doc_id", "page_index", "pos", "n", F.col("s.type").alias("type"), text.alias("text")).withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))
