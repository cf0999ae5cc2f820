"""Table schemas, as Spark DDL, and their export."""

from __future__ import annotations

import json

from pyspark.sql.types import StructType

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
TABLES = {
    "page": "doc_id string, page_id string, page_index int, width double, height double",
    "block": f"doc_id string, page_id string, block_id string, role string, box {BOX}, reading_order int, text string, font_size double, formula_id string",
    "span": f"doc_id string, block_id string, span_id string, text string, box {BOX}, font string, size double",
    "asset": f"doc_id string, page_id string, asset_id string, kind string, box {BOX}, path string, alt_text string",
    "formula": "doc_id string, formula_id string, page_id string, source_block_id string, anchor_block_id string, asset_id string, latex string, source_text string, start int, end int, mode string, confidence double, flags array<string>",
    "source_block": "doc_id string, chunk_no int, pos int, role string, text string, nearby_titles array<string>, preserve_tokens array<string>, requires_translation boolean",
    "plan_block": "doc_id string, chunk_no int, pos int, role string, target_lang string, translated_text string, inline_items array<struct<kind:string,text:string>>, render_intent string, quality_flags array<string>",
    "section": "doc_id string, section_id string, pos int, kind string, title string, level int, flags array<string>",
    "job": "job_id string, doc_id string, state string, progress double, message string",
    "job_event": "job_id string, id string, sequence long, source string, level string, phase string, message string",
}
#: Keys that describe layout and may not stand in a model's answer.
LAYOUT_KEYS = ("bbox", "x", "y", "x0", "y0", "x1", "y1", "width", "height", "left", "top", "right", "bottom", "page_number", "coordinates", "position", "column", "line_height")


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def export() -> str:
    """IO24: all schemas as JSON."""
    return json.dumps({name: schema(name).jsonValue() for name in TABLES}, sort_keys=True)
