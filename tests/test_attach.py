"""Formulas written back into their document."""

from quire.operators import attach

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
BLOCK = f"doc_id int, page_id int, block_id int, role string, text string, formula_id string, box {BOX}"
ASSET = f"doc_id int, page_id int, asset_id string, kind string, alt_text string, formula_id string, path string, box {BOX}"
FORMULA = "doc_id int, page_id int, formula_id string, n int, mode string, source_block_id int, anchor_block_id int, start int, end int, source_text string, asset_id string, latex string, quality_flags array<string>"


def test_a_text_found_in_another_reference(spark):
    """The second formula's text, one letter, stands first in the reference of the first; doing it again changes nothing, and a new one is still put in."""
    row = lambda i, n, start, end, text: (1, 0, i, n, "inline", None, 0, start, end, text, None, "x", [])
    tables = spark.createDataFrame([(1, 0, 0, "paragraph", "Reea", None, None)], BLOCK), spark.createDataFrame([], ASSET)
    first, second, third = row("i1", 2, 0, 3, "Ree"), row("j1", 3, None, None, "a"), row("k1", 4, None, None, "mul")
    new = spark.createDataFrame([first, second], FORMULA)
    once = attach.attach(attach.Document(*tables, spark.createDataFrame([], FORMULA)), new)
    twice = attach.attach(once, new)
    want = "{{formul{{formula:j1}}:i1}}a"
    text = lambda d: [r["text"] for r in d.blocks.collect()]
    assert text(once) == text(twice) == [want]
    more = attach.attach(twice, spark.createDataFrame([first, second, third], FORMULA))
    assert text(more) == [want.replace("mul", "{{formula:k1}}", 1)]
