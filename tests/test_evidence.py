from pyspark.sql import functions as F

from quire.functions import model_answers as m
from quire.operators import evidence as e

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_model_answers(spark):
    rows = [('Sure: ```{"a": {"x": 1}} {"blocks": [], "n": 2}```', '{"a": {"bbox": [1], "t": "u"}, "x": 3}', '{"text": "cut \\"off', '{"latex": "x", "confidence": 7}')]
    r = spark.createDataFrame(rows, "a string, b string, c string, d string").select(
        m.first_object(F.col("a"), "blocks").alias("o"), m.without_layout_keys(F.col("b")).alias("s"), m.has_layout_keys(F.col("b")).alias("h"), m.salvaged(F.col("c"), "text").alias("t"), m.recognition(F.col("d")).alias("r"), m.first_object(F.col("c"), "q").alias("none")
    ).first()
    assert r["o"] == '{"blocks": [], "n": 2}' and r["s"] == '{"a": {"t": "u"}}' and r["h"]
    assert r["t"] == 'cut "off' and r["r"]["confidence"] == 1.0 and r["none"] is None


def test_blocks_and_formulas(spark):
    b = spark.createDataFrame([("d", "b1", None), ("d", "b2", "f3")], "doc_id string, block_id string, formula_id string")
    f = spark.createDataFrame([("d", "f1", "b1", "b1"), ("d", "f2", None, "b1"), ("d", "f3", None, None)], "doc_id string, formula_id string, source_block_id string, anchor_block_id string")
    assert {r["block_id"]: r["formula_ids"] for r in e.block_formulas(b, f).collect()} == {"b1": ["f1", "f2"], "b2": ["f3"]}


def test_ranges_ids_and_columns(spark):
    members = spark.createDataFrame([("d", "c", 0, "b1", "abc"), ("d", "c", 1, "b2", "defg")], "doc_id string, cluster_id string, pos int, block_id string, text string")
    f = spark.createDataFrame([("d", "b2", 1, 3)], "doc_id string, block_id string, start int, end int")
    assert e.shifted_ranges(members, f).select("start", "end").first() == (5, 7)
    ids = spark.createDataFrame([("d", "s", 1), ("d", "s", 2), ("d", "t", 3)], "doc_id string, base string, pos int")
    assert [r["id"] for r in e.unique_ids(ids, "base", "pos").orderBy("pos").collect()] == ["s", "s_2", "t"]


def test_column_flow(spark):
    t = spark.createDataFrame([("d", "p", 0, "column", 1, (300.0, 50.0, 500.0, 90.0)), ("d", "q", 1, "column", 0, (50.0, 60.0, 250.0, 100.0)), ("d", "q", 2, "column", 1, (300.0, 70.0, 500.0, 400.0)), ("d", "q", 3, "page", 1, (0.0, 0.0, 9.0, 9.0)), ("e", "r", 0, "column", 1, (300.0, 50.0, 500.0, 90.0))], f"doc_id string, page_id string, pos int, span string, column int, box {BOX}")
    layouts = spark.createDataFrame([("d", "continuous_reflow", 2, 700.0, 50.0, 50.0), ("e", "continuous_reflow", 1, 700.0, 50.0, 50.0)], "doc_id string, mode string, column_count int, height double, margin_top double, margin_bottom double")
    got = {(r["page_id"], r["kind"]): r for r in e.column_issues(t, layouts).collect()}
    assert set(got) == {("p", "right_column_page_start"), ("p", "left_column_underfilled_before_right_column"), ("q", "left_column_underfilled_before_right_column")}
    r = got["q", "left_column_underfilled_before_right_column"]
    assert (r["left_bottom"], r["right_top"], r["left_whitespace"]) == (100.0, 70.0, 0.9167)


def test_pictures_that_may_be_formulas(spark):
    rows = [((100.0, 300.0, 200.0, 330.0), "", True), ((100.0, 20.0, 200.0, 60.0), "", False), ((100.0, 20.0, 250.0, 120.0), "", True), ((100.0, 760.0, 200.0, 790.0), "", False), ((100.0, 300.0, 120.0, 330.0), "", False), ((100.0, 300.0, 200.0, 330.0), "Header line", False)]
    df = spark.createDataFrame([(b, a) for b, a, _ in rows], f"box {BOX}, alt string")
    assert [r["x"] for r in df.select(e.formula_asset(F.col("box"), F.col("alt"), F.lit(800.0)).alias("x")).collect()] == [x for *_, x in rows]


def test_what_is_left_out_when_pages_are_set(spark):
    big, tiny, thin = (0.0, 0.0, 200.0, 20.0), (0.0, 0.0, 10.0, 10.0), (0.0, 0.0, 6.0, 50.0)
    rows = [("© The authors 2024", "x", "paragraph", big, "", False), ("© Authors 2024", "x", "paragraph", big, "", True), ("see doi:10.1/x J. phys", "x", "paragraph", big, "", False), ("see doi:10.1/x j. Phys", "x", "paragraph", big, "", True), ("in 2024", "x", "paragraph", thin, "", True), ("doi: 10.1", "x", "footnote", big, "", True), ("View Online here", "x", "paragraph", big, "", True), ("–12", "", "unknown", tiny, "", True), ("–12", "x", "unknown", tiny, "", False), ("α", "", "paragraph", tiny, "CMR10", True), ("α", "", "paragraph", tiny, "Arial", False), ("12", "", "heading", tiny, "", False), ("  ", "x", "paragraph", big, "", True)]
    df = spark.createDataFrame([r[:-1] for r in rows], f"t string, u string, role string, box {BOX}, font string")
    assert [r["x"] for r in df.select(e.suppressed(F.col("t"), F.col("u"), F.col("role"), F.col("box"), F.col("font")).alias("x")).collect()] == [r[-1] for r in rows]


def test_small_helpers(spark):
    r = spark.range(1).select(
        e.provider_order(F.array(*map(F.lit, "abc")), ["c"]).alias("p"), e.key_phrases(F.lit("Large models learn well. This other thing is new. Large models learn well. An Of"), most=3).alias("k"),
        e.merged_counts(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3))).alias("m"), e.attachment(F.lit(False), F.lit("text"), F.lit(False), F.lit(0.9)).alias("w"),
    ).first()
    assert r["p"] == ["c", "a", "b"] and r["k"] == ["Large models learn well"] and r["m"] == {"a": 3, "b": 3} and r["w"] == "no_source_asset"
