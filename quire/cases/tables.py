"""Cases of joins, aggregations, windows and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.cases.common import query
from quire.functions import geometry, ids, predicates
from quire.operators import chunks, evidence, formulas, integrity, jobs, layout, sections
from quire.plans import translation
from quire.registry import BOXES, BROKEN, CHUNKS, LINES, SECTIONS, TRANSLATED, box_pages, boxes, broken_plan, line_blocks, source_blocks
from quire.session import table

# --- geometry ------------------------------------------------------------------------------------------

PAIRS = f"{BOXES}, p AS (SELECT a.doc_id, a.page_id, a.item_id AS first_id, b.item_id AS second_id, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1 FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.page_id = b.page_id AND a.item_id < b.item_id)"


def pairs(spark, sf_dir):
    """Each two boxes of a page."""
    b = boxes(spark, sf_dir).select("doc_id", "page_id", "item_id", "box")
    other = b.select("doc_id", "page_id", F.col("item_id").alias("second_id"), F.col("box").alias("other"))
    return b.withColumnRenamed("item_id", "first_id").join(other, ["doc_id", "page_id"]).where("first_id < second_id")


@query(
    f"""
WITH {PAIRS}, g AS (SELECT first_id, second_id, greatest(0.0, by0 - ay1, ay0 - by1) AS apart, greatest(0.0, least(ax1, bx1) - greatest(ax0, bx0)) AS w, greatest(0.0, least(ay1, by1) - greatest(ay0, by0)) AS h,
  least(ax1 - ax0, bx1 - bx0) AS narrow, (ax1 - ax0) * (ay1 - ay0) AS area FROM p)
SELECT first_id, second_id, apart, w / greatest(1.0, narrow) AS across, w * h AS shared, area FROM g
"""
)
def gm01_gm02_distances(spark, sf_dir):
    a, b = F.col("box"), F.col("other")
    return pairs(spark, sf_dir).select("first_id", "second_id", geometry.vertical_distance(a, b).alias("apart"), geometry.horizontal_overlap(a, b).alias("across"), geometry.intersection(a, b).alias("shared"), geometry.area(a).alias("area"))


@query(f"WITH {BOXES} SELECT doc_id, page_id, item_id, x0 + (x1 - x0) / 20 * 3 AS x0, greatest(x0 + (x1 - x0) / 20 * 3 + 3, x0 + (x1 - x0) / 20 * 9) AS x1, least(1.0, 50 / greatest(x1 - x0, 0.01), 40 / greatest(y1 - y0, 0.01)) AS scale FROM boxes")
def gm04_gm07_ranges_and_fits(spark, sf_dir):
    part = geometry.range_box(F.col("box"), F.lit(3), F.lit(9), F.lit(20))
    return boxes(spark, sf_dir).select("doc_id", "page_id", "item_id", part["x0"].alias("x0"), part["x1"].alias("x1"), geometry.fit(geometry.width(F.col("box")), geometry.height(F.col("box")), F.lit(50.0), F.lit(40.0)).alias("scale"))


@query(
    f"""
WITH {BOXES}, n AS (SELECT item_id, kind, doc_id, page_id, x0 / 1000 AS a, y0 / 1000 AS b, x1 / 1000 AS c, y1 / 1000 AS d FROM boxes), s AS (SELECT *, least(greatest(a * 612, 0), 612.0) AS nx0, least(greatest(b * 792, 0), 792.0) AS ny0, least(greatest(c * 612, 0), 612.0) AS nx1, least(greatest(d * 792, 0), 792.0) AS ny1 FROM n)
SELECT item_id, doc_id, page_id, kind, CASE WHEN nx1 > nx0 AND ny1 > ny0 THEN nx0 END AS x0, CASE WHEN nx1 > nx0 AND ny1 > ny0 THEN ny0 END AS y0, CASE WHEN nx1 > nx0 AND ny1 > ny0 THEN nx1 END AS x1, CASE WHEN nx1 > nx0 AND ny1 > ny0 THEN ny1 END AS y1 FROM s
"""
)
def gm03_boxes_in_points(spark, sf_dir):
    four = F.array(*[F.col("box")[c] / 1000 for c in ("x0", "y0", "x1", "y1")])
    out = boxes(spark, sf_dir).select("item_id", "doc_id", "page_id", "kind", geometry.normalise(four, F.lit(612.0), F.lit(792.0)).alias("b"))
    return out.select("item_id", "doc_id", "page_id", "kind", "b.*")


@query(f"WITH {BOXES} SELECT doc_id, page_id, kind, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes GROUP BY ALL")
def ag11_union_boxes(spark, sf_dir):
    return layout.union_box(boxes(spark, sf_dir), ["doc_id", "page_id", "kind"]).select("doc_id", "page_id", "kind", "box.*")


@query(f"WITH {BOXES} SELECT doc_id, page_id, item_id, kind, page_id || '_b' || substr(sha1(page_id || '|' || printf('%.1f,%.1f,%.1f,%.1f', x0, y0, x1, y1) || '|' || item_id), 1, 12) AS block_id FROM boxes")
def hs01_block_ids(spark, sf_dir):
    return boxes(spark, sf_dir).select("doc_id", "page_id", "item_id", "kind", ids.block_id(F.col("page_id").cast("string"), F.col("box"), F.col("item_id")).alias("block_id"))


@query(
    f"""
WITH {BOXES}, s AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h, CASE kind WHEN 'table' THEN 'A Banner' ELSE 'shape' END AS alt FROM boxes)
SELECT doc_id, page_id, item_id, kind, kind <> 'table' AND w * h BETWEEN 180 AND 80000 AND w / h BETWEEN 1.4 AND 16 AND h <= 110 AND NOT (y0 <= 84 AND (h <= 70 OR w / h >= 4)) AND NOT (y1 >= 644 AND h <= 70) AS formula FROM s
"""
)
def pf09_formula_pictures(spark, sf_dir):
    alt = F.when(F.col("kind") == "table", "A Banner").otherwise("shape")
    return boxes(spark, sf_dir).select("doc_id", "page_id", "item_id", "kind", evidence.formula_asset(F.col("box"), alt, F.lit(700.0)).alias("formula"))


PUBLISHED = ("© Authors 2024", "see doi:10.1/x in j. Phys", "in 2024", "Doi: 10.5", "Crossmark", "12", "α", "plain text", " ", "−3")


@query(
    f"""
WITH b AS (SELECT event_id, [{", ".join("'" + x + "'" for x in PUBLISHED)}][event_id % 10 + 1] AS t, CASE event_id % 3 WHEN 0 THEN 'footnote' WHEN 1 THEN 'paragraph' ELSE 'heading' END AS role, CAST(event_id % 20 AS DOUBLE) AS w, CAST(event_id % 60 AS DOUBLE) AS h, CASE event_id % 2 WHEN 0 THEN 'CMMI' ELSE 'Arial' END AS font, CASE event_id % 4 WHEN 0 THEN 'x' ELSE '' END AS u FROM events)
SELECT event_id, trim(t) = '' OR regexp_matches(t, '(?i)^©\\s*authors?\\b') OR (lower(t) LIKE '%doi:%' AND regexp_matches(t, '\\bj\\.\\s+[A-Za-z]')) OR (w <= 8 AND h >= 40 AND regexp_matches(t, '\\d{{4}}')) OR (role = 'footnote' AND regexp_matches(lower(t), '\\bdoi:\\s*\\S+')) OR lower(t) LIKE 'crossmark%'
  OR (role <> 'heading' AND u = '' AND w <= 16 AND h <= 24 AND (regexp_full_match(replace(t, '−', '-'), '[+-]?\\d{{1,4}}') OR (font = 'CMMI' AND t = 'α'))) AS suppressed FROM b
"""
)
def pf13_suppressed(spark, sf_dir):
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (n % 20).cast("double").alias("x1"), (n % 60).cast("double").alias("y1"))
    role = F.when(n % 3 == 0, "footnote").when(n % 3 == 1, "paragraph").otherwise("heading")
    text = F.element_at(F.array(*map(F.lit, PUBLISHED)), (n % 10 + 1).cast("int"))
    return e.select("event_id", evidence.suppressed(text, F.when(n % 4 == 0, "x").otherwise(""), role, box, F.when(n % 2 == 0, "CMMI").otherwise("Arial")).alias("suppressed"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 AND event_id % 3 <> 0 THEN NULL WHEN value < 50 THEN 'low_confidence' WHEN event_id % 3 = 0 THEN 'no_source_asset' ELSE 'not_accepted' END AS refused, event_id % 2 = 1 AND event_type = 'error' AS escalated, event_type IN ('click', 'view') OR (event_type = 'error' AND value >= 58) AS whole_width FROM events")
def pf23_pf24_pf25_decisions(spark, sf_dir):
    n, v = F.col("event_id"), F.coalesce(F.col("value"), F.lit(0.0))
    flags = F.array(F.when(F.col("event_type") == "error", "formula_text_layer_corrupt").otherwise("formula_latex_normalized"))
    role = F.when(F.col("event_type") == "click", "title").when(F.col("event_type") == "view", "abstract").when(F.col("event_type") == "error", "formula").otherwise("paragraph")
    return table(spark, sf_dir, "events").select(
        "event_id",
        evidence.attachment(n % 5 == 0, F.when(n % 2 == 0, "image").otherwise("text"), n % 3 != 0, F.col("value"), 50.0).alias("refused"),
        evidence.escalates(flags, F.when(n % 2 == 1, "display").otherwise("inline")).alias("escalated"),
        F.coalesce(evidence.spans_columns(role, v, F.lit(100.0)), F.lit(False)).alias("whole_width"),
    )


@query(
    """
WITH b AS (SELECT DISTINCT l_orderkey AS page_id, CAST(floor(l_orderkey / 4) AS BIGINT) AS doc_id, l_linenumber AS pos, l_suppkey % 2 AS col, CAST((l_suppkey * 37 + l_linenumber * 61) % 300 + 50 AS DOUBLE) AS y0, CAST(l_partkey % 400 AS DOUBLE) AS x0, CAST((l_suppkey * 37 + l_linenumber * 61) % 300 + 60 + l_partkey % 60 AS DOUBLE) AS y1 FROM lineitem WHERE l_returnflag <> 'A'),
p AS (SELECT doc_id, page_id, arg_min(col, y0 * 1000000 + x0 * 1000 + pos) AS f, min(y0) FILTER (col = 1) AS rt, max(y1) FILTER (col = 1) AS rb, coalesce(max(y1) FILTER (col = 0), 50.0) AS lb FROM b WHERE doc_id % 5 <> 0 GROUP BY ALL)
SELECT doc_id, page_id, 'right_column_page_start' AS kind, NULL::DOUBLE AS left_bottom, NULL::DOUBLE AS left_whitespace FROM p WHERE f = 1
UNION ALL SELECT doc_id, page_id, 'left_column_underfilled_before_right_column', lb, round((650 - lb) / 600, 4) FROM p WHERE rt IS NOT NULL AND rt <= 50 + 600 * 0.15 AND greatest(0, 650 - lb) / 600 >= 0.45 AND rb > lb + 24
"""
)
def ag17_column_flow(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    y = ((F.col("l_suppkey") * 37 + F.col("l_linenumber") * 61) % 300 + 50).cast("double")
    x = (F.col("l_partkey") % 400).cast("double")
    box = F.struct(x.alias("x0"), y.alias("y0"), (x + 50).alias("x1"), (y + 10 + F.col("l_partkey") % 60).alias("y1"))
    span = F.when(F.col("l_returnflag") == "A", "page").otherwise("column")
    doc = F.floor(F.col("l_orderkey") / 4).cast("long")
    traces = i.select(doc.alias("doc_id"), F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("pos"), span.alias("span"), (F.col("l_suppkey") % 2).cast("int").alias("column"), box.alias("box"))
    layouts = i.select(doc.alias("doc_id")).distinct().select("doc_id", F.lit("continuous_reflow").alias("mode"), F.when(F.col("doc_id") % 5 == 0, 1).otherwise(2).alias("column_count"), F.lit(700.0).alias("height"), F.lit(50.0).alias("margin_top"), F.lit(50.0).alias("margin_bottom"))
    return evidence.column_issues(traces, layouts).select("doc_id", "page_id", "kind", "left_bottom", "left_whitespace")


@query(
    f"""
WITH {BOXES}, t AS (SELECT b.*, CASE CAST(x0 AS INTEGER) % 5 WHEN 0 THEN 'Running head' WHEN 1 THEN '© Authors 2020' WHEN 2 THEN 'see doi:10.1' ELSE item_id END AS text FROM boxes b JOIN pages_ USING (doc_id, page_id)),
r AS (SELECT doc_id, lower(text) AS low FROM t WHERE y0 <= 56 OR y1 >= 644 GROUP BY doc_id, lower(text) HAVING count(DISTINCT page_id) >= 2)
SELECT t.doc_id, t.page_id, t.item_id, t.kind FROM t LEFT JOIN r ON r.doc_id = t.doc_id AND r.low = lower(t.text)
WHERE NOT (r.low IS NOT NULL AND (y0 <= 56 OR y1 >= 644)) AND NOT (text LIKE '© Authors%') AND NOT (text LIKE '%doi:%' AND (y1 >= 644 OR y0 >= 504))
"""
)
def pf04_without_margins(spark, sf_dir):
    k = F.col("box.x0").cast("int") % 5
    text = F.when(k == 0, "Running head").when(k == 1, "© Authors 2020").when(k == 2, "see doi:10.1").otherwise(F.col("item_id"))
    return layout.without_margins(boxes(spark, sf_dir).withColumn("text", text), box_pages(spark, sf_dir)).select("doc_id", "page_id", "item_id", "kind")


@query(f"WITH {BOXES}, s AS (SELECT *, CASE WHEN kind = 'text' THEN 'caption' ELSE kind END AS k FROM boxes) SELECT doc_id, page_id, k AS flag, count(*) AS n FROM s GROUP BY ALL")
def ag06_kinds_by_page(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("flags", F.array(F.when(F.col("kind") == "text", "caption").otherwise(F.col("kind"))))
    return layout.flag_histogram(b, "flags", ["doc_id", "page_id"])


# --- blocks, sections and plans --------------------------------------------------------------------------


@query(f"WITH {LINES} SELECT doc_id, pos, CASE WHEN role IN ('title', 'heading') THEN 'emphasis' ELSE 'normal' END AS render_intent, CASE role WHEN 'title' THEN 5 WHEN 'heading' THEN 4 WHEN 'abstract' THEN 4 ELSE 3 END AS priority FROM lines")
def pf15_u13_layout_intents(spark, sf_dir):
    return sections.layout_intents(line_blocks(spark, sf_dir), "paper", True).select("doc_id", "pos", "render_intent", "priority")


@query(f"WITH {LINES}, s AS (SELECT *, pos % 5 AS p FROM lines) SELECT doc_id, pos, text FROM s WHERE p + 1 IN (2, 4)")
def pf12_pages_in_scope(spark, sf_dir):
    return evidence.in_scope(line_blocks(spark, sf_dir).withColumn("page_index", F.col("pos") % 5), pages=[2, 4]).select("doc_id", "pos", "text")


@query("SELECT DISTINCT l_orderkey AS doc_id, CAST(l_linenumber + 2 AS VARCHAR) AS block_id FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 2)")
def pf12_unknown_scope(spark, sf_dir):
    rows = lambda by: table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") + by).cast("string").alias("block_id")).distinct()
    return evidence.unknown_scope(rows(0), rows(2))


@query(f"WITH {LINES}, r AS (SELECT *, CASE WHEN pos % 3 = 0 THEN 'unknown' ELSE role END AS own FROM lines) SELECT doc_id, pos, CASE WHEN own = 'unknown' AND pos % 2 = 0 AND pos % 5 < 3 THEN 'caption' ELSE own END AS role FROM r")
def j15_signal_roles(spark, sf_dir):
    b = line_blocks(spark, sf_dir).withColumn("role", F.when(F.col("pos") % 3 == 0, "unknown").otherwise(F.col("role")))
    signals = b.where("pos % 2 = 0").select("doc_id", "pos", F.lit("caption").alias("role"), F.when(F.col("pos") % 5 < 3, 0.7).otherwise(0.3).alias("confidence"))
    return sections.with_signals(b, signals).select("doc_id", "pos", "role")


@query(
    f"""
WITH {SECTIONS}, c AS (SELECT doc_id, pos, min('cand_' || k) AS section_id FROM (SELECT doc_id, pos, pos // 4 AS k FROM sections WHERE pos % 4 < 2 UNION ALL SELECT doc_id, pos, pos // 4 + 1 FROM sections WHERE pos % 4 = 1) GROUP BY doc_id, pos)
SELECT doc_id, section_id, kind, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM (SELECT doc_id, pos, section_id, 'candidate' AS kind FROM c UNION ALL SELECT s.doc_id, s.pos, s.section_id, s.kind FROM sections s ANTI JOIN c ON s.doc_id = c.doc_id AND s.pos = c.pos) GROUP BY doc_id, section_id, kind
"""
)
def j16_merged_sections(spark, sf_dir):
    s = sections.sections(line_blocks(spark, sf_dir)).select("doc_id", "pos", "section_id", "kind")
    some = lambda where, add: s.where(where).select("doc_id", "pos", F.concat(F.lit("cand_"), (F.floor(F.col("pos") / 4) + add).cast("string")).alias("section_id"), F.lit("candidate").alias("kind"))
    out = sections.merged_sections(some("pos % 4 < 2", 0).unionByName(some("pos % 4 = 1", 1)), s)
    return out.select("doc_id", "section_id", "kind", F.array_join(F.transform("block_positions", lambda x: x.cast("string")), ",").alias("positions"))


@query(f"WITH {LINES} SELECT doc_id, pos, CASE WHEN pos % 3 <> 0 AND pos % 2 = 0 THEN 'old ' || pos ELSE {TRANSLATED('[fr] ')} END AS translated_text, pos % 3 <> 0 AND pos % 2 = 0 AS reused FROM lines")
def j22_reused_plan(spark, sf_dir):
    plan = translation.deterministic(source_blocks(spark, sf_dir), "fr")
    old = plan.where("pos % 2 = 0").select("doc_id", "pos", F.concat(F.lit("old "), F.col("pos").cast("string")).alias("translated_text"))
    return translation.reuse(plan, old, plan.where("pos % 3 = 0")).select("doc_id", "pos", "translated_text", "reused")


@query(f"WITH {LINES} SELECT doc_id, CAST(pos AS VARCHAR) AS block_id, CASE WHEN pos % 7 = 2 THEN NULL WHEN role IN ('title', 'heading') THEN 'emphasis' ELSE 'normal' END AS before, CASE WHEN pos % 5 = 1 THEN NULL ELSE 'normal' END AS after FROM lines WHERE (pos % 7 = 2) <> (pos % 5 = 1) OR (pos % 7 <> 2 AND pos % 5 <> 1 AND role IN ('title', 'heading'))")
def j26_intent_changes(spark, sf_dir):
    b = line_blocks(spark, sf_dir).withColumn("block_id", F.col("pos").cast("string"))
    before = b.where("pos % 7 <> 2").withColumn("render_intent", predicates.render_intent(F.col("role"), standard=True))
    after = b.where("pos % 5 <> 1").withColumn("render_intent", predicates.render_intent(F.col("role")))
    return layout.intent_diff(before, after)


@query(
    f"""
WITH RECURSIVE {CHUNKS}, c AS (SELECT doc_id, chunk_no, CAST(count(*) AS INTEGER) AS n_blocks, CAST(sum(len(text)) + count(*) - 1 AS BIGINT) AS n_chars FROM chunked GROUP BY doc_id, chunk_no)
SELECT doc_id, CAST(chunk_no AS INTEGER) AS index, CAST(max(chunk_no) OVER (PARTITION BY doc_id) AS INTEGER) AS total, n_blocks, n_chars FROM c
"""
)
def w16_ag18_chunks(spark, sf_dir):
    return chunks.chunk_rows(source_blocks(spark, sf_dir)).select("doc_id", "index", "total", "n_blocks", "n_chars")


@query(f"WITH {LINES}, {BROKEN}, p AS (SELECT *, CASE WHEN pos % 17 = 3 OR trim(t) = '' THEN text ELSE t END AS u FROM broken), e AS (SELECT doc_id, pos, CASE role WHEN 'title' THEN 'h1' WHEN 'heading' THEN 'h2' ELSE 'p' END AS tag, replace(replace(replace(u, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM p) SELECT doc_id, md5('<!doctype html>' || chr(10) || string_agg('<' || tag || '>' || t || '</' || tag || '>', chr(10) ORDER BY pos)) AS html_md5 FROM e GROUP BY doc_id")
def io21_html_of_documents(spark, sf_dir):
    from quire.sources.files import html_pages

    return html_pages(translation.rendered(line_blocks(spark, sf_dir), broken_plan(spark, sf_dir))).select("doc_id", F.md5(F.col("html").cast("binary")).alias("html_md5"))


# --- formulas, spans and ids -----------------------------------------------------------------------------


def formula_rows(spark, sf_dir):
    """Line items as formulas of their order: `doc_id`, `formula_id`, blocks and assets by line number, page by supplier."""
    i = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    return i.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("f"), n.cast("string")).alias("formula_id"), (F.col("l_suppkey") % 3).alias("page_id"), F.when(n % 2 == 0, F.concat(F.lit("b"), n.cast("string"))).alias("source_block_id"), F.concat(F.lit("b"), (n + 1).cast("string")).alias("anchor_block_id"), F.concat(F.lit("a"), n.cast("string")).alias("asset_id"))


def line_rows(spark, sf_dir, key, prefix):
    i = table(spark, sf_dir, "lineitem")
    return i.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit(prefix), F.col("l_linenumber").cast("string")).alias(key), (F.col("l_partkey") % 3).alias("page_id"))


FORMULA_ROWS = """f AS (SELECT l_orderkey AS doc_id, 'f' || l_linenumber AS formula_id, l_suppkey % 3 AS page_id, CASE WHEN l_linenumber % 2 = 0 THEN 'b' || l_linenumber END AS source_block_id, 'b' || (l_linenumber + 1) AS anchor_block_id, 'a' || l_linenumber AS asset_id FROM lineitem),
b AS (SELECT l_orderkey AS doc_id, 'b' || l_linenumber AS block_id, l_partkey % 3 AS page_id FROM lineitem), a AS (SELECT l_orderkey AS doc_id, 'a' || l_linenumber AS asset_id, l_partkey % 3 AS page_id FROM lineitem)"""


@query(
    f"""
WITH {FORMULA_ROWS} SELECT f.doc_id, 'source_block_id' AS location, formula_id AS ref_id FROM f JOIN b ON b.doc_id = f.doc_id AND b.block_id = f.source_block_id WHERE b.page_id <> f.page_id
UNION ALL SELECT f.doc_id, 'anchor_block_id', formula_id FROM f JOIN b ON b.doc_id = f.doc_id AND b.block_id = f.anchor_block_id WHERE b.page_id <> f.page_id
UNION ALL SELECT f.doc_id, 'asset_id', formula_id FROM f JOIN a ON a.doc_id = f.doc_id AND a.asset_id = f.asset_id WHERE a.page_id <> f.page_id
"""
)
def j05_anchor_pages(spark, sf_dir):
    out = integrity.anchor_issues(formula_rows(spark, sf_dir), line_rows(spark, sf_dir, "block_id", "b"), line_rows(spark, sf_dir, "asset_id", "a"))
    return out.select("doc_id", "location", "ref_id")


@query(f"WITH {FORMULA_ROWS} SELECT b.doc_id, b.block_id, string_agg(DISTINCT f.formula_id, ',' ORDER BY f.formula_id) AS formula_ids FROM b JOIN f ON f.doc_id = b.doc_id AND (f.source_block_id = b.block_id OR f.anchor_block_id = b.block_id OR f.formula_id = CASE WHEN b.page_id = 0 THEN 'f1' END) GROUP BY b.doc_id, b.block_id")
def j14_formulas_of_blocks(spark, sf_dir):
    b = line_rows(spark, sf_dir, "block_id", "b").withColumn("formula_id", F.when(F.col("page_id") == 0, "f1"))
    return evidence.block_formulas(b, formula_rows(spark, sf_dir)).select("doc_id", "block_id", F.array_join("formula_ids", ",").alias("formula_ids"))


@query(
    r"""
WITH b AS (SELECT user_id, event_id, 'ab x = ' || (event_id % 9) || ' cd' AS text FROM events),
f AS (SELECT *, CASE event_id % 4 WHEN 0 THEN 'x=' || (event_id % 9) WHEN 1 THEN 'y = 1' ELSE 'x = ' || (event_id % 9) END AS src, CASE event_id % 4 WHEN 2 THEN 90 ELSE 8 END AS e FROM b)
SELECT user_id AS doc_id, CASE WHEN event_id % 4 = 2 THEN 'formula_source_text_range_out_of_bounds' ELSE 'formula_source_text_range_mismatch' END AS code, 'f' || event_id AS ref_id FROM f WHERE event_id % 4 IN (1, 2)
UNION ALL SELECT user_id, 'formula_unknown_span_ref', 'f' || event_id FROM events WHERE event_id % 5 = 0
"""
)
def j06_ranges(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "event_id")
    k, n = (F.col("event_id") % 9).cast("string"), F.col("event_id")
    block = F.concat(F.lit("b"), n.cast("string"))
    b = e.select("doc_id", block.alias("block_id"), F.concat(F.lit("ab x = "), k, F.lit(" cd")).alias("text"), F.array(F.lit("s1")).alias("span_ids"))
    src = F.when(n % 4 == 0, F.concat(F.lit("x="), k)).when(n % 4 == 1, "y = 1").otherwise(F.concat(F.lit("x = "), k))
    f = e.select("doc_id", F.concat(F.lit("f"), n.cast("string")).alias("formula_id"), F.when(n % 2 == 0, block).alias("source_block_id"), block.alias("anchor_block_id"), F.array(F.when(n % 5 == 0, "s2").otherwise("s1")).alias("span_ids"), src.alias("source_text"), F.lit(3).alias("start"), F.when(n % 4 == 2, 90).otherwise(8).alias("end"))
    return integrity.range_issues(f, b).select("doc_id", "code", "ref_id")


@query(
    f"""
WITH RECURSIVE {CHUNKS} SELECT doc_id, pos, 'formula_ref_not_in_source_block' AS code, 'q' || (pos % 3) AS ref_id FROM chunked WHERE pos % 4 = 1 AND pos % 3 <> 0
"""
)
def j04_refs_of_plan(spark, sf_dir):
    src = source_blocks(spark, sf_dir)
    plan = translation.deterministic(src, "fr")
    ref = F.when(F.col("pos") % 4 == 1, F.concat(F.lit(" {{formula:q"), (F.col("pos") % 3).cast("string"), F.lit("}}"))).otherwise("")
    known = src.select("doc_id", F.lit("q0").alias("formula_id")).distinct()
    out = integrity.plan_reference_issues(src, plan.withColumn("translated_text", F.concat("translated_text", ref)), known)
    return out.select("doc_id", F.regexp_extract("location", r"(\d+)", 1).cast("int").alias("pos"), "code", "ref_id")


@query(
    """
WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber AS n FROM lineitem), docs AS (SELECT DISTINCT doc_id FROM b), d AS (SELECT DISTINCT doc_id, n FROM b),
s AS (SELECT doc_id, CAST(n // 3 AS BIGINT) AS sec, n FROM d WHERE n % 2 = 1 UNION ALL SELECT doc_id, 9, n FROM d WHERE n % 3 = 0 UNION ALL SELECT doc_id, 8, 77 FROM docs)
SELECT doc_id, 'unknown_block' AS code, 'b' || (n + 100) AS ref_id FROM d WHERE n = 2
UNION ALL SELECT doc_id, 'missing_block', 'b' || n FROM d WHERE n = 2
UNION ALL SELECT doc_id, 'unknown_asset', 'a9' FROM docs
UNION ALL SELECT doc_id, 'unknown_section_block', 'b77' FROM docs
UNION ALL SELECT doc_id, 'block_in_two_sections', 'b' || n FROM s GROUP BY doc_id, n HAVING count(DISTINCT sec) > 1
UNION ALL SELECT doc_id, 'unknown_section', 's5' FROM docs
"""
)
def j07_layout_plans(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("n"))
    b = lambda c: F.concat(F.lit("b"), c.cast("string"))
    docs, n = i.select("doc_id").distinct(), F.col("n")
    blocks = i.select("doc_id", b(n).alias("block_id"))
    planned = i.select("doc_id", b(F.when(n == 2, n + 100).otherwise(n)).alias("block_id"))
    named = i.distinct().where("n % 2 = 1").select("doc_id", F.floor(n / 3).cast("long").alias("sec"), n).unionByName(i.distinct().where("n % 3 = 0").select("doc_id", F.lit(9).cast("long").alias("sec"), n)).unionByName(docs.select("doc_id", F.lit(8).cast("long").alias("sec"), F.lit(77).cast("long").alias("n")))
    secs = named.groupBy("doc_id", "sec").agg(F.collect_list(b(n)).alias("block_ids")).select("doc_id", F.concat(F.lit("s"), F.col("sec").cast("string")).alias("section_id"), F.lit("body").alias("kind"), "block_ids")
    assets = lambda x: docs.select("doc_id", F.lit(x).alias("asset_id"))
    out = integrity.layout_plan_issues(blocks, assets("a1"), planned, assets("a9").unionByName(assets("a1")), secs, docs.select("doc_id", F.lit("s5").alias("section_id")))
    return out.select("doc_id", "code", "ref_id")


@query("SELECT o_orderkey AS job_id, o_custkey AS doc_id, CASE WHEN c_custkey IS NOT NULL AND o_orderkey % 3 = 0 THEN c_name END AS payload, c_custkey IS NOT NULL AND o_orderkey % 3 <> 0 AS stale FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 12) ON c_custkey = o_custkey")
def j24_workflows_of_jobs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("doc_id"))
    c = table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("payload"))
    mine = o.join(c, "doc_id").select("job_id", "doc_id", "payload")
    # Each job looks at the workflow of a document of its own, which bears its id if the id is divisible by three.
    key = F.concat_ws("-", F.col("doc_id").cast("string"), F.col("job_id").cast("string"))
    flows = mine.select(key.alias("doc_id"), F.when(F.col("job_id") % 3 == 0, F.col("job_id")).otherwise(F.lit(-1)).alias("job_id"), "payload")
    out = jobs.matching_workflow(o.select("job_id", key.alias("doc_id")), flows)
    return out.select("job_id", F.element_at(F.split("doc_id", "-"), 1).cast("long").alias("doc_id"), "payload", "stale")


@query("SELECT user_id || '/' || event_id AS candidate_id, CASE WHEN event_id % 2 = 0 THEN 's' || event_id ELSE 't' || event_id END AS span_id FROM events WHERE event_id % 2 = 0 OR event_id % 3 <> 0")
def j27_spans_of_candidates(spark, sf_dir):
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    name = lambda p: F.concat(F.lit(p), n.cast("string"))
    box = lambda x: F.struct(F.lit(x).alias("x0"), F.lit(0.0).alias("y0"), F.lit(x + 10.0).alias("x1"), F.lit(10.0).alias("y1"))
    none = F.array().cast("array<string>")
    cand = e.select(F.col("user_id").alias("doc_id"), name("b").alias("block_id"), F.concat_ws("/", "user_id", "event_id").alias("candidate_id"), F.when(n % 2 == 0, F.array(name("s"), F.lit("lost"))).otherwise(none).alias("span_ids"), F.lit("x = 1 + y").alias("source_text"), box(0.0).alias("box"))
    spans = e.select(F.col("user_id").alias("doc_id"), name("b").alias("block_id"), name("s").alias("span_id"), F.lit("other").alias("text"), box(0.0).alias("box"))
    spans = spans.unionByName(e.select(F.col("user_id").alias("doc_id"), name("b").alias("block_id"), name("t").alias("span_id"), F.lit(" 1 + ").alias("text"), F.when(n % 3 == 0, box(50.0)).otherwise(box(5.0)).alias("box")))
    return evidence.candidate_spans(cand, spans).select("candidate_id", "span_id")


@query("WITH o AS (SELECT l_partkey % 50 AS sig, l_suppkey % 40 AS blk, max(l_quantity) AS h FROM lineitem GROUP BY ALL), s AS (SELECT sig, max(h) AS h FROM o GROUP BY sig), b AS (SELECT blk, max(h) AS h FROM o GROUP BY blk) SELECT p_partkey AS block_no, coalesce(s.h, b.h) AS height FROM part LEFT JOIN s ON s.sig = p_partkey % 90 LEFT JOIN b ON b.blk = p_partkey % 60 WHERE coalesce(s.h, b.h) IS NOT NULL")
def j28_heights(spark, sf_dir):
    over = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("signature"), (F.col("l_suppkey") % 40).alias("block_id"), F.col("l_quantity").alias("height"))
    blocks = table(spark, sf_dir, "part").select(F.col("p_partkey"), (F.col("p_partkey") % 90).alias("signature"), (F.col("p_partkey") % 60).alias("block_id"))
    keyed = evidence.overflow_heights(over, blocks.select("signature", "block_id").distinct())
    return blocks.join(keyed, ["signature", "block_id"]).select(F.col("p_partkey").alias("block_no"), "height")


@query("SELECT user_id AS doc_id, event_id, event_type || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '_' || row_number() OVER w END AS id FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)")
def w09_unique_ids(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "event_id", "event_type")
    return evidence.unique_ids(e, "event_type", "event_id").select("doc_id", "event_id", "id")


@query(f"WITH {LINES}, o AS (SELECT doc_id, pos, coalesce(sum(len(text) + 1) OVER (PARTITION BY doc_id, pos // 4 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM lines) SELECT doc_id, CAST(pos AS VARCHAR) AS block_id, CAST(1 + off AS BIGINT) AS start, CAST(3 + off AS BIGINT) AS \"end\" FROM o")
def w06_shifted_ranges(spark, sf_dir):
    b = line_blocks(spark, sf_dir)
    block = F.col("pos").cast("string")
    members = b.select("doc_id", F.floor(F.col("pos") / 4).alias("cluster_id"), "pos", block.alias("block_id"), "text")
    out = evidence.shifted_ranges(members, b.select("doc_id", block.alias("block_id"), F.lit(1).alias("start"), F.lit(3).alias("end")))
    return out.select("doc_id", "block_id", F.col("start").cast("long"), F.col("end").cast("long"))


@query("SELECT l_orderkey AS doc_id, CAST(l_suppkey % 3 AS BIGINT) AS cluster_id, arg_max(l_linenumber, CASE WHEN l_returnflag = 'A' THEN 1000000.0::DOUBLE ELSE 0 END - l_linenumber * 1000 + l_quantity) AS block_id FROM lineitem GROUP BY ALL")
def ag14_primary_blocks(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    rows = i.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 3).cast("long").alias("cluster_id"), F.col("l_linenumber").alias("block_id"), F.when(F.col("l_returnflag") == "A", "display").otherwise("inline").alias("mode"), F.col("l_linenumber").alias("pos"), F.col("l_quantity").alias("width"), F.lit(1).alias("signals"))
    return evidence.primary_block(rows).select("doc_id", "cluster_id", "block_id")


@query("SELECT l_orderkey AS doc_id, round_even((sum(l_linenumber / 8.0::DOUBLE) + sum(l_linenumber / 4.0::DOUBLE)) / (2 * count(*)), 4) AS confidence FROM lineitem GROUP BY l_orderkey")
def ag10_mean_confidence(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc_id")
    return evidence.mean_confidence(i.select("doc_id", (F.col("l_linenumber") / 8).alias("confidence")), i.select("doc_id", (F.col("l_linenumber") / 4).alias("confidence")))


@query("SELECT event_id, event_type = 'view' AS has_view, CASE WHEN event_type = 'view' THEN 3 ELSE 2 END AS views, CASE WHEN event_type = 'view' THEN NULL ELSE 1 END AS own FROM events")
def ag15_merged_counts(spark, sf_dir):
    m = evidence.merged_counts(F.create_map(F.col("event_type"), F.lit(1)), F.create_map(F.lit("view"), F.lit(2)))
    own = F.when(F.col("event_type") != "view", m[F.col("event_type")])
    return table(spark, sf_dir, "events").select("event_id", (F.size(m) == 1).alias("has_view"), m["view"].alias("views"), own.alias("own"))


@query("SELECT DISTINCT 'b' || (event_id % 50) AS block_id FROM events")
def so03_continuations(spark, sf_dir):
    n = F.col("event_id")
    name = F.concat(F.lit("b"), (n % 50).cast("string"), F.when(n % 3 == 0, F.concat(F.lit("__cont_"), (n % 4).cast("string"))).otherwise(""))
    return evidence.continuation_ids(table(spark, sf_dir, "events").select(name.alias("block_id")), "block_id")


@query("SELECT event_id, 'copy' AS doc_id, CASE WHEN event_id % 2 = 0 THEN '/data/copy/' || event_type || '.png' ELSE '/data/other/' || event_type || '.png' END AS path FROM events")
def j23_copied_paths(spark, sf_dir):
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("doc_id"), "event_type")
    rows = rows.select("event_id", "doc_id", F.concat(F.lit("/data/"), F.when(n % 2 == 0, F.col("doc_id")).otherwise("other"), F.lit("/"), "event_type", F.lit(".png")).alias("path"))
    return evidence.copied_document(rows, "copy")


@query(
    f"""
WITH {BOXES}, l AS (SELECT *, lag(y1) OVER w AS py, lag((x0 + x1) / 2) OVER w AS pc FROM boxes WINDOW w AS (PARTITION BY doc_id, page_id ORDER BY y0, item_id))
SELECT doc_id, page_id, item_id, kind, CAST(sum(CASE WHEN coalesce(y0 - py <= 40.0 AND abs((x0 + x1) / 2 - pc) <= 32.0, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_id ORDER BY y0, item_id) AS INTEGER) AS island FROM l
"""
)
def w08_islands_down_the_page(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("down", F.struct("box.y0", "item_id"))
    return layout.islands(b, "down", 40.0).select("doc_id", "page_id", "item_id", "kind", "island")


@query("WITH s AS (SELECT user_id AS doc_id, event_id % 7 AS formula_id, event_id AS pos, event_type AS latex FROM events) SELECT doc_id, formula_id, arg_max(latex, pos + CASE WHEN pos % 3 = 0 THEN 1000000000 ELSE 0 END) AS latex FROM s GROUP BY doc_id, formula_id")
def sl07_j21_merged_formulas(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 7).alias("formula_id"), F.col("event_id").alias("pos"), F.lit(0).alias("n"), F.col("event_type").alias("latex"))
    return formulas.merge(e.where("pos % 3 <> 0"), e.where("pos % 3 = 0")).select("doc_id", "formula_id", "latex")


@query(
    """
WITH d AS (SELECT user_id AS doc_id, event_id AS pos, 'E_' || (event_id % 9) || ' = m c^2 + ' || (event_id % 9) AS text FROM events WHERE event_id % 4 = 0)
SELECT doc_id, pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS number FROM d
"""
)
def w10_running_numbers(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_id % 4 = 0")
    k = (F.col("event_id") % 9).cast("string")
    b = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), F.concat(F.lit("E_"), k, F.lit(" = m c^2 + "), k).alias("text"), F.lit("formula").alias("role"))
    found = formulas.detect(b)
    return formulas.numbered(found).join(found.select("doc_id", "formula_id", "pos"), ["doc_id", "formula_id"]).select("doc_id", "pos", "number")


@query("SELECT o_orderkey AS job_id, ['cancel', 'retry', 'continue', 'retypeset', 'dance'][o_orderkey % 5 + 1] AS command, CASE WHEN o_orderkey % 7 = 0 THEN 404 WHEN o_orderkey % 5 = 4 THEN 400 WHEN o_orderkey % 5 = 0 AND o_orderstatus <> 'O' THEN 409 WHEN o_orderkey % 5 = 1 AND o_orderstatus = 'F' THEN 409 WHEN o_orderkey % 5 IN (2, 3) AND o_orderstatus <> 'F' THEN 409 WHEN o_orderkey % 5 = 1 AND o_orderstatus = 'O' THEN 409 ELSE 200 END AS code FROM orders")
def ss08_commands(spark, sf_dir):
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    command = F.element_at(F.array(*map(F.lit, ("cancel", "retry", "continue", "retypeset", "dance"))), (n % 5 + 1).cast("int"))
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "rendering").otherwise("failed")
    out = jobs.guard(o.select(n.alias("job_id"), command.alias("command")), o.where(n % 7 != 0).select(n.alias("job_id"), state.alias("state")))
    return out.select("job_id", "command", "code")


@query("SELECT user_id AS workflow_id, count(*) AS n_steps, count(*) FILTER (event_type = 'error') AS n_failed, arg_max(event_type, event_id) AS name, CASE WHEN arg_max(event_type, event_id) = 'error' THEN 'failed' ELSE 'completed' END AS status FROM events GROUP BY user_id")
def ag08_attempts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    steps = e.select(F.col("user_id").alias("workflow_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("name"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"))
    return jobs.current_steps(steps)


@query(
    """
WITH w AS (SELECT user_id AS job_id, event_id, event_id % 6 AS step, event_type, CASE WHEN event_id % 4 = 0 THEN 'failed' WHEN event_id % 4 = 1 THEN 'completed' WHEN event_id % 4 = 2 THEN 'skipped' ELSE 'running' END AS status FROM events)
SELECT event_id, CAST(100 + step * 100 AS BIGINT) AS sequence, CASE status WHEN 'failed' THEN 'error' WHEN 'completed' THEN 'success' WHEN 'skipped' THEN 'warning' ELSE 'info' END AS level, job_id || ':' || substr(sha1(concat_ws(chr(31), job_id, 'workflow', step, event_type, status, 'm' || event_id, '')), 1, 16) AS id FROM w
"""
)
def hs02_workflow_events(spark, sf_dir):
    from quire.operators import events

    n = F.col("event_id")
    status = F.when(n % 4 == 0, "failed").when(n % 4 == 1, "completed").when(n % 4 == 2, "skipped").otherwise("running")
    steps = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job_id"), (n % 6).alias("step"), F.col("event_type").alias("name"), status.alias("status"), F.concat(F.lit("m"), n.cast("string")).alias("message"), F.lit(None).cast("string").alias("error"))
    out = events.workflow_events(steps)
    return out.select(F.substring("message", 2, 20).cast("long").alias("event_id"), "sequence", "level", "id")
