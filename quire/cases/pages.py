"""Cases of page text, plan repair, roll-ups and output helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.cases.common import Options, query
from quire.cases.flowing import GLYPHS
from quire.cases.flowing import WIDE as WIDE_OF
from quire.functions import formatting
from quire.operators import paging, rollups, sections, spans
from quire.plans import repair, styles
from quire.registry import LINES, _ASKED, _requirements_sql, instructions, line_blocks
from quire.session import table


def scripted(spark, sf_dir):
    """Events as lines of four spans: a letter, a small one above, below or on the line, an equals sign, and a number."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    y = F.when(n % 3 == 0, -4.0).when(n % 3 == 1, 4.0).otherwise(0.0)
    box = lambda top, high: F.struct(F.lit(0.0).alias("x0"), top.alias("y0"), F.lit(5.0).alias("x1"), (top + high).alias("y1"))
    k = (n % 10).cast("string")
    span = lambda i, text, font, size, b: F.struct(F.lit(i).alias("n"), text.alias("text"), F.lit(font).alias("font"), F.lit(size).alias("size"), b.alias("box"))
    first = F.when(n % 4 == 0, F.lit(" + ")).otherwise(F.lit("x"))
    each = F.array(span(0, first, "CMMI", 10.0, box(F.lit(0.0), 10.0)), span(1, k, "Adv4C4E74", 6.0, box(y + 2.0, 6.0)), span(2, F.lit(" = "), "Adv4C4E51", 10.0, box(F.lit(0.0), 10.0)), span(3, (n % 7).cast("string"), "CMR", 10.0, box(F.lit(0.0), 10.0)))
    return e.select(F.col("user_id").alias("doc_id"), n.alias("block_id"), F.lit(0).alias("line"), F.explode(each).alias("s")).select("doc_id", "block_id", "line", "s.*")


@query(
    """
SELECT user_id AS doc_id, event_id AS block_id, CASE WHEN event_id % 4 = 0 THEN ' + ' ELSE 'x' END || CASE WHEN event_id % 3 = 2 OR event_id % 4 = 0 THEN CAST(event_id % 10 AS VARCHAR) WHEN event_id % 10 = 0 THEN ''''
  WHEN event_id % 3 = 0 THEN '^{' || (event_id % 10) || '}' ELSE '_{' || (event_id % 10) || '}' END || ' / ' || (event_id % 7) AS text FROM events
"""
)
def st17_scripts(spark, sf_dir):
    return spans.line_texts(scripted(spark, sf_dir)).select("doc_id", "block_id", "text")


@query(
    r"""
WITH b AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'q_s' WHEN 1 THEN '∂f_{s}' WHEN 2 THEN 'plain words of a line' ELSE 'qs' END AS a, CASE event_id % 4 WHEN 0 THEN 'm_s' WHEN 1 THEN '∂t' WHEN 2 THEN 'and more' ELSE 'ms' END AS b, CASE WHEN event_id % 5 = 0 THEN 100 ELSE 20 END AS w FROM events)
SELECT event_id AS block_id, CASE WHEN event_id % 4 = 1 THEN '\frac{∂f_s}{∂t}' WHEN event_id % 4 IN (0, 3) THEN '\frac{q_s}{m_s}' ELSE a || ' ' || b END AS text, event_id % 4 <> 2 AS stacked FROM b
"""
)
def st18_stacked_fractions(spark, sf_dir):
    n = F.col("event_id")
    a = F.when(n % 4 == 0, "q_s").when(n % 4 == 1, "∂f_{s}").when(n % 4 == 2, "plain words of a line").otherwise("qs")
    b = F.when(n % 4 == 0, "m_s").when(n % 4 == 1, "∂t").when(n % 4 == 2, "and more").otherwise("ms")
    width = F.when(n % 5 == 0, 100).otherwise(20)
    e = table(spark, sf_dir, "events").select(F.lit("d").alias("doc_id"), n.alias("block_id"), F.posexplode(F.array(a, b)).alias("line", "text"), width.alias("width"))
    return spans.block_texts(e).select("block_id", "text", "stacked")


SPLITS = Options("One sentence. Another one here", "no marks whatsoever in it", "short", "一句话。第二句话很长很长很长", "a, b, c, d, e, f, g, h, i", "xxxxxxxxxxxxxxxxxxxxxxxxxxxxxx")
RFIND = lambda m: f"CASE WHEN contains(f, '{m}') THEN len(f) - instr(reverse(f), '{m[::-1]}') - {len(m)} + 1 ELSE -1 END"


@query(f"""
WITH {SPLITS.sql()}, a AS (SELECT event_id, text, least(20, len(text)) AS most, text[1:20] AS f FROM t), b AS (SELECT *, greatest({', '.join(RFIND(m) for m in paging.SENTENCE_MARKS)}) AS best FROM a)
SELECT event_id, CAST(CASE WHEN best >= greatest(1, floor(most * 0.55)) THEN best + CASE WHEN text[best + 1] = ' ' THEN 0 ELSE 1 END ELSE most END AS INTEGER) AS place FROM b
""")
def st25_split_places(spark, sf_dir):
    return SPLITS.rows(spark, sf_dir).select("event_id", paging.split_place(F.col("text"), F.lit(20)).alias("place"))


@query(f"WITH {LINES}, {GLYPHS}, m AS MATERIALIZED (SELECT {WIDE_OF} AS m), w AS (SELECT doc_id, pos, text, 100 + pos % 5 * 40 AS width, list_sum(list_transform(string_split(text, ''), lambda c: m[c])) AS h FROM lines, m) SELECT doc_id, pos, (greatest(1, ceil(h / 100.0 * 10 / width)) * 10 * 1.25)::DOUBLE AS height, greatest(1, ceil(h / 100.0 * 10 / width)) * 12.5 > 30 AS over FROM w")
def gm06_heights(spark, sf_dir):
    """Heights of all lines, and whether they pass a box of 30 points."""
    width = (100 + F.col("pos") % 5 * 40).cast("double")
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), width.alias("x1"), F.lit(30.0).alias("y1"))
    h, over = paging.text_height(F.col("text"), width, F.lit(10.0), F.lit(1.25)), paging.overflows(F.col("text"), box, F.lit(10.0), F.lit(1.25))
    return line_blocks(spark, sf_dir).select("doc_id", "pos", h.alias("height"), over.alias("over"))


FRAGMENTS = Options("aaaa bbbb cccc dddd eeee ffff gggg", "short", "xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx", "")


@query(
    f"""
WITH {FRAGMENTS.sql()}, w AS (SELECT event_id, CASE text WHEN 'short' THEN ['short'] WHEN '' THEN [''] WHEN 'aaaa bbbb cccc dddd eeee ffff gggg' THEN ['aaaa bbbb cccc dddd', 'eeee ffff gggg'] ELSE ['{"x" * 18}', '{"x" * 18}', 'xxxx'] END AS l FROM t)
SELECT event_id AS pos, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS fragment, unnest(l) AS text FROM w
"""
)
def w14_continuations(spark, sf_dir):
    rows = FRAGMENTS.rows(spark, sf_dir).select(F.lit("d").alias("doc_id"), F.col("event_id").alias("pos"), "text", F.lit(50.0).alias("width"), F.lit(26.0).alias("height"))
    return paging.continuations(rows, 10.0, 1.25).select("pos", "fragment", "text")


@query(
    """
WITH e AS (SELECT event_id, 'text ' || event_id || ' {{formula:a}} [3]' AS src, event_id % 5 AS k FROM events)
SELECT event_id AS pos, CASE k WHEN 0 THEN src WHEN 1 THEN 'mal {{formula:a}} x' WHEN 2 THEN 'neu {{formula:a}}' WHEN 3 THEN src ELSE 'ok {{formula:a}} [3]' END AS translated_text, CASE WHEN k = 4 THEN 'heading' ELSE 'paragraph' END AS role, CASE WHEN k = 2 THEN 'compact' ELSE 'normal' END AS render_intent,
  CASE k WHEN 0 THEN 'repaired_layout_plan,retry_attempt_2,empty_translation_repaired,missing_translation,missing_block_repaired' WHEN 1 THEN 'own,repaired_layout_plan,retry_attempt_2,formula_placeholder_syntax_repaired,preserve_token_repaired'
  WHEN 2 THEN 'own,repaired_layout_plan,retry_attempt_2,formula_placeholder_repaired' WHEN 3 THEN 'own,repaired_layout_plan,retry_attempt_2,empty_translation_repaired,missing_translation' ELSE 'own,repaired_layout_plan,retry_attempt_2,role_mismatch' END AS flags,
  CASE k WHEN 1 THEN 'reference_marker=[3]' WHEN 2 THEN 'citation=[3]' ELSE '' END AS items FROM e
"""
)
def js03_repaired_plans(spark, sf_dir):
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    keys = [F.lit("d").alias("doc_id"), F.lit(1).alias("chunk_no"), n.alias("pos")]
    source = F.concat(F.lit("text "), n.cast("string"), F.lit(" {{formula:a}} [3]"))
    sources = e.select(*keys, F.lit("paragraph").alias("role"), source.alias("text"), F.array(F.lit("{{formula:a}}"), F.lit("[3]")).alias("preserve_tokens"), F.lit(True).alias("requires_translation"))
    said = F.when(n % 5 == 1, "mal {formula:a}} x").when(n % 5 == 2, "neu").when(n % 5 == 3, "  ").otherwise("ok {{formula:a}} [3]")
    item = F.when(n % 5 == 2, F.array(F.struct(F.lit("citation").alias("kind"), F.lit("[3]").alias("text")))).otherwise(F.array().cast(repair.ITEMS))
    answers = e.where("event_id % 5 <> 0").select(*keys, F.lit(0).alias("n"), said.alias("translated_text"), F.when(n % 5 == 4, "heading").when(n % 5 == 3, "nonsense").otherwise("paragraph").alias("role"), F.when(n % 5 == 2, "compact").otherwise("odd").alias("render_intent"), item.alias("inline_items"), F.array(F.lit("own")).alias("quality_flags"))
    again = answers.withColumns({"n": F.lit(1), "translated_text": F.lit("a second answer")})
    out = repair.repaired(sources, answers.unionByName(again), 2)
    return out.select("pos", "translated_text", "role", "render_intent", F.array_join("quality_flags", ",").alias("flags"), F.array_join(F.transform("inline_items", lambda i: F.concat(i["kind"], F.lit("="), i["text"])), ",").alias("items"))


@query(
    """
WITH c AS (SELECT user_id AS doc_id, count(*) AS candidate_count, count(*) FILTER (event_id % 3 = 0) AS crop_count, CAST(round_even(sum(event_id % 8 * 0.25), 2) AS DOUBLE) AS text_ms, count(*) FILTER (event_type = 'click') AS cache_hit_count,
  count(*) FILTER (event_type IN ('view', 'error')) AS visual_attempt_count, count(*) FILTER (event_id % 5 = 0) AS skipped_visual_count, round_even(sum(CASE WHEN event_type = 'view' THEN event_id % 4 * 0.5 END), 2) AS view_ms FROM events GROUP BY user_id)
SELECT doc_id, candidate_count, crop_count, text_ms, cache_hit_count, visual_attempt_count, skipped_visual_count, CAST(view_ms AS DOUBLE) AS view_ms FROM c
"""
)
def ag09_dt02_performance(spark, sf_dir):
    e, n = table(spark, sf_dir, "events").withColumnRenamed("user_id", "doc_id"), F.col("event_id")
    candidates = e.select("doc_id", (n % 8 * 0.25).alias("text_ms"), F.lit(None).cast("double").alias("validation_ms"), F.lit(0.0).alias("crop_ms"), (n % 3 == 0).alias("cropped"))
    records = e.select("doc_id", F.when(F.col("event_type") == "click", "cache_hit").otherwise("done").alias("status"))
    flags = F.when(n % 5 == 0, F.array(F.lit("ocr_visual_candidate_limit_reached"))).otherwise(F.array().cast("array<string>"))
    attempts = e.select("doc_id", F.col("event_type").alias("provider"), (n % 4 * 0.5).alias("elapsed_ms"), flags.alias("flags"))
    out = rollups.performance(candidates, records, attempts, ("view", "error"))
    return out.select("doc_id", "candidate_count", "crop_count", "text_ms", "cache_hit_count", "visual_attempt_count", "skipped_visual_count", F.col("visual_ms_by_provider")["view"].alias("view_ms"))


@query("SELECT event_id AS doc_id, CAST(event_id % 3 AS BIGINT) AS block_overflow_count, CAST(CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id % 5 END AS BIGINT) AS figure_group_issue_count, CAST(event_id % 4 + CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END AS BIGINT) AS formula_issue_count, CASE WHEN event_id % 3 = 0 AND (event_id % 2 = 0 OR event_id % 5 = 0) AND event_id % 4 = 0 THEN 'passed' ELSE 'failed' END AS status, round_even((event_id % 100) * 0.75 + 0.0, 4)::DOUBLE AS slack_pt FROM events")
def ag19_validation(spark, sf_dir):
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(n.alias("doc_id"), (n % 3).alias("block_overflow_count"), F.when(n % 2 != 0, n % 5).alias("figure_group_issue_count"), (n % 4).alias("unresolved_count"), F.when(n % 4 != 0, 1).alias("raw_tex_unrendered_count"), F.lit(None).cast("int").alias("browser_katex_failed_count"), F.lit(0).alias("katex_error_count"))
    slack = table(spark, sf_dir, "events").select(n.alias("doc_id"), (n % 100).cast("double").alias("slack_px"))
    return rollups.validation(rows).join(rollups.in_points(slack, "slack_px"), "doc_id")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def so02_first_rows(spark, sf_dir):
    return rollups.first_rows(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["event_id"])


VALUES = Options("#abc", "#12345", "rgb(1, 2, 3)", "red", None, " #A1B2C3 ")


@query(r"WITH " + VALUES.sql() + r" SELECT event_id, CASE WHEN regexp_full_match(trim(text), '#[0-9a-fA-F]{3}(?:[0-9a-fA-F]{3})?') OR text LIKE 'rgb(%' THEN trim(text) ELSE '#111111' END AS color, CASE WHEN event_id % 4 = 0 THEN CAST(event_id // 4 AS VARCHAR) WHEN event_id % 4 = 2 THEN (event_id // 4) || '.5' WHEN event_id % 4 = 1 THEN (event_id // 4) || '.25' ELSE (event_id // 4) || '.75' END AS points FROM t")
def st26_formats(spark, sf_dir):
    return VALUES.rows(spark, sf_dir).select("event_id", formatting.safe_color(F.col("text")).alias("color"), formatting.points(F.col("event_id") / 4).alias("points"))


FALLBACKS = Options("{{formula:a}}", "  ", "E = m", "@@FORMULA_1@@", None)


@query("WITH " + FALLBACKS.sql() + " SELECT event_id, CASE WHEN text = 'E = m' THEN text WHEN event_id % 2 = 0 THEN 'second' WHEN event_id % 3 = 0 THEN 'formula f' || event_id ELSE 'formula' END AS shown FROM t")
def st26_fallback_texts(spark, sf_dir):
    n = F.col("event_id")
    return FALLBACKS.rows(spark, sf_dir).select("event_id", formatting.fallback_text(F.when(n % 3 == 0, F.concat(F.lit("f"), n.cast("string"))), F.col("text"), F.when(n % 2 == 0, "second")).alias("shown"))


TAGS = Options(r"E = m \tag{3.4}", r"x \tag*{(A2)} = y", "no tag", r"a  b \tag { } c", r"\tag{1}")


@query("WITH " + TAGS.sql() + r""", m AS (SELECT *, regexp_extract(text, '\\tag\*?\s*\{([^{}]+)\}', 1) AS n, regexp_extract(text, '\\tag\*?\s*\{([^{}]+)\}') AS w FROM t)
SELECT event_id, CASE WHEN trim(n) <> '' THEN '(' || replace(replace(trim(n), '(', ''), ')', '') || ')' END AS number, CASE WHEN w <> '' THEN trim(regexp_replace(replace(text, w, ''), '\s+', ' ', 'g')) ELSE text END AS bare FROM m""")
def st27_equation_tags(spark, sf_dir):
    return TAGS.rows(spark, sf_dir).select("event_id", formatting.equation_tag(F.col("text")).alias("number"), formatting.without_tag(F.col("text")).alias("bare"))


@query(
    f"""
WITH {_ASKED}, hits AS ({_requirements_sql()}), r AS (SELECT doc_id, list(DISTINCT requirement_id) AS ids FROM hits GROUP BY doc_id)
SELECT t.doc_id, coalesce(list_contains(ids, 'headers'), false) AS has_header, CASE WHEN coalesce(list_contains(ids, 'headers'), false) THEN CASE document_kind WHEN 'social_practice_report' THEN 'Social Practice Report' WHEN 'undergraduate_thesis' THEN 'Thesis' WHEN 'course_paper' THEN 'Course Paper' ELSE 'Academic Document' END END AS header_text,
  coalesce(list_contains(ids, 'page_numbers') OR list_contains(ids, 'main_text_page_numbers'), false) AS page_numbers, concat_ws(',', CASE WHEN list_contains(ids, 'main_text_12pt_simsun') OR list_contains(ids, 'line_spacing_1_5') THEN 'main_text' END, CASE WHEN list_contains(ids, 'level1_heading_16pt_simhei') THEN 'level1_heading' END, CASE WHEN list_contains(ids, 'highlight_important_content') THEN 'important_content' END) AS styles
FROM typed t LEFT JOIN r USING (doc_id)
"""
)
def st32_page_setups(spark, sf_dir):
    i = instructions(spark, sf_dir)
    out = styles.page_setups(sections.intents(i), sections.requirements(i))
    return out.select("doc_id", "has_header", "header_text", "page_numbers", F.array_join("styles", ",").alias("styles"))


@query("SELECT DISTINCT event_type AS name, CASE WHEN event_type = 'click' THEN 'stored' WHEN event_type = 'view' THEN 'env' ELSE 'default' END AS value, CASE WHEN event_type = 'click' THEN 'persisted' WHEN event_type = 'view' THEN 'environment' ELSE 'defaults' END AS layer FROM events")
def io25_layered_config(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct()
    layer = lambda rows, value: rows.select("name", F.lit(value).alias("value"))
    blank = e.where("name = 'error'").select("name", F.lit(None).cast("string").alias("value"))
    return styles.layered({"defaults": layer(e, "default"), "environment": layer(e.where("name IN ('view', 'click')"), "env"), "persisted": layer(e.where("name = 'click'"), "stored").unionByName(blank)})


# --- formulas of blocks, layout items, workflows ---------------------------------------------------------

LAYERS = Options("E = m c^2 + k (3)", "x_3=α+3", "ends with = Ω (A1)", "β ≤ γ and more prose", "", "@u = @x (2)")


@query("WITH " + LAYERS.sql() + r""", c AS (SELECT event_id, regexp_replace(text, '\s+and more prose$', '') AS c FROM t WHERE true),
n AS (SELECT event_id, CASE WHEN c LIKE 'ends with%' THEN 'ends' ELSE c END AS c, CASE WHEN c LIKE 'ends with%' THEN '' ELSE regexp_extract(c, '\(([A-Za-z]?\d+)\)$', 1) END AS number FROM c),
s AS (SELECT *, CASE WHEN c = '@u = @x (2)' THEN '\partial u / \partial x' ELSE trim(regexp_replace(replace(replace(replace(replace(regexp_replace(c, '\s*\([A-Za-z]?\d+\)$', ''), 'α', ' \alpha '), 'β', ' \beta '), '≤', ' \le '), 'γ', ' \gamma '), '\s+', ' ', 'g')) END AS l FROM n)
SELECT event_id, CASE WHEN c = '' THEN '' WHEN number <> '' THEN l || ' \tag{' || number || '}' ELSE l END AS latex, CASE c WHEN '' THEN 'empty' WHEN 'ends' THEN 'not_math' ELSE 'accepted' END AS status FROM s""")
def st09_st31_latex(spark, sf_dir):
    from quire.operators import formulas

    rows = LAYERS.rows(spark, sf_dir).withColumn("mode", F.lit("inline"))
    out = formulas.with_acceptance(formulas.with_latex(rows, "text"), "latex", "text", "mode")
    return out.select("event_id", "latex", F.col("verdict.status").alias("status"))


SUFFIXED = Options("so k = a_1 ^{n+1}) holds", "so v[i] = 3_{j} now", "∫ f_0 dx", "plain", "w = q")


@query("WITH " + SUFFIXED.sql() + r" SELECT event_id AS pos, regexp_extract(text, '(k = a_1 \^\{n\+1\}\)|v\[i\] = 3_|∫ f_0|w = q)') AS source_text, CAST(instr(text, regexp_extract(text, '(k = a_1 \^\{n\+1\}\)|v\[i\] = 3_|∫ f_0|w = q)')) - 1 AS INTEGER) AS start FROM t WHERE text <> 'plain'")
def st16_ar01_scripts_after(spark, sf_dir):
    from quire.operators import formulas

    rows = SUFFIXED.rows(spark, sf_dir).select(F.lit("d").alias("doc_id"), F.col("event_id").alias("pos"), "text")
    return formulas.inline_candidates(rows).select("pos", "source_text", "start")


SHORT = Options("AB-1234", "x_1 = 2", "re-use", "a-b", "see doi 10", "∞ values", "abc", "x^2")


@query("WITH " + SHORT.sql() + r" SELECT event_id, regexp_matches(text, '^[A-Za-z]{1,3}-\d{3,}$|^[A-Za-z]{1,2}-[A-Za-z]{3,}$|^[A-Za-z]{3,}-[A-Za-z]{2,}$|^∞\s*[A-Za-z]{3,}$') AS false_positive, text IN ('x_1 = 2', 'a-b', 'x^2') AS formula FROM t")
def pf08_inline_guards(spark, sf_dir):
    from quire.operators import formulas

    return SHORT.rows(spark, sf_dir).select("event_id", formulas.inline_false_positive(F.col("text")).alias("false_positive"), formulas.inline_formula(F.col("text")).alias("formula"))


PARTS = Options("{{formula:a}}", "x = 1", "the long words of prose go on", "a", "(b)", "Σ+1", "", "k 2 l")


@query("WITH " + PARTS.sql() + r" SELECT event_id, event_id % 5 <> 0 AND event_id % 3 <> 0 AND text <> '' AND NOT (text = '{{formula:a}}' AND event_id % 2 = 0 AND event_id % 7 = 0) AND (event_id % 11 = 0 OR text IN ('{{formula:a}}', 'x = 1', '(b)', 'Σ+1')) AS part FROM t")
def pf10_cluster_parts(spark, sf_dir):
    from quire.functions.fence import fenced
    from quire.operators import formulas

    n = F.col("event_id")
    role, height = F.when(n % 5 == 0, "heading").otherwise("paragraph"), F.when(n % 3 == 0, 90.0).otherwise(12.0)
    alone = (F.col("text") == "{{formula:a}}") & (n % 14 == 0)
    steps = formulas.cluster_steps(F.col("text"), role, height, F.when(n % 11 == 0, "f"), alone, "_c")
    return fenced(PARTS.rows(spark, sf_dir), *steps).select("event_id", F.col("_c").alias("part"))


@query("SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS p, l_suppkey AS s, CAST(700 - (y0 + 30) AS DOUBLE) AS top, CASE WHEN least(x0 + 40, 250) > greatest(x0, 100) AND least(y0 + 30, 300) > greatest(y0, 150) THEN greatest(0, x0 - 100) END::DOUBLE AS local_x0, least(x0 + 40, 250) > greatest(x0, 100) AND least(y0 + 30, 300) > greatest(y0, 150) AS touching FROM (SELECT *, l_partkey % 400 AS x0, l_suppkey % 600 AS y0 FROM lineitem)")
def gm05_transforms(spark, sf_dir):
    from quire.functions import geometry as g

    box = lambda x0, y0, x1, y1: F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))
    x, y = F.col("l_partkey") % 400, F.col("l_suppkey") % 600
    b, source = box(x, y, x + 40, y + 30), box(F.lit(100), F.lit(150), F.lit(250), F.lit(300))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), g.from_bottom(b, F.lit(700.0))["y0"].alias("top"), g.local(b, source)["x0"].alias("local_x0"), (g.intersection(b, source) > 0).alias("touching"))


def layouts(spark, sf_dir):
    """Orders as pages of layout JSON: an item per line, some of them twice, with two spans each."""
    from quire.sources import layout_json

    n = F.col("l_linenumber")
    span = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("content"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("latex"), F.lit(None).cast("array<double>").alias("bbox"))
    box = F.array(F.lit(10.0), (n * 20).cast("double"), F.lit(200.0), (n * 20 + 15).cast("double"))
    kind = F.when(n == 1, "title").when(n % 3 == 0, "interline_equation").when(n == 5, "header").otherwise("text")
    none = F.lit(None).cast("string")
    item = F.struct(kind.alias("type"), ((10 - n) * 100_000 + F.col("l_partkey")).cast("int").alias("index"), box.alias("bbox"), none.alias("text"), none.alias("content"), none.alias("html"), none.alias("table_body"), none.alias("img_path"), F.array(F.struct(box.alias("bbox"), F.array(span("text", F.concat(F.lit("part "), F.col("l_partkey").cast("string"))), span("inline_equation", F.lit("x=1"))).alias("spans"))).alias("lines"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber"), item.alias("item")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "item"))).alias("i"))
    items = F.transform("i", lambda x: x["item"])
    other = F.array().cast(f"array<{layout_json.ITEM}>")
    page = F.struct(F.lit(0).alias("page_idx"), F.array(F.lit(612.0), F.lit(792.0)).alias("page_size"), items.alias("para_blocks"), F.slice(items, 1, 2).alias("images"), other.alias("tables"), other.alias("interline_equations"), F.slice(items, 1, 1).alias("discarded_blocks"))
    return lines.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.array(page).alias("pages"))


@query(
    """
WITH i AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS doc_id, l_linenumber AS n, l_partkey AS p, 'part ' || l_partkey || ' x=1' AS text FROM lineitem), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (10 - n) * 100000 + p) - 1 AS pos FROM i)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN n = 1 THEN 'heading' WHEN n % 3 = 0 THEN 'formula' ELSE 'paragraph' END AS role, text, n * 20.0::DOUBLE AS y0 FROM o WHERE n <> 5
"""
)
def io02_io03_io04_io20_layout_blocks(spark, sf_dir):
    """Blocks of layout items, each with a number of its own for its place."""
    from quire.sources import layout_json

    return layout_json.blocks(layouts(spark, sf_dir)).select("doc_id", "pos", "role", "text", F.col("box.y0").alias("y0"))


@query(
    """
WITH d AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 10 = 0 THEN 'read' WHEN o_orderkey % 10 = 1 THEN 'validate' END AS breaks, o_custkey % 4 AS repairs, o_custkey % 2 = 0 AS translates FROM orders)
SELECT doc_id, CAST(CASE WHEN breaks IS NULL THEN least(repairs, 2) ELSE 0 END AS INTEGER) AS attempt, CASE breaks WHEN 'read' THEN 1 WHEN 'validate' THEN 6 ELSE 10 + 4 * least(repairs, 2) END AS n_steps, CASE breaks WHEN 'read' THEN 'read_input' WHEN 'validate' THEN 'fail' ELSE 'complete' END AS last_node FROM d
"""
)
def ss04_ss05_workflows(spark, sf_dir):
    """Orders as documents: some fail at once, some in validation, the others want none to three repairs, of which two are made."""
    from quire.plans import workflow
    from quire.scratch import store

    n = F.col("o_orderkey")
    docs = table(spark, sf_dir, "orders").select(n.alias("doc_id"), F.when(n % 10 == 0, "read").when(n % 10 == 1, "validate").alias("breaks"), (F.col("o_custkey") % 4).cast("int").alias("repairs"), (F.col("o_custkey") % 2 == 0).alias("translates"))
    fails = lambda name: lambda rows: rows.withColumn("error", F.when(F.col("breaks") == name, "broken").otherwise(F.col("error")))
    planned = lambda rows: rows.withColumn("has_plans", F.lit(True))
    nodes = {"read_input": fails("read"), "validate_layout_plan": fails("validate"), "build_source_plans": planned, "translate_chunks": planned, "evaluate_render": lambda rows: rows.withColumn("repair_recommended", F.col("attempt") < F.col("repairs"))}
    final, steps = workflow.run(docs, nodes, store)
    # One aggregation over both: a join would send a row of each document through the driver, where its tables look small enough to be broadcast.
    none = F.lit(None)
    both = steps.select("doc_id", "step", "node", none.cast("int").alias("attempt")).unionByName(final.select("doc_id", none.cast("int").alias("step"), none.cast("string").alias("node"), "attempt"))
    return both.groupBy("doc_id").agg(F.max("attempt").alias("attempt"), F.count("step").alias("n_steps"), F.max_by("node", "step").alias("last_node"))
