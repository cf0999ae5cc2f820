"""The queries of the library's own operators over the test tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import geometry, ids, predicates, text
from quire.functions.fence import fenced
from quire.operators import chunks, events, formulas, integrity, jobs, layout, sections
from quire.plans import translation
from quire.scratch import store
from quire.session import table
from quire.sources.files import html_pages
from quire.sources.text import text_blocks, virtual_pages

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- the tables as documents, boxes and logs ---------------------------------------------------


def line_blocks(spark, sf_dir):
    """Lines of documents as blocks: `doc_id`, `pos`, `text`, `role`."""
    return text_blocks(table(spark, sf_dir, "documents"), by="line")


LINES = r"""
raw AS (SELECT doc_id, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS t, generate_subscripts(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1) AS k FROM documents),
clean AS (SELECT doc_id, k, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM raw),
placed AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS pos, text FROM clean WHERE text <> ''),
lines AS (SELECT *, CASE WHEN pos = 0 AND len(text) <= 120 THEN 'title' WHEN regexp_matches(text, '^(?i:abstract|摘要)\b') THEN 'abstract'
  WHEN len(text) <= 90 AND right(text, 1) NOT IN ('.', '。', '!', '！', '?', '？') THEN 'heading' ELSE 'paragraph' END AS role FROM placed)
"""


def boxes(spark, sf_dir):
    """Line items as boxes on the page of their order: `doc_id`, `page_id`, `item_id`, `ord`, `kind`, `box`."""
    i = table(spark, sf_dir, "lineitem")
    x0 = (F.col("l_partkey") % 400).cast("double")
    y0 = ((F.col("l_suppkey") * 37 + F.col("l_linenumber") * 61) % 600).cast("double")
    box = F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + 20 + F.col("l_quantity") * 2).alias("x1"), (y0 + 8 + F.col("l_partkey") % 60).alias("y1"))
    item = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"))
    kind = F.when(F.col("l_returnflag") == "A", "figure").when(F.col("l_returnflag") == "R", "table").otherwise("text")
    return i.select(F.floor(F.col("l_orderkey") / 4).cast("long").alias("doc_id"), F.col("l_orderkey").alias("page_id"), item.alias("item_id"), kind.alias("kind"), box.alias("box")).distinct().withColumn("ord", F.col("item_id"))


def box_pages(spark, sf_dir):
    """Orders as pages of 560 x 700 points."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.floor(F.col("o_orderkey") / 4).cast("long").alias("doc_id"), F.col("o_orderkey").alias("page_id"), (F.col("o_orderkey") % 4).alias("page_index"), F.lit(560.0).alias("width"), F.lit(700.0).alias("height"))


BOXES = """
boxes AS (SELECT DISTINCT CAST(floor(l_orderkey / 4) AS BIGINT) AS doc_id, l_orderkey AS page_id,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER)) AS item_id,
  CASE l_returnflag WHEN 'A' THEN 'figure' WHEN 'R' THEN 'table' ELSE 'text' END AS kind,
  CAST(l_partkey % 400 AS DOUBLE) AS x0, CAST((l_suppkey * 37 + l_linenumber * 61) % 600 AS DOUBLE) AS y0,
  CAST(l_partkey % 400 AS DOUBLE) + 20 + l_quantity * 2 AS x1, CAST((l_suppkey * 37 + l_linenumber * 61) % 600 AS DOUBLE) + 8 + l_partkey % 60 AS y1 FROM lineitem),
pages_ AS (SELECT CAST(floor(o_orderkey / 4) AS BIGINT) AS doc_id, o_orderkey AS page_id, o_orderkey % 4 AS page_index, 560.0::DOUBLE AS width, 700.0::DOUBLE AS height FROM orders)
"""
SHARE = "greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0))"


def ref_texts(spark, sf_dir):
    """Events as texts that refer to formulas: `doc_id` (the user), `pos`, `location`, `text`."""
    e = table(spark, sf_dir, "events")
    body = F.concat(F.lit("see {{formula:"), "event_type", F.lit("}} and {{formula:F"), (F.col("event_id") % 5).cast("string"), F.lit("}} or {{formula:"), "event_type", F.lit("}}"))
    return e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("location"), body.alias("text"))


def ref_formulas(spark, sf_dir):
    """Formulas of users: the types of their events, but for errors, and F1."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("formula_id")).where("formula_id <> 'error'").distinct()
    return e.unionByName(e.select("doc_id", F.lit("F1").alias("formula_id")).distinct()).withColumn("latex", F.concat(F.lit("x_{"), "formula_id", F.lit("}")))


REFS = r"""
texts AS (SELECT user_id AS doc_id, event_id AS pos, 'event ' || event_id AS location,
  'see {{formula:' || event_type || '}} and {{formula:F' || (event_id % 5) || '}} or {{formula:' || event_type || '}}' AS text FROM events),
types AS (SELECT DISTINCT user_id AS doc_id, event_type AS formula_id FROM events WHERE event_type <> 'error'),
formulas AS (SELECT *, 'x_{' || formula_id || '}' AS latex FROM (SELECT * FROM types UNION ALL SELECT DISTINCT doc_id, 'F1' FROM types))
"""


def entry(spark, sf_dir):
    """Texts to blocks, chunks, a plan, its check, and a report per document."""
    return plan_report(spark, sf_dir)


# --- sources, roles, tokens -----------------------------------------------------------------------


@query(r"""
WITH parts AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n\s*\n+'), lambda t: trim(regexp_replace(t, '\s+', ' ', 'g'))), lambda t: t <> '') AS p FROM documents),
each_one AS (SELECT doc_id, unnest(p) AS text, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS pos FROM parts)
SELECT doc_id, pos, md5(text) AS text_md5, CASE WHEN pos = 0 AND len(text) <= 120 THEN 'title' WHEN regexp_matches(text, '^(?i:abstract|摘要)\b') THEN 'abstract'
  WHEN len(text) <= 90 AND right(text, 1) NOT IN ('.', '。', '!', '！', '?', '？') THEN 'heading' ELSE 'paragraph' END AS role FROM each_one
""")
def io05_paragraph_blocks(spark, sf_dir):
    out = text_blocks(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "pos", F.md5(F.col("text").cast("binary")).alias("text_md5"), "role")


@query(f"WITH {LINES} SELECT doc_id, pos, text, role FROM lines")
def io05_line_blocks(spark, sf_dir):
    return line_blocks(spark, sf_dir)


@query(
    f"""
WITH RECURSIVE {LINES},
sized AS (SELECT doc_id, pos, role, greatest(24.0::DOUBLE, greatest(1, len(text) // 48 + 1) * 10.5::DOUBLE * CASE WHEN role IN ('title', 'heading') THEN 1.4::DOUBLE ELSE 1.25::DOUBLE END) AS h FROM lines),
fold AS (
  SELECT doc_id, pos, role, 1 AS page_no, 54.0::DOUBLE AS y0, h, 54.0::DOUBLE + h + 10.0 AS next_y FROM sized WHERE pos = 0
  UNION ALL
  SELECT s.doc_id, s.pos, s.role, CASE WHEN f.next_y + s.h > 738.0 THEN f.page_no + 1 ELSE f.page_no END,
    CASE WHEN f.next_y + s.h > 738.0 THEN 54.0::DOUBLE ELSE f.next_y END, s.h, CASE WHEN f.next_y + s.h > 738.0 THEN 54.0::DOUBLE ELSE f.next_y END + s.h + 10.0
  FROM fold f JOIN sized s ON s.doc_id = f.doc_id AND s.pos = f.pos + 1)
SELECT doc_id, pos, role, page_no, y0, least(738.0::DOUBLE, y0 + h) AS y1 FROM fold
"""
)
def io06_virtual_pages(spark, sf_dir):
    return virtual_pages(line_blocks(spark, sf_dir)).select("doc_id", "pos", "role", "page_no", "y0", "y1")


@query(
    rf"""
WITH {LINES}, f AS (SELECT *, pos // 20 AS page_index, pos % 20 AS block_index, 8 + pos % 6 AS size, lower(text) AS low FROM lines),
g AS (SELECT *, (contains(text, '=') OR regexp_matches(text, '[≤≥∑∫]') OR regexp_matches(text, '\b\d+\s*[+\-*/]\s*\d+\b') OR regexp_matches(text, '\b[A-Za-zα-ωΑ-Ω]\s*[+\-*/]\s*[A-Za-z0-9α-ωΑ-Ω]\b')) AS op FROM f)
SELECT doc_id, pos, CASE WHEN page_index = 0 AND block_index = 0 THEN 'title' WHEN regexp_matches(low, '^abstract\.?$') OR starts_with(low, 'abstract ') THEN 'abstract'
  WHEN regexp_matches(text, '(?i)^\s*(?:(?:fig\.|figure|table)\s*[A-Z]?\d+(?:[.\-][A-Za-z0-9]+)*\s*[.:：)])') THEN 'caption'
  WHEN regexp_matches(low, '^(references|bibliography|works cited)\.?$') OR regexp_matches(text, '^\[\d+\]') THEN 'reference'
  WHEN op AND NOT regexp_matches(text, '(?i)\s+(?:and|are|as|defined\s+as|due\s+to|equation|for|from|holds?|in|into\s+the|is|notably|preventing|ratio\s+of|represents?|resulting|scaled|shown|the|then|thus|to|unlike|where|which|while|with)\b')
    AND NOT regexp_matches(text, '\b[A-Za-z]{{4,}}\b(?:[\s,-]+\b[A-Za-z]{{4,}}\b){{2,}}') AND regexp_matches(text, '^[A-Za-z0-9\s+\-*/=().,<>\[\]{{}}\\≤≥∑∫α-ωΑ-Ω^_]+$') THEN 'formula'
  WHEN regexp_matches(text, '^\(?\d+(?:\.\d+)*\)?\s+[A-Z]') AND len(text) < 120 THEN 'heading'
  WHEN regexp_matches(text, '^\d+\.\s+\S+') AND regexp_matches(text, '\b(19|20)\d{{2}}[a-z]?\b') THEN 'reference'
  WHEN len(text) < 90 AND size >= 12 THEN 'heading' ELSE 'paragraph' END AS role FROM g
"""
)
def pf01_block_roles(spark, sf_dir):
    b = fenced(line_blocks(spark, sf_dir), ("_stripped", text.strip(F.col("text"))), ("_squeezed", text.squeeze(F.col("text"))))
    role = predicates.block_role(F.col("_stripped"), F.floor(F.col("pos") / 20), F.col("pos") % 20, 8 + F.col("pos") % 6, squeezed=F.col("_squeezed"))
    return b.select("doc_id", "pos", role.alias("role"))


@query(f"WITH {LINES} SELECT doc_id, pos, regexp_matches(text, '^[×+\\-*/=·\\s]+$') OR lower(text) IN ('dx', 'n', 'vn', 'ω') OR NOT regexp_matches(text, '[A-Za-z0-9α-ωΑ-Ω∂∇∫∑=+\\-*/^_]') AS noise FROM lines")
def pf05_noise(spark, sf_dir):
    return line_blocks(spark, sf_dir).select("doc_id", "pos", predicates.noise(F.col("text")).alias("noise"))


TOKENS = text.TOKEN.replace("'", "''")


@query(
    f"""
SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(list_transform(regexp_extract_all(text, '{TOKENS}', 0), lambda t: trim(t))),
  lambda t: {{'at': instr(text, t), 'n': -len(t), 't': t}})), lambda s: s.t), ' | ') AS tokens FROM documents
"""
)
def sl01_preserve_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.preserve_tokens(F.col("text")), " | ").alias("tokens"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def st23_strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("text"))


@query(f"WITH {LINES} SELECT doc_id, pos, CASE WHEN len(text) <= 60 THEN text ELSE rtrim(text[1:59]) || '…' END AS short FROM lines")
def st19_compact(spark, sf_dir):
    return line_blocks(spark, sf_dir).select("doc_id", "pos", text.compact(F.col("text"), 60).alias("short"))


@query(
    r"""
WITH a AS (SELECT doc_id, text, regexp_replace(text, '[\x{1100}-\x{11FF}\x{2E80}-\x{A4CF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FFEF}]', '', 'g') AS thin FROM documents),
b AS (SELECT doc_id, len(text) - len(thin) AS wide, len(thin) AS n, len(regexp_extract_all(thin, '\t')) AS tabs, len(regexp_extract_all(thin, '[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}]')) AS blanks,
  len(regexp_extract_all(thin, '\p{Lu}')) AS capitals, len(regexp_extract_all(thin, '[\p{Nd}²³¹]')) AS digits, len(regexp_extract_all(thin, '[!-/:-@\[-~\x00-\x08\x0E-\x1B\x7F]')) AS narrow FROM a)
SELECT doc_id, (tabs * 2.0::DOUBLE * 100 + (blanks - tabs) * 34 + wide * 100 + capitals * 64 + digits * 56 + narrow * 52 + (n - blanks - capitals - digits - narrow) * 72) / 100.0::DOUBLE AS ems FROM b
"""
)
def st24_width_units(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.width_units(F.col("text")).alias("ems"))


@query("SELECT event_id, user_id || ':' || substr(sha1(user_id || '|' || event_type || '|' || coalesce(props, '')), 1, 12) AS id FROM events")
def hs02_stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", ids.stable_id(F.concat(F.col("user_id").cast("string"), F.lit(":")), F.col("user_id"), F.col("event_type"), F.col("props")).alias("id"))


# --- sections and intents --------------------------------------------------------------------------


def _kind_sql() -> str:
    out = []
    for name, where, pattern, role in predicates.SECTION_RULES:
        tests = ([f"role = '{role}'"] if role else []) + ([f"regexp_matches(short, '(?i){'^' if where == 'start' else ''}(?:{pattern})')"] if pattern else [])
        out.append(f"WHEN {' OR '.join(tests)} THEN '{name}'")
    return f"CASE {' '.join(out)} ELSE 'body' END"


SECTIONS = rf"""{LINES}, shorted AS (SELECT *, CASE WHEN len(text) <= 140 THEN text ELSE rtrim(text[1:139]) || '…' END AS short, CASE WHEN len(text) <= 100 THEN text ELSE rtrim(text[1:99]) || '…' END AS name FROM lines),
kinded AS (SELECT *, {_kind_sql()} AS kind FROM shorted),
sections AS (SELECT doc_id, printf('%s_%02d', kind, pos + 1) AS section_id, pos, kind, CASE WHEN kind = 'body' THEN '' ELSE name END AS title,
  CASE WHEN kind IN ({", ".join(f"'{k}'" for k in predicates.FIRST_LEVEL)}) OR role = 'heading' THEN 1 ELSE 2 END AS level FROM kinded)"""


@query(f"WITH {SECTIONS} SELECT * FROM sections")
def pf14_sections(spark, sf_dir):
    return sections.sections(line_blocks(spark, sf_dir)).drop("flags")


@query(f"WITH {SECTIONS} SELECT doc_id, coalesce(string_agg(CASE WHEN kind = 'title' THEN section_id END, ',' ORDER BY pos), '') AS titles, coalesce(string_agg(CASE WHEN kind = 'heading' THEN section_id END, ',' ORDER BY pos), '') AS headings FROM sections GROUP BY doc_id")
def so05_sections_by_kind(spark, sf_dir):
    out = sections.by_kind(sections.sections(line_blocks(spark, sf_dir)), ["title", "heading"])
    return out.select("doc_id", F.array_join("title", ",").alias("titles"), F.array_join("heading", ",").alias("headings"))


#: Instructions as users write them, each by a document.
INSTRUCTIONS = (
    "Please set this graduation project proposal for my supervisor",
    "An undergraduate thesis with a cover page, abstract, keywords, a table of contents, the main text, references and acknowledgements",
    "Course paper in academic style with consistent citations and a bibliography",
    "Thesis: 12-point SimSun main text, 1.5 line spacing, 16-point SimHei headings, page numbers from the main text on",
    "Keep figures, tables and equations aligned in the thesis and add lists of figures and tables",
    "A lab report, please",
    "Book report: highlight important content, nothing promotional",
    "Social practice report of approximately 5,000 words with headers",
    "Group assignment: course name, project title and all group members",
    "Homework with student name, student ID and submission date",
    "实验报告，封面，摘要和参考文献",
    "Just make it look nice",
)


def instructions(spark, sf_dir):
    """An instruction for each document: `doc_id`, `instruction`."""
    of = F.element_at(F.array(*map(F.lit, INSTRUCTIONS)), (F.col("doc_id") % len(INSTRUCTIONS) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", of.alias("instruction"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_ASKED = f"""asked AS (SELECT doc_id, lower([{", ".join(map(_quoted, INSTRUCTIONS))}][doc_id % {len(INSTRUCTIONS)} + 1]) AS low FROM documents),
typed AS (SELECT *, CASE WHEN regexp_matches(low, '本科论文|毕业论文|学位论文|undergraduate\\s+thesis|\\bthesis\\b') THEN 'undergraduate_thesis' WHEN regexp_matches(low, 'social\\s+practice\\s+report|社会实践报告') THEN 'social_practice_report'
  WHEN regexp_matches(low, 'group\\s+course\\s+assignment|group\\s+assignment|小组作业|团队作业') THEN 'group_assignment' WHEN regexp_matches(low, 'book\\s+report|读书报告|读后感') THEN 'book_report'
  WHEN regexp_matches(low, '实验报告|lab(?:oratory)?\\s+report|experiment\\s+report') THEN 'lab_report' WHEN regexp_matches(low, '开题报告|proposal\\s+report|research\\s+proposal|graduation\\s+project\\s+proposal') THEN 'proposal_report'
  WHEN regexp_matches(low, '课程论文|course\\s+paper|term\\s+paper') THEN 'course_paper' WHEN regexp_matches(low, '普通作业|作业|homework|assignment') THEN 'homework' ELSE 'generic_academic' END AS document_kind FROM asked)"""


def _requirements_sql() -> str:
    """Every rule as a SELECT of its own, in order."""
    parts, n = [], 0
    for kind, rules in sections.BY_DOCUMENT_KIND.items():
        for r, c, k in rules:
            parts.append((r, c, k, f"document_kind = '{kind}'"))
    for r, c, k, pattern in sections.BY_KEYWORD:
        parts.append((r, c, k, f"regexp_matches(low, {_quoted(pattern)})"))
    out = []
    for n, (r, c, k, test) in enumerate(parts):
        out.append(f"SELECT doc_id, {n} AS rule, '{r}' AS requirement_id, '{c}' AS category, CAST([{', '.join(map(_quoted, k))}] AS VARCHAR[]) AS kinds FROM typed WHERE {test}")
    return " UNION ALL ".join(out)


@query(f"WITH {_ASKED}, hits AS ({_requirements_sql()}), k AS (SELECT doc_id, requirement_id, arg_min(category, rule) AS category, list_distinct(flatten(list(kinds))) AS kinds FROM hits GROUP BY doc_id, requirement_id) SELECT doc_id, requirement_id, category, array_to_string(list_sort(kinds), ',') AS kinds FROM k")
def pf18_requirements(spark, sf_dir):
    return sections.requirements(instructions(spark, sf_dir)).select("doc_id", "requirement_id", "category", F.array_join(F.array_sort("section_kinds"), ",").alias("kinds"))


@query(
    f"""
WITH {SECTIONS}, {_ASKED}, hits AS ({_requirements_sql()}), wanted AS (SELECT doc_id, requirement_id, arg_min(category, rule) AS category, list_distinct(flatten(list(kinds))) AS kinds FROM hits GROUP BY doc_id, requirement_id),
present AS (SELECT doc_id, list(DISTINCT kind) AS have FROM sections GROUP BY doc_id),
m AS (SELECT w.*, list_sort(list_filter(w.kinds, lambda x: NOT coalesce(list_contains(p.have, x), false))) AS missing FROM wanted w LEFT JOIN present p USING (doc_id))
SELECT doc_id, requirement_id, category, CASE WHEN len(kinds) = 0 THEN 'recognized' WHEN len(missing) = 0 THEN 'satisfied' ELSE 'missing' END AS status, coalesce(array_to_string(missing, ','), '') AS missing FROM m
"""
)
def j17_requirement_coverage(spark, sf_dir):
    out = sections.coverage(sections.requirements(instructions(spark, sf_dir)), sections.sections(line_blocks(spark, sf_dir)))
    return out.withColumn("missing", F.array_join("missing", ","))


@query(
    r"""
SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'undergraduate\s+thesis|\bthesis\b') THEN 'undergraduate_thesis' WHEN regexp_matches(lower(text), 'social\s+practice\s+report') THEN 'social_practice_report'
  WHEN regexp_matches(lower(text), 'group\s+course\s+assignment|group\s+assignment') THEN 'group_assignment' WHEN regexp_matches(lower(text), 'book\s+report') THEN 'book_report'
  WHEN regexp_matches(lower(text), 'lab(?:oratory)?\s+report|experiment\s+report') THEN 'lab_report' WHEN regexp_matches(lower(text), 'proposal\s+report|research\s+proposal') THEN 'proposal_report'
  WHEN regexp_matches(lower(text), 'course\s+paper|term\s+paper') THEN 'course_paper' WHEN regexp_matches(lower(text), 'homework|assignment') THEN 'homework' ELSE 'generic_academic' END AS document_kind,
  CASE WHEN regexp_matches(lower(text), '\bapa\b') THEN 'apa' WHEN regexp_matches(lower(text), '\bmla\b') THEN 'mla' WHEN regexp_matches(lower(text), '\bieee\b') THEN 'ieee' WHEN regexp_matches(lower(text), '\bchicago\b') THEN 'chicago' ELSE 'auto' END AS citation_style
FROM conversations
"""
)
def pf17_intents(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", predicates.first_rule(F.col("text"), predicates.DOCUMENT_KINDS, "generic_academic").alias("document_kind"), predicates.first_rule(F.col("text"), predicates.CITATION_STYLES, "auto").alias("citation_style"))


@query(
    f"""
WITH {LINES}, by_role AS (SELECT doc_id, role, count(*) AS n, CAST(sum(len(text)) AS BIGINT) AS c FROM lines GROUP BY doc_id, role)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_blocks, CAST(sum(c) + sum(n) - 1 AS BIGINT) AS n_chars, string_agg(role || '=' || n, ',' ORDER BY role) AS roles FROM by_role GROUP BY doc_id
"""
)
def ag01_document_counts(spark, sf_dir):
    out = sections.document_counts(line_blocks(spark, sf_dir))
    return out.withColumn("roles", F.array_join(F.transform(F.map_entries("roles"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))


# --- chunks and plans -------------------------------------------------------------------------------

CHUNKS = f"""{LINES},
fold AS (
  SELECT doc_id, pos, role, 1 AS chunk_no, 1 AS n, CAST(len(text) AS BIGINT) AS chars FROM lines WHERE pos = 0
  UNION ALL
  SELECT doc_id, pos, role, chunk_no + cut, CASE WHEN cut = 1 THEN 1 ELSE n + 1 END, CASE WHEN cut = 1 THEN size ELSE chars + size + 1 END
  FROM (SELECT b.doc_id, b.pos, b.role, f.chunk_no, f.n, f.chars, len(b.text) AS size,
    CASE WHEN b.role IN ('title', 'heading') OR (f.chars + len(b.text) + 1 > 600 AND NOT (f.role IN ('title', 'heading') AND f.n = 1)) THEN 1 ELSE 0 END AS cut
    FROM fold f JOIN lines b ON b.doc_id = f.doc_id AND b.pos = f.pos + 1)),
chunked AS (SELECT f.doc_id, f.pos, f.role, f.chunk_no, l.text FROM fold f JOIN lines l ON l.doc_id = f.doc_id AND l.pos = f.pos)"""


def TRANSLATED(mark: str) -> str:  # noqa: N802
    """SQL: the deterministic translation of `text`: a mark in front, but for texts of nothing but formula references."""
    return rf"CASE WHEN regexp_full_match(text, '(?:\s*\{{\{{formula:[A-Za-z0-9_.:-]+\}}\}}\s*)+') THEN text ELSE '{mark}' || text END"


#: The lines with their broken translation, as broken_plan() has it, but for those that it leaves out.
BROKEN = f"broken AS (SELECT *, CASE WHEN pos % 11 = 5 THEN ' ' WHEN pos % 13 = 4 THEN ({TRANSLATED('[fr] ')})[1:9] ELSE {TRANSLATED('[fr] ')} END AS t FROM lines)"


def source_blocks(spark, sf_dir):
    return chunks.source_blocks(line_blocks(spark, sf_dir), 600)


@query(f"WITH RECURSIVE {CHUNKS} SELECT doc_id, pos, chunk_no FROM chunked")
def w03_chunks(spark, sf_dir):
    return chunks.assign_chunks(line_blocks(spark, sf_dir), 600).select("doc_id", "pos", "chunk_no")


@query(f"WITH {LINES}, t AS (SELECT *, list(CASE WHEN role IN ('title', 'heading') THEN text END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM lines) SELECT doc_id, pos, coalesce(array_to_string(list_filter(l, lambda x: x IS NOT NULL)[-2:], ' > '), '') AS titles FROM t")
def w02_nearby_titles(spark, sf_dir):
    return chunks.nearby_titles(line_blocks(spark, sf_dir)).select("doc_id", "pos", F.array_join("nearby_titles", " > ").alias("titles"))


@query(
    f"""
WITH RECURSIVE {CHUNKS}, c AS (SELECT doc_id, chunk_no, CAST(count(*) AS INTEGER) AS n_blocks, CAST(sum(len(text)) + count(*) - 1 AS BIGINT) AS n_chars,
  array_to_string(list(text ORDER BY pos)[-2:], ' ') AS two FROM chunked GROUP BY doc_id, chunk_no)
SELECT doc_id, printf('%d_chunk_%04d', doc_id, chunk_no) AS chunk_id, CAST(chunk_no AS INTEGER) AS index, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total, n_blocks, n_chars,
  lag(CASE WHEN len(two) <= 220 THEN two ELSE rtrim(two[1:219]) || '…' END) OVER (PARTITION BY doc_id ORDER BY chunk_no) AS tail FROM c
"""
)
def w04_chunk_context(spark, sf_dir):
    out = chunks.chunk_rows(source_blocks(spark, sf_dir))
    tail = F.regexp_extract("context", r"(?s)Previous chunk tail: (.*)\.\nCurrent chunk summary: ", 1)
    return out.select("doc_id", "chunk_id", "index", "total", "n_blocks", "n_chars", F.when(tail != "", tail).alias("tail"))


@query(f"WITH RECURSIVE {CHUNKS}, p AS (SELECT *, {TRANSLATED('【译】')} AS t FROM chunked) SELECT doc_id, chunk_no, pos, role, 'zh' AS target_lang, t AS translated_text, CASE WHEN t = text THEN 'formula_preserved_without_translation' ELSE 'mock_translation' END AS flag FROM p")
def u01_deterministic_plan(spark, sf_dir):
    """A plan of all blocks. Lines have no formula role, so of the two formula rules only that for texts of references applies."""
    plan = translation.deterministic(source_blocks(spark, sf_dir), "zh")
    return plan.select("doc_id", "chunk_no", "pos", "role", "target_lang", "translated_text", F.col("quality_flags")[0].alias("flag"))


def broken_plan(spark, sf_dir, sources=None):
    """A plan that lacks every 17th block, shortens every 13th and blanks every 11th; of `sources`, if they are at hand."""
    plan = translation.deterministic(source_blocks(spark, sf_dir) if sources is None else sources, "fr").where("pos % 17 <> 3")
    cut = F.when(F.col("pos") % 11 == 5, F.lit(" ")).when(F.col("pos") % 13 == 4, F.substring("translated_text", 1, 9)).otherwise(F.col("translated_text"))
    return plan.withColumn("translated_text", cut)


def sources_and_plan(spark, sf_dir):
    """(source blocks, their broken plan). The blocks are written once: they are read two or three times, and folding documents into chunks and searching them for tokens takes most of the time."""
    sources = store(source_blocks(spark, sf_dir).drop("nearby_titles"), "sources")
    return sources, broken_plan(spark, sf_dir, sources)


@query(
    rf"""
WITH {LINES}, {BROKEN}, r AS (SELECT DISTINCT doc_id, pos, t, unnest(regexp_extract_all(text, '\{{\{{formula:[A-Za-z0-9_.:-]+\}}\}}')) AS ref FROM broken WHERE pos % 17 <> 3)
SELECT doc_id, pos, 'missing_block' AS code, '' AS detail FROM lines WHERE pos % 17 = 3 UNION ALL SELECT doc_id, pos, 'missing_token', ref FROM r WHERE NOT contains(t, ref)
"""
)
def j02_plan_coverage(spark, sf_dir):
    """All issues. All tokens stand among the inline items, so only formula references can be lost; j02_lost_refs loses others too."""
    return translation.coverage_issues(*sources_and_plan(spark, sf_dir)).select("doc_id", "pos", "code", "detail")


@query(
    f"""
WITH {LINES} SELECT doc_id, pos, 'missing_token' AS code, '{{{{formula:q' || (pos % 4) || '}}}}' AS detail FROM lines WHERE pos % 3 = 1
UNION ALL SELECT doc_id, pos, 'missing_token', '[7]' FROM lines WHERE pos % 6 = 4
UNION ALL SELECT doc_id, pos + 100000, 'unknown_block', '' FROM lines WHERE pos % 5 = 0
"""
)
def j02_lost_refs(spark, sf_dir):
    """Plans that lose a formula reference in every third block, a citation in every sixth (also from the inline items), and make up every fifth block once more."""
    ref = F.concat(F.lit("{{formula:q"), (F.col("pos") % 4).cast("string"), F.lit("}}"))
    src = line_blocks(spark, sf_dir).select("doc_id", F.lit(1).alias("chunk_no"), "pos", F.array(ref, F.lit("[7]")).alias("preserve_tokens"))
    shown = F.when(F.col("pos") % 3 == 1, F.lit("nothing")).otherwise(F.concat(ref, F.lit(" kept")))
    items = F.when(F.col("pos") % 6 == 4, F.array().cast("array<struct<kind:string,text:string>>")).otherwise(F.array(F.struct(F.lit("citation").alias("kind"), F.lit("[7]").alias("text")), F.struct(F.lit("formula").alias("kind"), ref.alias("text"))))
    plan = src.select("doc_id", "chunk_no", "pos", shown.alias("translated_text"), items.alias("inline_items"))
    more = plan.where("pos % 5 = 0").withColumn("pos", F.col("pos") + 100_000)
    return translation.coverage_issues(src, plan.unionByName(more)).select("doc_id", "pos", "code", "detail")


@query(
    f"""
WITH {LINES}, {BROKEN}
SELECT doc_id, pos, CASE WHEN pos % 17 = 3 OR trim(t) = '' THEN text ELSE t END AS shown_text, CASE WHEN pos % 17 = 3 THEN 'missing_translation' WHEN trim(t) = '' THEN 'empty_translation' ELSE '' END AS flags FROM broken
"""
)
def j01_rendered_blocks(spark, sf_dir):
    out = translation.rendered(line_blocks(spark, sf_dir), broken_plan(spark, sf_dir))
    return out.select("doc_id", "pos", "shown_text", F.array_join("flags", ",").alias("flags"))


def _bare(text: str) -> str:
    """SQL: a text without its tokens, references and numeric citations, squeezed and trimmed."""
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(list_reduce(list_prepend({text}, tokens), lambda a, b: replace(a, b, ' ')), '\{{\{{formula:[A-Za-z0-9_.:-]+\}}\}}', ' ', 'g'), '\[[0-9,\-\s;]+\]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(
    rf"""
WITH {LINES}, {BROKEN}, k AS (SELECT *, list_transform(list_sort(list_transform(list_distinct(list_transform(regexp_extract_all(text, '{TOKENS}', 0), lambda x: trim(x))), lambda x: {{'at': instr(text, x), 'n': -len(x), 't': x}})), lambda s: s.t) AS tokens FROM broken
  WHERE pos % 17 <> 3 AND NOT regexp_full_match(text, '(?:\s*\{{\{{formula:[A-Za-z0-9_.:-]+\}}\}}\s*)+')),
q AS (SELECT doc_id, pos, {_bare("text")} AS s, {_bare("t")} AS u FROM k), r AS (SELECT *, len(u) / len(s) AS ratio FROM q WHERE s <> '')
SELECT doc_id, pos, 'translation_quality_empty' AS flag, 'severe' AS severity FROM r WHERE u = ''
UNION ALL SELECT doc_id, pos, 'translation_quality_suspiciously_short', 'severe' FROM r WHERE u <> '' AND len(s) >= 80 AND ratio < 0.18
UNION ALL SELECT doc_id, pos, 'translation_quality_suspiciously_long', 'warning' FROM r WHERE u <> '' AND len(s) >= 80 AND ratio > 2.8
"""
)
def j19_quality_issues(spark, sf_dir):
    return translation.quality_issues(*sources_and_plan(spark, sf_dir), "fr").select("doc_id", "pos", "flag", "severity")


#: A glossary: source terms and what they are to become in French.
TERMS = (("the", "le"), ("and", "et"), ("tion", "cion"), ("Er", "ER"), ("x y", "y x"), ("a", "à"), ("zz top", "haut"))


@query(
    rf"""
WITH {LINES}, {BROKEN}, g AS (SELECT unnest([{", ".join(f"{{'s': '{a.lower()}', 't': '{b.lower()}'}}" for a, b in TERMS)}]) AS g), k AS (SELECT doc_id, pos, text, t, list_transform(list_sort(list_transform(list_distinct(list_transform(regexp_extract_all(text, '{TOKENS}', 0), lambda x: trim(x))), lambda x: {{'at': instr(text, x), 'n': -len(x), 't': x}})), lambda s: s.t) AS tokens FROM broken
  WHERE pos % 17 <> 3 AND NOT regexp_full_match(text, '(?:\s*\{{\{{formula:[A-Za-z0-9_.:-]+\}}\}}\s*)+')), q AS (SELECT * FROM k WHERE {_bare("text")} <> '')
SELECT DISTINCT doc_id, pos FROM q, g WHERE g.s <> g.t AND contains(lower(text), g.s) AND NOT contains(lower(t), g.t)
"""
)
def j19_u04_key_terms(spark, sf_dir):
    terms = spark.createDataFrame(list(TERMS), "source_term string, target_term string")
    return translation.missing_terms(*sources_and_plan(spark, sf_dir), terms).select("doc_id", "pos")


@query(f"WITH {LINES} SELECT doc_id, arg_min(text, pos) FILTER (role = 'title') AS title, array_to_string((list(text ORDER BY pos) FILTER (role = 'heading'))[1:6], ' | ') AS headings, array_to_string((list(text ORDER BY pos) FILTER (role = 'paragraph'))[1:3], ' | ') AS paragraphs FROM lines GROUP BY doc_id".replace("array_to_string(", "coalesce(array_to_string(").replace(", ' | ')", ", ' | '), '')"))
def ag20_brief(spark, sf_dir):
    return translation.brief(line_blocks(spark, sf_dir)).select("doc_id", "title", F.array_join("headings", " | ").alias("headings"), F.array_join("paragraphs", " | ").alias("paragraphs"))


@query(
    rf"""
WITH RECURSIVE {CHUNKS}, {BROKEN}, r AS (SELECT DISTINCT doc_id, pos, t, unnest(regexp_extract_all(text, '\{{\{{formula:[A-Za-z0-9_.:-]+\}}\}}')) AS ref FROM broken WHERE pos % 17 <> 3),
i AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM lines WHERE pos % 17 = 3 UNION ALL SELECT doc_id FROM r WHERE NOT contains(t, ref)) GROUP BY doc_id)
SELECT c.doc_id, CAST(max(chunk_no) AS INTEGER) AS n_chunks, count(*) AS n_blocks, CAST(coalesce(any_value(i.n), 0) AS BIGINT) AS n_issues FROM chunked c LEFT JOIN i ON i.doc_id = c.doc_id GROUP BY c.doc_id
"""
)
def plan_report(spark, sf_dir):
    """The smallest whole path: texts, blocks, chunks, a plan (broken_plan), its coverage of the blocks, a report per document."""
    sources, plan = sources_and_plan(spark, sf_dir)
    issues = translation.coverage_issues(sources, plan).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_issues"))
    report = sources.groupBy("doc_id").agg(F.max("chunk_no").alias("n_chunks"), F.count(F.lit(1)).alias("n_blocks"))
    return report.join(issues, "doc_id", "left").select("doc_id", "n_chunks", "n_blocks", F.coalesce("n_issues", F.lit(0)).cast("long").alias("n_issues"))


@query(f"WITH {LINES}, {BROKEN}, p AS (SELECT *, CASE WHEN pos % 17 = 3 OR trim(t) = '' THEN text ELSE t END AS u FROM broken), e AS (SELECT doc_id, CASE role WHEN 'title' THEN 9 WHEN 'heading' THEN 9 ELSE 7 END + len(replace(replace(replace(u, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS n FROM p) SELECT doc_id, CAST(16 + sum(n) + count(*) - 1 AS INTEGER) AS n FROM e GROUP BY doc_id")
def io21_html(spark, sf_dir):
    return html_pages(translation.rendered(line_blocks(spark, sf_dir), broken_plan(spark, sf_dir))).select("doc_id", F.length("html").alias("n"))


# --- integrity ---------------------------------------------------------------------------------------


@query(f"WITH {REFS}, r AS (SELECT DISTINCT doc_id, location, unnest(regexp_extract_all(text, '\\{{\\{{formula:([A-Za-z0-9_.:-]+)\\}}\\}}', 1)) AS ref_id FROM texts) SELECT r.doc_id, CASE WHEN regexp_full_match(ref_id, 'F[A-Za-z0-9_]+') THEN 'stale_legacy_formula_ref' ELSE 'unknown_formula_ref' END AS code, location, ref_id FROM r ANTI JOIN formulas f ON r.doc_id = f.doc_id AND r.ref_id = f.formula_id")
def j03_unknown_refs(spark, sf_dir):
    return integrity.reference_issues(ref_texts(spark, sf_dir), ref_formulas(spark, sf_dir))


@query(
    f"""
WITH {REFS}, u AS (SELECT doc_id, list_sort(list_distinct(list(r))) AS u FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\{{\\{{formula:([A-Za-z0-9_.:-]+)\\}}\\}}', 1)) AS r FROM texts) GROUP BY doc_id),
k AS (SELECT doc_id, list_sort(list_distinct(list(formula_id))) AS k FROM formulas GROUP BY doc_id)
SELECT u.doc_id, array_to_string(u, ',') AS referenced, coalesce(array_to_string(list_filter(u, lambda x: k IS NULL OR NOT list_contains(k, x)), ','), '') AS unknown,
  coalesce(array_to_string(list_filter(k, lambda x: NOT list_contains(u, x)), ','), '') AS unused, CAST(len(u) AS INTEGER) AS n_referenced FROM u LEFT JOIN k USING (doc_id)
"""
)
def ag07_formula_ref_sets(spark, sf_dir):
    out = integrity.formula_ref_sets(ref_texts(spark, sf_dir), ref_formulas(spark, sf_dir))
    return out.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("referenced", "unknown", "unused")], "n_referenced")


@query(
    f"""
WITH {REFS}, e AS (SELECT user_id AS doc_id, event_id AS pos, event_type AS a, 'F' || (event_id % 5) AS b FROM events)
SELECT e.doc_id, e.pos, 'see ' || coalesce(fa.latex, '{{{{formula:' || a || '}}}}') || ' and ' || coalesce(fb.latex, '{{{{formula:' || b || '}}}}') || ' or ' || coalesce(fa.latex, '{{{{formula:' || a || '}}}}') AS text
FROM e LEFT JOIN formulas fa ON fa.doc_id = e.doc_id AND fa.formula_id = e.a LEFT JOIN formulas fb ON fb.doc_id = e.doc_id AND fb.formula_id = e.b
"""
)
def j20_substitute_refs(spark, sf_dir):
    return integrity.substitute_refs(ref_texts(spark, sf_dir), ref_formulas(spark, sf_dir)).select("doc_id", "pos", "text")


@query("SELECT l_orderkey AS doc_id, 'duplicate_item_id' AS code, CAST(l_linenumber AS VARCHAR) AS ref_id FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def j08_duplicate_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber")
    return integrity.duplicate_keys(rows, ["l_linenumber"], "item").select("doc_id", "code", "ref_id")


@query("SELECT DISTINCT o_custkey % 7 AS doc_id, 'unknown_key' AS code, CAST(o_custkey AS VARCHAR) AS ref_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)")
def j08_missing_parents(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("doc_id"), F.col("o_custkey").alias("key"))
    parents = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select((F.col("c_custkey") % 7).alias("doc_id"), F.col("c_custkey").alias("key"))
    return integrity.missing_parents(rows, "key", parents, "order").select("doc_id", "code", "ref_id")


# --- layout ------------------------------------------------------------------------------------------


@query(f"WITH {BOXES} SELECT a.doc_id, a.page_id, a.item_id AS first_id, b.item_id AS second_id, {SHARE} AS share FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.page_id = b.page_id AND a.item_id < b.item_id WHERE {SHARE} >= 0.12")
def j12_overlaps(spark, sf_dir):
    return layout.overlaps(boxes(spark, sf_dir))


@query(f"WITH {BOXES} SELECT b.doc_id, b.page_id, b.item_id FROM boxes b JOIN pages_ p USING (doc_id, page_id) WHERE b.x1 > 440.01 OR b.y1 > 600.01 OR b.x0 < -0.01 OR b.y0 < -0.01")
def j12_outside_page(spark, sf_dir):
    """Boxes that pass the edges of smaller pages, of 440 x 600 points."""
    pages = box_pages(spark, sf_dir).withColumns({"width": F.lit(440.0), "height": F.lit(600.0)})
    return layout.outside_page(boxes(spark, sf_dir), pages)


NEAR = "greatest(0.0, b.y0 - a.y1, a.y0 - b.y1) <= 90 AND greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / greatest(1.0, least(a.x1 - a.x0, b.x1 - b.x0)) >= 0.35"


@query(f"WITH {BOXES} SELECT b.doc_id, b.page_id, b.item_id FROM boxes b WHERE b.kind = 'text' AND EXISTS (SELECT 1 FROM boxes a WHERE a.doc_id = b.doc_id AND a.page_id = b.page_id AND a.kind <> 'text' AND {NEAR})")
def j09_near_assets(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return layout.near_assets(b.where("kind = 'text'"), b).select("doc_id", "page_id", "item_id")


@query(
    f"WITH {BOXES}, h AS (SELECT b.doc_id, b.page_id, b.item_id AS candidate_id, a.item_id AS asset_id, {SHARE} AS share FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.page_id = b.page_id AND a.kind <> 'text' AND b.kind = 'text') "
    "SELECT doc_id, page_id, candidate_id, asset_id, share FROM h WHERE share >= 0.6 QUALIFY row_number() OVER (PARTITION BY doc_id, page_id, candidate_id ORDER BY share DESC, asset_id) = 1"
)
def j10_best_asset(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return layout.best_asset(b.where("kind = 'text'").withColumnRenamed("item_id", "candidate_id"), b.where("kind <> 'text'").withColumnRenamed("item_id", "asset_id"))


@query(
    f"""
WITH RECURSIVE {BOXES}, a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_id ORDER BY y0, x0, item_id) AS k FROM boxes WHERE kind = 'figure'),
s AS (SELECT a.doc_id, a.page_id, a.item_id AS asset_id, a.k, c.item_id AS caption_id, greatest(0.0, c.y0 - a.y1, a.y0 - c.y1) + CASE WHEN c.y1 <= a.y0 THEN 30.0 ELSE 0.0 END + abs((a.x0 + a.x1) / 2 - (c.x0 + c.x1) / 2) * 0.05::DOUBLE AS score
  FROM a JOIN boxes c ON c.doc_id = a.doc_id AND c.page_id = a.page_id AND c.kind = 'text' WHERE greatest(0.0, c.y0 - a.y1, a.y0 - c.y1) <= 90),
o AS (SELECT a.doc_id, a.page_id, a.item_id AS asset_id, a.k, list({{'score': s.score, 'caption': s.caption_id}} ORDER BY s.score, s.caption_id) FILTER (s.caption_id IS NOT NULL) AS near FROM a LEFT JOIN s ON s.doc_id = a.doc_id AND s.page_id = a.page_id AND s.asset_id = a.item_id GROUP BY ALL),
f AS (SELECT doc_id, page_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS asset_id, CAST(NULL AS STRUCT(score DOUBLE, caption VARCHAR)) AS pick, CAST([] AS VARCHAR[]) AS used FROM o WHERE k = 1
  UNION ALL SELECT o.doc_id, o.page_id, o.k, o.asset_id, list_filter(o.near, lambda x: NOT list_contains(f.used, x.caption))[1], list_append(f.used, coalesce(list_filter(o.near, lambda x: NOT list_contains(f.used, x.caption))[1].caption, '')) FROM f JOIN o ON o.doc_id = f.doc_id AND o.page_id = f.page_id AND o.k = f.k + 1)
SELECT doc_id, page_id, asset_id, pick.caption AS caption_id, pick.score AS score FROM f WHERE pick IS NOT NULL
"""
)
def j11_caption_pairs(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return layout.caption_pairs(b.where("kind = 'text'").withColumnRenamed("item_id", "caption_id"), b.where("kind = 'figure'").withColumnRenamed("item_id", "asset_id"))


ORDER = """row_number() OVER (PARTITION BY b.doc_id, b.page_id ORDER BY g, round_even(b.y0 / 8, 0), CASE WHEN two THEN round_even(b.y0, 1) ELSE round_even(b.x0, 1) END, CASE WHEN two THEN round_even(b.x0, 1) ELSE round_even(b.y0, 1) END, round_even(b.x1 - b.x0, 1), b.item_id) - 1"""


@query(
    f"""
WITH {BOXES}, f AS (SELECT b.*, p.width AS w, (b.x1 - b.x0) <= p.width * 0.58 AND NOT ((b.x1 - b.x0) < 14 AND b.y1 - b.y0 > 40) AS body, (b.x0 + b.x1) / 2 < p.width / 2 AS lft FROM boxes b JOIN pages_ p USING (doc_id, page_id)),
s AS (SELECT doc_id, page_id, count(*) >= 3 AND coalesce(max(x1) FILTER (body AND lft) - min(x0) FILTER (body AND lft) < max(w) * 0.58 AND max(x1) FILTER (body AND NOT lft) - min(x0) FILTER (body AND NOT lft) < max(w) * 0.58, false) AS two, min(y0) FILTER (body) AS top, max(y1) FILTER (body) AS bottom FROM f GROUP BY doc_id, page_id),
b AS (SELECT f.*, s.two, CASE WHEN NOT s.two THEN 0.0 WHEN body THEN CASE WHEN lft THEN 0.0 ELSE 1.0 END WHEN y1 < top THEN -1.0 WHEN y0 > bottom THEN 2.0 ELSE 1.5 END AS g FROM f JOIN s USING (doc_id, page_id))
SELECT doc_id, page_id, item_id, CAST({ORDER} AS INTEGER) AS reading_order FROM b
"""
)
def w01_reading_order(spark, sf_dir):
    out = layout.reading_order(boxes(spark, sf_dir).withColumnRenamed("item_id", "block_id"), box_pages(spark, sf_dir))
    return out.select("doc_id", "page_id", F.col("block_id").alias("item_id"), "reading_order")


@query(
    f"""
WITH {BOXES}, t AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page_id ORDER BY item_id) AS DOUBLE) AS o FROM boxes WHERE kind = 'text')
SELECT a.doc_id, a.page_id, a.item_id AS asset_id, coalesce(max(t.o) + 0.5, -0.5) AS place FROM boxes a LEFT JOIN t ON t.doc_id = a.doc_id AND t.page_id = a.page_id AND t.y0 <= a.y0 WHERE a.kind <> 'text' GROUP BY ALL
"""
)
def j13_asset_order(spark, sf_dir):
    from pyspark.sql import Window as W

    b = boxes(spark, sf_dir)
    blocks = b.where("kind = 'text'").withColumn("reading_order", F.row_number().over(W.partitionBy("doc_id", "page_id").orderBy("item_id")))
    return layout.asset_order(b.where("kind <> 'text'").withColumnRenamed("item_id", "asset_id"), blocks)


def HALF_EVEN(value: str, of: int) -> str:  # noqa: N802
    """SQL: a whole number divided by another, rounded to 4 digits, ties to even."""
    n = f"CAST({value} AS BIGINT) * 10000"
    return f"(({n}) // {of} + CASE WHEN 2 * (({n}) % {of}) > {of} OR (2 * (({n}) % {of}) = {of} AND (({n}) // {of}) % 2 = 1) THEN 1 ELSE 0 END) / 10000.0::DOUBLE"


@query(
    f"""
WITH {BOXES}, u AS (SELECT doc_id, page_id, sum((x1 - x0) * (y1 - y0)) AS a, max(y1) AS y, count(*) AS n FROM boxes GROUP BY doc_id, page_id),
v AS (SELECT p.doc_id, p.page_id, coalesce(n, 0) AS n_items, {HALF_EVEN('coalesce(a, 0.0)', 392000)} AS utilization, {HALF_EVEN('greatest(0.0, 700.0 - coalesce(y, 0.0))', 700)} AS bottom_whitespace FROM pages_ p LEFT JOIN u USING (doc_id, page_id))
SELECT *, (utilization < 0.18 AND bottom_whitespace >= 0.3) OR (bottom_whitespace >= 0.45 AND utilization <= 0.35) AS underfilled FROM v
"""
)
def ag04_page_use(spark, sf_dir):
    return layout.page_use(boxes(spark, sf_dir), box_pages(spark, sf_dir))


@query(f"WITH {BOXES} SELECT b.doc_id, kind AS text, count(DISTINCT page_id) AS n_pages FROM boxes b JOIN pages_ p USING (doc_id, page_id) WHERE y0 <= 56.0 OR y1 >= 644.0 GROUP BY b.doc_id, kind HAVING count(DISTINCT page_id) >= 2")
def ag03_repeated_margins(spark, sf_dir):
    return layout.repeated_margin_text(boxes(spark, sf_dir).withColumnRenamed("kind", "text"), box_pages(spark, sf_dir))


@query(
    f"""
WITH {BOXES}, f AS (SELECT doc_id, arg_min(page_id, page_index) AS page_id FROM pages_ GROUP BY doc_id)
SELECT b.doc_id, greatest(36.0, least(72.0, min(x0))) AS "left", greatest(36.0, least(72.0, min(y0))) AS top, greatest(36.0, least(72.0, 560.0 - max(x1))) AS "right", greatest(36.0, least(72.0, 700.0 - max(y1))) AS bottom FROM boxes b JOIN f USING (doc_id, page_id) GROUP BY b.doc_id
"""
)
def ag16_source_margins(spark, sf_dir):
    return layout.source_margins(boxes(spark, sf_dir), box_pages(spark, sf_dir))


@query("SELECT l_orderkey AS page_id, list_sort(list(l_quantity))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS median FROM lineitem GROUP BY l_orderkey")
def ag12_upper_median(spark, sf_dir):
    return layout.upper_median(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "page_id"), ["page_id"], "l_quantity")


@query("SELECT l_orderkey AS doc_id, greatest(18.0, least(48.0, coalesce(median(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 22.0))) AS height FROM lineitem GROUP BY l_orderkey")
def ag13_display_height(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_returnflag") == "A", "display").otherwise("inline").alias("display_mode"), F.col("l_quantity").alias("height"))
    return layout.display_height(i)


@query(
    f"""
WITH {BOXES}, l AS (SELECT *, lag(y1) OVER w AS py, lag((x0 + x1) / 2) OVER w AS pc FROM boxes WINDOW w AS (PARTITION BY doc_id, page_id ORDER BY item_id))
SELECT doc_id, page_id, item_id, CAST(sum(CASE WHEN coalesce(y0 - py <= 14.0 AND abs((x0 + x1) / 2 - pc) <= 32.0, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_id ORDER BY item_id) AS INTEGER) AS island FROM l
"""
)
def w07_islands(spark, sf_dir):
    return layout.islands(boxes(spark, sf_dir), "item_id").select("doc_id", "page_id", "item_id", "island")


@query(
    f"""
WITH {BOXES}, m AS (SELECT *, max(y1) OVER (PARTITION BY doc_id, page_id ORDER BY y0, y1, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS deep FROM boxes)
SELECT doc_id, page_id, item_id, CAST(sum(CASE WHEN y0 <= deep + 10.0 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_id ORDER BY y0, y1, item_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS band FROM m
"""
)
def w05_bands(spark, sf_dir):
    return layout.bands(boxes(spark, sf_dir)).select("doc_id", "page_id", "item_id", "band")


@query("SELECT user_id AS doc_id, event_type AS flag, count(*) AS n FROM events GROUP BY user_id, event_type")
def ag02_flag_histogram(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.array("event_type").alias("flags"))
    return layout.flag_histogram(e, "flags", ["doc_id"])


@query("SELECT user_id AS doc_id, coalesce(string_agg(DISTINCT CASE WHEN event_type IN ('error', 'signup') THEN event_type END, ',' ORDER BY CASE WHEN event_type IN ('error', 'signup') THEN event_type END), '') AS blocking, count(*) FILTER (event_type IN ('error', 'signup')) AS n_blocking, count(*) FILTER (event_type IN ('error', 'signup')) = 0 AS accepted FROM events GROUP BY user_id")
def ag05_gate(spark, sf_dir):
    return layout.gate(ag02_flag_histogram(spark, sf_dir), ["error", "signup"]).select("doc_id", F.array_join("blocking", ",").alias("blocking"), "n_blocking", "accepted")


# --- logs and jobs -----------------------------------------------------------------------------------


def log_sources(spark, sf_dir):
    """Events as two log sources that overlap: all of them, and the errors again with later sequences."""
    e = table(spark, sf_dir, "events")
    row = lambda df, base: df.select(F.col("user_id").alias("job_id"), F.col("event_id").cast("string").alias("id"), (F.col("event_id") * 10 + base).cast("long").alias("sequence"), "event_type")
    return [row(e, 100), row(e.where("event_type = 'error'"), 9000)]


@query("SELECT user_id AS job_id, CAST(event_id AS VARCHAR) AS id, CAST(event_id * 10 + 100 AS BIGINT) AS sequence, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 80")
def w12_merged_log(spark, sf_dir):
    return events.merge_events(log_sources(spark, sf_dir), "job_id", 80)


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def ss10_keep_last(spark, sf_dir):
    return events.keep_last(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, coalesce(sum(len(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM conversations) WHERE b < 900")
def sl03_log_tail(spark, sf_dir):
    return events.log_tail(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 900).select("conv_id", "turn")


def updates(spark, sf_dir):
    state = F.when(F.col("event_type") == "error", "canceled").when(F.col("event_type") == "signup", "queued").otherwise("rendering")
    return table(spark, sf_dir, "events").select(F.concat_ws("-", "user_id", (F.col("event_id") % 7)).alias("job_id"), F.col("event_id").alias("seq"), state.alias("state"))


@query(
    """
WITH u AS (SELECT concat_ws('-', user_id, event_id % 7) AS job_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'canceled' WHEN 'signup' THEN 'queued' ELSE 'rendering' END AS state FROM events)
SELECT job_id, CASE WHEN count(*) FILTER (state = 'canceled') > 0 THEN 'canceled' ELSE arg_max(state, seq) END AS state, coalesce(min(seq) FILTER (state = 'canceled'), max(seq)) AS seq, count(*) AS n_updates FROM u GROUP BY job_id
"""
)
def ss03_sticky_states(spark, sf_dir):
    return jobs.sticky_status(updates(spark, sf_dir))


@query(
    """
WITH j AS (SELECT o_orderkey AS job_id, o_custkey AS doc_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'queued' WHEN '2-HIGH' THEN 'parsing' WHEN '3-MEDIUM' THEN 'translating' WHEN '5-LOW' THEN 'rendering' ELSE 'completed' END AS state FROM orders),
up AS (SELECT DISTINCT c_custkey AS doc_id FROM customer WHERE c_acctbal > 3000),
have AS (SELECT c_custkey AS doc_id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')), chunked AS (SELECT c_custkey AS doc_id FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD') AND c_nationkey < 20)
SELECT job_id, state, CASE WHEN state IN ('translating', 'rendering') AND doc_id IN (SELECT doc_id FROM have) AND doc_id IN (SELECT doc_id FROM chunked) THEN 'continue' WHEN doc_id IN (SELECT doc_id FROM up) THEN 'restart' ELSE 'fail' END AS action
FROM j WHERE state IN ('queued', 'parsing', 'translating', 'rendering')
"""
)
def j25_resume_actions(spark, sf_dir):
    p = F.col("o_orderpriority")
    state = F.when(p == "1-URGENT", "queued").when(p == "2-HIGH", "parsing").when(p == "3-MEDIUM", "translating").when(p == "5-LOW", "rendering").otherwise("completed")
    j = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("doc_id"), state.alias("state"))
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "doc_id")
    made = lambda name, test: c.where(test).select("doc_id", F.lit(name).alias("name"))
    artifacts = made("document-ir", "c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')").unionByName(made("translation-chunks", "c_mktsegment IN ('BUILDING', 'HOUSEHOLD') AND c_nationkey < 20"))
    return jobs.resume_actions(j, c.where("c_acctbal > 3000").select("doc_id"), artifacts).select("job_id", "state", "action")


@query("SELECT CAST(user_id AS VARCHAR) AS workflow_id, arg_max(event_type, event_id) AS name, count(*) AS n_steps, count(*) FILTER (event_type = 'error') AS n_failed FROM events GROUP BY user_id")
def ss06_current_steps(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    steps = e.select(F.col("user_id").cast("string").alias("workflow_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("name"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"))
    return jobs.current_steps(steps).select("workflow_id", "name", "n_steps", "n_failed")


# --- formulas ----------------------------------------------------------------------------------------


def formula_blocks(spark, sf_dir):
    """Events as blocks of prose with a formula in them, or a formula by itself."""
    e = table(spark, sf_dir, "events", fine=True)
    k = F.col("event_id") % 9
    body = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("E_"), k, F.lit(" = m c^2 + "), k, F.lit(" ("), k, F.lit(")"))).otherwise(F.concat(F.lit("Here the value x_"), k, F.lit("=α+"), k, F.lit(" holds for all users, which is known.")))
    return e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), body.alias("text"), F.when(F.col("event_id") % 4 == 0, "formula").otherwise("paragraph").alias("role"))


#: The blocks of formula_blocks(), and what is a formula in them, told from their texts: the relation that a letter begins, up to a full stop or a word of prose.
FORMULA_BLOCKS = """b AS (SELECT user_id AS doc_id, event_id AS pos, CASE WHEN event_id % 4 = 0 THEN 'E_' || (event_id % 9) || ' = m c^2 + ' || (event_id % 9) || ' (' || (event_id % 9) || ')' ELSE 'Here the value x_' || (event_id % 9) || '=α+' || (event_id % 9) || ' holds for all users, which is known.' END AS text FROM events),
found AS (SELECT *, NOT regexp_matches(text, '[A-Za-z]{4,}') AS whole, regexp_extract(text, '[A-Za-zα-ωΑ-Ω][A-Za-z0-9_]*\\s*=\\s*[A-Za-z0-9α-ωΑ-Ω_+]+') AS m FROM b)"""


@query(f"WITH {FORMULA_BLOCKS} SELECT doc_id, pos, CASE WHEN whole THEN 'display' ELSE 'inline' END AS mode, CAST(CASE WHEN whole THEN 0 ELSE instr(text, m) - 1 END AS INTEGER) AS start, CASE WHEN whole THEN text ELSE m END AS source_text FROM found WHERE m <> ''")
def w15_formula_candidates(spark, sf_dir):
    return formulas.detect(formula_blocks(spark, sf_dir)).select("doc_id", "pos", "mode", "start", "source_text")


@query(
    f"""
WITH {FORMULA_BLOCKS} SELECT doc_id, pos, CASE WHEN whole THEN 'display' ELSE 'inline' END AS mode, CASE WHEN whole THEN regexp_replace(text, ' \\((\\d)\\)$', ' \\\\tag{{\\1}}') ELSE replace(m, 'α', ' \\alpha ') END AS latex, 0.96::DOUBLE AS confidence, 'accepted' AS status, true AS accepted FROM found WHERE m <> ''
"""
)
def u08_recognised_formulas(spark, sf_dir):
    return formulas.recognise(formulas.detect(formula_blocks(spark, sf_dir))).select("doc_id", "pos", "mode", "latex", "confidence", "status", "accepted")


@query(f"WITH {FORMULA_BLOCKS} SELECT doc_id, count(*) FILTER (NOT whole AND m <> '') AS n_inline, count(*) FILTER (whole AND m <> '') AS n_display FROM found GROUP BY doc_id")
def ag02_formula_summary(spark, sf_dir):
    return formulas.summary(formulas.recognise(formulas.detect(formula_blocks(spark, sf_dir)))).select("doc_id", "n_inline", "n_display")


@query(
    f"""
WITH {FORMULA_BLOCKS}, r AS (SELECT *, '{{{{formula:f' || substr(sha1(concat_ws('|', doc_id, pos, CASE WHEN whole THEN 0 ELSE 1 END, CASE WHEN whole THEN text ELSE m END)), 1, 12) || '}}}}' AS ref FROM found)
SELECT doc_id, pos, CASE WHEN m = '' THEN text WHEN whole THEN ref ELSE replace(text, m, ref) END AS text_with_refs FROM r
"""
)
def ar01_texts_with_refs(spark, sf_dir):
    b = formula_blocks(spark, sf_dir)
    return formulas.with_refs(b, formulas.recognise(formulas.detect(b))).select("doc_id", "pos", "text_with_refs")


@query(f"WITH {FORMULA_BLOCKS} SELECT doc_id, 'f' || substr(sha1(concat_ws('|', doc_id, pos, 0, text)), 1, 12) AS formula_id, CAST(regexp_extract(text, '\\((\\d)\\)$', 1) AS INTEGER) AS number FROM found WHERE whole")
def w10_formula_numbers(spark, sf_dir):
    """All these formulas have numbers of their own; w10_running_numbers has none that do."""
    return formulas.numbered(formulas.detect(formula_blocks(spark, sf_dir)))


@query()
def gm03_normalised_boxes(spark, sf_dir):
    b = boxes(spark, sf_dir)
    four = F.array(*[F.col("box")[c] / 1000 for c in ("x0", "y0", "x1", "y1")])
    return b.select("item_id", geometry.normalise(four, F.lit(612.0), F.lit(792.0)).alias("box"))
