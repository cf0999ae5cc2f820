"""Cases of text on pages: fragments of boxes, and continuous flow in one and two columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.cases.common import query
from quire.operators import flow, paging
from quire.registry import LINES, line_blocks

#: The width of a character in hundredths of an em, as SQL.
GLYPH = r"""CASE WHEN c = chr(9) THEN 200 WHEN regexp_full_match(c, '[\x0A-\x0D\x1C-\x20\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}]') THEN 34
  WHEN regexp_full_match(c, '[\x{1100}-\x{11FF}\x{2E80}-\x{A4CF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FFEF}]') THEN 100
  WHEN regexp_full_match(c, '\p{Lu}') THEN 64 WHEN regexp_full_match(c, '[\p{Nd}²³¹]') THEN 56 WHEN ascii(c) < 128 THEN 52 ELSE 72 END"""
GLYPHS = f"glyphs AS MATERIALIZED (SELECT c, CAST({GLYPH} AS BIGINT) AS w FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '')"
WIDE = "(SELECT coalesce(map_from_entries(list((c, w))), MAP {}) FROM glyphs)"


# --- boxes --------------------------------------------------------------------------------------------------

# A fold over the glyphs of what a box can hold at most gives the cut: (lines, hundredths on the line, glyphs that went in).
W14_SQL = rf"""
WITH RECURSIVE {LINES}, {GLYPHS}, m AS MATERIALIZED (SELECT {WIDE} AS m), boxed AS (
  SELECT doc_id, pos, text, 60 + pos % 4 * 25 AS width, 26 + pos % 3 * 20 AS height FROM lines
), cuts AS (
  SELECT doc_id, pos, -1 AS fragment, CAST(NULL AS VARCHAR) AS out, text AS rest, width, height FROM boxed
  UNION ALL
  SELECT doc_id, pos, fragment + 1, CASE WHEN fits THEN rest ELSE rtrim(rest[1:cut]) END, CASE WHEN fits THEN '' ELSE ltrim(rest[cut + 1:]) END, width, height
  FROM (
    SELECT *, CASE WHEN back >= greatest(1, floor(went * 0.6)) THEN back + 1 ELSE went END AS cut FROM (
      SELECT *, greatest(CASE WHEN contains(f, ' ') THEN went - instr(reverse(f), ' ') ELSE -1 END, CASE WHEN contains(f, '。') THEN went - instr(reverse(f), '。') ELSE -1 END, CASE WHEN contains(f, '，') THEN went - instr(reverse(f), '，') ELSE -1 END,
               CASE WHEN contains(f, '.') THEN went - instr(reverse(f), '.') ELSE -1 END, CASE WHEN contains(f, ',') THEN went - instr(reverse(f), ',') ELSE -1 END) AS back FROM (
        SELECT *, rest[1:went] AS f FROM (
          SELECT *, CASE WHEN fits THEN 1 ELSE greatest(1, list_reduce(list_prepend({{'l': 1::BIGINT, 'u': 0::BIGINT, 'n': 0::BIGINT}}, list_transform(string_split(rest[1:room], ''), lambda c: {{'l': 0::BIGINT, 'u': m[c], 'n': 0::BIGINT}})),
              lambda s, g: CASE WHEN s.l > many THEN s WHEN s.u > 0 AND s.u + g.u > wide THEN {{'l': s.l + 1, 'u': g.u, 'n': s.n + CASE WHEN s.l + 1 > many THEN 0 ELSE 1 END}} ELSE {{'l': s.l, 'u': s.u + g.u, 'n': s.n + 1}} END).n) END AS went FROM (
            SELECT c.*, m.m, greatest(1, floor(width / 10.0)) * 100 AS wide, greatest(1, floor(height / 12.5)) AS many, CAST(greatest(1, floor(height / 12.5)) * (greatest(1, floor(width / 10.0)) * 100 / 34 + 1) AS BIGINT) AS room,
                   greatest(1, ceil(list_sum(list_transform(string_split(rest, ''), lambda c: m.m[c])) / 100.0 * 10 / width)) * 12.5 <= height AS fits
            FROM cuts c, m WHERE rest <> ''
          )
        )
      )
    )
  )
)
SELECT doc_id, pos, CAST(fragment AS INTEGER) AS fragment, out AS text FROM cuts WHERE fragment >= 0
"""


@query(W14_SQL)
def w14_continued_lines(spark, sf_dir):
    """Lines of documents in boxes of twelve sizes, cut where they are full."""
    rows = line_blocks(spark, sf_dir).select("doc_id", "pos", "text", (60 + F.col("pos") % 4 * 25).cast("double").alias("width"), (26 + F.col("pos") % 3 * 20).cast("double").alias("height"))
    return paging.continuations(rows, 10.0, 1.25)


# --- pages --------------------------------------------------------------------------------------------------

#: Pages of the cases: small, so that there are many.
PAGE = {"width": 420.0, "height": 400.0, "left": 40.0, "top": 40.0, "right": 40.0, "bottom": 40.0, "gap": 20.0}
#: Characters of a piece: so short that no column ends within one.
SHORT = 20


def pieces(spark, sf_dir):
    """Lines of documents in pieces of SHORT characters, each 17th an asset instead; the number of a piece is 4096 times its line's, and its place in it."""
    b = line_blocks(spark, sf_dir)
    # One pass over a line; a substring a piece would count its characters from the line's beginning each time.
    cut = F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{SHORT}}}"), F.lit(0)), lambda x: F.trim(x))
    p = b.select("doc_id", F.col("pos").alias("line"), "role", F.posexplode(cut).alias("k", "text")).withColumn("pos", F.col("line").cast("long") * 4096 + F.col("k"))
    asset, head = F.col("pos") % 17 == 16, F.col("role").isin("title", "heading")
    n = F.col("pos")
    return p.select(
        "doc_id", "pos", F.when(asset, "asset").otherwise("text").alias("kind"), "role", F.when(head & (F.col("line") % 2 == 0), "full").otherwise("column").alias("span"), "text",
        F.when(F.col("role") == "title", 14.0).when(F.col("role") == "heading", 12.0).otherwise(10.0).alias("font_size"), F.lit(1.25).alias("line_height"), F.when(head, 4.0).otherwise(0.0).alias("space_before"), F.lit(2.5).alias("space_after"),
        F.when(head, 0.0).otherwise(2.0).alias("indent"), (100 + n % 7 * 60).cast("double").alias("width"), (30 + n % 5 * 90).cast("double").alias("height"),
    )


def _flow_sql(columns: int) -> str:
    """Recursive SQL: a step an item, with the page, the cursors of the columns, and what stands on the page."""
    top, bottom, wide = PAGE["top"], PAGE["height"] - PAGE["bottom"], PAGE["width"] - PAGE["left"] - PAGE["right"]
    narrow = (wide - PAGE["gap"]) / 2 if columns == 2 else wide
    step = narrow + PAGE["gap"] if columns == 2 else 0.0
    over = f"kind = 'text' AND span = 'column' AND {columns} = 2"

    def turn(inner: str, when: str, beside: bool = True) -> str:
        """Where `when` holds, on to the next column (if `beside`), or else to the next page."""
        col = f"({when}) AND {beside} AND {over} AND act = 0"
        new = f"({when}) AND NOT ({beside} AND {over} AND act = 0)"
        return f"""(SELECT * REPLACE (CASE WHEN {new} THEN page + 1 ELSE page END AS page, CASE WHEN {new} THEN {top} WHEN {col} THEN c1 ELSE y END AS y, CASE WHEN {new} THEN {top} WHEN {col} THEN y ELSE c0 END AS c0,
          CASE WHEN {new} THEN {top} ELSE c1 END AS c1, CASE WHEN {new} THEN 0 WHEN {col} THEN 1 ELSE act END AS act, texts AND NOT ({new}) AS texts, assets AND NOT ({new}) AS assets) FROM {inner})"""

    base = f"""(SELECT f.doc_id, p.pos, p.n, p.kind, p.role, p.span, p.text, p.font, p.sb, p.aw, p.ah, f.page, f.texts, f.assets,
        CASE WHEN {columns} = 2 AND NOT (p.kind = 'text' AND p.span = 'column') AND f.act = 0 THEN f.y ELSE f.c0 END AS c0, CASE WHEN {columns} = 2 AND NOT (p.kind = 'text' AND p.span = 'column') AND f.act = 1 THEN f.y ELSE f.c1 END AS c1, f.act,
        CASE WHEN {columns} = 1 THEN f.y WHEN p.kind = 'text' AND p.span = 'column' THEN CASE f.act WHEN 0 THEN f.c0 ELSE f.c1 END ELSE greatest(f.y, CASE f.act WHEN 0 THEN f.c1 ELSE f.c0 END) END AS y,
        greatest(1, ceil(p.h / 100.0 * p.font / greatest(1.0, CASE WHEN p.span = 'column' THEN {narrow} ELSE {wide} END - p.indent * p.font))) * p.font * 1.25 + 0.6 AS high
      FROM flow f JOIN numbered p ON p.doc_id = f.doc_id AND p.n = f.n + 1)"""
    s = turn(base, f"kind = 'text' AND role IN ('title', 'heading') AND texts AND y + high + 36 > {bottom}", False)
    s = turn(s, f"kind = 'text' AND texts AND {bottom} - y - sb < font * 1.25 * 2")
    s = turn(s, f"kind = 'text' AND (texts OR assets) AND y + sb + high > {bottom}")
    s = turn(s, f"kind = 'text' AND (texts OR assets) AND y + sb + high > {bottom}")
    s = turn(s, f"kind = 'asset' AND (texts OR assets) AND y + 8.0 + ah > {bottom}")
    return f"""
WITH RECURSIVE {LINES}, {GLYPHS}, m AS MATERIALIZED (SELECT {WIDE} AS m), cut AS (
  SELECT doc_id, pos AS line, role, unnest(range(0, (len(text) - 1) // {SHORT} + 1)) AS k, text FROM lines
), pieces AS (
  SELECT doc_id, line * 4096 + k AS pos, CASE WHEN (line * 4096 + k) % 17 = 16 THEN 'asset' ELSE 'text' END AS kind, role, role IN ('title', 'heading') AS head, line, trim(text[k * {SHORT} + 1:(k + 1) * {SHORT}]) AS text FROM cut
), numbered AS MATERIALIZED (
  SELECT doc_id, pos, kind, role, CASE WHEN head AND line % 2 = 0 THEN 'full' ELSE 'column' END AS span, text, CASE role WHEN 'title' THEN 14.0::DOUBLE WHEN 'heading' THEN 12.0::DOUBLE ELSE 10.0::DOUBLE END AS font,
         CASE WHEN head THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END AS sb, CASE WHEN head THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END AS indent, list_sum(list_transform(string_split(text, ''), lambda c: m.m[c])) AS h,
         greatest(24.0, (100 + pos % 7 * 60) * scale) AS aw, greatest(24.0, (30 + pos % 5 * 90) * scale) AS ah, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n
  FROM (SELECT *, least(1.0::DOUBLE, {wide} / (100 + pos % 7 * 60), greatest(72.0, {PAGE["height"]} * 0.42) / (30 + pos % 5 * 90)) AS scale FROM pieces WHERE kind = 'asset' OR text <> ''), m
), flow AS (
  SELECT DISTINCT doc_id, CAST(NULL AS BIGINT) AS pos, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS part, 1 AS page, CAST(NULL AS INTEGER) AS col, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS y1, false AS clipped,
         {top}::DOUBLE AS y, {top}::DOUBLE AS c0, {top}::DOUBLE AS c1, 0 AS act, false AS texts, false AS assets FROM numbered
  UNION ALL
  SELECT doc_id, pos, n, kind, page, CASE WHEN {over} THEN act END, x0, up, x1, bot, kind = 'text' AND bot > {bottom},
         ny, CASE WHEN NOT ({over}) OR act = 0 THEN ny ELSE c0 END, CASE WHEN NOT ({over}) OR act = 1 THEN ny ELSE c1 END, CASE WHEN {over} THEN act ELSE 0 END, texts OR kind = 'text', assets OR kind = 'asset'
  FROM (SELECT *, CASE kind WHEN 'text' THEN bot + 2.5 ELSE bot + 8.0 END AS ny FROM (
    SELECT *, CASE kind WHEN 'text' THEN up + high ELSE up + ah END AS bot, CASE WHEN kind = 'asset' THEN {PAGE["left"]} + greatest(0.0, ({wide} - aw) / 2) ELSE {PAGE["left"]} + CASE WHEN {over} THEN act * {step} ELSE 0.0 END END AS x0,
      CASE WHEN kind = 'asset' THEN {PAGE["left"]} + greatest(0.0, ({wide} - aw) / 2) + aw ELSE {PAGE["left"]} + CASE WHEN {over} THEN act * {step} + {narrow} ELSE {wide} END END AS x1
    FROM (SELECT *, CASE kind WHEN 'text' THEN y + sb ELSE y + 8.0 END AS up FROM {s})))
)
SELECT doc_id, pos, part, CAST(page AS INTEGER) AS page, CAST(col AS INTEGER) AS col, round(x0, 3) AS x0, round(y0, 3) AS y0, round(x1, 3) AS x1, round(y1, 3) AS y1, clipped FROM flow WHERE n > 0
"""


def _placed(spark, sf_dir, columns):
    out = flow.reflow(pieces(spark, sf_dir), flow.Pages(**PAGE, columns=columns))
    return out.select("doc_id", "pos", "part", "page", F.col("column").alias("col"), *[F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")], F.array_contains("flags", "overflow_clipped").alias("clipped"))


@query(_flow_sql(1))
def w13_one_column(spark, sf_dir):
    return _placed(spark, sf_dir, 1)


@query(_flow_sql(2))
def w13_two_columns(spark, sf_dir):
    return _placed(spark, sf_dir, 2)


@query()
def w13_pages_with_figures(spark, sf_dir):
    """Whole lines on pages of two columns, each eighth one the caption of a figure, some of which are taller than a page. Without SQL: texts are cut, and figures wait."""
    n, b = F.col("pos"), line_blocks(spark, sf_dir)
    head = F.col("role").isin("title", "heading")
    items = b.select(
        "doc_id", n.cast("long").alias("pos"), F.when(n % 8 == 5, "figure").otherwise("text").alias("kind"), "role", F.when(head, "full").otherwise("column").alias("span"), "text", F.when(head, 12.0).otherwise(10.0).alias("font_size"), F.lit(1.25).alias("line_height"),
        F.lit(2.0).alias("space_before"), F.lit(4.0).alias("space_after"), F.when(head, 0.0).otherwise(2.0).alias("indent"), (100 + n % 7 * 60).cast("double").alias("width"), (60 + n % 5 * 200).cast("double").alias("height"),
    )
    out = flow.reflow(items, flow.Pages(**PAGE, columns=2))
    return out.withColumn("flags", F.array_join("flags", ","))
