"""Cases of text functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.cases.common import Options, query
from quire.functions import ids, model_answers, predicates, text
from quire.operators import evidence, formulas
from quire.session import table

MENDED = Options("a ¼ b þ c", "x\u0304 is", "the ð f of Þx Ð end", "¯ y and z ¯", "soft\u00adhyphen  two", "ℏ times ℝ", "plain text", "\u02d9 q r\u0307", "one\x02two\x0cthree", "p \x01 q \x03 r \x04 s")
REPAIRED = r"""replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, chr(1), ' × '), chr(3), '-'), chr(4), ' · '), '¼', '='), 'þ', '+'), 'ð', '∫'), chr(173), ''), chr(61623), ' · '), 'Ð', '∫'), 'Þ', '∂'), 'ℏ', ' \hbar '), 'ℝ', ' \mathbb{R} ')"""
ACCENTED = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({REPAIRED}, '\b([A-Za-z])\x{{304}}', ' \\bar{{\1}} ', 'g'), '¯\s*([A-Za-z])\b', ' \\bar{{\1}} ', 'g'), '\b([A-Za-z])\s*¯', ' \\bar{{\1}} ', 'g'), '\x{{2D9}}\s*([A-Za-z])\b', ' \\dot{{\1}} ', 'g'), '\b([A-Za-z])\x{{307}}', ' \\dot{{\1}} ', 'g')"


@query(rf"WITH {MENDED.sql()} SELECT event_id, trim(regexp_replace(regexp_replace({ACCENTED}, '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g'), '\s+', ' ', 'g')) AS repaired FROM t")
def st01_repaired(spark, sf_dir):
    return MENDED.rows(spark, sf_dir).select("event_id", text.repair(F.col("text")).alias("repaired"))


LIGATURES = Options("o\ufb00ice e\ufb03cient", "\ufb01rst \ufb02ow", "ba\ufb04e", "no ligature", "\ufb00\ufb01")


@query(f"WITH {LIGATURES.sql()} SELECT event_id, replace(replace(replace(replace(replace(text, '\ufb03', 'ffi'), '\ufb04', 'ffl'), '\ufb00', 'ff'), '\ufb01', 'fi'), '\ufb02', 'fl') AS spelled FROM t")
def st02_ligatures(spark, sf_dir):
    return LIGATURES.rows(spark, sf_dir).select("event_id", text.expand_ligatures(F.col("text")).alias("spelled"))


BRACES = Options("a |{z} b", "a |{z x1 } b", "no |brace", "m |ffl {z} n", "k |{z f+2} j", "|{z 3}")


@query(rf"WITH {BRACES.sql()} SELECT event_id, CASE WHEN regexp_matches(text, '\|\s*(?:ffl|\s)*\{{\s*z') THEN trim(regexp_replace(regexp_replace(regexp_replace(text, '\|\s*(?:ffl|\s)*\{{\s*z\s*\}}', '', 'g'), '\|\s*(?:ffl|\s)*\{{\s*z\s*([a-z0-9+]+)\s*\}}', '_{{\1}}', 'g'), '\s+', ' ', 'g')) ELSE text END AS mended FROM t")
def st03_underbraces(spark, sf_dir):
    return BRACES.rows(spark, sf_dir).select("event_id", formulas.underbraces(F.col("text")).alias("mended"))


SLASHES = Options("@u = @x", "f0s = k", "@a then gs = fn", "y = x plain", "@q no sign", "@p and ab = cd12")


@query(rf"WITH {SLASHES.sql()} SELECT event_id, CASE WHEN contains(text, '@') AND contains(text, '=') THEN regexp_replace(regexp_replace(text, '@([A-Za-z]\w*)\s*=\s*@([A-Za-z]\w*)', '@\1 / @\2', 'g'), '\b([a-z][a-z0-9]{{1,5}})\s*=\s*([a-z][a-z0-9]{{1,5}})\b', '\1 / \2', 'g') ELSE text END AS mended FROM t")
def st04_slash_glyphs(spark, sf_dir):
    return SLASHES.rows(spark, sf_dir).select("event_id", formulas.slash_glyphs(F.col("text")).alias("mended"))


REALS = Options("Z I R^n f", "over I R_2 now", "Z I R g", "I R", "plain Z here", "x in I R^{k+1}")


@query(rf"WITH {REALS.sql()} SELECT event_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\bZ\s+I\s*R[_^]\{{?([A-Za-z0-9+/-]+)\}}?', '\\int_{{\\mathbb{{R}}^{{\1}}}}', 'g'), '\bZ\s+I\s*R', '\\int_{{\\mathbb{{R}}}}', 'g'), '\bI\s*R\s*[_^]\s*\{{?([A-Za-z0-9+/-]+)\}}?', '\\mathbb{{R}}^{{\1}}', 'g'), '\bI\s*R', '\\mathbb{{R}}', 'g') AS mended FROM t")
def st05_real_spaces(spark, sf_dir):
    return REALS.rows(spark, sf_dir).select("event_id", formulas.real_spaces(F.col("text")).alias("mended"))


NAMES = Options(r"\partial tx + 1", "f0s and m 0 n", "qs times fn", "k2 + k9", r"no names \partial q", r"\partial yz k3")


@query(rf"WITH {NAMES.sql()} SELECT event_id, regexp_replace(text, '\\partial\s+([txyz])([A-Za-z])\b', '\\partial_{{\1}} \2', 'g') AS partials, regexp_replace(regexp_replace(regexp_replace(text, '\b([fqmn])\s*0\s*([sn])\b', '\1''_\2', 'g'), '\b([fqmn])([sn])\b', '\1_\2', 'g'), '\bk([0-9])\b', 'k^\1', 'g') AS waves FROM t")
def st06_st07_names(spark, sf_dir):
    return NAMES.rows(spark, sf_dir).select("event_id", text.compact_partials(F.col("text")).alias("partials"), text.wave_names(F.col("text")).alias("waves"))


CLOSED = Options("(a))^", "[x", "{a}}b}", "f(x)_", "((y", "none")


@query(rf"""WITH {CLOSED.sql()}, s AS (SELECT event_id, regexp_replace(text, '\s*(?:[_^]\s*)+$', '') AS s FROM t)
SELECT event_id, CASE WHEN s = '(a))' THEN '(a)' WHEN s LIKE '%(%' THEN s || repeat(')', len(s) - len(replace(s, '(', '')) - len(s) + len(replace(s, ')', ''))) WHEN s LIKE '%[%' THEN s || ']' WHEN s LIKE '%}}}}b}}' THEN replace(s, '}}}}b}}', '}}b') ELSE s END AS closed FROM s""")
def st08_balanced(spark, sf_dir):
    return formulas.balanced(CLOSED.rows(spark, sf_dir), "text").select("event_id", F.col("text").alias("closed"))


HYPHENS = Options("inter- nation- al law", "co- operate", "a- b stays", "well-known word", "ab- cd- ef- gh")


@query(r"WITH " + HYPHENS.sql() + r""", s AS (SELECT event_id, string_split(text, '- ') AS p FROM t)
SELECT event_id, CASE WHEN len(p) = 1 OR p[1] = 'a' THEN array_to_string(p, '- ') ELSE array_to_string(p, '') END AS joined FROM s""")
def st11_hyphens(spark, sf_dir):
    return HYPHENS.rows(spark, sf_dir).select("event_id", text.join_hyphenated(F.col("text")).alias("joined"))


NUMBERED = Options("E = m (3.4)", "x = 1, (A2)", "y (2) z", "none", "a = b (12a)  ")


@query(rf"WITH {NUMBERED.sql()} SELECT event_id, regexp_extract(text, '(\([A-Za-z]?\d+(?:[.-]\d+)*[a-z]?\))\s*$', 1) AS number FROM t")
def st12_equation_numbers(spark, sf_dir):
    return NUMBERED.rows(spark, sf_dir).select("event_id", text.equation_number(F.col("text")).alias("number"))


COMMANDS = Options(r"\alpha beta gam x1y", r"the \frac of things", "ab abc abcd", r"under_score word \tiny", "")


@query(rf"WITH {COMMANDS.sql()} SELECT event_id, array_to_string(list_filter(regexp_extract_all(text, '\\?[A-Za-z0-9_]+'), lambda x: regexp_full_match(x, '[A-Za-z]{{3,}}')), ' ') AS words FROM t")
def st13_words(spark, sf_dir):
    return COMMANDS.rows(spark, sf_dir).select("event_id", F.array_join(text.words_of(F.col("text")), " ").alias("words"))


CORRUPT = Options("@u = @x", "a ¼ b", "of\ufb00er", "f 0 s þ g", "clean = text", "plain words only", "@q m0n")


@query(rf"""
WITH {CORRUPT.sql()}, f AS (SELECT event_id, regexp_matches(text, '[\x01-\x04¼þðÞÐ\x{{FB00}}-\x{{FB04}}]|@[A-Za-z]') AS marked, regexp_matches(text, '[\x{{FB00}}-\x{{FB04}}]') AS lig,
  regexp_matches(text, '@[A-Za-z]\w*\s*=\s*@[A-Za-z]') OR regexp_matches(text, '\b[a-z][a-z0-9_'']{{1,5}}\s*=\s*[a-z][a-z0-9_'']{{1,5}}\b') AS slash, regexp_matches(text, '\b[fqmn]\s*0\s*[sn]\b') AS prime FROM t)
SELECT event_id, array_to_string(list_filter([CASE WHEN marked THEN 'formula_text_layer_corrupt' END, CASE WHEN lig THEN 'formula_pdf_ligature_corrupt' END, CASE WHEN marked AND slash THEN 'formula_slash_glyph_suspect' END, CASE WHEN marked AND prime THEN 'formula_prime_glyph_suspect' END], lambda x: x IS NOT NULL), ',') AS flags FROM f
""")
def st14_corruption(spark, sf_dir):
    return CORRUPT.rows(spark, sf_dir).select("event_id", F.array_join(text.corruption_flags(F.col("text")), ",").alias("flags"))


BROKEN = Options("a {formula:x1}} b", "{{formula:y}} whole", "{formula:a}} and {formula:b.c}}", "none", "x{formula:q}}")


@query(rf"WITH {BROKEN.sql()} SELECT event_id, regexp_replace(text, '(^|[^{{])\{{formula:([A-Za-z0-9_.:-]+)\}}\}}', '\1{{{{formula:\2}}}}', 'g') AS mended, CAST(len(regexp_extract_all(text, '(?:^|[^{{])\{{formula:')) AS INTEGER) AS n FROM t")
def st15_broken_refs(spark, sf_dir):
    return BROKEN.rows(spark, sf_dir).select("event_id", text.repair_refs(F.col("text")).alias("mended"), text.broken_refs(F.col("text")).alias("n"))


MARKED = Options("as [1, 2] says Fig. 2 of {{formula:a}} now", "Fig. 2 twice Fig. 2", "[3-5] alone", "plain  text", "{{formula:b}}")


@query(rf"WITH {MARKED.sql()} SELECT event_id, regexp_replace(regexp_replace(regexp_replace(replace(text, 'Fig. 2', ' '), '\{{\{{formula:[^}}]+\}}\}}', ' ', 'g'), '\[[0-9,\-\s;]+\]', ' ', 'g'), '\s+', ' ', 'g') AS bare FROM t")
def st20_without_tokens(spark, sf_dir):
    return MARKED.rows(spark, sf_dir).select("event_id", text.remove_tokens(F.col("text"), F.array(F.lit("Fig. 2"))).alias("bare"))


SECRETS = Options("<think>x y</think>done", "Authorization: Bearer abc.def-1", "key sk-abcdefgh12 here", "nothing", "<THINK a='b'>\nz</think> bearer Q_1", "sk-abc short")


@query(rf"WITH {SECRETS.sql()} SELECT event_id, regexp_replace(regexp_replace(regexp_replace(text, '(?is)<think\b[^>]*>.*?</think>', '', 'g'), '(?i)bearer\s+[A-Za-z0-9._\-]+', 'Bearer [redacted]', 'g'), '\bsk-[A-Za-z0-9_\-]{{6,}}', 'sk-[redacted]', 'g') AS shown FROM t")
def st21_redacted(spark, sf_dir):
    return SECRETS.rows(spark, sf_dir).select("event_id", text.redact(F.col("text")).alias("shown"))


KINDS = Options("{{formula:x}}", "x = 2", "[1, 2]", "Fig. 3", "(Smith, 2020)", "Table A1", "a ≤ b")


@query(rf"WITH {KINDS.sql()} SELECT event_id, CASE WHEN text LIKE '{{{{formula:%' OR regexp_matches(text, '[=<>≤≥∑∫^]') THEN 'formula' WHEN text LIKE '[%' OR text LIKE 'Fig%' OR text LIKE 'Table%' THEN 'reference_marker' ELSE 'citation' END AS kind FROM t")
def st22_token_kinds(spark, sf_dir):
    return KINDS.rows(spark, sf_dir).select("event_id", text.token_kind(F.col("text")).alias("kind"))


TEX = Options("a $x$ and $$y+1$$", r"so \(z\) and \[w\]", "costs 5 dollars", "$a$ $b$ $c$")


@query(rf"WITH {TEX.sql()}, e AS (SELECT event_id, regexp_extract_all(text, '\$\$[^$]+\$\$|\$[^$\n]+\$|\\\([^)]*\\\)|\\\[[^\]]*\\\]') AS l FROM t) SELECT event_id AS pos, unnest(l) AS tex, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS n FROM e")
def st28_j29_raw_tex(spark, sf_dir):
    rows = TEX.rows(spark, sf_dir).select(F.lit("d").alias("doc_id"), F.col("event_id").alias("pos"), "text")
    return formulas.raw_tex(rows).select("pos", "tex", "n")


@query("WITH r AS (SELECT event_id, [event_type, 'F' || (event_id % 5), event_type] AS l FROM events) SELECT event_id, array_to_string(CASE WHEN l[1] = l[2] THEN l[1:1] ELSE l[1:2] END, ',') AS refs, 3 AS n FROM r")
def so04_refs_in_order(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    body = F.concat(F.lit("{{formula:"), "event_type", F.lit("}} {{formula:F"), (F.col("event_id") % 5).cast("string"), F.lit("}} {{formula:"), "event_type", F.lit("}}"))
    return e.select("event_id", F.array_join(text.formula_refs(body), ",").alias("refs"), F.size(text.formula_tokens(body)).alias("n"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'view' ELSE event_type || ',view' END AS distinct_values, CASE WHEN event_type IN ('click', 'view') THEN '' ELSE event_type END AS missing, CAST(greatest(1, least(200, event_id % 300 - 20)) AS BIGINT) AS limited FROM events")
def so01_sl06_sl04_dt01_lists(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    values = F.array(F.col("event_type"), F.lit(""), F.lit("view"), F.col("event_type"), F.lit(None).cast("string"))
    missing = ids.missing_from(F.array("event_type"), F.array(F.lit("click"), F.lit("view")))
    return e.select("event_id", F.array_join(ids.ordered_distinct(values), ",").alias("distinct_values"), F.array_join(missing, ",").alias("missing"), ids.clamp(F.col("event_id") % 300 - 20, 1, 200).cast("long").alias("limited"))


TABLES = Options("a  b  c\nd  e  f", "a b c", "one  two  three  four", "x\ty\nz\tw", "Table 1  a  b", "Table 1  a  b  c", "a  b\nc  d")


@query(rf"""
WITH {TABLES.sql()}, r AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS rows FROM t)
SELECT event_id, CASE WHEN lower(text) LIKE 'table %' AND len(rows) <= 1 THEN len(regexp_split_to_array(trim(text), '\s{{2,}}|\t')) >= 4
  WHEN len(rows) >= 2 THEN len(list_filter(rows, lambda x: contains(x, chr(9)) OR len(regexp_split_to_array(x, '\s{{2,}}')) >= 3)) >= 2 ELSE len(regexp_split_to_array(trim(text), '\s{{2,}}')) >= 4 END AS tabular FROM r
""")
def pf02_tables(spark, sf_dir):
    return TABLES.rows(spark, sf_dir).select("event_id", predicates.table_like(F.col("text")).alias("tabular"))


CAPTIONS = Options("Figure 2. A plot", "Fig. 3: B", "Table A1) C", "See Figure 2.", "Figure two.", "图 3：结果", " figure 4.2: D")


@query(rf"WITH {CAPTIONS.sql()} SELECT event_id, regexp_matches(text, '(?i)^\s*(?:(?:fig\.|figure|table)\s*[A-Z]?\d+(?:[.\-][A-Za-z0-9]+)*\s*[.:：)]|(?:图|表)\s*[A-Z]?\d+\s*[.:：、)])') AS caption FROM t")
def pf03_captions(spark, sf_dir):
    return CAPTIONS.rows(spark, sf_dir).select("event_id", predicates.caption_label(F.col("text")).alias("caption"))


PROSE = Options("x = 1 where y", "x = 1", "these three words follow", "a + b", "ratio of a to b", "Long words here, again")


@query(rf"WITH {PROSE.sql()} SELECT event_id, regexp_matches(text, '(?i)\s+(?:and|are|as|for|from|holds?|in|is|ratio\s+of|the|to|where|which|with)\b') OR regexp_matches(text, '\b[A-Za-z]{{4,}}\b(?:[\s,-]+\b[A-Za-z]{{4,}}\b){{2,}}') AS prose FROM t")
def pf06_prose(spark, sf_dir):
    return PROSE.rows(spark, sf_dir).select("event_id", predicates.prose(F.col("text")).alias("prose"))


LOOKS = Options("x = 1", "E = m c^2 + k", "the gradient of things", "a b c", "see doi = x", "@u = @x", "v[i] = 2", "no signs here at all", "β ≤ γ", "Fig = 2")


@query(rf"""
WITH {LOOKS.sql()}, s AS (SELECT *, len(regexp_extract_all(text, '=|≤|≥')) + len(regexp_extract_all(text, '[@^_]')) + len(regexp_extract_all(text, '\[[A-Za-z0-9_]+\]')) AS signs, len(regexp_extract_all(text, '\b[A-Za-z]{{4,}}\b')) AS words FROM t)
SELECT event_id, signs AS n_signs, signs >= 1 AND words < 3 AND NOT regexp_matches(text, '\b(?:doi|http|https|Fig|Figure|Table|Section|Sec)\b') AS formula FROM s
""")
def pf07_looks_like_formula(spark, sf_dir):
    rows = formulas.fenced(LOOKS.rows(spark, sf_dir), *formulas.formula_steps(F.col("text"), "_f"))
    return rows.select("event_id", F.col("_f_signs").cast("long").alias("n_signs"), F.col("_f").alias("formula"))


WANTED = Options("{{formula:a}} {{formula:b}}", "text {{formula:a}}", "plain text goes here", "{{formula:c}}")


@query(f"WITH {WANTED.sql()} SELECT event_id, NOT (trim(replace(replace(replace(text, '{{{{formula:a}}}}', ''), '{{{{formula:b}}}}', ''), '{{{{formula:c}}}}', '')) = '') AS wanted FROM t")
def pf11_requires_translation(spark, sf_dir):
    return WANTED.rows(spark, sf_dir).select("event_id", predicates.requires_translation(F.lit("paragraph"), F.col("text")).alias("wanted"))


STYLES = Options("paper", " Slide_Like", "HANDOUT", "unknown", None, "")


@query(f"WITH {STYLES.sql()} SELECT event_id, CASE WHEN lower(trim(text)) IN ('paper', 'slide_like', 'handout') THEN lower(trim(text)) ELSE 'paper' END AS style FROM t")
def pf16_known_values(spark, sf_dir):
    return STYLES.rows(spark, sf_dir).select("event_id", predicates.known_or(F.col("text"), ("paper", "slide_like", "handout"), "paper").alias("style"))


COLUMNS = Options("two columns please", "single column, no, two columns", "双栏排版", "one column", "column gap: 5 mm then column gap 1cm", "column gap 20", "", "2-column layout, 栏距 12pt")


@query(rf"""
WITH {COLUMNS.sql()}, l AS (SELECT *, regexp_extract_all(text, '(?i)双栏|两栏|双列|两列|(?:double|two|2)\s*[- ]?\s*col(?:umns?|umes?|ums?)|单栏|一栏|单列|(?:single|one|1)\s*[- ]?\s*col(?:umns?|umes?|ums?)')[-1] AS last,
  regexp_extract_all(text, '(?i)(?:栏距|列距|column\s+gap)\s*[:：=]?\s*(\d+(?:\.\d+)?)\s*(?:pt|mm|cm|毫米|厘米)?', 1)[-1] AS n, lower(regexp_extract_all(text, '(?i)(?:栏距|列距|column\s+gap)\s*[:：=]?\s*(?:\d+(?:\.\d+)?)\s*(pt|mm|cm|毫米|厘米)?', 1)[-1]) AS unit FROM t)
SELECT event_id, CASE WHEN last IS NULL THEN 1 WHEN regexp_matches(last, '(?i)双|两|double|two|2') THEN 2 ELSE 1 END AS n_columns,
  CASE WHEN n IS NULL THEN 18.0::DOUBLE WHEN unit = 'mm' THEN round(CAST(n AS DOUBLE) * 72 / 25.4, 2) WHEN unit = 'cm' THEN round(CAST(n AS DOUBLE) * 72 / 2.54, 2) ELSE CAST(n AS DOUBLE) END AS gap FROM l
""")
def pf19_columns(spark, sf_dir):
    return COLUMNS.rows(spark, sf_dir).select("event_id", predicates.column_count(F.col("text")).alias("n_columns"), predicates.column_gap(F.col("text")).alias("gap"))


LANGS = Options("zh", "zh-CN", "ZH_tw", "Chinese (simplified)", "en", "zhx", " zh ", "fr")


@query(f"WITH {LANGS.sql()} SELECT event_id, replace(lower(trim(text)), '_', '-') = 'zh' OR replace(lower(trim(text)), '_', '-') LIKE 'zh-%' OR lower(trim(text)) LIKE 'chinese%' AS chinese, event_id % 3 <> 0 AND event_id % 2 = 0 AS reviewed FROM t")
def pf20_review_scope(spark, sf_dir):
    role = F.when(F.col("event_id") % 3 == 0, "table").otherwise("paragraph")
    return LANGS.rows(spark, sf_dir).select("event_id", predicates.chinese_target(F.col("text")).alias("chinese"), predicates.reviewable(role, F.col("event_id") % 2 == 0).alias("reviewed"))


LEAKS = Options("the model of the data", "模型很大", "quite other words that nobody wrote here", "ok", "", "a mix 模 of the model", "new words")


@query(rf"""
WITH {LEAKS.sql()}, w AS (SELECT *, len(regexp_extract_all(text, '[\x{{4e00}}-\x{{9fff}}]')) AS han, regexp_extract_all(lower(text), '[a-z][a-z''’\-]*') AS words, len(regexp_replace(text, '\s+', '', 'g')) AS dense FROM t)
SELECT event_id, CASE WHEN trim(text) = '' THEN true WHEN han >= 2 OR han / greatest(dense, 1) >= 0.03 THEN false WHEN len(words) < 3 THEN false
  ELSE len(list_intersect(list_distinct(words), ['the', 'model', 'of', 'data', 'is', 'large'])) / greatest(len(list_distinct(words)), 1) >= 0.5 OR len(words) >= 5 END AS leaks FROM w
""")
def pf21_leakage(spark, sf_dir):
    return LEAKS.rows(spark, sf_dir).select("event_id", predicates.untranslated(F.lit("the model of the data is large"), F.col("text")).alias("leaks"))


ANSWERS = Options('{"text": "a b", "bbox": [1]}', '{"text": "cut off', '{"x": 1}', '{"latex": "y", "confidence": 0.5}', '{"text": "z", "score": 7}', '{"note": "n", "a": {"x": 1}}', '{"latex": "", "confidence": "high"}')


@query(rf"""
WITH {ANSWERS.sql()}, j AS (SELECT *, CASE WHEN json_valid(text) THEN text END AS j FROM t)
SELECT event_id, coalesce(len(list_intersect(json_keys(j), ['bbox', 'x', 'y', 'width', 'position'])) > 0, false) AS has_layout, CASE WHEN contains(text, '"text"') THEN regexp_extract(text, '"text"\s*:\s*"([^"]*)', 1) END AS salvaged,
  coalesce(j ->> '$.latex', j ->> '$.text', '') AS latex, CASE WHEN text LIKE '%0.5%' THEN 0.5 WHEN text LIKE '%score": 7%' THEN 1.0 ELSE 0.86 END::DOUBLE AS confidence FROM j
""")
def pf22_js02_js04_answers(spark, sf_dir):
    t = F.col("text")
    found = model_answers.recognition(t)
    return ANSWERS.rows(spark, sf_dir).select("event_id", model_answers.has_layout_keys(t).alias("has_layout"), model_answers.salvaged(t, "text").alias("salvaged"), found["latex"].alias("latex"), found["confidence"].alias("confidence"))


PHRASES = Options("Large Models learn well. This other thing", "Deep nets win and Deep nets win again", "no", "That Thing fails", "alpha beta gamma delta epsilon zeta eta theta", "ab cd ef")


@query(rf"""
WITH {PHRASES.sql()}, p AS (SELECT event_id, regexp_extract_all(text, '\b(?:[A-Z][A-Za-z0-9-]{{2,}}|[a-z][A-Za-z0-9-]{{3,}})(?:\s+(?:[A-Z][A-Za-z0-9-]{{2,}}|[a-z][A-Za-z0-9-]{{3,}})){{1,4}}\b') AS l FROM t),
d AS (SELECT event_id, list_filter(l, lambda x, i: list_position(l, x) = i AND NOT regexp_matches(lower(x), '^(?:this|that|these) ')) AS l FROM p)
SELECT event_id, array_to_string(l[1:12], '|') AS phrases FROM d
""")
def sl02_key_phrases(spark, sf_dir):
    return PHRASES.rows(spark, sf_dir).select("event_id", F.array_join(evidence.key_phrases(F.col("text")), "|").alias("phrases"))


PROVIDERS = Options("a", "b", "c")


@query(f"WITH {PROVIDERS.sql()} SELECT event_id, CASE text WHEN 'a' THEN 'a,b,c' WHEN 'b' THEN 'b,a,c' ELSE 'c,a,b' END AS ordered FROM t")
def sl05_provider_order(spark, sf_dir):
    every = F.array(*map(F.lit, "abc"))
    return PROVIDERS.rows(spark, sf_dir).select("event_id", F.array_join(F.concat(F.filter(every, lambda p: p == F.col("text")), F.filter(every, lambda p: p != F.col("text"))), ",").alias("_own"), "text").select("event_id", F.when(F.col("text") == "a", F.array_join(evidence.provider_order(every, ["a"]), ",")).when(F.col("text") == "b", F.array_join(evidence.provider_order(every, ["b"]), ",")).otherwise(F.array_join(evidence.provider_order(every, ["c"]), ",")).alias("ordered"))


CUT = Options("E = m c^2, where m is", "x = 1。next", "y = 3 n, dx", "A = b12.", "k = B2.34", "f = g; h", "p = q", "r = s with t")


@query(rf"""
WITH {CUT.sql()}, a AS (SELECT event_id, regexp_replace(regexp_replace(text, '(?i)\b(?:dx|n)\b(\s*,|$)', '\1', 'g'), '\s+', ' ', 'g') AS c FROM t),
b AS (SELECT event_id, regexp_replace(regexp_replace(c, '\s+(?:where|is|with)\b.*', ''), '[。；;].*', '') AS c FROM a),
d AS (SELECT event_id, regexp_replace(trim(c, ' ,;。；'), '\.$', '') AS c FROM b)
SELECT event_id, regexp_replace(c, '([A-Za-z]\d*)\.\d{{1,3}}$', '\1') AS cut FROM d
""")
def st10_cut_at_prose(spark, sf_dir):
    return formulas.fenced(CUT.rows(spark, sf_dir), *formulas.cut_steps(F.col("text"), "_c")).select("event_id", F.col("_c").alias("cut"))


WIDE = Options("one two three", "a\nb\nc", "", "wide 图图图 text", "tail\n")


@query(f"""
WITH {WIDE.sql()}, l AS (SELECT event_id, text, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS line FROM t),
u AS (SELECT event_id, text, len(regexp_extract_all(line, '[a-z]')) * 52 + len(regexp_extract_all(line, '图')) * 100 + len(regexp_extract_all(line, ' ')) * 34 AS h FROM l)
SELECT event_id, CAST(CASE WHEN any_value(text) = '' THEN 0 ELSE sum(greatest(1, CAST(ceil(h / 100.0 * 10 / 40) AS INTEGER))) END AS INTEGER) AS n_lines FROM u GROUP BY event_id
""")
def st24_wrapped_lines(spark, sf_dir):
    return WIDE.rows(spark, sf_dir).select("event_id", text.wrapped_lines(F.col("text"), F.lit(40.0), F.lit(10.0)).alias("n_lines"))
