"""Predicates and ordered classifications as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import FORMULA_REF, PROSE_BOUNDARY, THREE_LONG_WORDS, repair, squeeze, strip

# Labels of captions, signs of mathematics, roles of blocks that stand together, and of headings.
CAPTION_LABEL = r"(?i)^\s*(?:(?:fig\.|figure|table)\s*[A-Z]?\d+(?:[.\-][A-Za-z0-9]+)*\s*[.:：)]|(?:图|表)\s*[A-Z]?\d+(?:[.\-][A-Za-z0-9]+)*\s*[.:：、)])"
MATH_SIGNAL = r"[=+*/^_<>≤≥≠≈∑∫√∞∂∇±×÷·\\]|[α-ωΑ-Ω]"
CLUSTERS = ("caption", "figure", "formula", "reference", "table")
HEADINGS = ("title", "heading")
# Fixed value: whole texts that are noise: operators alone, one between stray symbols, two known remains, and texts without any letter, digit or sign of a formula.
NOISE = r"^(?:[×+\-*/=·\s]+|(?:@|\\partial)?\s*[=+\-*/·]\s*(?:@|\\partial)?|(?i:coll\s*=\s*X)|(?i:dB\s*-?\s*\d+))$|\A[^A-Za-z0-9α-ωΑ-Ω∂∇∫∑=+\-*/^_]*\z"


def table_like(text: Column) -> Column:
    """PF02: two rows or more of three columns, or one row of four, told by tabs and double spaces."""
    rows = F.filter(F.transform(F.split(text, r"\n"), lambda x: F.trim(x)), lambda x: x != "")
    wide = F.size(F.filter(rows, lambda x: x.contains("\t") | (F.size(F.split(x, r"\s{2,}")) >= 3))) >= 2
    one = F.size(F.split(F.trim(text), r"\s{2,}")) >= 4
    labelled = F.lower(squeeze(text)).startswith("table ") & (F.size(rows) <= 1)
    return F.when(labelled, F.size(F.split(F.trim(text), r"\s{2,}|\t")) >= 4).when(F.size(rows) >= 2, wide).otherwise(one)


def caption_label(text: Column) -> Column:
    """PF03: starts with a figure or table label, its number and punctuation."""
    return squeeze(text).rlike(CAPTION_LABEL)


def prose(text: Column, fixed: Column | None = None) -> Column:
    """PF06: holds a word that begins prose, or three long words in a row. `fixed`: the repaired text, if it is at hand."""
    fixed = repair(text) if fixed is None else fixed
    return fixed.rlike(PROSE_BOUNDARY) | fixed.rlike(THREE_LONG_WORDS)


def noise(text: Column, fixed: Column | None = None) -> Column:
    """PF05: nothing, a stray symbol, or no letter, digit or sign of a formula. `fixed`: the repaired text, if it is at hand."""
    t = repair(text) if fixed is None else fixed
    return t.isNull() | (t == "") | ((F.length(t) <= 2) & F.lower(t).isin("dx", "n", "vn", "ω")) | t.isin("∫", "\\int", "Ω", "× -") | t.rlike(NOISE)


def boilerplate(text: Column, x0: Column, y0: Column, x1: Column, y1: Column, height: Column, band: float = 0.08) -> Column:
    """PF04: copyright lines, upright timestamps, and DOI or journal lines at the foot of a page."""
    t = squeeze(text)
    foot = (y1 >= height - height * band) | (y0 >= height * 0.72)
    copyright_line = t.rlike(r"(?i)^©\s*(?:(?:the\s+)?author\(s\)|authors?|作者)\b.*(?:19|20)\d{2}\.?$")
    stamp = (x1 - x0 <= 14) & (y1 - y0 >= 40) & t.rlike(r"^\d{1,2}\s+[A-Z][a-z]+\s+(?:19|20)\d{2}\s+\d{2}:\d{2}:\d{2}$")
    low = F.lower(t)
    journal = low.rlike(r"\bj\.\s+[a-z]") & low.rlike(r"\b(?:19|20)\d{2}\b")
    return (t != "") & (copyright_line | F.coalesce(stamp | (foot & (low.contains("doi:") | journal)), F.lit(False)))


def block_role(text: Column, page_index: Column, block_index: Column, font_size: Column, y0: Column | None = None, height: Column | None = None, squeezed: Column | None = None) -> Column:
    """PF01: the first rule that holds gives the role of a block. `squeezed`: the squeezed text, if it is at hand; `text` is then taken as stripped."""
    t = strip(text) if squeezed is None else text
    low, one = F.lower(t), squeeze(text) if squeezed is None else squeezed
    fixed = repair(t)
    operator = t.contains("=") | t.rlike("[≤≥∑∫]") | t.rlike(r"\b\d+\s*[+\-*/]\s*\d+\b") | t.rlike(r"\b[A-Za-zα-ωΑ-Ω]\s*[+\-*/]\s*[A-Za-z0-9α-ωΑ-Ω]\b")
    formula = operator & t.rlike(r"^[A-Za-z0-9\s+\-*/=().,<>\[\]{}\\≤≥∑∫α-ωΑ-Ω^_]+$") & ~prose(t, fixed)
    role = (
        F.when((page_index == 0) & (block_index == 0), "title")
        .when(low.rlike(r"^abstract\.?$") | low.startswith("abstract "), "abstract")
        .when(table_like(t), "table")
        .when(caption_label(t), "caption")
        .when(low.rlike(r"^(references|bibliography|works cited)\.?$") | t.rlike(r"^\[\d+\]"), "reference")
        .when(formula, "formula")
    )
    if y0 is not None and height is not None:
        role = role.when(F.coalesce((height > 0) & (y0 > height * 0.78) & (font_size <= 8.5) & (F.length(t) < 360), F.lit(False)), "footnote")
    return (
        role.when(one.rlike(r"^\(?\d+(?:\.\d+)*\)?\s+[A-Z]") & (F.length(one) < 120), "heading")
        .when(t.rlike(r"^\d+\.\s+\S+") & t.rlike(r"\b(19|20)\d{2}[a-z]?\b"), "reference")
        .when((F.length(t) < 90) & (font_size >= 12), "heading")
        .otherwise("paragraph")
    )


def text_role(text: Column, index: Column) -> Column:
    """IO05: the role of a paragraph of plain text, by place, length and end."""
    ends = F.lit(False)
    for mark in ".。!！?？":
        ends = ends | text.endswith(mark)
    return (
        F.when((index == 0) & (F.length(text) <= 120), "title")
        .when(text.rlike(r"(?i)^(abstract|摘要)\b"), "abstract")
        .when((F.length(text) <= 90) & ~ends, "heading")
        .otherwise("paragraph")
    )


def math_signals(text: Column) -> Column:
    """PF07: how many signs of mathematics a text has."""
    return F.regexp_count(text, F.lit(MATH_SIGNAL))


def formula_only(text: Column) -> Column:
    """PF07: nothing but formula references and white space, and one at least."""
    return text.rlike(FORMULA_REF) & (F.trim(F.regexp_replace(text, FORMULA_REF, "")) == "")


def formula_like(text: Column, most: int = 260, words: int = 3) -> Column:
    """PF07: a short text with mathematical signs and few words."""
    t = repair(text)
    return (t != "") & (F.length(t) <= most) & (math_signals(t) >= 1) & (F.regexp_count(t, F.lit(r"\b[A-Za-z]{4,}\b")) <= words) & ~prose(t)


def display_formula_like(text: Column) -> Column:
    """PF07: a formula that stands on its own: at most 96 characters and two signs."""
    return formula_like(text, 96) & (math_signals(repair(text)) >= 2)


def requires_translation(role: Column, text: Column) -> Column:
    """PF11: false for formulas that are references only, or look like formulas."""
    return ~(formula_only(text) | ((role == "formula") & formula_like(text)))


# Section kinds and what tells them, in order; `start` at the start of the text, else anywhere; a role by itself is enough.
SECTION_RULES = (
    ("cover", "start", r"(cover\s+page|封面)\b", None),
    ("title", None, None, "title"),
    ("abstract", "start", r"(abstract|摘要)\b", "abstract"),
    ("keywords", "start", r"(keywords?|关键词|关键字)\b", None),
    ("toc", "start", r"(contents?|table\s+of\s+contents|目录)\b", None),
    ("list_of_figures", "start", r"(list\s+of\s+figures|figures\s+list|图目录|插图目录)\b", None),
    ("list_of_tables", "start", r"(list\s+of\s+tables|tables\s+list|表目录|表格目录)\b", None),
    ("references", "start", r"(references?|bibliography|参考文献)\b", None),
    ("appendix", "start", r"(appendix|附录)\b", None),
    ("acknowledgements", "start", r"(acknowledg(e)?ments?|致谢)\b", None),
    ("course_info", "any", r"course\s+name|课程名称|课程名|submission\s+date|提交日期", None),
    ("author_info", "any", r"student\s+name|student\s+id|student\s+number|group\s+members?|姓名|学号|小组成员|团队成员", None),
    ("experiment_purpose", "any", r"实验目的|experimental\s+purpose|objective", None),
    ("experiment_theory", "any", r"实验原理|theory|principles?", None),
    ("experiment_steps", "any", r"实验步骤|procedure|method", None),
    ("experiment_results", "start", r"(results?|结果)\b", None),
    ("experiment_analysis", "start", r"(analysis|分析)\b", None),
    ("result_analysis", "any", r"结果分析|results?\s+and\s+discussion|analysis", None),
    ("conclusion", "start", r"(conclusion|结论)\b", None),
    ("heading", None, None, "heading"),
    ("figure", None, None, "figure"),
    ("table", None, None, "table"),
    ("formula", None, None, "formula"),
    ("references", None, None, "reference"),
)
FIRST_LEVEL = ("title", "cover", "abstract", "keywords", "toc", "list_of_figures", "list_of_tables", "references", "appendix", "acknowledgements")


def section_kind(short: Column, role: Column) -> Column:
    """PF14: the section kind of a block: the first rule that holds, over its first 140 characters (compact())."""
    kind = None
    for name, where, pattern, by_role in SECTION_RULES:
        holds = F.lit(False)
        if by_role:
            holds = holds | (role == by_role)
        if pattern:
            holds = holds | short.rlike(f"(?i){'^' if where == 'start' else ''}(?:{pattern})")
        kind = F.when(holds, name) if kind is None else kind.when(holds, name)
    return kind.otherwise("body")


def section_title(short: Column, kind: Column) -> Column:
    """PF14: '' for body text, else the first 100 characters (compact()), or the kind itself."""
    return F.when(kind == "body", "").when(short == "", kind).otherwise(short)


def section_level(kind: Column, role: Column) -> Column:
    """PF14: 1 for the front and back matter and headings, else 2."""
    return F.when(kind.isin(*FIRST_LEVEL) | (role == "heading"), 1).otherwise(2)


def render_intent(role: Column, style: Column | None = None, standard: bool = False) -> Column:
    """PF15: how a block is to be rendered."""
    out = F.when(role.isin("figure", "table"), "preserve_asset")
    if standard:
        out = out.when(role.isin(*HEADINGS), "emphasis").when(role.isin("reference", "footnote"), "compact")
    if style is not None:
        out = out.when((style == "slide_like") & role.isin(*HEADINGS), "callout").when(style == "handout", "compact")
    return out.otherwise("normal")


def priority(role: Column) -> Column:
    """PF15: 5 for titles down to 2 for notes and references."""
    return F.when(role == "title", 5).when(role.isin("heading", "abstract"), 4).when(role.isin("footnote", "reference"), 2).otherwise(3)


def known_or(value: Column, known: tuple[str, ...], default: str) -> Column:
    """PF16: the value if it is one of `known`, else the default."""
    low = F.lower(F.trim(value))
    return F.when(low.isin(*known), low).otherwise(default)


def chinese_target(lang: Column) -> Column:
    """PF20: a Chinese target language."""
    low = F.regexp_replace(F.lower(F.trim(lang)), "_", "-")
    return (low == "zh") | low.startswith("zh-") | low.startswith("chinese")


def reviewable(role: Column, wanted: Column) -> Column:
    """PF20: translated prose whose quality is to be reviewed."""
    return F.coalesce(wanted, F.lit(True)) & ~role.isin("formula", "figure", "table", "reference")


LATIN = r"[A-Za-z][A-Za-z'’\-]*"
HAN = r"一-鿿"


def _latin_words(text: Column, least: int) -> Column:
    """Whether a text has `least` words of LATIN or more. One pass, which ends with the last of them: nothing is tried again, and no word is copied."""
    return text.rlike(rf"\A[^A-Za-z]*+(?:{LATIN}+[^A-Za-z]*+){{{least}}}")


def untranslated(source: Column, cleaned: Column) -> Column:
    """PF21: a translation into Chinese (tokens removed) that still looks like its source."""
    dense = F.regexp_replace(cleaned, r"(?U)\s+", "")
    words = F.regexp_extract_all(cleaned, F.lit(LATIN), F.lit(0))
    mine = F.array_distinct(F.transform(words, lambda w: F.lower(w)))
    theirs = F.array_distinct(F.transform(F.regexp_extract_all(source, F.lit(LATIN), F.lit(0)), lambda w: F.lower(w)))
    overlap = F.size(F.array_intersect(mine, theirs)) / F.greatest(F.size(mine), F.lit(1))
    return (
        F.when(F.trim(cleaned) == "", True)
        .when(cleaned.rlike(rf"\A[^{HAN}]*+[{HAN}][^{HAN}]*+[{HAN}]"), False)
        .when(cleaned.rlike(f"[{HAN}]") & (F.lit(1.0) / F.greatest(F.length(dense), F.lit(1)) >= 0.03), False)
        .when(~_latin_words(cleaned, 3), False)
        .when(_latin_words(cleaned, 5), True)
        # Only three or four words are compared with those of the source.
        .otherwise(overlap >= 0.5)
    )


# Keyword rules for the kind of document that an instruction asks for, in order.
DOCUMENT_KINDS = (
    ("undergraduate_thesis", r"本科论文|毕业论文|学位论文|undergraduate\s+thesis|\bthesis\b"),
    ("social_practice_report", r"social\s+practice\s+report|社会实践报告"),
    ("group_assignment", r"group\s+course\s+assignment|group\s+assignment|小组作业|团队作业"),
    ("book_report", r"book\s+report|读书报告|读后感"),
    ("lab_report", r"实验报告|lab(?:oratory)?\s+report|experiment\s+report"),
    ("proposal_report", r"开题报告|proposal\s+report|research\s+proposal|graduation\s+project\s+proposal"),
    ("course_paper", r"课程论文|course\s+paper|term\s+paper"),
    ("homework", r"普通作业|作业|homework|assignment"),
)
# Keyword rules for citation styles, and below for where a template comes from, in order.
CITATION_STYLES = (
    ("gb_t_7714", r"gb/t\s*7714|gbt\s*7714|国标\s*7714|参考文献国标"),
    ("apa", r"\bapa\b"),
    ("mla", r"\bmla\b"),
    ("ieee", r"\bieee\b"),
    ("chicago", r"\bchicago\b"),
)
TEMPLATE_SOURCES = (
    ("school_template", r"学校模板|院校模板|school\s+template|university\s+template"),
    ("course_requirement", r"课程要求|课程模板|course\s+requirement|course\s+template"),
    ("user_specified", r"自定义|用户指定|user\s+specified|custom"),
)


def first_rule(text: Column, rules: tuple[tuple[str, str], ...], default: str) -> Column:
    """PF17: the name of the first rule whose pattern is in the lower-cased text."""
    low, out = F.lower(text), None
    for name, pattern in rules:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise(default)


def intent_confidence(text: Column) -> Column:
    """PF17: .82 if a document kind was named, .45 for another instruction, .35 for none."""
    named = first_rule(text, DOCUMENT_KINDS, "") != ""
    return F.when(named, 0.82).when(F.coalesce(text, F.lit("")) != "", 0.45).otherwise(0.35)


# How instructions ask for two columns, for one, and for the gap between them.
TWO_COLUMNS = r"(?i)双栏|两栏|双列|两列|(?:double|two|2)\s*[- ]?\s*col(?:umns?|umes?|ums?)"
ONE_COLUMN = r"(?i)单栏|一栏|单列|(?:single|one|1)\s*[- ]?\s*col(?:umns?|umes?|ums?)"
COLUMN_GAP = r"(?i)(?:栏距|列距|column\s+gap)\s*[:：=]?\s*(\d+(?:\.\d+)?)\s*(pt|mm|cm|毫米|厘米)?"


def column_count(text: Column, default: int = 1) -> Column:
    """PF19: one or two columns, as the instruction says last."""
    last = F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(f"{TWO_COLUMNS}|{ONE_COLUMN}"), F.lit(0))), -1)
    return F.when(last == "", default).when(last.rlike(TWO_COLUMNS), 2).otherwise(1)


def column_gap(text: Column, default: float = 18.0) -> Column:
    """PF19: the gap that the instruction names last, in points (mm and cm rounded to 1/100)."""
    none = F.array(F.lit(""))
    value = F.element_at(F.concat(none, F.regexp_extract_all(text, F.lit(COLUMN_GAP), F.lit(1))), -1)
    unit = F.lower(F.element_at(F.concat(none, F.regexp_extract_all(text, F.lit(COLUMN_GAP), F.lit(2))), -1))
    number = value.try_cast("double")
    return F.when(value == "", default).when(unit.isin("mm", "毫米"), F.bround(number * 72.0 / 25.4, 2)).when(unit.isin("cm", "厘米"), F.bround(number * 72.0 / 2.54, 2)).otherwise(number)
