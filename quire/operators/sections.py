"""Sections, requirements and layout intents of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import predicates as p
from quire.functions.fence import fenced
from quire.functions.text import compact, squeeze


def sections(blocks: DataFrame) -> DataFrame:
    """PF14, W11: one section per block: `section_id` (kind and two-digit place), `kind`, `title`, `level`, `flags`."""
    order = F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))
    out = fenced(blocks, ("_squeezed", squeeze(F.col("text"))), ("_short", compact(F.col("_squeezed"), 140, True)), ("kind", p.section_kind(F.col("_short"), F.col("role")))).withColumn("_n", order)
    flags = F.array_compact(F.array(F.when((F.col("kind") == "body") & (F.col("role") == "unknown"), "section_kind_uncertain"), F.when(F.trim("text") == "", "empty_section_source")))
    title = p.section_title(compact(F.col("_squeezed"), 100, True), F.col("kind"))
    return out.select("doc_id", F.format_string("%s_%02d", "kind", "_n").alias("section_id"), "pos", "kind", title.alias("title"), p.section_level(F.col("kind"), F.col("role")).alias("level"), flags.alias("flags"))


def merged_sections(candidates: DataFrame, fallback: DataFrame) -> DataFrame:
    """Candidate sections claim their blocks (first section by id for a block); uncovered blocks get their fallback section; in order of place."""
    claim = W.partitionBy("doc_id", "pos").orderBy("section_id")
    claimed = candidates.withColumn("_k", F.row_number().over(claim)).where("_k = 1").drop("_k")
    rest = fallback.join(claimed.select("doc_id", "pos"), ["doc_id", "pos"], "left_anti")
    both = claimed.unionByName(rest)
    return both.groupBy("doc_id", "section_id", "kind").agg(F.array_sort(F.collect_list("pos")).alias("block_positions")).withColumn("place", F.col("block_positions")[0])


# What the kinds of documents ask for by themselves, in order: document kind, then id, category and section kinds of each requirement.
BY_DOCUMENT_KIND = {
    "proposal_report": (("formal_academic_style", "style", ()), ("supervisor_submission", "tone", ()), ("clear_title", "structure", ("title",)), ("main_text", "structure", ("body",))),
    "undergraduate_thesis": (("clear_title", "structure", ("title",)), ("main_text", "structure", ("body",)), ("references", "bibliography", ("references",))),
    "course_paper": (("academic_style", "style", ()), ("clear_title", "structure", ("title",)), ("readable_body_text", "style", ("body",))),
    "lab_report": (
        ("lab_objective", "structure", ("experiment_purpose",)),
        ("lab_principles", "structure", ("experiment_theory",)),
        ("lab_procedure", "structure", ("experiment_steps",)),
        ("lab_results", "structure", ("experiment_results",)),
        ("lab_analysis", "structure", ("experiment_analysis",)),
        ("lab_conclusion", "structure", ("conclusion",)),
    ),
    "book_report": (("clear_headings", "structure", ("heading",)), ("highlight_important_content", "style", ()), ("non_promotional_tone", "tone", ())),
    "social_practice_report": (
        ("target_length_5000_words", "length", ()),
        ("cover_page", "structure", ("cover",)),
        ("table_of_contents", "structure", ("toc",)),
        ("section_headings", "structure", ("heading",)),
        ("headers", "structure", ()),
        ("page_numbers", "numbering", ()),
    ),
    "group_assignment": (("cover_page", "structure", ("cover",)), ("course_name", "metadata", ("course_info",)), ("project_title", "metadata", ("title",)), ("group_members", "metadata", ("author_info",))),
    "homework": (("formal_assignment_style", "style", ()),),
}
# What keywords of an instruction ask for, in order: id, category, section kinds, pattern over the lower-cased instruction.
_ALIGNED = r"figures?.*tables?.*equations?|figures?.*tables?|图.*表.*公式"
_LISTS = r"lists?\s+of\s+figures?\s+and\s+tables?|图目录|表目录"
BY_KEYWORD = (
    ("cover_page", "structure", ("cover",), r"cover\s+page|封面"),
    ("abstract", "structure", ("abstract",), r"\babstract\b|摘要"),
    ("keywords", "structure", ("keywords",), r"\bkeywords?\b|关键词|关键字"),
    ("table_of_contents", "structure", ("toc",), r"table\s+of\s+contents|\btoc\b|目录"),
    ("main_text", "structure", ("body",), r"main\s+text|正文"),
    ("references", "bibliography", ("references",), r"\breferences?\b|bibliography|参考文献"),
    ("acknowledgements", "structure", ("acknowledgements",), r"acknowledg(?:e)?ments?|致谢"),
    ("consistent_citations_references", "bibliography", ("references",), r"citations?\s+and\s+references?|consistent\s+citations?|引用.*参考文献"),
    ("asset_alignment", "asset", ("figure", "table", "formula"), _ALIGNED),
    ("figure_numbering", "numbering", ("figure",), _ALIGNED),
    ("table_numbering", "numbering", ("table",), _ALIGNED),
    ("formula_numbering", "numbering", ("formula",), _ALIGNED),
    ("list_of_figures", "structure", ("list_of_figures",), _LISTS),
    ("list_of_tables", "structure", ("list_of_tables",), _LISTS),
    ("main_text_12pt_simsun", "style", ("body",), r"12[- ]?point\s+simsun|12\s*pt\s+simsun|12\s*号\s*宋体|小四|simsun"),
    ("line_spacing_1_5", "style", ("body",), r"1\.5\s+line\s+spacing|1\.5\s*倍行距|line\s+spacing"),
    ("level1_heading_16pt_simhei", "style", ("heading",), r"16[- ]?point\s+simhei|16\s*pt\s+simhei|16\s*号\s*黑体|simhei"),
    ("main_text_page_numbers", "numbering", ("body",), r"page\s+numbers?.*main\s+text|页码.*正文|正文.*页码"),
    ("course_name", "metadata", ("course_info",), r"course\s+name|课程名称|课程名"),
    ("student_name", "metadata", ("author_info",), r"student\s+name|学生姓名|姓名"),
    ("student_id", "metadata", ("author_info",), r"student\s+id|student\s+number|学号"),
    ("submission_date", "metadata", ("course_info",), r"submission\s+date|提交日期|日期"),
    ("project_title", "metadata", ("title",), r"project\s+title|项目标题|课题名称"),
    ("group_members", "metadata", ("author_info",), r"group\s+members?|all\s+group\s+members?|小组成员|团队成员"),
    ("headers", "structure", (), r"headers?|页眉"),
    ("page_numbers", "numbering", (), r"page\s+numbers?|页码"),
    ("target_length_5000_words", "length", (), r"approximately\s+5,?000\s+words|约\s*5000\s*字|5,?000\s+words"),
    ("highlight_important_content", "style", (), r"highlight\s+important\s+content|突出重点|highlight"),
    ("non_promotional_tone", "tone", (), r"commercial|promotional|商业|宣传"),
    ("formal_academic_style", "style", (), r"formal|professional|正式|规范|academic\s+style"),
)


def requirements(instructions: DataFrame) -> DataFrame:
    """PF18: requirement rows of instructions (`doc_id`, `instruction`): `requirement_id`, `category`, `section_kinds`.

    First what the kind of document asks for, then what keywords do; of rules with the same id the first gives the category, and the section kinds of all
    are put together in order. The rules are a list of fixed size, so they are applied as an array of conditions, without a join.
    """
    rows = instructions.select("doc_id", F.coalesce("instruction", F.lit("")).alias("_i"))
    rows = rows.withColumns({"_low": F.lower("_i"), "_kind": p.first_rule(F.col("_i"), p.DOCUMENT_KINDS, "generic_academic")})
    rule = lambda r, c, k: F.struct(F.lit(r).alias("requirement_id"), F.lit(c).alias("category"), F.array(*map(F.lit, k)).cast("array<string>").alias("section_kinds"))
    hits = [F.when(F.col("_kind") == kind, rule(*x)) for kind, rules in BY_DOCUMENT_KIND.items() for x in rules]
    hits += [F.when(F.col("_low").rlike(f"(?U){pattern}"), rule(r, c, k)) for r, c, k, pattern in BY_KEYWORD]
    each = rows.select("doc_id", F.posexplode(F.array_compact(F.array(*hits))).alias("rule", "x")).select("doc_id", "rule", "x.*")
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("rule", "section_kinds"))), lambda x: x["section_kinds"])
    return each.groupBy("doc_id", "requirement_id").agg(F.min_by("category", "rule").alias("category"), F.array_distinct(F.flatten(kinds)).alias("section_kinds"))


def coverage(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Requirements against the section kinds present: `status` satisfied, missing, or recognized (asks for no section), and the `missing` kinds."""
    kinds = found.groupBy("doc_id").agg(F.collect_set("kind").alias("_kinds"))
    out = wanted.join(kinds, "doc_id", "left")
    missing = F.array_except("section_kinds", F.coalesce("_kinds", F.array().cast("array<string>")))
    status = F.when(F.size("section_kinds") == 0, "recognized").when(F.size(missing) == 0, "satisfied").otherwise("missing")
    return out.select("doc_id", "requirement_id", "category", status.alias("status"), F.sort_array(missing).alias("missing"))


def with_signals(blocks: DataFrame, signals: DataFrame, least: float = 0.6) -> DataFrame:
    """The role of a signal (`doc_id`, `pos`, `role`, `confidence`) for blocks whose own is unknown, if it is sure enough."""
    side = signals.select("doc_id", "pos", F.col("role").alias("_role"), "confidence")
    use = (F.col("role") == "unknown") & (F.col("confidence") >= least)
    return blocks.join(side, ["doc_id", "pos"], "left").withColumn("role", F.when(use, F.col("_role")).otherwise(F.col("role"))).drop("_role", "confidence")


def layout_intents(blocks: DataFrame, style: str = "paper", standard: bool = False) -> DataFrame:
    """U13, PF15: the layout plan of blocks: `render_intent`, `priority`, with the section they stand in."""
    intent = p.render_intent(F.col("role"), F.lit(style), standard)
    plan = blocks.select("doc_id", "pos", "role", intent.alias("render_intent"), p.priority(F.col("role")).alias("priority"))
    return plan.join(sections(blocks).select("doc_id", "pos", "section_id", "kind"), ["doc_id", "pos"])


def by_kind(found: DataFrame, kinds: list[str]) -> DataFrame:
    """SO05: per document the section ids of each of `kinds`, in order: one array column per kind."""
    in_order = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("pos", "section_id")))), lambda x: x["section_id"]).alias(k)
    return found.groupBy("doc_id").agg(*[in_order(k) for k in kinds])


def intents(instructions: DataFrame) -> DataFrame:
    """PF16-PF19: what instructions (`doc_id`, `instruction`) ask for, one column each."""
    i = F.coalesce(F.col("instruction"), F.lit(""))
    return instructions.select(
        "doc_id",
        p.first_rule(i, p.DOCUMENT_KINDS, "generic_academic").alias("document_kind"),
        p.intent_confidence(i).alias("confidence"),
        p.first_rule(i, p.CITATION_STYLES, "auto").alias("citation_style"),
        p.first_rule(i, p.TEMPLATE_SOURCES, "default_academic").alias("template_source"),
        F.when(F.lower(i).rlike(r"\bdocx\b|\bword\b|\.docx|word文档|word 格式"), F.array(*map(F.lit, ("html_preview", "pdf", "docx")))).otherwise(F.array(*map(F.lit, ("html_preview", "pdf")))).alias("outputs"),
        p.column_count(i).alias("column_count"),
        p.column_gap(i).alias("column_gap_pt"),
    )


def document_counts(blocks: DataFrame) -> DataFrame:
    """AG01: per document its blocks, characters (with separators, AG18) and a map of blocks by role."""
    each = blocks.groupBy("doc_id", "role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("c"))
    return each.groupBy("doc_id").agg(F.sum("n").alias("n_blocks"), (F.sum("c") + F.greatest(F.sum("n") - 1, F.lit(0))).alias("n_chars"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n")))).alias("roles"))
