"""What an instruction asks of pages and styles, and settings in layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The headers of document kinds, and named styles with the requirements that ask for them.
HEADERS = {"social_practice_report": "Social Practice Report", "undergraduate_thesis": "Thesis", "course_paper": "Course Paper"}
OTHER_HEADER = "Academic Document"
SERIF = ("Times New Roman", "SimSun", "Songti SC", "Noto Serif CJK SC", "serif")
SANS = ("Times New Roman", "SimHei", "Heiti SC", "Noto Sans CJK SC", "sans-serif")
STYLES = {
    "main_text": (("main_text_12pt_simsun", "line_spacing_1_5"), {"font_size_pt": 12.0, "bold": False, "alignment": "justify", "line_height": 1.5, "first_line_indent_em": 2.0, "font_stack": SERIF}),
    "level1_heading": (("level1_heading_16pt_simhei",), {"font_size_pt": 16.0, "bold": True, "alignment": "left", "line_height": 1.5, "font_stack": SANS}),
    "important_content": (("highlight_important_content",), {"font_size_pt": 12.0, "bold": True, "alignment": "left", "line_height": 1.5}),
}


def page_setups(intents: DataFrame, wanted: DataFrame) -> DataFrame:
    """ST32: a row per intent (`doc_id`, `document_kind`): `has_header`, `header_text` (null without a header), `page_numbers`, and the names of the `styles` (keys of STYLES) that its requirements ask for."""
    ids = wanted.groupBy("doc_id").agg(F.collect_set("requirement_id").alias("_ids"))
    out = intents.select("doc_id", "document_kind").join(ids, "doc_id", "left").withColumn("_ids", F.coalesce("_ids", F.array().cast("array<string>")))
    has = lambda *names: F.arrays_overlap("_ids", F.array(*map(F.lit, names)))
    title = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in HEADERS.items() for x in kv]), F.col("document_kind")), F.lit(OTHER_HEADER))
    named = F.array_compact(F.array(*[F.when(has(*asks), F.lit(name)) for name, (asks, _) in STYLES.items()]))
    return out.select("doc_id", has("headers").alias("has_header"), F.when(has("headers"), title).alias("header_text"), has("page_numbers", "main_text_page_numbers").alias("page_numbers"), named.alias("styles"))


def layered(layers: dict[str, DataFrame]) -> DataFrame:
    """IO25: settings (`name`, `value`) of layers from the weakest to the strongest: each name's strongest value that isn't null, and its `layer`."""
    every = None
    for i, (layer, rows) in enumerate(layers.items()):
        part = rows.select("name", F.struct(F.lit(i).alias("i"), F.col("value").cast("string").alias("value"), F.lit(layer).alias("layer")).alias("x")).where("x.value is not null")
        every = part if every is None else every.unionByName(part)
    return every.groupBy("name").agg(F.max("x").alias("x")).select("name", "x.value", "x.layer")


def redacted(settings: DataFrame, secret: str = "(?i)key|token|secret|password") -> DataFrame:
    """IO25: settings to show: values of secret names are replaced by whether they are set."""
    return settings.withColumn("value", F.when(F.col("name").rlike(secret), F.when(F.coalesce("value", F.lit("")) != "", "[set]").otherwise("[unset]")).otherwise(F.col("value")))
