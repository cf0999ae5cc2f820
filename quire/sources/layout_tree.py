"""IO02 to IO04: pages of layout extractors from their files, with items of any shape and depth, as VARIANT columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.fence import fenced
from quire.functions.text import repair, strip_tags
from quire.scratch import store

# Patterns of paths; lists of items of a page, in order; fields that hold an item's text by precedence, and lists that do.
PAGES_FILE, CONTENT_FILE = r"middle\.json$", r"content_list_v2\.json$"
LISTS = ("para_blocks", "interline_equations", "tables", "images")
TEXTS = ("text", "content", "table_body", "code_body")
CAPTIONS = ("image_caption", "table_caption", "chart_caption", "image_footnote", "table_footnote", "chart_footnote", "list_items")
#: The place of an item without an index.
LAST = 1_000_000
ITEM = ["doc_id", "page_index", "i"]


def read_files(spark: SparkSession, folder: str, pages: str = PAGES_FILE, contents: str = CONTENT_FILE, doc: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """A row per document (by default the folder of a file): `doc_id`, `pages`, `contents`: the texts of its newest file of pages and of contents; null where there is none. Any depth of folders.

    `pages`, `contents`, `doc`: patterns of paths; the first group of `doc` is the document.
    """
    path = F.col("path")
    rows = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(folder).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("at"))
    newest = lambda p: F.max_by(F.when(path.rlike(p), F.col("value")), F.when(path.rlike(p), F.struct("at", "path")))
    return rows.where(path.rlike(pages) | path.rlike(contents)).groupBy(F.regexp_extract("path", doc, 1).alias("doc_id")).agg(newest(pages).alias("pages"), newest(contents).alias("contents"))


def _objects(raw: Column) -> Column:
    """The objects of a JSON array as texts, as they stand; null if it is none."""
    return F.filter(F.from_json(raw, "array<string>"), lambda x: x.startswith("{"))


def raw_items(files: DataFrame) -> DataFrame:
    """Items as JSON texts: `doc_id`, `page_index`, `i` (their place in the lists), `raw`. Pages without items of their own take those of the content list of the same number, if there is one. A document's two files stand in its row, so they are read once."""
    none = F.array().cast("array<string>")
    objects = _objects(F.get_json_object("pages", "$.pdf_info"))
    both = fenced(files, ("_pages", objects), ("_lists", F.from_json("contents", "array<string>")))
    with_list = F.transform("_pages", lambda p, i: F.struct(p.alias("page"), F.get("_lists", i).alias("list")))
    each = both.select("doc_id", F.posexplode(with_list).alias("page_index", "x")).select("doc_id", "page_index", "x.page", "x.list")
    own = F.concat(*[F.coalesce(_objects(F.get_json_object("page", f"$.{c}")), none) for c in LISTS])
    every = fenced(each, ("_own", own), ("_items", F.when(F.size("_own") > 0, F.col("_own")).otherwise(F.coalesce(_objects(F.col("list")), none))))
    return every.select("doc_id", "page_index", F.posexplode("_items").alias("i", "raw"))


def kind_of(v: Column) -> Column:
    """STRING, ARRAY, OBJECT or another type of a VARIANT, without what is in it."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def _text(v: Column, path: str) -> Column:
    """The string at a path; null for anything but a string."""
    x = F.try_variant_get(v, path, "variant")
    return F.when(kind_of(x) == "STRING", F.try_variant_get(v, path, "string"))


def _list(v: Column, path: str) -> Column:
    """The array at a path, as VARIANTs; null for anything else."""
    x = F.try_variant_get(v, path, "variant")
    return F.when(kind_of(x) == "ARRAY", F.try_variant_get(x, "$", "array<variant>"))


def _depth(raw: Column) -> Column:
    """How deep the brackets of a JSON text are nested, at the most."""
    signs = F.split(F.regexp_replace(raw, r"[^\[\]]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda a, c: F.struct((a["now"] + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)).alias("now"), F.greatest(a["most"], a["now"] + F.when(c == "[", 1).otherwise(0)).alias("most"))
    return F.aggregate(signs, start, step, lambda a: a["most"])


def nested_texts(rows: DataFrame) -> DataFrame:
    """Texts of nested contents: ITEM, `text`. `rows`: ITEM, `raw` (of the item), `content` (VARIANT, an object).

    The strings of the object, and those of its arrays: their strings, and of their objects the content (a string, or an array like this one) and then the children. A level a step, for as many levels as
    the deepest one has brackets; each string carries its path, and the paths give the order. Keys stand in the order of the file, which a VARIANT doesn't keep.
    """
    deepest = rows.agg(F.max(_depth(F.get_json_object("raw", "$.content")))).first()[0]
    keys = F.json_object_keys(F.get_json_object("raw", "$.content"))
    named = rows.select(*ITEM, keys.alias("keys"), F.explode(F.try_variant_get("content", "$", "map<string,variant>")).alias("key", "v"))
    level = named.select(*ITEM, F.array(F.array_position("keys", F.col("key")).cast("int")).alias("path"), "v")
    found = [level.where(kind_of(F.col("v")) == "STRING").select(*ITEM, "path", F.try_variant_get("v", "$", "string").alias("text"))]
    arrays = level.where(kind_of(F.col("v")) == "ARRAY")
    for _ in range(deepest or 0):
        each = arrays.select(*ITEM, "path", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("n", "v"))
        string, content = kind_of(F.col("v")) == "STRING", F.try_variant_get("v", "$.content", "variant")
        told = F.when(string, F.try_variant_get("v", "$", "string")).otherwise(_text(F.col("v"), "$.content"))
        here = lambda k: F.concat("path", F.array(F.col("n").cast("int"), F.lit(k)))  # noqa: E731, B023
        found.append(each.select(*ITEM, here(0).alias("path"), told.alias("text")).where("text IS NOT NULL"))
        inner = F.array(F.struct(here(1).alias("path"), content.alias("v")), F.struct(here(2).alias("path"), F.try_variant_get("v", "$.children", "variant").alias("v")))
        below = each.where(kind_of(F.col("v")) == "OBJECT").select(*ITEM, F.explode(inner).alias("x")).select(*ITEM, "x.path", "x.v")
        arrays = below.where(kind_of(F.col("v")) == "ARRAY")
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy(*ITEM).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), " ").alias("text"))


def items(files: DataFrame) -> DataFrame:
    """IO03, IO04: items in order: `doc_id`, `page_index`, `pos`, `type`, `index`, `bbox` (array<double>), `text`, `item` (VARIANT).

    Text: of the lines' spans (content, else text); of an item without lines those of its blocks; else its first string of TEXTS, tags off; else what is nested in its content; else its captions and list items. All repaired.
    Items go by index (those without one last), upper and left edge, and their place in the file; of those alike in type, box, index and the first 80 characters the first stays. Unknown fields are
    left in `item`; text that is no JSON gives no items.
    """
    v = F.col("item")
    # Written once: how deep the items are, what is nested in them and what they say are all taken from the same rows, not from the files again.
    rows = store(raw_items(files), "items").withColumn("item", F.try_parse_json("raw")).where("item IS NOT NULL")
    lines = F.coalesce(_list(v, "$.lines"), F.flatten(F.transform(F.coalesce(_list(v, "$.blocks"), F.array().cast("array<variant>")), lambda b: F.coalesce(F.try_variant_get(b, "$.lines", "array<variant>"), F.array().cast("array<variant>")))))
    span = lambda s: F.coalesce(F.try_variant_get(s, "$.content", "string"), F.try_variant_get(s, "$.text", "string"), F.lit(""))
    spans = F.flatten(F.transform(lines, lambda x: F.coalesce(F.try_variant_get(x, "$.spans", "array<variant>"), F.array().cast("array<variant>"))))
    of_lines = repair(F.array_join(F.filter(F.transform(spans, span), lambda s: F.trim(s) != ""), " "))
    parts = F.flatten(F.array(*[F.coalesce(F.try_variant_get(v, f"$.{c}", "array<string>"), F.array().cast("array<string>")) for c in CAPTIONS]))
    captions = F.array_join(F.filter(parts, lambda x: F.trim(x) != ""), " ")
    plain = strip_tags(F.coalesce(*[_text(v, f"$.{c}") for c in TEXTS]))
    told = rows.select(*ITEM, "raw", "item", of_lines.alias("_lines"), plain.alias("_plain"), captions.alias("_captions"), F.try_variant_get(v, "$.content", "variant").alias("content"))
    need = (F.coalesce("_lines", F.lit("")) == "") & F.col("_plain").isNull() & (kind_of(F.col("content")) == "OBJECT")
    nested = nested_texts(told.where(need).select(*ITEM, "raw", "content")).withColumnRenamed("text", "_nested")
    text = F.when(F.coalesce("_lines", F.lit("")) != "", F.col("_lines")).otherwise(repair(F.coalesce("_plain", "_nested", "_captions")))
    index = F.when(F.schema_of_variant(F.try_variant_get(v, "$.index", "variant")) == "BIGINT", F.try_variant_get(v, "$.index", "int"))
    kind = F.lower(F.trim(F.coalesce(F.try_variant_get(v, "$.type", "string"), F.lit(""))))
    full = told.join(nested, ITEM, "left").select(*ITEM, kind.alias("type"), index.alias("index"), F.try_variant_get(v, "$.bbox", "array<double>").alias("bbox"), text.alias("text"), "item")
    page = ["doc_id", "page_index"]
    order = [F.coalesce("index", F.lit(LAST)), F.coalesce(F.get("bbox", 1), F.lit(0.0)), F.coalesce(F.get("bbox", 0), F.lit(0.0)), F.col("i")]
    same = W.partitionBy(*page, "type", "bbox", "index", F.substring("text", 1, 80)).orderBy(*order)
    once = full.withColumn("_k", F.row_number().over(same)).where("_k = 1")
    pos = F.row_number().over(W.partitionBy(*page).orderBy(*order)) - 1
    return once.withColumn("pos", pos).select(*page, "pos", "type", "index", "bbox", "text", "item")
