"""File sources and sinks: uploads by magic bytes, manifests, JSON artifacts, data URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Most bytes of an upload.
CAP = 50 * 1024 * 1024
IMAGES = ("png", "jpg", "jpeg", "webp", "gif")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """IO26: the files of a folder: `path`, `modificationTime`, `length`, `content`; each is a job of its own."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def checked(files: DataFrame, cap: int = CAP) -> DataFrame:
    """IO11, IO12: adds `kind` (pdf, docx, image, text) by suffix and `reject`: null, too_large, unsupported_type or wrong_content.

    A PDF has its mark in the first 1,024 bytes, a DOCX begins like a ZIP file. Rejected files stay as rows, for a quarantine.
    """
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(suffix == "pdf", "pdf").when(suffix == "docx", "docx").when(suffix.isin(*IMAGES), "image").when(suffix.isin("txt", "md"), "text")
    head = F.hex(F.substring("content", 1, 1024))
    wrong = ((kind == "pdf") & ~head.contains("255044462D")) | ((kind == "docx") & ~head.startswith("504B0304"))
    reject = F.when(F.col("length") > cap, "too_large").when(kind.isNull(), "unsupported_type").when(wrong, "wrong_content")
    return files.withColumn("kind", kind).withColumn("reject", reject)


def manifest(files: DataFrame) -> DataFrame:
    """IO14, HS03: `path`, `filename`, `size_bytes`, `sha256` of files."""
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def chosen_upload(files: DataFrame) -> DataFrame:
    """IO13: of a document's files (`doc_id`, `role`, `path`): the source, else the content file, else any that isn't a layout."""
    rank = F.when(F.col("role") == "source", 0).when(F.col("role") == "content", 1).when(F.col("role") != "layout", 2)
    return files.withColumn("_r", rank).where("_r is not null").groupBy("doc_id").agg(F.min(F.struct("_r", "path")).alias("x")).select("doc_id", F.col("x.path").alias("path"))


def write_artifacts(rows: DataFrame, path: str) -> None:
    """IO16: append rows of (`doc_id`, `artifact`, `version`, `payload`), a folder per artifact."""
    rows.write.mode("append").partitionBy("artifact").json(path)


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """IO16: the last version of each document's artifacts: the last write wins."""
    rows = spark.read.schema("doc_id string, version long, payload string, artifact string").json(path)
    w = W.partitionBy("doc_id", "artifact").orderBy(F.desc("version"), F.desc("payload"))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def read_jobs(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """IO17: job files that parse, newest first, `limit` (1 to 100) of them: the feature is the first page of a list."""
    schema = "job_id string, doc_id string, state string, progress double, message string, _corrupt_record string"
    rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    rows = rows.select("*", F.col("_metadata.file_modification_time").alias("modified")).where(F.col("_corrupt_record").isNull() & F.col("job_id").isNotNull())
    return rows.drop("_corrupt_record").orderBy(F.desc("modified"), "job_id").limit(max(1, min(100, limit)))


def data_url(mime, content):
    """IO23: bytes as a data URL."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))  # Spark may break base64 into lines


def input_summary(sources: DataFrame, blocks: DataFrame, assets: DataFrame) -> DataFrame:
    """IO15: per document how many sources, blocks and assets, the first 600 characters of its text, and all flags once in order."""
    s = sources.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sources"), F.array_distinct(F.flatten(F.array_sort(F.collect_list("flags")))).alias("flags"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    b = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.substring(text, 1, 600).alias("excerpt"))
    a = assets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_assets"))
    zero = F.lit(0)
    return s.join(b, "doc_id", "left").join(a, "doc_id", "left").select("doc_id", "n_sources", F.coalesce("n_blocks", zero).alias("n_blocks"), F.coalesce("n_assets", zero).alias("n_assets"), F.coalesce("excerpt", F.lit("")).alias("excerpt"), "flags")


def kept_assets(assets: DataFrame) -> DataFrame:
    """IO19: assets (`doc_id`, `page_id`, `pos`, `kind`, `box`): of equal boxes, to a tenth, the first; vector drawings of 36 square points and more."""
    b = F.col("box")
    tenth = [F.round(b[c], 1) for c in ("x0", "y0", "x1", "y1")]
    w = W.partitionBy("doc_id", "page_id", *tenth).orderBy("pos")
    big = (F.col("kind") != "vector") | ((b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) >= 36)
    return assets.where(big).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def html_pages(rendered: DataFrame) -> DataFrame:
    """IO21: documents as HTML text: `doc_id`, `html`; titles and headings as such, all else as paragraphs, escaped."""
    escaped = F.replace(F.replace(F.replace(F.col("shown_text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = F.when(F.col("role") == "title", "h1").when(F.col("role") == "heading", "h2").otherwise("p")
    one = F.concat(F.lit("<"), tag, F.lit(">"), escaped, F.lit("</"), tag, F.lit(">"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("h")))), lambda x: x["h"]), "\n")
    return rendered.groupBy("doc_id").agg(F.concat(F.lit("<!doctype html>\n"), body).alias("html"))
