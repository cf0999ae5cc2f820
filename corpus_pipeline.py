"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
Stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, langid, lines, mixing, simhash
from quire.llm.common import free, skew_join, store
from quire.session import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; those without letters or without a known n-gram go.

    Texts, labels and all else stay as they are, whatever language was found.
    """
    model = langid.learn(docs.select("doc_id", "text", "lang"))
    found = langid.identify(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != langid.UND) & (F.col("score") > 0)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take later occurrences of repeated three-line windows out of the texts; documents of which nothing is left go."""
    out = lines.dedup_lines(docs.select(*COLUMNS))
    emptied = (F.col("n_removed") > 0) & (F.trim("text") == "")
    out = out.where(~F.coalesce(emptied, F.lit(False)))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each SimHash component: the one with the least id (null last), then by a hash of the text.

    Rows are told apart by id and text, so different texts that share an id are judged each for itself, and rows with a null id are
    deduplicated like any other. Rows that repeat id and text are one row (the first by the other columns).
    """
    hashes = {"_h1": F.xxhash64(F.col("text").isNull(), "text"), "_h2": F.xxhash64(F.lit(7), "text")}
    docs = docs.select(*COLUMNS)
    key = ["doc_id", *hashes]
    classes = store(simhash.near_components(docs.select("doc_id", "text").withColumns(hashes), carry=key).groupBy("root", *key).agg(F.count(F.lit(1)).alias("_n")), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), *key, "_n")).alias("_first")
    kept = store(classes.groupBy("root").agg(first).select(F.col("_first.doc_id").alias("_kept"), "_first._h1", "_first._h2", "_first._n"), "kept")
    out = skew_join(docs.withColumns(hashes), kept, ["_h1", "_h2"], merge=True).where(F.col("doc_id").eqNullSafe(F.col("_kept")))
    once = out.where("_n = 1").select(*COLUMNS)
    if kept.where("_n > 1").limit(1).count():
        again = out.where("_n > 1").groupBy("_h1", "_h2").agg(F.min(F.struct(*COLUMNS)).alias("_r")).select("_r.*")
        once = once.unionByName(again)
    return once


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents towards the target weights of their sources."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every copy: doc_id, source, ids, n_tokens, and the SHA-256 of ids and of the bytes that they decode to."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, ("ids", "n_tokens", "ids_sha256", "decoded_sha256"), carry=["doc_id", "source"])


STAGES = [("language ID", language), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("mixing", mixing_stage), ("byte-level BPE", tokens)]

#: SQL can express neither the trained language stage nor the SimHash and BPE stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            out, done = store(out, f"stage{i + 1}"), docs
            free(done)  # what a stage has read is not needed any more
        docs = out
    return docs
