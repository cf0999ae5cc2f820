"""Line dedup: repeated windows of consecutive lines, found over the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import with_outputs

#: Lines in a window.
WINDOW = 3


def line_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per window of `window` consecutive lines: `_id`, `_th` (hash of the text), `_pos`, `_h1`, `_h2`.

    Windows of nothing but spaces are left out. The two 64-bit hashes have
    different seeds and are used together as one 128-bit key.
    """
    lines = F.split(F.col("_t"), "\n", -1)
    starts = F.when(F.size("_l") >= window, F.sequence(F.lit(0), F.size("_l") - window)).otherwise(F.array().cast("array<int>"))
    return (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
        .where(F.col("_t").isNotNull())
        .select("_id", F.xxhash64("_t").alias("_th"), lines.alias("_l"))
        .select("_id", "_th", F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("_l", i + 1, window), "\n"))).alias("_pos", "_w"))
        .where(F.translate("_w", " \n", "") != "")
        .select("_id", "_th", "_pos", F.xxhash64("_w").alias("_h1"), F.xxhash64(F.lit(7), "_w").alias("_h2"))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Remove later occurrences of repeated three-line windows; documents keep all their columns.

    Windows overlap and start at every line (lines end at "\\n"). Of the
    occurrences of a window in the whole corpus, ordered by (id, text hash,
    position), the first stays; the lines that any later one covers go, except
    that an occurrence which overlaps the first one in the same document is left alone
    (it would tear the kept one). Covered positions of a document are merged
    into runs and the text is rebuilt from the gaps.

    Returns the input columns with the text replaced, and `n_lines` and
    `n_removed` int. Null text: stays null, 0 lines. Empty text: one (empty)
    line. Null ids sort first and are otherwise ids like any other. Rows that
    repeat both id and text are one document and share its result. Input
    columns called n_lines or n_removed are replaced.

    Shuffles: 16-byte keys once for the counts (combined before the shuffle, so
    a line that a third of all documents share costs a row a task), once for
    the join, whose sides are both dealt out anew so that a skewed key can be split;
    the texts once by document.
    """
    found = line_windows(docs, id_col, text_col, window)
    repeated = (
        found.groupBy("_h1", "_h2")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_id", "_th", "_pos")).alias("_first"))
        .where("_n > 1")
        .select(F.col("_h1").bitwiseXOR(F.lit(1)).alias("_k1"), F.col("_h2").alias("_k2"), "_first")
    )
    here = F.struct("_id", "_th", "_pos")
    same = F.col("_id").eqNullSafe(F.col("_first._id")) & (F.col("_th") == F.col("_first._th"))
    later = (
        found.withColumns({"_k1": F.col("_h1").bitwiseXOR(F.lit(1)), "_k2": F.col("_h2")})
        .join(repeated, ["_k1", "_k2"])
        .where((here > F.col("_first")) & ~(same & (F.col("_pos") - F.col("_first._pos") < window)))
        .groupBy("_id", "_th", "_pos")
        .agg(F.lit(1).alias("_one"))
    )
    by_doc = W.partitionBy("_id", "_th")
    since = F.coalesce(F.lag("_pos").over(by_doc.orderBy("_pos")) + window, F.lit(0))
    gaps = (
        later.withColumn("_from", since)
        .groupBy("_id", "_th")
        .agg(F.array_sort(F.collect_list(F.when(F.col("_pos") > F.col("_from"), F.struct(F.col("_from").alias("s"), F.col("_pos").alias("e"))))).alias("_gaps"), (F.max("_pos") + window).alias("_rest"))
        .withColumnsRenamed({"_id": "_id2", "_th": "_th2"})
    )
    whole = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.struct("*").alias("_row"))
    out = whole.join(gaps, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_th") == F.col("_th2")), "left").withColumn("_l", F.split(F.col("_row")[text_col], "\n", -1))
    kept = F.concat(
        F.flatten(F.transform("_gaps", lambda g: F.slice("_l", g["s"] + 1, g["e"] - g["s"]))),
        F.slice("_l", F.col("_rest") + 1, F.greatest(F.size("_l") - F.col("_rest"), F.lit(0))),
    )
    out = out.withColumn("_kept", F.when(F.col("_gaps").isNotNull() & F.col("_l").isNotNull(), kept))
    n = F.when(F.col("_l").isNull(), 0).otherwise(F.size("_l"))
    text = F.when(F.col("_kept").isNotNull(), F.array_join("_kept", "\n")).otherwise(F.col("_row")[text_col])
    names = docs.columns
    done = with_outputs("_row", out, **{text_col: text, "n_lines": n, "n_removed": F.when(F.col("_kept").isNull(), 0).otherwise(n - F.size("_kept"))})
    return done.select(*[c for c in names if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")
