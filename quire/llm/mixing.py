"""Mixing sources to target weights: repetition rates by source, and copies drawn by a hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import WORD, store, with_outputs

#: The weights that sources get in code point order, again and again.
WEIGHTS = (5, 2, 1)
#: Words to take, as a share of all words.
SHARE = 1.5
#: Most times that a source may be repeated.
MOST = 2.0
SEED = "quire-mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source of (`_source`, `_size`): `_ssize` long, `_target` double, `_rate` double.

    Targets are in proportion to the weights; one above `most` times its
    source's size stops there and the excess is shared again by weight until
    none is above. That fixed point is found in one pass: with the sources
    ordered by cap/weight, those below the water level are capped.
    The windows run over one row per source, never over documents, and in one task: sources are meant to be
    names (a hundred thousand are no matter), not addresses of single pages.
    """
    by_source = sizes.groupBy("_source").agg(F.sum("_size").alias("_ssize"))
    everything = W.partitionBy()
    order = W.orderBy(F.col("_source").asc_nulls_last())
    index = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (index + 1).cast("int"))
    ranked = by_source.withColumn("_w", weight).withColumn("_cap", F.col("_ssize") * F.lit(float(most)))
    ranked = ranked.withColumn("_ask", F.lit(float(share)) * F.sum("_ssize").over(everything))
    # Water level if this source and all after it in cap/weight order stay uncapped.
    fill = W.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_cap").over(fill), F.lit(0.0))
    left = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(fill), F.lit(0.0))
    level = (F.col("_ask") - before) / left
    ranked = ranked.withColumn("_level", F.when(F.col("_cap") / F.col("_w") > level, level))
    ranked = ranked.withColumn("_final", F.max("_level").over(everything))
    target = F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_final") * F.col("_w")))
    return ranked.select("_source", "_ssize", target.alias("_target")).withColumn("_rate", F.when(F.col("_ssize") > 0, F.col("_target") / F.col("_ssize")).otherwise(0.0))


def draw(id_col: Column, text_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) decided by the id, or by the text where the id is null, and the seed: 52 bits of an MD5."""
    own = F.concat(F.lit("|"), F.md5(F.coalesce(text_col, F.lit("")).cast("binary")))
    key = F.concat(F.coalesce(id_col.cast("string"), own), F.lit("|" + seed))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, carry: list[str] | None = None) -> DataFrame:
    """The columns of `carry` (default: all of the input), and `size`, `source_size` long, `target` double, `copies` int, `taken` long.

    `copies` is the whole part of the source's rate (target / source size),
    and one more if the document's draw is below the fraction. Null text has
    size 0. Null is a source like any other, last in order; sources without words
    have target 0 and take nothing. Rows with the same id draw alike; rows with a null id
    draw by their text, so those of equal texts draw alike. No rows: no rows. Input columns with the names of outputs are replaced.
    The table of sources is written first, so Spark knows its size when it plans the join onto the documents: below
    spark.sql.autoBroadcastJoinThreshold it is broadcast and the documents stay where they are; above, both sides are
    shuffled and AQE splits hot sources.
    """
    size = F.coalesce(F.size(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))), F.lit(0))
    size = F.when(F.col(text_col).isNull(), 0).otherwise(size).cast("long")
    targets = store(source_targets(docs.select(F.col(source_col).alias("_source"), size.alias("_size")), weights, share, most), "targets")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).alias("_src"), size.alias("_size"), F.struct(*(docs.columns if carry is None else carry)).alias("_row"))
    out = rows.join(targets, F.col("_src").eqNullSafe(F.col("_source")))
    whole = F.floor("_rate").cast("int")
    out = out.withColumn("_n", whole + (draw(F.col("_id"), F.col("_text"), seed) < F.col("_rate") - whole).cast("int"))
    return with_outputs("_row", out, size=F.col("_size"), source_size=F.col("_ssize"), target=F.col("_target"), copies=F.col("_n"), taken=F.col("_size") * F.col("_n"))


def mix(docs: DataFrame, **kwargs) -> DataFrame:
    """The mix itself: each document as many times as `plan_mix` gives copies, with its input columns and `copy` int from 0."""
    planned = plan_mix(docs, **kwargs)
    names = [c for c in docs.columns if c.lower() != "copy"]
    return planned.where("copies > 0").select(*names, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
