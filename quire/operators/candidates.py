"""All places of a document that may be formulas, from five sources by precedence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import predicates
from quire.functions import text as t
from quire.functions.fence import fenced
from quire.operators import clusters, evidence, formulas, layout, spanruns
from quire.scratch import store

PAGE = ["doc_id", "page_id"]
BLOCK = [*PAGE, "block_id"]
#: Sources by precedence: what an earlier one holds, a later one doesn't give again.
SOURCES = ("known", "cluster", "block", "inline", "asset")
COLUMNS = (*PAGE, "candidate_id", "source", "block_id", "asset_id", "mode", "start", "end", "source_text", "box", "flags", "members")
_REF = f"^{t.FORMULA_REF}$"


def _rows(df: DataFrame, source: str, mode: str, text: Column, **more: Column) -> DataFrame:
    """Candidates in COLUMNS; the id is 16 digits of the SHA-1 of source, page and what the candidate is made of."""
    none, ids = F.lit(None).cast("int"), F.array().cast(f"array<{df.schema['block_id'].dataType.simpleString()}>")
    given = {"block_id": F.col("block_id"), "asset_id": F.lit(None).cast("string"), "start": none, "end": none, "box": F.col("box"), "flags": F.array().cast("array<string>"), "members": ids} | more
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (F.col("doc_id"), F.col("page_id"), given["block_id"], given["asset_id"], given["start"], text)]
    number = F.concat(F.lit("fc_"), F.substring(F.sha1(F.concat_ws("|", F.lit(source), *parts).cast("binary")), 1, 16))
    return df.select(*PAGE, number.alias("candidate_id"), F.lit(source).alias("source"), given["block_id"].alias("block_id"), given["asset_id"].alias("asset_id"), F.lit(mode).alias("mode"), *[given[n].cast("int").alias(n) for n in ("start", "end")], text.alias("source_text"), given["box"].alias("box"), given["flags"].alias("flags"), given["members"].alias("members"))


def union(blocks: DataFrame, spans: DataFrame, lines: DataFrame, assets: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Candidates (COLUMNS) from `known` formulas, clusters of blocks, blocks, places inside blocks, and assets, in this precedence.

    `blocks`: columns of clusters.merged(); `spans`, `lines`: those of spanruns.inline_runs(); `assets`: PAGE, `asset_id`, `kind`, `box`, `alt_text`, `formula_id`; `known`: PAGE, `formula_id`, `block_id`, `mode`, `start`, `end`, `source_text`. A known display formula and a cluster hold their
    blocks whole. Blocks that have a formula or are a reference give none; those with the role of a formula that read as one give one; in others, places that overlap a known formula's are passed over. Pictures that may be formulas (PF09) are candidates, but
    one that a display candidate lies on (by 60 % of the smaller, J10) goes with that one. Every step is an anti-join or a union by document and page; ids that repeat stay once. Clusters and candidates are written, as
    they are read more than once.
    """
    found = []
    free = blocks
    if known is not None:
        source = F.trim(F.coalesce("source_text", F.lit("")))
        good = known.join(blocks.select(*BLOCK, F.col("box")), BLOCK).where((source != "") & ~predicates.noise(source))
        flags = F.array(F.lit("legacy_formula_migrated"), F.concat(F.lit("legacy_formula_replaced:"), "formula_id"))
        shown = F.col("mode") == "display"
        found += [_rows(good.where(shown), "known", "display", source, start=F.col("start"), end=F.col("end"), flags=F.array_append(flags, F.lit("formula_display_cluster"))), _rows(good.where(~shown), "known", "inline", source, start=F.col("start"), end=F.col("end"), flags=flags)]
        free = free.join(good.where(shown).select(*BLOCK), BLOCK, "left_anti")
    merged = store(clusters.merged(free).where("n_members > 1"), "clusters")
    found.append(_rows(merged, "cluster", "display", F.col("text"), start=F.lit(0), end=F.length("text"), flags=F.array(F.lit("formula_display_cluster")), members=F.col("members")))
    free = free.join(merged.select(*PAGE, F.explode("members").alias("block_id")), BLOCK, "left_anti")
    free = free.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).where(F.col("formula_id").isNull() & ~F.col("text").rlike(_REF))
    # Only blocks with the role of a formula are told by their look; prose goes on as it is, and no other role gives a candidate.
    whole = fenced(free.where("role = 'formula'"), *formulas.formula_steps(F.col("text"), "_f")).where("_f_display")
    found.append(_rows(whole, "block", "display", F.col("text"), start=F.lit(0), end=F.length("text")))
    rest = free.where(F.col("role").isin(*spanruns.ROLES)).select(*BLOCK, "role", "text", "box")
    # Blocks are told apart by page too.
    inside = spanruns.inline_runs(rest.withColumn("block_id", F.struct("page_id", "block_id")), *[_paged(x) for x in (spans, lines)])
    inside = inside.withColumns({"page_id": F.col("block_id.page_id"), "block_id": F.col("block_id.block_id")})
    if known is not None:
        held = known.where("mode = 'inline'").select(*BLOCK, F.col("start").alias("_s"), F.col("end").alias("_e"))
        on = [inside[c] == held[c] for c in BLOCK] + [(F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s"))]
        inside = inside.join(held, on, "left_anti")
    found.append(_rows(inside, "inline", "inline", F.col("source_text"), start=F.col("start"), end=F.col("end"), flags=F.col("flags")))
    pictures = assets.where(F.col("formula_id").isNull() & evidence.formula_asset(F.col("box"), F.col("alt_text"))).select(*PAGE, "asset_id", "box")
    texts = store(reduce(DataFrame.unionByName, found).dropDuplicates([*PAGE, "candidate_id"]), "candidates")
    matched = layout.best_asset(texts.where("mode = 'display'").select(*PAGE, "candidate_id", "box"), pictures).select(*PAGE, "candidate_id", F.col("asset_id").alias("_asset"))
    texts = texts.join(matched, [*PAGE, "candidate_id"], "left").withColumn("asset_id", F.coalesce("_asset", "asset_id")).drop("_asset")
    alone = pictures.join(matched.select(*PAGE, F.col("_asset").alias("asset_id")), [*PAGE, "asset_id"], "left_anti")
    kind = blocks.schema["block_id"].dataType.simpleString()
    return texts.unionByName(_rows(alone.withColumn("block_id", F.lit(None).cast(kind)), "asset", "display", F.lit(""), asset_id=F.col("asset_id"))).select(*COLUMNS)


def _paged(rows: DataFrame) -> DataFrame:
    """Spans or lines whose block ids carry their page."""
    return rows.withColumn("block_id", F.struct("page_id", "block_id"))
