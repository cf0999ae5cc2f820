"""Formulas that are spread over blocks of a page, grown from a seed and merged (W05, with PF10 as its gate)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import predicates
from quire.functions import text as t
from quire.functions.fence import fenced
from quire.operators.formulas import CLUSTER_HEIGHT, CLUSTER_LENGTH, NO_CLUSTER, SIGNAL, cluster_steps

# Points by which a band reaches up and down, and by which boxes of two columns may stand apart; the longest weak fragment.
REACH, APART, OVERLAP, WEAK = 10.0, 72.0, -4.0, 64
PAGE = ["doc_id", "page_id"]


def weak_fragment(fixed: Column, role: Column, height: Column) -> Column:
    """A short text that can only go along with a formula beside it: a sign, a digit, or a few letters. `fixed`: its repaired text."""
    compact = F.replace(fixed, F.lit(" "), F.lit(""))
    tiny = (height >= 4.0) & (F.length(compact) <= 8) & compact.rlike(r"^[A-Za-z0-9_{}'^]+$") & compact.rlike(r"[0-9_{}'^]|[A-Za-z]{2,}")
    read = fixed.rlike(r"[∂@∇∫∑=+\-−×·/^_'\d]") | (compact.rlike(r"^[A-Za-z]{1,4}[A-Za-z0-9]{0,3}$") & (F.length(compact) <= 6))
    return ~role.isin(*NO_CLUSTER) & (fixed != "") & (F.length(fixed) <= WEAK) & ~predicates.prose(fixed, fixed) & (tiny | height.between(*CLUSTER_HEIGHT)) & read


def cluster_members(blocks: DataFrame) -> DataFrame:
    """The members of clusters of two and more blocks: `doc_id`, `page_id`, `block_id`, `seed` (the block id of the one it grew from).

    `blocks`: `doc_id`, `page_id`, `block_id`, `ord`, `column`, `role`, `text`, `box`, `formula_id`, `independent`. Blocks that may be parts (PF10) are seeds in reading order, if they aren't members
    yet. From its seed a band grows up and down: every part or weak fragment within REACH of it joins and widens it, until none is left. It has to be in the seed's column, or beside or over the seed. Columns tell what a block is;
    a page's boxes of parts and fragments, no texts, go through one task, in time m log m a seed.
    """
    height = F.col("box.y1") - F.col("box.y0")
    stripped = F.trim(F.coalesce("text", F.lit("")))
    # Long texts and roles that take no part go before anything is searched in them: Java's regular expressions recurse on long texts.
    short = F.length(F.replace(t.squeeze(F.regexp_replace(stripped, t.CONTROL, " ")), F.lit("\u00ad"), F.lit(""))) <= max(CLUSTER_LENGTH, WEAK)
    likely = blocks.where(short & ~F.coalesce("role", F.lit("")).isin(*NO_CLUSTER))
    told = fenced(likely, *cluster_steps(stripped, F.coalesce("role", F.lit("")), height, F.col("formula_id"), F.coalesce("independent", F.lit(False)), "_part"), ("_fixed", t.repair(stripped)))
    told = told.withColumn("_part", F.coalesce("_part", F.lit(False))).withColumn("_weak", F.coalesce(weak_fragment(F.col("_fixed"), F.coalesce("role", F.lit("")), height), F.lit(False)))
    rows = told.where("_part OR _weak").select(*PAGE, "ord", "block_id", "column", "_part", *[F.col(f"box.{c}").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = f"doc_id {kinds['doc_id']}, page_id {kinds['page_id']}, block_id {kinds['block_id']}, seed {kinds['block_id']}"

    def grow(keys, table):
        import numpy as np
        import pyarrow as pa

        ids = table.column("block_id")
        column = table.column("column").to_pandas().to_numpy()
        part = table.column("_part").to_numpy()
        x0, y0, x1, y1 = (table.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1"))
        order = np.lexsort((ids.to_pandas().to_numpy(), table.column("ord").to_numpy()))
        free = np.ones(len(part), bool)
        members, seeds = [], []
        for s in order.tolist():
            if not part[s] or not free[s]:
                continue
            beside = (np.minimum(x1, x1[s]) - np.maximum(x0, x0[s]) >= OVERLAP) | (np.maximum(x0, x0[s]) - np.minimum(x1, x1[s]) <= APART)
            some = np.flatnonzero(free & ((column == column[s]) | beside))
            # Boxes by their upper edge: a gap of more than REACH below all that came before ends what a band can reach.
            some = some[np.argsort(y0[some], kind="stable")]
            deep = np.maximum.accumulate(y1[some])
            gaps = np.concatenate(([0], np.cumsum(y0[some][1:] > deep[:-1] + REACH)))
            mine = some[gaps == gaps[np.flatnonzero(some == s)[0]]]
            if len(mine) > 1:
                free[mine] = False
                members += mine.tolist()
                seeds += [s] * len(mine)
        of = lambda k: pa.array([k.as_py()] * len(members), k.type)
        return pa.table({"doc_id": of(keys[0]), "page_id": of(keys[1]), "block_id": ids.take(pa.array(members, pa.int64())), "seed": ids.take(pa.array(seeds, pa.int64()))})

    return rows.groupBy(*PAGE).applyInArrow(grow, out)


def merged(blocks: DataFrame) -> DataFrame:
    """Blocks with each cluster as one: `doc_id`, `page_id`, `block_id`, `ord` (from 0, anew), `role`, `text`, `box`, `n_members`, `members`, `seed`.

    `blocks` as for cluster_members(), with `display`: whether one of its formulas is a display formula. A merged block has the id and role of its primary member (AG14: a display formula or the role of one first, then the earliest, the widest, the one with
    the most signs), the texts of its members by line (a quarter of a point of their upper edges), then from left to right, the union of their boxes, and stands where its seed stood.
    """
    width = F.col("box.x1") - F.col("box.x0")
    found = blocks.join(cluster_members(blocks), [*PAGE, "block_id"], "left")
    shown = F.when(F.coalesce("display", F.lit(False)) | (F.col("role") == "formula"), 1).otherwise(0)
    rank = F.struct(shown, -F.col("ord"), width, F.regexp_count(t.repair(F.coalesce("text", F.lit(""))), F.lit(SIGNAL)))
    place = F.struct(F.bround(F.col("box.y0") / 4, 0).alias("y"), F.bround("box.x0", 1).alias("x"), "ord", "block_id", F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    union = F.struct(F.min("box.x0").alias("x0"), F.min("box.y0").alias("y0"), F.max("box.x1").alias("x1"), F.max("box.y1").alias("y1"))
    first = F.min(F.when(F.col("block_id") == F.coalesce("seed", "block_id"), F.col("ord")))
    groups = found.groupBy(*PAGE, F.coalesce("seed", "block_id").alias("_head")).agg(
        F.max_by(F.struct("block_id", "role"), rank).alias("_p"), first.alias("_ord"), F.array_sort(F.collect_list(place)).alias("_m"), union.alias("box"), F.count(F.lit(1)).alias("n_members"), F.first("seed", ignorenulls=True).alias("seed")
    )
    texts = F.array_join(F.transform(F.filter("_m", lambda m: m["text"] != ""), lambda m: m["text"]), " ")
    order = W.partitionBy(*PAGE).orderBy("_ord", "_head")
    return groups.select(*PAGE, "_p.block_id", (F.row_number().over(order) - 1).alias("ord"), "_p.role", texts.alias("text"), "box", "n_members", F.transform("_m", lambda m: m["block_id"]).alias("members"), "seed")
