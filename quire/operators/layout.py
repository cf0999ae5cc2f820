"""Spatial joins and page diagnostics over boxes (`doc_id`, `page_id`, an id, `box`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions.predicates import boilerplate, caption_label

PAGE = ["doc_id", "page_id"]


#: Points of a grid tile (twice as many as a line of text or a small figure is wide, so that most boxes lie in one or two), and the tiles that coordinates fall into at the least and at the most: what lies further out is in the outermost ones.
TILE, FIRST_TILE, LAST_TILE = 128.0, -4, 19


def _tile(at: Column) -> Column:
    return F.least(F.greatest(F.floor(at / TILE), F.lit(FIRST_TILE)), F.lit(LAST_TILE)).cast("int")


def tiled(items: DataFrame, box: str = "box", reach: float = 0.0) -> DataFrame:
    """Adds `tx`, `ty`: a row for each tile that a box, made higher by `reach` up and down, lies in; boxes without coordinates have none."""
    b = F.col(box)
    across, down = F.sequence(_tile(b["x0"]), _tile(b["x1"])), F.sequence(_tile(b["y0"] - reach), _tile(b["y1"] + reach))
    placed = b["x0"].isNotNull() & b["y0"].isNotNull() & b["x1"].isNotNull() & b["y1"].isNotNull()
    return items.where(placed).withColumn("tx", F.explode(across)).withColumn("ty", F.explode(down))


def _once(a: Column, b: Column, reach: float = 0.0, side: str = "") -> Column:
    """Whether this tile (of the table `side`) is the one of two boxes that meet: that of the left upper corner of what they share. `reach`: by which the first one was made higher."""
    return (F.col(f"{side}tx") == _tile(F.greatest(a["x0"], b["x0"]))) & (F.col(f"{side}ty") == _tile(F.greatest(a["y0"] - reach, b["y0"])))


def overlaps(items: DataFrame, least: float = 0.12) -> DataFrame:
    """Pairs of items of a page (`item_id`, `ord`) that share at least `least` (above 0) of the smaller one's area.

    Boxes are laid out on the tiles of their page and joined by page and tile; a pair that meets in several counts in one. So a page with very many boxes is no single key,
    and a box meets only those near it. Both sides are the same table, without other names in it, so that Spark shuffles it once.
    """
    if least <= 0:
        raise ValueError("least must be above 0")
    each = tiled(items.select(*PAGE, "item_id", "ord", "box"))
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    share = g.overlap_of_smaller(a("box"), b("box"))
    same = [a(c) == b(c) for c in (*PAGE, "tx", "ty")]
    pairs = each.alias("a").join(each.alias("b"), same).where((a("ord") < b("ord")) & _once(a("box"), b("box"), side="a.") & (share >= least))
    return pairs.select(*map(a, PAGE), a("item_id").alias("first_id"), b("item_id").alias("second_id"), share.alias("share"))


def outside_page(items: DataFrame, pages: DataFrame, slack: float = 0.01) -> DataFrame:
    """Items that pass the edges of their page (`width`, `height`)."""
    b = F.col("box")
    out = items.join(pages.select(*PAGE, "width", "height"), PAGE)
    return out.where((b["x0"] < -slack) | (b["y0"] < -slack) | (b["x1"] > F.col("width") + slack) | (b["y1"] > F.col("height") + slack)).select(*PAGE, "item_id")


def near_assets(blocks: DataFrame, assets: DataFrame, distance: float = 90.0, overlap: float = 0.35) -> DataFrame:
    """Blocks (`box`) with a figure, table or image of their page above or below within reach, overlapping by `overlap` (above 0) across. A semi-join by page and tile, as in overlaps()."""
    side = tiled(assets.where(F.col("kind").isin("image", "figure", "table")).select(*PAGE, F.col("box").alias("_box")), "_box", distance)
    near = (g.vertical_distance(F.col("_box"), F.col("box")) <= distance) & (g.horizontal_overlap(F.col("_box"), F.col("box")) >= overlap)
    found = tiled(blocks.select(*PAGE, "box")).join(side, [*PAGE, "tx", "ty"]).where(near).select(*PAGE, "box").distinct()
    return blocks.join(found, [*PAGE, "box"], "left_semi").select(blocks.columns)


def refine_captions(blocks: DataFrame, assets: DataFrame) -> DataFrame:
    """Captions without a label become paragraphs; labelled small paragraphs near an asset become captions."""
    near = near_assets(blocks, assets).select("doc_id", "block_id").distinct().withColumn("_near", F.lit(True))
    label = caption_label(F.col("text"))
    small = F.coalesce("font_size", F.lit(10.0)) <= 10.5
    role = F.when((F.col("role") == "caption") & ~label, "paragraph").when((F.col("role") == "paragraph") & label & F.col("_near") & small, "caption").otherwise(F.col("role"))
    return blocks.join(near, ["doc_id", "block_id"], "left").withColumn("role", role).drop("_near")


def best_asset(candidates: DataFrame, assets: DataFrame, least: float = 0.6) -> DataFrame:
    """For each candidate (`candidate_id`, `box`) the asset of its page that it overlaps most, if by `least` (above 0) of the smaller; ties: the first asset id. Joined by page and tile, as in overlaps()."""
    side = tiled(assets.select(*PAGE, "asset_id", F.col("box").alias("_box")), "_box")
    share = g.overlap_of_smaller(F.col("box"), F.col("_box"))
    hits = tiled(candidates.select(*PAGE, "candidate_id", "box")).join(side, [*PAGE, "tx", "ty"]).withColumn("share", share).where((F.col("share") >= least) & _once(F.col("box"), F.col("_box")))
    return hits.groupBy(*PAGE, "candidate_id").agg(F.min(F.struct((-F.col("share")).alias("s"), "asset_id")).alias("x")).select(*PAGE, "candidate_id", "x.asset_id", (-F.col("x.s")).alias("share"))


def caption_pairs(captions: DataFrame, assets: DataFrame, distance: float = 90.0) -> DataFrame:
    """Each asset, in order of y, x and id, takes the nearest caption that is left: `asset_id`, `caption_id`, `score`.

    Score: the gap, 30 more if the caption is above, and a twentieth of the distance between the centres across.
    A caption has one asset, so the choice is an ordered fold per page over the scored pairs within reach.
    """
    side = captions.select(*PAGE, "caption_id", F.col("box").alias("_c"))
    gap = g.vertical_distance(F.col("box"), F.col("_c"))
    above = F.when(F.col("_c.y1") <= F.col("box.y0"), 30.0).otherwise(0.0)
    across = F.abs((F.col("box.x0") + F.col("box.x1")) / 2 - (F.col("_c.x0") + F.col("_c.x1")) / 2)
    scored = assets.join(side, PAGE).where(gap <= distance).select(*PAGE, F.struct(F.col("box.y0").alias("y"), F.col("box.x0").alias("x"), F.col("asset_id").alias("id"), (gap + above + across * 0.05).alias("score"), F.col("caption_id").alias("caption")).alias("p"))
    pages = scored.groupBy(*PAGE).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<string>").alias("done"), F.array().cast("array<struct<id:string,caption:string,score:double>>").alias("out"))

    def take(acc, p):
        free = ~F.array_contains(acc["used"], p["caption"]) & ~F.array_contains(acc["done"], p["id"])
        pick = F.struct(p["id"].alias("id"), p["caption"].alias("caption"), p["score"].alias("score"))
        return F.struct(*[F.when(free, F.concat(acc[n], F.array(v))).otherwise(acc[n]).alias(n) for n, v in (("used", p["caption"]), ("done", p["id"]), ("out", pick))])

    return pages.select(*PAGE, F.explode(F.aggregate("ps", start, take, lambda a: a["out"])).alias("x")).select(*PAGE, F.col("x.id").alias("asset_id"), F.col("x.caption").alias("caption_id"), "x.score")


def asset_order(assets: DataFrame, blocks: DataFrame) -> DataFrame:
    """As-of: an asset's place is half past the last block that begins at or above it on its page, or -0.5.

    One union and one window per page: no pairs.
    """
    both = blocks.select(*PAGE, F.col("box.y0").alias("_y"), F.lit(0).alias("_kind"), F.col("reading_order").cast("double").alias("_o"), F.lit(None).cast("string").alias("asset_id"))
    both = both.unionByName(assets.select(*PAGE, F.col("box.y0").alias("_y"), F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_o"), "asset_id"))
    upto = W.partitionBy(*PAGE).orderBy("_y", "_kind").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("place", F.coalesce(F.max("_o").over(upto) + 0.5, F.lit(-0.5))).where("_kind = 1").select(*PAGE, "asset_id", "place")


def repeated_margin_text(blocks: DataFrame, pages: DataFrame, band: float = 0.08) -> DataFrame:
    """AG03: lower-cased texts that stand in the top or bottom band of two pages or more of a document with two pages or more."""
    sized = blocks.join(pages.select(*PAGE, "height"), PAGE).where("height > 0")
    edge = (F.col("box.y0") <= F.col("height") * band) | (F.col("box.y1") >= F.col("height") * (1 - band))
    return sized.where(edge & (F.col("text") != "")).groupBy("doc_id", F.lower("text").alias("text")).agg(F.countDistinct("page_id").alias("n_pages")).where("n_pages >= 2")


def without_margins(blocks: DataFrame, pages: DataFrame, band: float = 0.08) -> DataFrame:
    """PF04: blocks without repeated margin texts and without boilerplate."""
    repeated = repeated_margin_text(blocks, pages, band).select("doc_id", F.col("text").alias("_low"), F.lit(True).alias("_rep"))
    out = blocks.join(pages.select(*PAGE, "height"), PAGE).withColumn("_low", F.lower("text")).join(repeated, ["doc_id", "_low"], "left")
    b, h = F.col("box"), F.col("height")
    edge = (b["y0"] <= h * band) | (b["y1"] >= h * (1 - band))
    return out.where(~(F.coalesce("_rep", F.lit(False)) & edge) & ~boilerplate(F.col("text"), b["x0"], b["y0"], b["x1"], b["y1"], h, band)).drop("_low", "_rep", "height")


def reading_order(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds `reading_order` int from 0 per page.

    Pages of three blocks and more whose narrow blocks make two columns, each under 58 % of the page's width, are read column by
    column, with what stands above them first and below or across last; others row by row, in rows of 8 points.
    """
    b, w = F.col("box"), F.col("width")
    wide = b["x1"] - b["x0"]
    body = (wide > 0) & (b["y1"] > b["y0"]) & (wide <= w * 0.58) & ~((wide < 14) & (b["y1"] - b["y0"] > 40))
    left = (b["x0"] + b["x1"]) / 2 < w / 2
    page = W.partitionBy(*PAGE)
    rows = blocks.join(pages.select(*PAGE, "width"), PAGE).withColumns({"_body": body, "_left": left})
    of = lambda cond, f, c: f(F.when(cond, c)).over(page)
    lefts, rights = F.col("_body") & F.col("_left"), F.col("_body") & ~F.col("_left")
    span = lambda cond: of(cond, F.max, b["x1"]) - of(cond, F.min, b["x0"])
    columns = (F.count(F.lit(1)).over(page) >= 3) & (span(lefts) < w * 0.58) & (span(rights) < w * 0.58)
    top, bottom = of(F.col("_body"), F.min, b["y0"]), of(F.col("_body"), F.max, b["y1"])
    group = F.when(F.col("_body"), F.when(F.col("_left"), 0.0).otherwise(1.0)).when(b["y1"] < top, -1.0).when(b["y0"] > bottom, 2.0).otherwise(1.5)
    rows = rows.withColumn("_two", F.coalesce(columns, F.lit(False))).withColumn("_group", F.when(F.col("_two"), group).otherwise(0.0))
    row, x, y = F.bround(b["y0"] / 8), F.bround(b["x0"], 1), F.bround(b["y0"], 1)
    order = page.orderBy("_group", row, F.when(F.col("_two"), y).otherwise(x), F.when(F.col("_two"), x).otherwise(y), F.bround(wide, 1), "block_id")
    return rows.withColumn("reading_order", F.row_number().over(order) - 1).drop("_body", "_left", "_two", "_group", "width")


def page_use(items: DataFrame, pages: DataFrame, low: float = 0.18) -> DataFrame:
    """AG04: per page its share of covered area (4 digits), white space below the last item, and whether it is little used (PF25)."""
    used = items.groupBy(*PAGE).agg(F.sum(g.area(F.col("box"))).alias("_a"), F.max("box.y1").alias("_y"), F.count(F.lit(1)).alias("n_items"))
    out = pages.join(used, PAGE, "left")
    share = F.bround(F.coalesce("_a", F.lit(0.0)) / (F.col("width") * F.col("height")), 4)
    below = F.bround(F.greatest(F.lit(0.0), F.col("height") - F.coalesce("_y", F.lit(0.0))) / F.col("height"), 4)
    out = out.select(*PAGE, F.coalesce("n_items", F.lit(0)).alias("n_items"), share.alias("utilization"), below.alias("bottom_whitespace"))
    under = (F.col("utilization") < low) & (F.col("bottom_whitespace") >= 0.3) | (F.col("bottom_whitespace") >= 0.45) & (F.col("utilization") <= 0.35)
    return out.withColumn("underfilled", under)


def flag_histogram(rows: DataFrame, flags: str = "flags", by: list[str] | None = None) -> DataFrame:
    """AG02, AG04, AG06: how often each flag stands."""
    return rows.select(*(by or []), F.explode(flags).alias("flag")).groupBy(*(by or []), "flag").agg(F.count(F.lit(1)).alias("n"))


def gate(histogram: DataFrame, blocking: list[str]) -> DataFrame:
    """AG05: per document the blocking flags, and whether it is accepted or wants repair."""
    hit = F.col("flag").isin(*blocking)
    return histogram.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.when(hit, F.col("flag")))).alias("blocking"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_blocking")).withColumn("accepted", F.col("n_blocking") == 0).withColumn("repair_recommended", F.col("n_blocking") > 0)


def union_box(items: DataFrame, by: list[str]) -> DataFrame:
    """AG11, AG16: the box around all items of a group."""
    return items.groupBy(*by).agg(F.struct(F.min("box.x0").alias("x0"), F.min("box.y0").alias("y0"), F.max("box.x1").alias("x1"), F.max("box.y1").alias("y1")).alias("box"))


def source_margins(items: DataFrame, pages: DataFrame, low: float = 36.0, high: float = 72.0) -> DataFrame:
    """AG16: margins of a document's first page, each kept between 36 and 72 points."""
    first = pages.groupBy("doc_id").agg(F.min_by(F.struct("page_id", "width", "height"), "page_index").alias("p")).select("doc_id", "p.*")
    box = union_box(items.join(first.select("doc_id", "page_id"), PAGE, "left_semi"), PAGE)
    keep = lambda c: F.greatest(F.lit(low), F.least(F.lit(high), c))
    return first.join(box, PAGE).select("doc_id", keep(F.col("box.x0")).alias("left"), keep(F.col("box.y0")).alias("top"), keep(F.col("width") - F.col("box.x1")).alias("right"), keep(F.col("height") - F.col("box.y1")).alias("bottom"))


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """AG12: the middle value of each group, the upper of two."""
    v = F.sort_array(F.collect_list(value))
    return rows.groupBy(*by).agg(F.element_at(v, F.floor(F.size(v) / 2).cast("int") + 1).alias("median"))


def display_height(formulas: DataFrame, font: float = 10.0) -> DataFrame:
    """AG13: per document the true median of positive display formula heights (none: 2.2 fonts), between 18 and 48 points."""
    h = F.when((F.col("display_mode") == "display") & (F.col("height") > 0), F.col("height"))
    return formulas.groupBy("doc_id").agg(F.greatest(F.lit(18.0), F.least(F.lit(48.0), F.coalesce(F.median(h), F.lit(2.2 * font)))).alias("height"))


def islands(items: DataFrame, order: str, gap: float = 14.0) -> DataFrame:
    """Numbers runs of items of a page whose gap to the item before is at most `gap` and that begin within 32 points of its centre: `island` int from 1."""
    page = W.partitionBy(*PAGE).orderBy(order)
    before = F.lag("box").over(page)
    centre = lambda b: (b["x0"] + b["x1"]) / 2
    close = (F.col("box.y0") - before["y1"] <= gap) & (F.abs(centre(F.col("box")) - centre(before)) <= 32.0)
    return items.withColumn("_new", F.when(F.coalesce(close, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("_new").over(page).cast("int")).drop("_new")


def bands(items: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """Numbers vertical bands of a page: items whose heights, widened by the tolerance, meet directly or through others: `band` int from 1.

    Meeting intervals on a line are runs of the order by top edge, so the fixed point needs one window: a band begins
    where an item starts below all that came before.
    """
    page = W.partitionBy(*PAGE).orderBy("box.y0", "box.y1", "item_id")
    deepest = F.max("box.y1").over(page.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(F.col("box.y0") <= deepest + tolerance, 0).otherwise(1)
    return items.withColumn("_new", new).withColumn("band", F.sum("_new").over(page.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_new")


def intent_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Blocks whose render intent differs, or that only one side has."""
    side = lambda df, n: df.select("doc_id", "block_id", F.col("render_intent").alias(n))
    return side(before, "before").join(side(after, "after"), ["doc_id", "block_id"], "full").where(~F.col("before").eqNullSafe(F.col("after")))
