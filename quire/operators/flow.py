"""Continuous page flow: texts, assets and figures with captions placed on pages of one or two columns."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Points around figures; what a heading keeps free below it; the least scale of a figure that is too tall; the share of a page that an asset may be high.
FIGURE_BEFORE, FIGURE_BETWEEN, FIGURE_AFTER = 8.0, 4.0, 8.0
KEPT_BELOW = 36.0
LEAST_SCALE = 0.72
ASSET_SHARE, ASSET_LEAST, ASSET_TALLEST = 0.42, 24.0, 72.0
EPSILON = 0.01
#: Roles that ask for room below them, or for a page of their own.
KEPT_TOGETHER = ("title", "heading", "reference")
#: Least lines of a text at the foot of a column.
FOOT_LINES = 2

PLACED = "doc_id {id}, pos long, part string, fragment int, fragments int, page int, column int, x0 double, y0 double, x1 double, y1 double, placement string, text string, flags array<string>"


@dataclass(frozen=True)
class Pages:
    """Pages that content flows on, in points. `columns`: 1 or 2 (any other number is 1)."""

    width: float = 595.0
    height: float = 842.0
    left: float = 54.0
    top: float = 54.0
    right: float = 54.0
    bottom: float = 54.0
    columns: int = 1
    gap: float = 18.0


class _Flow:
    """The cursors of one document, its page so far, and the figures that wait for room: all that placing an item depends on."""

    def __init__(self, pages: Pages):
        self.x0, self.y0 = pages.left, pages.top
        self.width = pages.width - pages.left - pages.right
        self.bottom = pages.height - pages.bottom
        self.page_height = pages.height
        self.two = pages.columns == 2
        gap = min(max(0.0, pages.gap), max(0.0, self.width - 2.0)) if self.two else 0.0
        self.step = (self.width - gap) / 2 + gap if self.two else 0.0
        self.narrow = (self.width - gap) / 2 if self.two else self.width
        self.page, self.texts, self.assets = 1, False, False
        self.waiting: deque = deque()
        self.restart(self.y0)

    @property
    def tallest(self) -> float:
        return self.bottom - self.y0

    @property
    def used(self) -> bool:
        return self.texts or self.assets

    def restart(self, y: float) -> None:
        """Both columns go on from `y`, the first one first."""
        self.cols, self.active, self.y = [y, y] if self.two else [y], 0, y

    def level(self) -> None:
        """The cursor below all columns, for what spans them."""
        if self.two:
            self.cols[self.active] = self.y
            self.y = max(self.cols)

    def to_column(self) -> None:
        if self.two:
            self.y = self.cols[self.active]

    def next_column(self) -> bool:
        if not self.two or self.active:
            return False
        self.cols[0], self.active = self.y, 1
        self.y = self.cols[1]
        return True

    def end_page(self) -> None:
        self.page += 1
        self.texts = self.assets = False
        self.restart(self.y0)

    def break_page(self) -> Iterator[tuple]:
        """End the page, with the waiting figures that still fit on it, and begin the next one with one that waits."""
        self.level()
        while self.waiting and self.waiting[0]["needs"] <= self.bottom - self.y + EPSILON:
            yield from self.figure(self.waiting.popleft(), "page_bottom" if self.texts else "page_top")
            self.level()
        if self.used:
            self.end_page()
        yield from self.begin_page()

    def begin_page(self) -> Iterator[tuple]:
        while self.waiting and not self.used:
            yield from self.figure(self.waiting.popleft(), "page_top")

    def sized(self, item: dict) -> tuple[float, float]:
        """Width and height of an asset, scaled down to the page."""
        width, height = max(1.0, item["width"]), max(1.0, item["height"])
        scale = min(1.0, self.width / width, max(ASSET_TALLEST, self.page_height * ASSET_SHARE) / height)
        return max(ASSET_LEAST, width * scale), max(ASSET_LEAST, height * scale)

    def asset_box(self, width: float, height: float, before: float) -> tuple:
        self.y += before
        x0 = self.x0 + max(0.0, (self.width - width) / 2)
        self.assets = True
        return self.page, None, x0, self.y, x0 + width, self.y + height

    def asset(self, item: dict) -> Iterator[tuple]:
        self.level()
        width, height = self.sized(item)
        if self.used and self.y + FIGURE_BEFORE + height > self.bottom:
            yield from self.break_page()
        box = self.asset_box(width, height, FIGURE_BEFORE)
        yield ("asset", 1, 1, *box, "inline", None, ["reflow_asset"])
        self.restart(box[-1] + FIGURE_AFTER)

    def prepared(self, item: dict) -> dict:
        """A figure with its caption: the room that it needs, and its scale where that is more than a page."""
        width, height = self.sized(item)
        style, text = item["style"], item["text"]
        caption = style.height(item["units"], self.width) if text else None
        around = FIGURE_BETWEEN + style.before + caption + style.after if text else FIGURE_AFTER
        fixed, scale = FIGURE_BEFORE + around, 1.0
        if fixed + height > self.tallest + EPSILON:
            target = min(height, max(height * LEAST_SCALE, max(ASSET_LEAST, self.tallest - fixed)))
            if target < height - EPSILON:
                scale, width, height = target / height, width * target / height, target
        return item | {"size": (width, height), "caption": caption, "scale": scale, "needs": fixed + height, "too_tall": fixed + height > self.tallest + EPSILON}

    def figure(self, item: dict, placement: str) -> Iterator[tuple]:
        """The asset of a figure across all columns, and its caption below it; a caption goes over to the next page where it doesn't fit."""
        self.level()
        style, text, flags = item["style"], item["text"], ["reflow_asset", "figure_grouped"]
        flags += ["figure_caption_grouped"] * bool(text) + ["figure_group_scaled"] * (item["scale"] < 1.0 - EPSILON) + ["figure_group_split"] * item["too_tall"]
        box = self.asset_box(*item["size"], FIGURE_BEFORE)
        yield (item["pos"], "asset", 1, 1, *box, placement, None, flags)
        self.y = box[-1] + FIGURE_BETWEEN
        if text:
            parts = [text]
            if self.y + style.before + item["caption"] > self.bottom:
                if not item["too_tall"]:
                    self.end_page()
                else:
                    first = self.bottom - self.y - style.before
                    if first < style.font * style.line:
                        self.end_page()
                        first = None
                    parts = style.fragments(text, self.width, self.tallest, first) or [text]
            split = ["figure_group_split", "figure_caption_continued"] * (len(parts) > 1)
            for i, part in enumerate(parts, 1):
                if i > 1 and self.used:
                    self.end_page()
                height = style.height(item["measure"](part), self.width)
                if self.used and self.y + style.before + height > self.bottom:
                    self.end_page()
                self.y += style.before
                clipped = ["overflow_clipped", "figure_caption_continued"] * (self.y + height > self.bottom)
                more = ["reflow_split"] * (len(parts) > 1) + ["reflow_continued"] * (i > 1)
                yield (item["pos"], "caption", i, len(parts), self.page, None, self.x0, self.y, self.x0 + self.width, self.y + height, placement, part, list(dict.fromkeys(split + clipped + more)))
                self.texts = True
                self.y += height + style.after
        self.restart(self.y)

    def text(self, item: dict) -> Iterator[tuple]:
        style, text, column = item["style"], item["text"], self.two and item["span"] == "column"
        width = self.narrow if column else self.width
        back = self.to_column if column else self.level
        back()
        if not text:
            return
        if item["role"] == "reference" and self.texts:
            yield from self.break_page()
            back()
        needs = style.height(item["units"], width)
        if item["role"] in ("title", "heading") and self.texts and self.y + needs + KEPT_BELOW > self.bottom:
            yield from self.break_page()
            back()
        first = self.bottom - self.y - style.before
        if self.texts and first < style.font * style.line * FOOT_LINES:
            if not (column and self.next_column()):
                yield from self.break_page()
            back()
            first = self.bottom - self.y - style.before
        parts = style.fragments(text, width, self.tallest, first if self.texts else None)
        clipped: list[str] = []
        for i, part in enumerate(parts, 1):
            height = needs if len(parts) == 1 else style.height(item["measure"](part), width)
            if self.used and self.y + style.before + height > self.bottom:
                if not (column and self.next_column()):
                    yield from self.break_page()
                back()
            self.y += style.before
            if self.y + height > self.bottom:
                if self.used:
                    if not (column and self.next_column()):
                        yield from self.break_page()
                    back()
                    self.y += style.before
                if self.y + height > self.bottom:
                    clipped = ["overflow_clipped"]
            x0 = self.x0 + (self.active * self.step if column else 0.0)
            more = ["reflow_split"] * (len(parts) > 1) + ["reflow_continued"] * (i > 1)
            yield ("text", i, len(parts), self.page, self.active if column else None, x0, self.y, x0 + width, self.y + height, "inline", part, clipped + more)
            self.texts = True
            self.y += height + style.after
            if not column:
                self.restart(self.y)
            else:
                self.cols[self.active] = self.y

    def plain(self, pos: int, kind: str, role: str, span: str, text: str, style, units: int) -> tuple | None:
        """The row of a text that goes whole where the cursor stands, as most do, the same as text() gives; None, and nothing done, where anything else may happen."""
        column = self.two and span == "column"
        if kind != "text" or self.waiting or not text or role in KEPT_TOGETHER or self.two and not column:
            return None
        y, width = self.cols[self.active] if column else self.y, self.narrow
        first = self.bottom - y - style.before
        if self.texts and first < style.font * style.line * FOOT_LINES or len(text) > style.chars(width, (self.texts and first) or self.tallest):
            return None
        height, up = style.height(units, width), y + style.before
        if up + height > self.bottom:
            return None
        x0 = self.x0 + (self.active * self.step if column else 0.0)
        self.texts, self.y = True, up + height + style.after
        self.cols[self.active] = self.y
        return (pos, "text", 1, 1, self.page, self.active if column else None, x0, up, x0 + width, up + height, "inline", text, [])

    def place(self, item: dict) -> Iterator[tuple]:
        """The rows that an item gives: (pos, part, fragment, fragments, page, column, box, placement, text, flags); those of figures that waited may come first."""
        if self.waiting and not self.used:
            yield from self.begin_page()
        if item["kind"] == "figure":
            ready = self.prepared(item)
            self.level()
            if self.used and self.y + ready["needs"] > self.bottom:
                self.waiting.append(ready)
            else:
                yield from self.figure(ready, "inline")
            return
        for row in self.asset(item) if item["kind"] == "asset" else self.text(item):
            yield row if len(row) == 13 else (item["pos"], *row)

    def finish(self) -> Iterator[tuple]:
        while self.waiting:
            if self.used:
                yield from self.break_page()
            else:
                yield from self.begin_page()
                if self.used:
                    self.end_page()


def reflow(items: DataFrame, pages: Pages = Pages()) -> DataFrame:
    """A row for each placed asset and each fragment of a text or caption: see PLACED (`column`: from 0; null for what spans the page).

    `items`: `doc_id`, `pos`, `kind` (text, asset, figure), `role`, `span` (column or full), `text` (of a figure: its caption), `font_size`, `line_height` (a factor), `space_before`, `space_after`, `indent` (ems),
    `width`, `height` (of an asset, in points). Items go by pos. Texts are cut at ends of sentences, clauses or words where a column is full (ST25), go on in the next column and then on the next page; two lines at least stay at the
    foot of a column. What spans the page begins below both columns, and both go on below it. Titles and headings keep room below them; references begin a page. Assets and figures
    span the page. A figure without room waits while texts go on, and stands at the foot of its page if there is room left in the end, or at the head of the next one; one that is taller than a page is scaled down to 72 %
    at the least, and its caption is split. White space in texts is squeezed; a text of nothing takes no room; null numbers are 0, but font size and line height 12 and 1.25.

    What an item's place depends on is all that came before it in its document, so a document is placed by one task, which reads its items one after another and
    holds the cursors and waiting figures only; documents are dealt out over all tasks.
    """
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(PLACED.format(id=items.schema["doc_id"].dataType.simpleString()))
    number = lambda name, other: F.coalesce(F.col(name).cast("double"), F.lit(other)).alias(name)
    squeezed = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)[\s\x1C-\x1F]+", " ")).alias("text")
    numbers = {"font_size": 12.0, "line_height": 1.25, "space_before": 0.0, "space_after": 0.0, "indent": 0.0, "width": 0.0, "height": 0.0}
    rows = items.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("kind"), F.coalesce("role", F.lit("paragraph")).alias("role"), F.coalesce("span", F.lit("full")).alias("span"), squeezed, *[number(n, x) for n, x in numbers.items()])
    names = rows.columns

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        from quire.functions.fitting import Style, glyph_widths, widths_of

        kinds = to_arrow_schema(schema)
        measure = lambda t: int(glyph_widths(t).sum())
        styles: dict[tuple, Style] = {}
        flow, doc, out = None, None, []

        def handed():
            made = pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
            out.clear()
            return made

        for batch in batches:
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(names)}
            columns["units"] = widths_of(columns["text"])
            fields = list(columns)
            for values in zip(*columns.values(), strict=True):
                owner, pos, kind, role, span, text, *look, _, _, units = values
                if flow is None or owner != doc:
                    out += [(doc, *r) for r in flow.finish()] if flow else []
                    flow, doc = _Flow(pages), owner
                style = styles.get(tuple(look))
                if style is None:
                    if len(styles) > 1000:
                        styles.clear()
                    style = styles[tuple(look)] = Style(*look)
                row = flow.plain(pos, kind, role, span, text, style, units)
                if row:
                    out.append((doc, *row))
                else:
                    item = dict(zip(fields, values, strict=True))
                    item["style"], item["measure"] = style, measure
                    out += [(doc, *r) for r in flow.place(item)]
                if len(out) > 5000:
                    yield handed()
        if flow:
            out += [(doc, *r) for r in flow.finish()]
        if out:
            yield handed()

    many = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(many, "doc_id").sortWithinPartitions("doc_id", "pos", "kind", "text").mapInArrow(run, schema)
