"""Texts cut to boxes and columns, against the rules spelled out glyph by glyph, and the placing of figures."""

import random
from functools import cache
from math import ceil

import pytest

from quire.functions.fitting import BREAKS, SENTENCE_MARKS, Style, boxed_fragments, glyph_widths
from quire.operators import flow, paging

ITEM = "doc_id string, pos long, kind string, role string, span string, text string, font_size double, line_height double, space_before double, space_after double, indent double, width double, height double"


@cache
def glyph(c):
    return int(glyph_widths(c)[0])


def width_of(text):
    return sum(map(glyph, text))


def slow_boxes(text, width, height, font, line):
    many, wide, out = max(1, int(height / (font * line))), 100 * max(1, int(width / font)), []
    while True:
        lines = sum(max(1, ceil(width_of(t) / 100 * font / width)) for t in (text.splitlines() or [text])) if text else 0
        if lines * font * line <= height:
            return [*out, text] if text or not out else out
        lines, used, end = 1, 0, 0
        for i, c in enumerate(text):
            if c == "\n":
                lines, used = lines + 1, 0
            else:
                if used and used + width_of(c) > wide:
                    lines, used = lines + 1, 0
                used += width_of(c)
            if lines > many:
                break
            end = i + 1
        end = max(end, 1)
        back = max(text.rfind(b, 0, end) for b in BREAKS)
        end = back + 1 if back >= max(1, int(end * 0.6)) else end
        out.append(text[:end].rstrip())
        text = text[end:].lstrip()
        if not text:
            return out


def test_boxes_by_glyphs():
    draw = random.Random(1)
    for _ in range(400):
        text = "".join(draw.choice("ab cD1.,\n 图。é\r") for _ in range(draw.randrange(0, 150)))
        box = (draw.choice([20.0, 50.0, 80.0]), draw.choice([12.0, 26.0, 60.0]), draw.choice([10.0, 8.0]), 1.25)
        assert boxed_fragments(text, *box) == slow_boxes(text, *box)


def slow_fragments(style, text, width, tallest, first):
    height = lambda t: style.height(width_of(t), width)

    def most(t, room):
        return max([k for k in range(1, len(t) + 1) if height(t[:k].strip()) <= room], default=1)

    def cut(t, n):
        n = min(n, len(t))
        at = max(t.rfind(m, 0, n) for m in SENTENCE_MARKS)
        return at + (not t[at].isspace()) if at >= max(1, int(n * 0.55)) else n

    if not text or len(text) <= style.chars(width, first or tallest):
        return [text] if text else []
    out = []
    while text:
        room = first if first and not out else tallest
        n = min(style.chars(width, room), most(text, room))
        if len(text) <= n:
            return [*out, text]
        at = cut(text, n)
        part, text = text[:at].strip(), text[at:].strip()
        if text and (len(text) < 12 or style.lines(width_of(text), width) < 2):
            at = cut(part, max(1, int(len(part) * 0.75)))
            part, text = part[:at].strip(), f"{part[at:].strip()} {text}".strip()
        out.append(part)
    return out


def test_fragments_of_columns():
    draw = random.Random(2)
    for _ in range(100):
        text = " ".join("".join(draw.choice("abcD1.,图。é;!") for _ in range(draw.randrange(1, 9))) for _ in range(draw.randrange(0, 90)))
        style = Style(draw.choice([8.0, 10.0]), 1.25, 0, 0, draw.choice([0, 2.0]))
        room = (draw.choice([60.0, 150.0]), draw.choice([40.0, 100.0]), draw.choice([None, 14.0, 30.0]))
        assert style.fragments(text, *room) == slow_fragments(style, text, *room)


def test_long_texts_take_linear_time():
    import time

    text, took = "some words of a long text. " * 20_000, []
    for t in (text, text * 4):
        began = time.perf_counter()
        boxed_fragments(t, 200.0, 100.0, 10.0, 1.25)
        Style(10.0, 1.25, 0, 0, 0).fragments(t, 200.0, 100.0)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]  # four times the text; quadratic would be 16 and more


def text(doc, pos, t, role="paragraph", span="column", **more):
    return (doc, pos, "text", role, span, t, 10.0, 1.25, 0.0, 0.0, 0.0, None, None)


def figure(doc, pos, caption, width, height, kind="figure"):
    return (doc, pos, kind, "figure", "full", caption, 10.0, 1.25, 2.0, 2.0, 0.0, width, height)


SMALL = flow.Pages(width=220.0, height=240.0, left=20.0, top=20.0, right=20.0, bottom=20.0, gap=20.0, columns=2)  # 180 x 200, columns of 80


def placed(spark, rows, pages=SMALL):
    got = flow.reflow(spark.createDataFrame(rows, ITEM).repartition(3), pages).collect()
    return {(r["doc_id"], r["pos"], r["part"], r["fragment"]): r for r in got}


def test_columns_and_full_width(spark):
    lines = "word " * 40
    got = placed(spark, [text("a", 1, "A title", "title", "full"), text("a", 2, lines), text("a", 3, "end"), text("a", 4, None), text("b", 1, "alone")])
    assert (got["a", 1, "text", 1]["column"], got["a", 1, "text", 1]["x1"]) == (None, 200.0)
    parts = [r for k, r in sorted(got.items()) if k[:3] == ("a", 2, "text")]
    assert [p["column"] for p in parts][0] == 0 and " ".join(p["text"] for p in parts).split() == lines.split()
    assert parts[0]["y0"] == got["a", 1, "text", 1]["y1"]
    assert ("a", 4, "text", 1) not in got and got["b", 1, "text", 1]["page"] == 1


def test_text_goes_to_the_next_column_and_page(spark):
    lines = "many words in a row " * 60
    got = placed(spark, [text("a", 1, lines)])
    parts = [got[k] for k in sorted(got)]
    assert [(p["page"], p["column"]) for p in parts][:3] == [(1, 0), (1, 1), (2, 0)] and all("reflow_split" in p["flags"] for p in parts)
    assert all(p["y1"] <= 220.0 + 1e-6 for p in parts) and " ".join(p["text"] for p in parts).split() == lines.split()


def test_figures_wait_for_room(spark):
    rows = [text("a", 1, "words " * 40, span="full"), figure("a", 2, "Figure 1: first", 100.0, 90.0), text("a", 3, "more words " * 6, span="full"), text("a", 4, "last words " * 60, span="full")]
    got = placed(spark, rows)
    first, caption = got["a", 2, "asset", 1], got["a", 2, "caption", 1]
    assert first["page"] == 2 and first["placement"] == "page_top" and first["y0"] == 28.0
    assert caption["page"] == 2 and caption["y0"] == pytest.approx(first["y1"] + 4 + 2)
    assert got["a", 3, "text", 1]["page"] == 1  # texts go on in front of a figure that waits


def test_a_figure_higher_than_a_page_is_scaled_and_its_caption_cut(spark):
    got = placed(spark, [figure("a", 1, "Caption of many words " * 60, 500.0, 900.0), figure("a", 2, None, 10.0, 10.0), figure("a", 3, None, 5.0, 5.0, "asset")])
    asset = got["a", 1, "asset", 1]
    assert "figure_group_scaled" in asset["flags"] and "figure_group_split" in asset["flags"]
    parts = [r for k, r in sorted(got.items()) if k[:3] == ("a", 1, "caption")]
    assert len(parts) > 1 and len({p["page"] for p in parts}) == len(parts) and " ".join(p["text"] for p in parts).split() == ("Caption of many words " * 60).split()
    assert got["a", 2, "asset", 1]["x1"] - got["a", 2, "asset", 1]["x0"] == 24.0 and got["a", 3, "asset", 1]["flags"] == ["reflow_asset"]


def test_boxes_never_cross(spark):
    draw = random.Random(3)
    rows = []
    for doc in "abcdef":
        for pos in range(40):
            kind = draw.random()
            if kind < 0.15:
                rows.append(figure(doc, pos, draw.choice([None, "A caption", "word " * 50]), draw.choice([50.0, 400.0]), draw.choice([30.0, 120.0, 500.0]), draw.choice(["figure", "asset"])))
            else:
                rows.append(text(doc, pos, "word " * draw.choice([1, 8, 60]), draw.choice(["paragraph", "paragraph", "heading", "reference"]), draw.choice(["column", "column", "full"])))
    for columns in (1, 2):
        got = placed(spark, rows, flow.Pages(**(SMALL.__dict__ | {"columns": columns})))
        assert {k[:2] for k in got} == {r[:2] for r in rows}
        by_page: dict = {}
        for r in got.values():
            by_page.setdefault((r["doc_id"], r["page"]), []).append(r)
        for some in by_page.values():
            for i, a in enumerate(some):
                for b in some[:i]:
                    assert a["x1"] <= b["x0"] + 1e-6 or b["x1"] <= a["x0"] + 1e-6 or a["y1"] <= b["y0"] + 1e-6 or b["y1"] <= a["y0"] + 1e-6


def test_plain_texts_are_placed_as_by_all_rules():
    """Texts that go in whole take a short way; it has to give what the long one gives, and leave the same cursors."""
    draw = random.Random(6)
    styles = [Style(10.0, 1.25, b, a, i) for b in (0.0, 3.0) for a in (0.0, 2.5) for i in (0.0, 2.0)]
    short = 0
    for columns in (1, 2):
        for _ in range(60):
            quick, slow = (flow._Flow(flow.Pages(**(SMALL.__dict__ | {"columns": columns}))) for _ in range(2))
            for pos in range(60):
                t = "word " * draw.choice([1, 3, 8, 60])
                item = {"pos": pos, "kind": draw.choice(["text"] * 8 + ["asset", "figure"]), "role": draw.choice(["paragraph"] * 6 + ["heading", "reference"]), "span": draw.choice(["column"] * 5 + ["full"]), "text": draw.choice([t.strip(), t.strip(), ""]), "style": draw.choice(styles), "measure": width_of, "width": 80.0, "height": draw.choice([20.0, 90.0])}
                item["units"] = width_of(item["text"])
                want = list(slow.place(item))
                row = quick.plain(*[item[k] for k in ("pos", "kind", "role", "span", "text", "style", "units")])
                short += bool(row)
                assert ([row] if row else list(quick.place(item))) == want
                assert (quick.y, quick.cols, quick.active, quick.page, quick.texts, quick.assets) == (slow.y, slow.cols, slow.active, slow.page, slow.texts, slow.assets)
            assert list(quick.finish()) == list(slow.finish())
    assert short > 1000


def test_pieces_of_a_long_line(spark, tmp_path):
    """Pieces were cut by their places, each counted from the beginning of the line."""
    from quire.cases import flowing

    text = "Ab 译文😀é  " * 40 + "end."
    spark.createDataFrame([(1, text), (2, "x"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = flowing.pieces(spark, str(tmp_path))
    got = [r["text"] for r in made.where("doc_id = 1").orderBy("pos").collect()]
    line = " ".join(text.split())
    assert got == [line[i : i + 20].strip(" ") for i in range(0, len(line), 20)]
    assert "substring" not in made._jdf.queryExecution().analyzed().toString()


def test_nothing(spark):
    assert flow.reflow(spark.createDataFrame([], ITEM)).collect() == []
    rows = spark.createDataFrame([("d", 0, None, 50.0, 20.0), ("d", 1, "a b", 0.0, 0.0)], "doc_id string, pos int, text string, width double, height double")
    assert sorted((r["pos"], r["fragment"], r["text"]) for r in paging.continuations(rows, 10.0, 1.25).collect())[0] == (0, 0, "")
