"""Text on pages: estimated heights, overflow, and splits at sentences, words or lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.fitting import SENTENCE_MARKS
from quire.functions.text import wrapped_lines

def text_height(text: Column, width: Column, font_size: Column, line_height: Column) -> Column:
    """GM06: the height in points that a text takes up."""
    return wrapped_lines(text, width, font_size) * font_size * line_height


def overflows(text: Column, box: Column, font_size: Column, line_height: Column) -> Column:
    """GM06: whether a text is higher than its box."""
    return text_height(text, box["x1"] - box["x0"], font_size, line_height) > box["y1"] - box["y0"]


def last_place(text: Column, mark: str) -> Column:
    """Where a mark stands last in a text, from 0; -1 if it doesn't."""
    at = F.instr(F.reverse(text), mark[::-1])
    return F.when(at > 0, F.length(text) - at - len(mark) + 1).otherwise(-1)


def split_place(text: Column, most: Column) -> Column:
    """ST25: how many characters of a text go first if at most `most` may: up to the last end of a sentence, clause or word that lies beyond 55 % of it, else `most`."""
    most = F.least(most, F.length(text))
    front = F.substring(text, F.lit(1), most)
    best = F.greatest(*[last_place(front, m) for m in SENTENCE_MARKS])
    char = F.substring(text, best + 1, F.lit(1))
    return F.when(best >= F.greatest(F.lit(1), F.floor(most * 0.55)), best + F.when(char.rlike(r"(?U)^\s$"), 0).otherwise(1)).otherwise(most).cast("int")


def continuations(rows: DataFrame, font_size: float, line_height: float) -> DataFrame:
    """Texts (`doc_id`, `pos`, `text`, `width`, `height`) cut into fragments that fit their box: `fragment` from 0, `text`. One that fits is one fragment.

    Lines are filled by glyph widths (ST24), and broken by the text's own line feeds. A cut moves back to the last blank or mark of BREAKS if that
    lies beyond 60 % of the fragment. What is over goes on in a box of the same size. Each row is cut by itself, by searches in running sums of its widths, in time linear in the text.
    """
    boxed = rows.select("doc_id", "pos", F.coalesce("text", F.lit("")).alias("text"), "width", "height")

    @F.pandas_udf("array<string>")
    def cut(texts, widths, heights):
        import pandas as pd

        from quire.functions.fitting import boxed_fragments

        return pd.Series([boxed_fragments(t, w, h, font_size, line_height) for t, w, h in zip(texts, widths, heights, strict=True)], dtype=object)

    return boxed.select("doc_id", "pos", F.posexplode(cut("text", "width", "height")).alias("fragment", "text"))
