"""Text of lines from spans: subscripts and superscripts by size and place, stacked fractions, and inline candidates by font and signs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.functions.fence import fenced

# Markers of fonts whose at and equals signs are partials and slashes, or whose zero is a prime; what a script can stand on; what tells mathematics.
SLASH_FONT, PRIME_FONT = "4C4E51", "4C4E74"
SCRIPTABLE = r"[A-Za-z0-9α-ωΑ-Ω)\]}'](?U)\s*$"
GEOMETRY = r"[∂@∇∫∑¼þ=/_^]|\b[fgqmn][sn]\b"
# Fractions that come apart into their lines, and what they are.
STACKED = (
    (r"(?U)(?:∂|@)\s*f(?:_?\{?s\}?)\s*(?:∂|@)\s*t\b", r"\\frac{∂f_s}{∂t}"),
    (r"(?U)\bq(?:_?\{?s\}?)\s+m(?:_?\{?s\}?)\b", r"\\frac{q_s}{m_s}"),
    (r"(?U)\bf'\s+s\s+k\^?\{?2\}?\b", r"\\frac{f'_s}{k^2}"),
)


def span_text(text: Column, font: Column) -> Column:
    """The text of a span, mended but not squeezed."""
    slashes = F.translate(text, "@=", "∂/")
    return t.repair_fragment(F.when(F.coalesce(font, F.lit("")).contains(SLASH_FONT), slashes).otherwise(F.coalesce(text, F.lit(""))))


def _put(acc: Column) -> Column:
    """The text so far with the open script, if there is one, at its end."""
    script = F.trim(acc["script"])
    mark = F.when(acc["kind"] == "super", "^").otherwise("_")
    suffix = F.when(acc["prime"] & (script == "0"), "'").when(script == "'", "'").when(script.startswith("{"), F.concat(mark, script)).otherwise(F.concat(mark, F.lit("{"), script, F.lit("}")))
    return F.when(acc["kind"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.when(script == "", acc["script"]).otherwise(suffix)))


def line_texts(spans: DataFrame, by: tuple[str, ...] = ("doc_id", "block_id", "line")) -> DataFrame:
    """ST17: a row per line (`by`): `text`, in which small spans (82 % of the largest or less) that stand off the middle of the large ones are scripts.

    `spans`: `n`, `text`, `font`, `size`, `box`. The middle is the upper median of the centres of spans of 90 % of the largest size and more; a span is a superscript or
    subscript if its centre is 16 % of that size (.9 at least) above or below. Neighbouring scripts of a kind are one; a script needs a letter, digit or closing bracket before it.
    A fold over the spans of a line, as what a span becomes depends on the text before it.
    """
    by = list(by)
    centre = (F.col("box.y0") + F.col("box.y1")) / 2
    rows = spans.select(*by, F.struct("n", span_text(F.col("text"), F.col("font")).alias("text"), F.coalesce("font", F.lit("")).alias("font"), F.col("size").cast("double").alias("size"), centre.alias("c"), (F.trim(F.coalesce("text", F.lit(""))) != "").alias("some")).alias("s"))
    lines = rows.groupBy(*by).agg(F.array_sort(F.collect_list("s")).alias("s"), F.coalesce(F.max(F.when(F.col("s.some"), F.col("s.size"))), F.lit(10.0)).alias("base"))
    main = F.sort_array(F.transform(F.filter("s", lambda x: x["some"] & (x["size"] >= F.col("base") * 0.9) & x["c"].isNotNull()), lambda x: x["c"]))
    lines = fenced(lines, ("main", F.when(F.size(main) > 0, F.element_at(main, F.floor(F.size(main) / 2).cast("int") + 1))))
    off = F.greatest(F.lit(0.9), F.col("base") * 0.16)

    def kind(x):
        small = F.col("main").isNotNull() & (x["size"] <= F.col("base") * 0.82)
        return F.when(F.coalesce(small & (x["c"] < F.col("main") - off), F.lit(False)), "super").when(F.coalesce(small & (x["c"] > F.col("main") + off), F.lit(False)), "sub").otherwise("")

    tokens = F.transform(F.filter("s", lambda x: x["text"] != ""), lambda x: F.struct(x["text"].alias("text"), kind(x).alias("kind"), x["font"].contains(PRIME_FONT).alias("prime")))
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("kind"), F.lit("").alias("script"), F.lit(False).alias("prime"))

    def step(acc, x):
        more = (acc["kind"] != "") & (x["kind"] == acc["kind"])
        done = _put(acc)
        begins = (x["kind"] != "") & (F.trim(x["text"]) != "") & done.rlike(SCRIPTABLE)
        return F.struct(
            F.when(more, acc["out"]).when(begins, done).otherwise(F.concat(done, x["text"])).alias("out"),
            F.when(more, acc["kind"]).when(begins, x["kind"]).otherwise("").alias("kind"),
            F.when(more, F.concat(acc["script"], x["text"])).when(begins, x["text"]).otherwise("").alias("script"),
            F.when(more, acc["prime"] | x["prime"]).when(begins, x["prime"]).otherwise(F.lit(False)).alias("prime"),
        )

    return lines.select(*by, F.aggregate(tokens, start, step, _put).alias("text"))


def stacked_fractions(text: Column, stacked: Column) -> Column:
    """ST18: fractions whose numerator and denominator stand one after the other, where the block's lines are stacked."""
    mended = text
    for pattern, fraction in STACKED:
        mended = F.regexp_replace(mended, pattern, fraction)
    return F.when(F.coalesce(stacked, F.lit(False)), mended).otherwise(text)


def block_texts(lines: DataFrame) -> DataFrame:
    """ST18: a row per block (`doc_id`, `block_id`) from its lines (`line`, `text`, `width`): `text`, the lines joined, with stacked fractions mended.

    Lines are stacked if there are two or more with text, signs of mathematics among them, and one of 42 points or eight characters at the most.
    """
    some = lines.where(F.trim("text") != "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.trim("text").alias("text")))), lambda x: x["text"]), " ")
    narrow = F.count_if((F.col("width") <= 42) | (F.length(F.trim("text")) <= 8))
    found = some.groupBy("doc_id", "block_id").agg(F.count(F.lit(1)).alias("_n"), narrow.alias("_narrow"), joined.alias("_text"))
    stacked = (F.col("_n") >= 2) & (F.col("_narrow") >= 1) & F.col("_text").rlike(GEOMETRY)
    return found.select("doc_id", "block_id", stacked_fractions(F.col("_text"), stacked).alias("text"), stacked.alias("stacked"))
