"""Formulas in text layers: candidates, LaTeX, acceptance, and their merge into documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import predicates as p
from quire.functions import text as t
from quire.functions.fence import fenced

# Fixed value: signs and commands of mathematics.
SIGNAL = (
    r"(?:[=≤≥∑∫√∞≈≠∂∇^_+\-*/]|\\(?:partial|nabla|frac|sum|int|sqrt|alpha|beta|gamma|delta|epsilon|varepsilon|zeta|eta|theta|lambda|mu|nu|xi|pi|rho|varrho|sigma|tau|"
    r"phi|varphi|chi|psi|omega|Delta|Omega|Gamma|Phi|Pi|Sigma|Theta|Lambda|Xi|Psi|le|leq|ge|geq|ne|neq|approx|sim|simeq|equiv|propto|infty|to|rightarrow|leftarrow|mapsto|"
    r"pm|mp|in|notin|subset|subseteq|supset|supseteq|cup|cap|cdot|times|div|mathbb|mathcal|mathrm|mathbf|operatorname|bar|dot|hat|vec|left|right)|"
    r"\b[A-Za-zα-ωΑ-Ω]\s*[+\-*/^_]\s*[A-Za-z0-9α-ωΑ-Ω])"
)
# What a formula inside prose looks like, by precedence, and the script that may follow it.
INLINE = (
    r"@[A-Za-z][A-Za-z0-9_]*\s*=\s*@?[A-Za-z][A-Za-z0-9_]*(?:\s*[+\-−*/·]\s*[A-Za-z0-9_@().,\[\]α-ωΑ-Ω∇]+)*",
    r"[A-Za-zα-ωΑ-Ω]\[[A-Za-z0-9_]+\](?:\s*(?:=|¼)\s*[−-]?[A-Za-z0-9α-ωΑ-Ω.\[\]_]+)+",
    r"\b[A-Za-zα-ωΑ-Ω][A-Za-z0-9_]*\s*=\s*(?:\([^)]{1,32}\)|[A-Za-z0-9α-ωΑ-Ω_{}+\-−*/^.,\[\]]+)(?:\s*[+\-−*/=]\s*(?:\([^)]{1,32}\)|[A-Za-z0-9α-ωΑ-Ω_{}+\-−*/^.,\[\]]+)){0,6}",
    r"(?:\\[A-Za-z]+|∫|∑|∇)[A-Za-z0-9α-ωΑ-Ω_{}()\[\]\s+\-−*/=.,\\]+",
)
SCRIPT = r"\s*(?:[_^]\s*(?:\{[^{}\n\r]{1,32}\}|\\?[A-Za-z0-9α-ωΑ-Ω+\-–−]+))[)\]]*"
#: AR01, ST16: each pattern with all the scripts and closing brackets after it.
INLINE_WHOLE = tuple(f"(?U)(?:{x})(?:{SCRIPT})*[)\\]]*" for x in INLINE)
# Links, labels and citations that are no formulas; the signs that are counted; noise words; what ends a formula's tail; relations before a full stop.
NO_FORMULA = r"(?U)@\S+\.\S+|\b(?:doi|http|https|Fig|Figure|Table|Section|Sec)\b"
CITATION = r"(?U)^\([A-Z][A-Za-z'’\-]+,?\s+\d{4}[a-z]?\)$"
SIGNS, INDEX = r"[=≤≥∂∇∫∑@^_]|\\[A-Za-z]+", r"\[[A-Za-z0-9_]+\]"
NOISE_WORDS = r"(?iU)\b(?:coll|dx|vn|n)\b(?=\s*[,:;)]|$)"
# Fixed value: what a formula's text has to have for its noise to be taken out: a control character, such a word, or white space other than single blanks.
NOISY = rf"(?iU)[\x00-\x1f]|{NOISE_WORDS.removeprefix('(?iU)')}|[\s&&[^ ]]|  "
TAIL = r"(?isU)\b(?:defined\s+as|equation|into\s+the|where|while|with|holds?|shown|represents?)\b.*"
RELATION_END = r"(?:=|≤|≥|<|>|≠|≈|\\(?:le|leq|ge|geq|ne|neq|approx|sim))\s*[A-Za-z0-9α-ωΑ-Ω]+[)\]}]*\.$"
EDGES = " \t\n\r,;。；"


def balanced(rows: DataFrame, column: str) -> DataFrame:
    """ST08: in `column`, dangling script signs off, surplus closing brackets off from the right, missing ones added.

    A column a step: a text with more closing brackets than opening ones, or fewer, is cut at the closing ones, and put together without the surplus ones.
    """
    rows = fenced(rows, (column, F.regexp_replace(column, r"\s*(?:[_^]\s*)+$", "")))
    for left, right in ("()", "[]", "{}"):
        without = lambda bracket: F.octet_length(F.replace(F.col(column), F.lit(bracket), F.lit("")))
        parts, opened = F.split(column, "\\" + right, -1), F.regexp_count(column, F.lit("\\" + left))
        kept = F.least(F.size(parts) - 1, opened)
        joined = F.concat(F.array_join(F.slice(parts, F.lit(1), kept + 1), right), F.array_join(F.slice(parts, kept + 2, F.size(parts)), ""), F.repeat(F.lit(right), F.greatest(opened - F.size(parts) + 1, F.lit(0))))
        rows = fenced(rows, (column, F.when(without(left) != without(right), joined).otherwise(F.col(column))))
    return rows


def trimmed(text: Column) -> Column:
    """Blanks, commas, semicolons and Chinese full stops off both ends."""
    return F.btrim(text, F.lit(EDGES))


def cut_steps(source: Column, to: str, raw: bool = False, fixed: Column | None = None) -> list[tuple[str, Column]]:
    """ST10: steps for fenced() that leave in `to` a formula's text up to the first word of prose or sentence mark, and in `to`_whole what it was cut from.

    `raw`: only squeezed first, not repaired; hyphens join words, and three long words in a row end a formula too. `fixed`: the repaired text, if it is at hand.
    """
    c, boundary = F.col(to), f"(?is){t.PROSE_BOUNDARY.removeprefix('(?i)')}"
    before, after = F.regexp_extract(c, "(?s)^([^,]*),", 1), F.regexp_extract(c, "(?s)^[^,]*,(.*)$", 1)
    noise = F.when(c.rlike(NOISY), t.squeeze(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f]+", " "), NOISE_WORDS, ""))).otherwise(F.trim(c))
    prose = F.regexp_replace(c, f"{boundary}.*", "")
    if raw:
        prose = F.regexp_replace(prose, f"(?s){t.THREE_LONG_WORDS}.*", "")
    stop = c.endswith(".") & (c.rlike(RELATION_END) | ~c.rlike(r"\d\.$"))
    return [
        (f"{to}_whole", F.regexp_replace(F.regexp_replace(source, rf"^[{EDGES}]+|[{EDGES}]+$", ""), r"(?U)\s+", " ") if raw else trimmed(t.repair(source) if fixed is None else fixed)),
        (to, t.join_hyphenated(F.col(f"{to}_whole")) if raw else F.col(f"{to}_whole")),
        (to, noise),
        (to, F.regexp_replace(prose, r"(?s)[。；;].*", "")),
        (to, trimmed(F.when(c.contains(",") & F.concat(F.lit(" "), F.trim(after)).rlike(boundary), before).otherwise(c))),
        (to, F.when(stop, F.rtrim(F.regexp_replace(c, r"\.$", ""))).otherwise(c)),
        (to, F.when(c.contains("."), F.regexp_replace(c, r"([A-Za-z]\d*)\.\d{1,3}$", "$1")).otherwise(c)),
        (to, F.rtrim(F.regexp_replace(trimmed(c), TAIL, ""), F.lit(EDGES))),
    ]


def math_signs(fixed: Column) -> Column:
    """PF07: how many relations, operators, scripts and indices a repaired text has."""
    return F.regexp_count(fixed, F.lit(SIGNS)) + F.when(fixed.contains("["), F.regexp_count(fixed, F.lit(INDEX))).otherwise(0)


def formula_steps(source: Column, to: str) -> list[tuple[str, Column]]:
    """PF07: steps for fenced() that tell in `to` whether a text looks like a formula and in `to`_display whether one that stands by itself; `to`_fixed is the repaired text, `to`_signs its signs."""
    n, signs, prose, noise = F.col(f"{to}_fixed"), F.col(f"{to}_signs"), F.col(f"{to}_prose"), F.col(f"{to}_noise")
    words = F.regexp_count(n, F.lit(r"(?<!\\)\b[A-Za-z]{4,}\b"))
    return [
        (f"{to}_fixed", t.repair(source)),
        (f"{to}_noise", p.noise(n, n)),
        (f"{to}_prose", p.prose(n, n)),
        (f"{to}_signs", math_signs(n)),
        (to, (F.length(n) >= 3) & (signs >= 1) & ~noise & ~(prose & (signs < 2)) & n.rlike("[A-Za-zα-ωΑ-Ω@∇∫∑]") & (words < 3) & ~n.rlike(CITATION) & ~n.rlike(NO_FORMULA)),
        (f"{to}_display", F.col(to) & (F.length(n) <= 260) & ~prose & (signs >= F.when(F.length(n) <= 24, 1).otherwise(2)) & ~n.rlike("[\u4e00-\u9fff]")),
    ]


def slash_glyphs(text: Column, source: Column | None = None) -> Column:
    """ST04: where a text layer (the text, or the source that it was made from) is corrupt, the equals signs that were slashes."""
    marked = (text if source is None else F.concat_ws(" ", source, text)).rlike("[\\x01-\\x04¼þðÞÐ\ufb00-\ufb04]|@[A-Za-z]")
    fixed = F.regexp_replace(text, r"@([A-Za-z][A-Za-z0-9_']*)\s*=\s*@([A-Za-z][A-Za-z0-9_']*)", "@$1 / @$2")
    fixed = F.regexp_replace(fixed, r"\b([fqmn]\s*0\s*[sn])\s*=\s*([A-Za-z][A-Za-z0-9_']{0,5})\b", "$1 / $2")
    fixed = F.regexp_replace(fixed, r"\b([a-z][a-z0-9_']{1,5})\s*=\s*([a-z][a-z0-9_']{1,5})\b", "$1 / $2")
    return F.when(text.contains("=") & marked, fixed).otherwise(text)


# What is left of an underbrace and its label, with ligatures as filler.
_FILLER = "(?:ffl|ffi|ff|fi|fl|[\\s\ufb00-\ufb04])"
UNDERBRACE = f"(?U)\\|\\s*{_FILLER}*\\{{\\s*z((?:ffl|ffi|ff|fi|fl|[\\s\ufb00-\ufb04A-Za-z0-9+\\-−])*)\\}}"
UNDERBRACE_RESTS = (r"(?U)\|\s*\{\s*z\s*[^}]*\}", r"(?U)\|\s*(?:ffl|ffi|ff|fi|fl|\s)+\{\s*z(?:\s*(?:ffl|ffi|ff|fi|fl))*\s*\}")


def underbraces(text: Column) -> Column:
    """ST03: what is left of an underbrace, as a subscript, or nothing where its label is only filler; squeezed if anything was mended."""
    label = lambda x: F.regexp_replace(t.expand_ligatures(x), r"(?U)(?:ffl|ffi|ff|fi|fl|\s)+", "")
    subscripts = F.transform(F.regexp_extract_all(text, F.lit(UNDERBRACE), F.lit(1)), lambda x: F.when(label(x) == "", "").otherwise(F.concat(F.lit("_{"), label(x), F.lit("}"))))
    between = F.split(text, UNDERBRACE, -1)
    joined = F.array_join(F.zip_with(between, subscripts, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    mended = reduce(lambda c, x: F.regexp_replace(c, x, ""), UNDERBRACE_RESTS, joined)
    return F.when(text.contains("|") & text.contains("{") & (mended != text), t.squeeze(mended)).otherwise(text)


# Integrals and the reals whose glyphs fell apart, in order.
FALLEN_APART = (
    (r"(?U)\bZ\s+I\s*R[_^]\{?([A-Za-z0-9+\-/]+)\}?", r"\\int_{\\mathbb{R}^{$1}}"),
    (r"(?U)\bZ\s+I\s*R", r"\\int_{\\mathbb{R}}"),
    (r"(?U)\bI\s*R\s*[\^_]\s*\{?([A-Za-z0-9+\-/]+)\}?", r"\\mathbb{R}^{$1}"),
    (r"(?U)\bI\s*R", r"\\mathbb{R}"),
    (r"(?U)\bZ\s+(?=(?:\\?[A-Za-zα-ωΑ-Ω])[^=]{0,64}(?:\(|d[A-Za-z]|\\,d))", r"\\int "),
)


def real_spaces(text: Column) -> Column:
    """ST05: integrals, also over the reals, and powers of the reals whose glyphs fell apart."""
    return F.when(text.contains("Z") | text.contains("I"), reduce(lambda c, r: F.regexp_replace(c, *r), FALLEN_APART, text)).otherwise(text)


def with_latex(rows: DataFrame, source: str, latex: str = "latex", flags: str = "flags") -> DataFrame:
    """ST09: adds the LaTeX of a text layer's formula ('' if there is none) and flags that say what was done.

    A column a step, so that each is computed once and none grows by the others.
    """
    made = latex, flags
    rows = rows.withColumn("_raw", F.coalesce(source, F.lit("")))
    raw = F.col("_raw")
    steps = (
        ("_ligatures", t.expand_ligatures(raw)),
        ("_braces", underbraces(F.col("_ligatures"))),
        ("_slashes", slash_glyphs(F.col("_braces"), raw)),
        ("_fixed", t.repair(F.col("_slashes"))),
        *cut_steps(F.col("_slashes"), "_cut", fixed=F.col("_fixed")),
        ("_empty", (F.col("_cut") == "") | p.noise(F.col("_cut"), F.col("_cut"))),
        ("_number", t.equation_number(F.col("_cut"))),
        ("_bare", F.when(F.col("_number") != "", F.regexp_replace("_cut", r"[,;:]?\s*\([A-Za-z]?\d+(?:[.\-]\d+)*[a-z]?\)\s*$", "")).otherwise(F.col("_cut"))),
        ("_spaces", real_spaces(F.col("_bare"))),
        *t.symbol_steps(F.col("_spaces"), "_named"),
        ("_named", F.when(F.col("_named").contains("@"), F.regexp_replace("_named", r"@([A-Za-z][A-Za-z0-9_]*)", r"\\partial $1")).otherwise(F.col("_named"))),
        ("_named", F.regexp_replace(F.regexp_replace("_named", r"\b([A-Za-z])\s+([0-9])\b", "$1$2"), r"\b([0-9])\s+([A-Za-z])\b", "$1$2")),
        ("_partial", t.compact_partials(F.col("_named"))),
        ("_waves", t.wave_names(F.col("_partial"))),
        ("_closed", t.squeeze(F.col("_waves"))),
    )
    rows = fenced(rows, *steps)
    rows = balanced(rows, "_closed")
    tagged = F.concat("_closed", F.lit(" \\tag{"), F.regexp_replace("_number", "[()]", ""), F.lit("}"))
    some = ~F.col("_empty")
    rules = (
        ("formula_latex_normalized", F.col("_fixed") != raw),
        ("formula_pdf_ligature_repaired", F.col("_ligatures") != raw),
        ("formula_underbrace_artifact_repaired", F.col("_braces") != F.col("_ligatures")),
        ("formula_slash_glyph_repaired", F.col("_slashes") != F.col("_braces")),
        ("formula_text_truncated", F.col("_cut") != F.col("_cut_whole")),
        ("formula_equation_number_preserved", some & (F.col("_number") != "")),
        ("formula_pdf_math_degradation_repaired", some & (F.col("_spaces") != F.col("_bare"))),
        ("formula_compact_partial_repaired", some & (F.col("_partial") != F.col("_named"))),
        ("formula_compact_variable_repaired", some & (F.col("_waves") != F.col("_partial"))),
        ("formula_low_confidence", F.col("_empty")),
    )
    told = [F.when(c, F.lit(n)) for n, c in rules]
    found = F.array_distinct(F.concat(F.array_compact(F.array(told[0])), t.corruption_flags(raw), F.array_compact(F.array(*told[1:]))))
    value = F.when(F.col("_empty"), "").when(F.col("_number") != "", tagged).otherwise(F.col("_closed"))
    return rows.withColumns({made[0]: value, made[1]: found}).drop("_raw", *[n for n, _ in steps])


def with_acceptance(rows: DataFrame, latex: str, source: str, mode: str, name: str = "verdict") -> DataFrame:
    """ST31: adds a struct of `status`, `accepted`, `level`, `fallback` and `signals` for a formula's LaTeX.

    The rules in order: empty, corrupt (for display formulas), prose, too few signs; an external renderer is taken as absent and so finds no error.
    """
    n = F.col("_n")
    corrupt = t.corruption_flags(F.when(F.coalesce(source, F.lit("")) != "", F.col(source)).otherwise(F.col(latex)), n)
    rows = fenced(rows, ("_n", t.repair(F.col(latex))), ("_signals", F.regexp_count(n, F.lit(SIGNAL))), ("_words", F.regexp_count(n, F.lit("[A-Za-z]{3,}"))), ("_corrupt", corrupt), ("_prose", p.prose(n, n)))
    signals, words, flags = F.col("_signals"), F.col("_words"), F.col("_corrupt")
    unrepaired = n.rlike(r"[A-Za-z]_?[A-Za-z]\s*=\s*k(?:\^?\d|\{\d\})|[A-Za-z]\s*0\s*[A-Za-z]")
    structured = n.rlike(r"\\(?:frac|dfrac|tfrac|sum|int|partial|nabla|sqrt)\b|\\begin\{")
    has = lambda *names: F.arrays_overlap(flags, F.array(*[F.lit(f"formula_{x}") for x in names]))
    severe = (has("text_layer_corrupt", "slash_glyph_suspect", "prime_glyph_suspect") & unrepaired) | (has("text_layer_corrupt", "prime_glyph_suspect") & ~structured)
    like_prose = (F.col("_prose") & (words >= 2)) | ((words >= 4) & n.rlike(r"[,.;]\s+[A-Za-z]{3,}")) | ((F.length(n) > 80) & (words >= 6) & (signals < 3)) | ((words >= 10) & (signals <= F.greatest(F.lit(1), F.floor(words / 8))))
    relation = (F.length(n) <= 64) & n.rlike(r"[A-Za-z0-9α-ωΑ-Ω\\})]\s*(?:=|≤|≥|≠|≈|\\(?:le|leq|ge|geq|ne|neq|approx|sim))\s*[A-Za-z0-9α-ωΑ-Ω\\{(]")
    least = F.when(relation | (F.length(n) <= 24), 1).otherwise(2)
    rows = fenced(rows, ("_status", F.when(n == "", "empty").when((F.col(mode) == "display") & severe, "corrupt_text_layer").when(like_prose, "prose_like").when(signals < least, "not_math").otherwise("accepted")))
    status = F.col("_status")
    tagged = n.rlike(r"\\tag\{\d+(?:\.\d+)*\}$")
    low = (F.length(n) <= 8) | ((signals <= 1) & (F.regexp_count(n, F.lit("[A-Za-z]{1,2}")) >= 4)) | (~tagged & (F.regexp_count(n, F.lit("=")) >= 3) & (signals < 3)) | (F.size(flags) > 0)
    level = F.when(status != "accepted", "fallback_required").when(low, "accepted_low_confidence").otherwise("accepted_structured")
    fallback = F.when(status == "corrupt_text_layer", "formula_asset_image").when(status != "accepted", "source_text_plaintext")
    verdict = F.struct(status.alias("status"), (status == "accepted").alias("accepted"), level.alias("level"), fallback.alias("fallback"), signals.alias("signals"))
    return fenced(rows, (name, verdict)).drop("_n", "_signals", "_words", "_corrupt", "_prose", "_status")


def inline_false_positive(text: Column) -> Column:
    """PF08: part numbers, hyphenated words and the like."""
    s = F.regexp_replace(F.regexp_replace(text, r"^[\s,.;:()\[\]{}]+", ""), r"[\s,.;:()\[\]{}]+$", "")
    return s.rlike(r"^[A-Za-z]{1,3}-\d{3,}$") | s.rlike(r"^[A-Za-z]{1,2}-[A-Za-z]{3,}$") | s.rlike(r"^[A-Za-z]{3,}-[A-Za-z]{2,}$") | s.rlike(r"^(?:∞|\\infty)\s*[A-Za-z]{3,}$") | s.rlike(r"^[A-Za-z]{2,}\s*(?:-|−)\s*[A-Za-z0-9]{2,}$")


def inline_formula(text: Column, fixed: Column | None = None) -> Column:
    """PF08: a short text that is a formula inside prose. `fixed`: the repaired text, if it is at hand."""
    n = t.repair(text) if fixed is None else fixed
    return ~p.noise(text, n) & F.length(n).between(2, 48) & ~inline_false_positive(n) & ~n.rlike(r"(?i)@\S+\.\S+|\b(?:doi|https?)\b") & ~p.prose(text, n) & ~n.rlike("^[A-Za-z]{2,}$") & (n.rlike(SIGNAL) | n.rlike(r"[A-Za-zα-ωΑ-Ω][\^_][A-Za-z0-9{]"))


def inline_candidates(blocks: DataFrame) -> DataFrame:
    """AR01: candidates inside blocks (`doc_id`, `pos`, `text`): `n` from 1, `source_text`, `start` (0-based), `end`.

    The patterns are tried in order, each from left to right; a match takes the scripts and brackets after it (ST16), is cut where prose
    begins (ST10), and has to look like a formula (PF07). Of overlapping ones the first found stays.
    """
    return _candidates(blocks.select("doc_id", "pos", "text", F.lit(None).cast("string").alias("_display"))).drop("mode")


def _candidates(blocks: DataFrame) -> DataFrame:
    """Candidates of blocks, with `mode`: one for the whole block where `_display`, its repaired text, isn't null (`n` is 0), else those inside it. Both in one pass, so that no block is judged twice."""
    place = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<k:int,s:int,t:string>>").alias("out"))

    def located(k, pattern):
        def one(acc, m):
            s = F.call_function("locate", m, F.col("text"), acc["at"] + 1) - 1
            return F.struct((s + F.length(m)).alias("at"), F.concat(acc["out"], F.array(F.struct(F.lit(k).alias("k"), s.alias("s"), m.alias("t")))).alias("out"))

        return F.aggregate(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), place, one, lambda a: a["out"])

    whole = F.array(F.struct(F.lit(-1).alias("k"), F.lit(0).alias("s"), F.lit(None).cast("string").alias("t")))
    each = F.when(F.col("_display").isNotNull(), whole).when(F.col("text").rlike(r"[=¼∫∑∇]|\\[A-Za-z]"), F.concat(*[located(k, x) for k, x in enumerate(INLINE_WHOLE)]))
    found = blocks.select("doc_id", "pos", "_display", F.length("text").alias("_long"), F.explode(each).alias("x"))
    found = fenced(found.select("doc_id", "pos", "_display", "_long", "x.*"), *cut_steps(F.col("t"), "_c", raw=True), *formula_steps(F.col("_c"), "_f"))
    here = F.greatest(F.call_function("locate", F.col("_c"), F.col("t")) - 1, F.lit(0))
    inside = F.struct("k", "s", (F.col("s") + here).alias("start"), (F.col("s") + here + F.length("_c")).alias("end"), F.col("_c").alias("text"))
    alone = F.struct("k", "s", F.lit(0).alias("start"), F.col("_long").alias("end"), F.col("_display").alias("text"))
    kept = found.where((F.col("k") < 0) | F.col("_f")).select("doc_id", "pos", F.when(F.col("k") < 0, alone).otherwise(inside).alias("m"))
    taken = F.array().cast("array<struct<k:int,s:int,start:int,end:int,text:string>>")
    free = lambda acc, m: F.when(F.exists(acc, lambda c: (m["start"] < c["end"]) & (m["end"] > c["start"])), acc).otherwise(F.concat(acc, F.array(m)))
    told = lambda m, n, mode: F.struct(n.alias("n"), m["text"].alias("source_text"), m["start"].alias("start"), m["end"].alias("end"), F.lit(mode).alias("mode"))
    chosen = F.aggregate(F.array_sort(F.filter("ms", lambda m: m["k"] >= 0)), taken, free)
    ordered = F.array_sort(F.transform(chosen, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"))))
    both = F.concat(F.transform(F.filter("ms", lambda m: m["k"] < 0), lambda m: told(m, F.lit(0), "display")), F.transform(ordered, lambda m, i: told(m, i + 1, "inline")))
    return kept.groupBy("doc_id", "pos").agg(F.collect_list("m").alias("ms")).select("doc_id", "pos", F.explode(both).alias("m")).select("doc_id", "pos", "m.*")


def detect(blocks: DataFrame) -> DataFrame:
    """Display candidates (whole blocks) and inline ones, one per place, in document order, with ids: `formula_id`, `mode`.

    A block that is a formula by itself, by its role and without prose or by its look, gives one display candidate and no inline ones; noise gives none.
    """
    told = fenced(blocks, *formula_steps(F.col("text"), "_f")).where(~F.col("_f_noise") & (F.col("_f_fixed") != ""))
    whole = ((F.col("role") == "formula") & ~F.col("_f_prose")) | F.col("_f_display")
    both = _candidates(told.where(whole.isNotNull()).select("doc_id", "pos", "text", F.when(whole, F.col("_f_fixed")).alias("_display")))
    fid = F.concat(F.lit("f"), F.substring(F.sha1(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("pos").cast("string"), F.col("n").cast("string"), "source_text").cast("binary")), 1, 12))
    return both.withColumn("formula_id", fid)


def recognise(candidates: DataFrame, providers: list | None = None) -> DataFrame:
    """Candidates with `latex`, `flags`, `confidence`, `status`, `accepted`, `provider`.

    Without providers: the text path, .96 if accepted without corruption, at most .58 with it, 0 if refused.
    `providers`: functions from a source-text column to a struct of `latex` and `confidence`; the first accepted answer counts,
    else the text path.
    """
    base = with_latex(candidates, "source_text", "_t_latex", "flags").withColumn("_a_text", F.struct(F.col("_t_latex").alias("latex"), F.lit(None).cast("double").alias("confidence")))
    names = []
    for i, provider in enumerate(providers or []):
        names.append(f"provider{i}")
        base = base.withColumn(f"_a_provider{i}", provider(F.col("source_text")))
    names.append("text")
    for n in names:
        base = with_acceptance(base.withColumn("_l", F.col(f"_a_{n}.latex")), "_l", "source_text", "mode", f"_v_{n}")
    pick = reduce(lambda c, n: c.when(F.col(f"_v_{n}.accepted"), n), names[1:], F.when(F.col(f"_v_{names[0]}.accepted"), names[0])).otherwise("text")
    base = base.withColumn("provider", pick)
    of = lambda kind, field: F.coalesce(*[F.when(F.col("provider") == n, F.col(f"_{kind}_{n}.{field}")) for n in names])
    corrupt = F.exists("flags", lambda f: f.contains("corrupt") | f.contains("suspect"))
    own = F.when(~of("v", "accepted"), 0.0).when(corrupt, 0.58).otherwise(0.96)
    return base.select(*candidates.columns, of("a", "latex").alias("latex"), "flags", F.coalesce(of("a", "confidence"), own).alias("confidence"), of("v", "status").alias("status"), of("v", "accepted").alias("accepted"), "provider")


def with_refs(blocks: DataFrame, formulas: DataFrame) -> DataFrame:
    """AR01, J21: block texts with accepted formulas replaced by references, from right to left so that places stay right."""
    ref = F.concat(F.lit("{{formula:"), "formula_id", F.lit("}}"))
    cuts = formulas.where("accepted").groupBy("doc_id", "pos").agg(F.sort_array(F.collect_list(F.struct("start", "end", ref.alias("ref"))), asc=False).alias("cuts"))
    put = F.aggregate("cuts", F.col("text"), lambda text, c: F.overlay(text, c["ref"], c["start"] + 1, c["end"] - c["start"]))
    return blocks.join(cuts, ["doc_id", "pos"], "left").withColumn("text_with_refs", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(put)).drop("cuts")


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """J21, SL07: formulas by id: the newest row at the place of the first; ids only in one side stay."""
    both = old.withColumn("_round", F.lit(0)).unionByName(new.withColumn("_round", F.lit(1)))
    key = W.partitionBy("doc_id", "formula_id").orderBy(F.desc("_round"), F.desc("pos"), F.desc("n"))
    return both.withColumn("_k", F.row_number().over(key)).where("_k = 1").drop("_k", "_round")


def summary(formulas: DataFrame) -> DataFrame:
    """AG02: per document counts by mode and acceptance, and the ids of low confidence (below .65), sorted."""
    return formulas.groupBy("doc_id").agg(
        F.count_if(F.col("mode") == "inline").alias("n_inline"),
        F.count_if(F.col("mode") == "display").alias("n_display"),
        F.count_if("accepted").alias("n_accepted"),
        F.count_if(~F.col("accepted")).alias("n_fallback"),
        F.sort_array(F.collect_list(F.when(F.col("confidence") < 0.65, F.col("formula_id")))).alias("low_confidence"),
    )


def numbered(formulas: DataFrame) -> DataFrame:
    """Display formulas get numbers in order; one with its own number keeps it and the count goes on from the larger.

    Two running windows per document: k, the count of formulas without a number so far, and the greatest of 0 and (own number - k) so far; both together are the running number.
    """
    own = F.regexp_extract("source_text", r"\((\d+)\)\s*$", 1).try_cast("int")
    so_far = W.partitionBy("doc_id").orderBy("pos", "n", "formula_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = formulas.where("mode = 'display'").select("doc_id", "pos", "n", "formula_id", own.alias("_own"))
    rows = rows.withColumn("_k", F.count_if(F.col("_own").isNull()).over(so_far))
    ahead = F.greatest(F.lit(0), F.coalesce(F.max(F.col("_own") - F.col("_k")).over(so_far), F.lit(0)))
    return rows.select("doc_id", "formula_id", F.coalesce("_own", F.col("_k") + ahead).cast("int").alias("number"))


def raw_tex(texts: DataFrame) -> DataFrame:
    """J29, ST28: TeX that stands bare in a text (`doc_id`, `pos`, `text`): delimited by dollars or brackets."""
    pattern = r"\$\$[^$]+\$\$|\$[^$\n]+\$|\\\([^)]*\\\)|\\\[[^\]]*\\\]"
    return texts.select("doc_id", "pos", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("n", "tex"))


# Limits of blocks that may be parts of one formula, what may stand between their letters and digits, and roles that are never such parts.
CLUSTER_LENGTH, CLUSTER_WORDS, CLUSTER_HEIGHT = 96, 3, (7.0, 72.0)
NO_CLUSTER = ("title", "heading", "footnote", "reference")


def cluster_steps(text: Column, role: Column, height: Column, formula_id: Column, independent: Column, to: str) -> list[tuple[str, Column]]:
    """PF10: steps for fenced() that tell in `to` whether a block may be a part of a formula that is spread over blocks.

    It has a fitting role, height and length, is no reference to a formula of its own (`independent`), and has a formula's id, is a reference, or looks like a formula
    with three words of three letters at the most.
    """
    stripped = F.trim(text)
    bare = t.squeeze(F.regexp_replace(t.repair(stripped), t.FORMULA_REF, " "))
    words = F.regexp_count(F.col(f"{to}_bare"), F.lit(r"(?<!\\)\b[A-Za-z]{3,}\b"))
    prose_words = F.regexp_count(t.repair(stripped), F.lit(r"(?<!\\)\b[A-Za-z]{3,}\b"))
    compact = F.replace(F.col(f"{to}_bare"), F.lit(" "), F.lit(""))
    joined = compact.rlike(r"(?U)^[\p{L}\p{N}=+\-−×·()\[\]{}/*^_.,']+$") & compact.rlike(r"[=+\-−×·()\[\]{}]")
    like = (F.length(stripped) <= CLUSTER_LENGTH) & ~(p.prose(stripped) & (prose_words > CLUSTER_WORDS)) & ((F.col(f"{to}_bare") == "") | ((words <= CLUSTER_WORDS) & (F.col(f"{to}_like") | joined)))
    fits = ~role.isin(*NO_CLUSTER) & (stripped != "") & height.between(*CLUSTER_HEIGHT) & (F.length(stripped) <= CLUSTER_LENGTH) & ~independent
    return [(f"{to}_bare", bare), *formula_steps(F.col(f"{to}_bare"), f"{to}_like"), (to, fits & (formula_id.isNotNull() | stripped.rlike(f"^{t.FORMULA_REF}$") | like))]
