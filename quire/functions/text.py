"""Text repair and extraction as column expressions.

White space means Unicode white space, as `(?U)` makes it for Spark's regular expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Replacements that undo what PDF text layers do to symbols, applied in this order.
PDF_REPLACEMENTS = {
    "\x01": " × ",
    "\x03": "-",
    "\x04": " · ",
    "¼": "=",
    "þ": "+",
    "ð": "∫",
    "\u00ad": "",
    "\uf0b7": " · ",
    "Ð": "∫",
    "Þ": "∂",
    "ℏ": r" \hbar ",
    "ℝ": r" \mathbb{R} ",
}
# Ligatures.
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl"}
# Accents that stand before or after a letter, as patterns in order of application.
ACCENTS = (
    (r"(?U)\b([A-Za-z])\u0304", r" \\bar{$1} "),
    (r"(?U)¯\s*([A-Za-z])\b", r" \\bar{$1} "),
    (r"(?U)\b([A-Za-z])\s*¯", r" \\bar{$1} "),
    (r"(?U)\u02d9\s*([A-Za-z])\b", r" \\dot{$1} "),
    (r"(?U)\b([A-Za-z])\u0307", r" \\dot{$1} "),
)
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
# Fixed value: what repair() changes: a character that it replaces, an accent, a control character, or white space other than single blanks.
REPAIRED = "(?U)[\\x00-\\x1f\u0304\u0307¯\u02d9" + "".join(x for x in PDF_REPLACEMENTS if x > " ") + "[\\s&&[^ ]]]|  "
# Greek letters and symbols as LaTeX commands.
GREEK = {
    "α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "δ": r"\delta", "ε": r"\epsilon", "ϵ": r"\epsilon", "η": r"\eta", "ζ": r"\zeta",
    "θ": r"\theta", "κ": r"\kappa", "λ": r"\lambda", "μ": r"\mu", "ν": r"\nu", "ξ": r"\xi", "π": r"\pi", "ρ": r"\rho", "σ": r"\sigma",
    "τ": r"\tau", "φ": r"\phi", "ψ": r"\psi", "χ": r"\chi", "ω": r"\omega", "ϕ": r"\varphi", "ϱ": r"\varrho", "Ω": r"\Omega",
    "Δ": r"\Delta", "Γ": r"\Gamma", "Θ": r"\Theta", "Λ": r"\Lambda", "Ξ": r"\Xi", "Π": r"\Pi", "Ψ": r"\Psi", "Σ": r"\Sigma", "Φ": r"\Phi",
}
SYMBOLS = {
    "≤": r"\le", "≥": r"\ge", "≠": r"\ne", "≈": r"\approx", "∑": r"\sum", "∫": r"\int", "√": r"\sqrt{}", "∞": r"\infty", "∂": r"\partial",
    "∇": r"\nabla", "→": r"\to", "↦": r"\mapsto", "←": r"\leftarrow", "±": r"\pm", "∓": r"\mp", "∈": r"\in", "∉": r"\notin", "⊂": r"\subset",
    "⊆": r"\subseteq", "△": r"\Delta", "∆": r"\Delta", "×": r"\times", "÷": r"\div", "·": r"\cdot", "−": "-",
}
# Fixed value: words that end a formula and begin prose.
PROSE_BOUNDARY = (
    r"(?i)\s+(?:and|are|as|defined\s+as|due\s+to|equation|for|from|holds?|in|into\s+the|is|notably|preventing|ratio\s+of|represents?|"
    r"resulting|scaled|shown|the|then|thus|to|unlike|where|which|while|with)\b"
)
LONG_WORDS = r"\b[A-Za-z]{4,}\b(?:[\s,-]+\b[A-Za-z]{4,}\b){2,}"
# Fixed value: the first three of those words, which tell as much: Java's open-ended group recurses once a word and overflows its stack on long lines.
THREE_LONG_WORDS = LONG_WORDS.replace("{2,}", "{2}")
# References to formulas, well-formed, with a brace lost, and of the old kind.
FORMULA_REF = r"\{\{formula:([A-Za-z0-9_.:-]+)\}\}"
BROKEN_REF = r"(?<!\{)\{formula:([A-Za-z0-9_.:-]+)\}\}"
OLD_REF = r"@@FORMULA_[A-Za-z0-9_]+@@"
# Fixed value: tokens that a translation must keep: references, citations, labels, formulas.
TOKEN = (
    r"(\{\{formula:[A-Za-z0-9_.:-]+\}\}|\[[0-9,\-\s;]+\]|"
    r"\([A-Z][A-Za-z'’\-]+(?:\s+(?:and|&)\s+[A-Z][A-Za-z'’\-]+|\s+et al\.?)?,?\s+\d{4}[a-z]?\)|"
    r"\b[A-Z][A-Za-z'’\-]+(?:\s+(?:and|&)\s+[A-Z][A-Za-z'’\-]+|\s+et al\.?)?,?\s+\d{4}[a-z]?\b|"
    r"\b[A-Z][A-Za-z'’\-]+\s+et al\.?,?\s+\(\d{4}[a-z]?\)|\b[A-Z][A-Za-z'’\-]+\s+\(\d{4}[a-z]?\)|"
    r"\b(?:Eq|Equation|Fig|Figure|Table|Sec|Section|Appendix)\.?\s*[A-Z]?\d+(?:[.\-][A-Za-z0-9]+)*|"
    r"\([A-Za-z0-9+\-*/=<>≤≥∑∫^_.,\s]+\)|\b[A-Za-z][A-Za-z0-9_]*\s*=\s*[A-Za-z0-9+\-*/^_().]+)"
)


# Dollar signs at the ends of a text; thoughts, tokens and keys in diagnostics; words split by a hyphen; numbers of equations; partials and names that run together, and what they are.
MATH_MARKS = (r"^\$\$?", r"\$\$?$")
THOUGHTS, BEARER, SECRET_KEY = r"(?is)<think\b[^>]*>.*?</think>", r"(?i)bearer\s+[A-Za-z0-9._\-]+", r"\bsk-[A-Za-z0-9_\-]{6,}"
HYPHENATED = r"\b([A-Za-z]{2,})-\s+([A-Za-z]{2,})\b"
EQUATION_NUMBER = r"(?:[,;:]\s*)?(\([A-Za-z]?\d+(?:[.\-]\d+)*[a-z]?\))\s*$"
COMPACT_PARTIAL = (r"\\partial\s+([txyz])([A-Za-z])\b", r"\\partial_{$1} $2")
WAVE_NAMES = ((r"\b([fqmn])\s*0\s*([sn])\b", "$1'_$2"), (r"\b([fqmn])([sn])\b", "$1_$2"), (r"\bk([0-9])\b", "k^$1"))
# Fixed value: a text without this has none of those names, before or after the others are mended.
ANY_WAVE_NAME = r"[fqmn]\s*0?\s*[sn]|k[0-9]"
# Signs of a corrupt text layer, ligatures, slashes and primes that were read wrong, and such names left in LaTeX.
CORRUPT, LIGATURE, PRIMES = "[\\x01-\\x04¼þðÞÐ\ufb00-\ufb04]|@[A-Za-z]", "[\ufb00-\ufb04]", r"\b[fqmn]\s*0\s*[sn]\b"
SLASHES = (r"@[A-Za-z][A-Za-z0-9_']*\s*=\s*@[A-Za-z][A-Za-z0-9_']*", r"\b[a-z][a-z0-9_']{1,5}\s*=\s*[a-z][a-z0-9_']{1,5}\b")
UNREPAIRED = r"\\partial\s+[A-Za-z]{2,}\s*=\s*\\partial|\b[fqmn]\s*0\s*[sn]\b|\b[fqmn]_?[sn]\s*=\s*k(?:\^?\d|\{\d\})\b"
# What tells a token's kind: formulas, then markers of references; all else are citations.
FORMULA_TOKEN, MARKER_TOKEN = (r"^\{\{formula:", r"[=<>≤≥∑∫^]"), (r"^\[[0-9,\-\s;]+\]$", r"(?i)^(?:Fig|Figure|Table|Eq|Equation|Sec|Section|Appendix)\b")


# Fixed value: characters of which every token has one, by which texts without tokens are told at once.
IN_TOKENS = r"[{\[(=0-9]"


#: White space that isn't one space already: squeezed texts have no match, where "a run" would be one at each word.
BLANKS = r"(?U) \s+|[^\S ]\s*"


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def replace_all(text: Column, table: dict[str, str]) -> Column:
    """Literal replacements, in order."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), table.items(), text)


def repair_fragment(text: Column) -> Column:
    """ST01 without the squeeze: symbols, accents, and control characters to spaces."""
    single = {k: v for k, v in PDF_REPLACEMENTS.items() if len(v) == 1}
    gone = "".join(k for k, v in PDF_REPLACEMENTS.items() if not v)
    text = F.translate(text, "".join(single) + gone, "".join(single.values()))
    text = replace_all(text, {k: v for k, v in PDF_REPLACEMENTS.items() if len(v) > 1})
    text = reduce(lambda c, a: F.regexp_replace(c, *a), ACCENTS, text)
    return F.regexp_replace(text, CONTROL, " ")


def repair(text: Column) -> Column:
    """ST01: text of a PDF layer repaired and squeezed. One search tells whether there is anything to repair or to squeeze."""
    return F.trim(F.when(text.rlike(REPAIRED), F.regexp_replace(repair_fragment(text), r"(?U)\s+", " ")).otherwise(text))


def expand_ligatures(text: Column) -> Column:
    """ST02: ligatures as letters."""
    return replace_all(text, LIGATURES)


def strip(text: Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def compact(text: Column, limit: int, squeezed: bool = False) -> Column:
    """ST19: squeezed (unless it is), and cut to limit - 1 characters and an ellipsis if longer."""
    text = text if squeezed else squeeze(text)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, limit - 1), r"(?U)\s+$", ""), F.lit("…")))


def repair_refs(text: Column) -> Column:
    """ST15: formula references that lost their first brace, whole again."""
    return F.regexp_replace(text, BROKEN_REF, "{{formula:$1}}")


def broken_refs(text: Column) -> Column:
    """ST15: how many references repair_refs() mends."""
    return F.regexp_count(text, F.lit(BROKEN_REF))


def formula_refs(text: Column) -> Column:
    """SO04: distinct ids of the formulas referred to, in order; null: none."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(text, F.lit(FORMULA_REF), F.lit(1))), F.array().cast("array<string>"))


def formula_tokens(text: Column) -> Column:
    """SO04: all whole references, repeats included, in order."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(FORMULA_REF), F.lit(0)), F.array().cast("array<string>"))


def preserve_tokens(text: Column) -> Column:
    """SL01: the distinct tokens to keep, by where they first stand in the text; ties: the longer first, then by text."""
    matches = F.when(text.rlike(IN_TOKENS), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))
    found = F.array_distinct(F.transform(matches, lambda t: F.trim(t)))
    order = F.array_sort(F.transform(found, lambda t: F.struct(F.instr(text, t).alias("at"), (-F.length(t)).alias("n"), t.alias("t"))))
    return F.coalesce(F.transform(order, lambda s: s["t"]), F.array().cast("array<string>"))


def remove_tokens(text: Column, tokens: Column) -> Column:
    """ST20: tokens, formula references and numeric citations as spaces, squeezed inside."""
    left = F.aggregate(tokens, text, lambda acc, t: F.replace(acc, t, F.lit(" ")))
    left = F.regexp_replace(F.regexp_replace(left, FORMULA_REF, " "), r"\[[0-9,\-\s;]+\]", " ")
    return F.regexp_replace(left, BLANKS, " ")


def words_of(text: Column, least: int = 3, skip_commands: bool = True) -> Column:
    """ST13: runs of `least` or more letters; with `skip_commands`, not those after a backslash."""
    before = r"(?<!\\)" if skip_commands else ""
    return F.regexp_extract_all(repair(text), F.lit(rf"{before}\b[A-Za-z]{{{least},}}\b"), F.lit(0))


def strip_tags(text: Column) -> Column:
    """ST23: tags as spaces, squeezed; only tags go, so the text of scripts and styles stays."""
    return squeeze(F.regexp_replace(text, "<[^>]+>", " "))


def strip_math_marks(text: Column) -> Column:
    """ST23: dollar signs around a text removed."""
    return F.trim(reduce(lambda c, mark: F.regexp_replace(c, mark, ""), MATH_MARKS, F.trim(text)))


def redact(text: Column) -> Column:
    """ST21: thoughts and secrets out of a diagnostic preview."""
    text = F.regexp_replace(text, THOUGHTS, "")
    text = F.regexp_replace(text, BEARER, "Bearer [redacted]")
    text = F.regexp_replace(text, SECRET_KEY, "sk-[redacted]")
    return F.regexp_replace(text, CONTROL, " ")


def join_hyphenated(text: Column, rounds: int = 4) -> Column:
    """ST11: words split by a hyphen and white space, joined; chains up to 2**rounds parts."""
    return F.when(text.rlike(HYPHENATED), reduce(lambda c, _: F.regexp_replace(c, HYPHENATED, "$1$2"), range(rounds), text)).otherwise(text)


def equation_number(text: Column) -> Column:
    """ST12: a number in parentheses at the end of a formula, or ''."""
    return F.regexp_extract(text, EQUATION_NUMBER, 1)


def to_latex_symbols(text: Column) -> Column:
    """Part of ST09: Greek letters and symbols as LaTeX commands, with spaces around."""
    return replace_all(text, {k: f" {v} " for k, v in (GREEK | SYMBOLS).items()})


def symbol_steps(source: Column, to: str) -> list[tuple[str, Column]]:
    """to_latex_symbols() as steps for fenced(): a few symbols a step, which are looked for one by one only where the text has one of them. No symbol stands in a command, so their order is free."""
    every = sorted((GREEK | SYMBOLS).items())
    steps = [(to, source)]
    for i in range(0, len(every), 8):
        some = {k: f" {v} " for k, v in every[i : i + 8]}
        steps.append((to, F.when(F.col(to).rlike(f"[{''.join(some)}]"), replace_all(F.col(to), some)).otherwise(F.col(to))))
    return steps


def compact_partials(text: Column) -> Column:
    """ST06: `\\partial tx` as `\\partial_{t} x`."""
    return F.when(text.contains("\\partial"), F.regexp_replace(text, *COMPACT_PARTIAL)).otherwise(text)


def wave_names(text: Column) -> Column:
    """ST07: squeezed names such as f0s, qs and k2 as f'_s, q_s and k^2."""
    return F.when(text.rlike(ANY_WAVE_NAME), reduce(lambda c, name: F.regexp_replace(c, *name), WAVE_NAMES, text)).otherwise(text)


def corruption_flags(text: Column, latex: Column | None = None) -> Column:
    """ST14: what is suspect about a formula's text and its LaTeX, as flags in order."""
    raw, made = F.coalesce(text, F.lit("")), F.coalesce(latex if latex is not None else F.lit(""), F.lit(""))
    marked = raw.rlike(CORRUPT)
    slash = raw.rlike(SLASHES[0]) | raw.rlike(SLASHES[1])
    flags = (
        ("formula_text_layer_corrupt", marked),
        ("formula_pdf_ligature_corrupt", raw.rlike(LIGATURE) | made.rlike(LIGATURE)),
        ("formula_slash_glyph_suspect", (marked & slash) | made.rlike(UNREPAIRED)),
        ("formula_prime_glyph_suspect", (marked & raw.rlike(PRIMES)) | made.rlike(PRIMES)),
    )
    return F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in flags]))


def token_kind(token: Column) -> Column:
    """ST22: formula, reference_marker or citation."""
    return (
        F.when(token.rlike(FORMULA_TOKEN[0]) | token.rlike(FORMULA_TOKEN[1]), F.lit("formula"))
        .when(token.rlike(MARKER_TOKEN[0]) | token.rlike(MARKER_TOKEN[1]), F.lit("reference_marker"))
        .otherwise(F.lit("citation"))
    )


# Widths in hundredths of an em, by the first class that holds: tabs, white space, wide scripts, capitals, digits, other ASCII, all else.
WIDTHS = {"tab": 200, "blank": 34, "wide": 100, "capital": 64, "digit": 56, "ascii": 52, "other": 72}
WIDE = r"\u1100-\u11FF\u2E80-\uA4CF\uAC00-\uD7AF\uF900-\uFAFF\uFE30-\uFE6F\uFF00-\uFFEF"
BLANK = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
DIGIT = r"\p{Nd}\xB2\xB3\xB9\u2070\u2074-\u2079\u2080-\u2089"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def width_hundredths(text: Column) -> Column:
    """ST24: the width of a text in hundredths of an em, a whole number.

    Most characters are narrow ASCII ones, most others are ASCII too. So those go first, in runs, by plain ranges, and only what is left is searched for classes that take longer to tell.
    Lengths before and after are compared, as counting matches makes a string of each.
    """
    w = WIDTHS
    let = lambda value, f: F.transform(F.array(value), f)[0]
    without = lambda x, pattern: F.regexp_replace(x, f"{pattern}+", "")

    def more(left: Column, kinds) -> Column:
        """By how much the characters of `left` are wider than ASCII ones: those of no kind are others."""
        count = lambda pattern: F.char_length(left) - F.char_length(without(left, pattern))
        return reduce(lambda total, k: total + count(k[0]) * (w[k[1]] - w[k[2]]), kinds, F.char_length(left) * (w["other"] - w["ascii"]))

    ascii_kinds = ((r"\t", "tab", "blank"), (r"[\x09-\x0D\x1C-\x20]", "blank", "other"), ("[A-Z]", "capital", "other"), ("[0-9]", "digit", "other"))
    kinds = ((f"[{BLANK}]", "blank", "other"), (f"[{WIDE}&&[^{BLANK}]]", "wide", "other"), (f"[\\p{{IsUppercase}}&&[^{WIDE}]]", "capital", "other"), (f"[{DIGIT}&&[^{WIDE}]]", "digit", "other"))
    beyond = lambda left: let(without(left, r"[\x00-\x7F]"), lambda rest: more(rest, kinds) - F.char_length(rest) * (w["other"] - w["ascii"]))
    narrow = r"[\x00-\x08\x0E-\x1B!-/:-@\[-\x7F]"
    return F.char_length(text) * w["ascii"] + let(without(text, narrow), lambda left: more(left, ascii_kinds) + beyond(left))


def width_units(text: Column) -> Column:
    """ST24: the width of a text in ems."""
    return width_hundredths(text) / 100.0


def hard_lines(text: Column) -> Column:
    """The lines of a text; a break at its end begins no new one."""
    lines = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(1)))).otherwise(lines)


def wrapped_lines(text: Column, width: Column, font_size: Column) -> Column:
    """ST24: lines that a text takes up at a width: none for no text, one where the width or the font is nothing, else one or more for each of its own lines."""
    each = F.transform(hard_lines(text), lambda t: F.greatest(F.lit(1), F.ceil(width_units(t) * font_size / width)).cast("int"))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + x)
    return F.when(F.coalesce(text, F.lit("")) == "", 0).when((width <= 0) | (font_size <= 0), 1).otherwise(total)
