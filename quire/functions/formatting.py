"""Small helpers of output: points, colours, equation tags, fallback texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import FORMULA_REF, OLD_REF, squeeze, strip

# Tags of equations in LaTeX, and the ink where no colour is given.
TAG = r"\\tag\*?(?U)\s*\{([^{}]+)\}"
INK = "#111111"


def points(value: Column) -> Column:
    """ST26: a number of points with three digits at the most, without zeros at the end."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.3f", value.cast("double")), "0+$", ""), r"\.$", "")


def safe_color(value: Column) -> Column:
    """ST26: a colour as #rgb, #rrggbb or rgb(r, g, b); else the ink."""
    text = strip(F.coalesce(value, F.lit(INK)))
    return F.when(text.rlike(r"^#[0-9a-fA-F]{3}(?:[0-9a-fA-F]{3})?$") | text.rlike(r"^rgb\(\s*\d{1,3}\s*,\s*\d{1,3}\s*,\s*\d{1,3}\s*\)$"), text).otherwise(INK)


def fallback_text(formula_id: Column, *candidates: Column) -> Column:
    """ST26: the first candidate that is neither blank nor a mere reference; else the formula's id."""
    usable = [F.when((strip(c) != "") & ~strip(c).rlike(f"^(?:{FORMULA_REF}|{OLD_REF})$"), strip(c)) for c in candidates]
    name = F.when(F.coalesce(formula_id, F.lit("")) != "", F.concat(F.lit("formula "), formula_id)).otherwise("formula")
    return reduce(lambda a, b: F.coalesce(a, b), [*usable, name])


def equation_tag(latex: Column) -> Column:
    """ST27: the number in a formula's tag, in parentheses; null without one."""
    number = F.trim(F.regexp_replace(F.trim(F.regexp_extract(latex, TAG, 1)), r"^\((.*)\)$", "$1"))
    return F.when(number != "", F.concat(F.lit("("), number, F.lit(")")))


def without_tag(latex: Column) -> Column:
    """ST27: a formula without its first tag, squeezed if it had one."""
    found = F.regexp_extract(latex, TAG, 0)
    at = F.instr(latex, found)
    rest = F.concat(F.substring(latex, F.lit(1), at - 1), F.substring(latex, at + F.length(found), F.length(latex)))
    return F.when(found != "", squeeze(rest)).otherwise(latex)
