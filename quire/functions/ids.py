"""Stable ids and ordered lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import squeeze


def stable_id(prefix: Column, *parts: Column, digits: int = 12, separator: str = "|") -> Column:
    """HS02: prefix and the first digits of the SHA-1 of the parts, joined; null parts count as empty."""
    key = F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(prefix, F.substring(F.sha1(key.cast("binary")), 1, digits))


def block_id(page_id: Column, box: Column, text: Column) -> Column:
    """HS01: the id of a block from its page, its box in tenths (half up, this library's own rule) and its squeezed text."""
    tenths = F.concat_ws(",", *[F.format_string("%.1f", F.round(box[c], 1)) for c in ("x0", "y0", "x1", "y1")])
    return stable_id(F.concat(page_id, F.lit("_b")), page_id, tenths, squeeze(text))


def ordered_distinct(values: Column) -> Column:
    """SO01: distinct values in order of first place, without nulls and empty strings."""
    return F.filter(F.array_distinct(values), lambda v: v.isNotNull() & (v != ""))


def missing_from(values: Column, known: Column) -> Column:
    """SL06: what is not known, sorted."""
    return F.sort_array(F.array_except(values, known))


def clamp(value: Column, low: float, high: float) -> Column:
    """DT01, SL04."""
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
