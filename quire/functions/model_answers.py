"""Answers of models: JSON inside other text, fields of broken JSON, and keys that may not stand in it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.schemas import LAYOUT_KEYS


def first_object(text: Column, key: str) -> Column:
    """JS01: the first JSON object in a text that has `key`, as JSON; null if there is none. Text around it, such as code fences, is passed over."""

    @F.pandas_udf("string")
    def find(values):
        import json

        decode = json.JSONDecoder().raw_decode

        def one(value):
            at = (value or "").find("{")
            while at >= 0:
                try:
                    found, _ = decode(value, at)
                except ValueError:
                    found = None
                if isinstance(found, dict) and key in found:
                    return json.dumps(found, ensure_ascii=False, sort_keys=True)
                at = value.find("{", at + 1)
            return None

        return values.map(one)

    return find(text)


def without_layout_keys(value: Column) -> Column:
    """PF22: a JSON text without layout keys, at any depth; null for what isn't JSON."""

    @F.pandas_udf("string")
    def strip(values):
        import json

        def clean(x):
            if isinstance(x, dict):
                return {k: clean(v) for k, v in x.items() if k not in LAYOUT_KEYS}
            return [clean(v) for v in x] if isinstance(x, list) else x

        def one(text):
            try:
                return json.dumps(clean(json.loads(text)), ensure_ascii=False, sort_keys=True)
            except (TypeError, ValueError):
                return None

        return values.map(one)

    return strip(value)


def has_layout_keys(value: Column) -> Column:
    """PF22: whether a JSON object has a layout key at its top."""
    return F.coalesce(F.arrays_overlap(F.json_object_keys(value), F.array(*map(F.lit, LAYOUT_KEYS))), F.lit(False))


def salvaged(text: Column, field: str) -> Column:
    """JS02: the string of a field in JSON that may be cut off: up to its closing quote or the end; null without the field."""
    found = F.regexp_extract(text, rf'(?s)"{field}"\s*:\s*"((?:[^"\\]|\\.)*)', 1)
    plain = F.replace(F.replace(F.replace(found, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.when(text.rlike(rf'"{field}"\s*:\s*"'), plain)


def recognition(text: Column, confidence: float = 0.86) -> Column:
    """JS04: struct of `latex` and `confidence` (0 to 1, .86 if not given or not a number) from a recogniser's JSON."""
    fields = F.from_json(text, "latex string, text string, confidence string, score string")
    given = F.coalesce(fields["confidence"], fields["score"]).try_cast("double")
    return F.struct(F.coalesce(fields["latex"], fields["text"], F.lit("")).alias("latex"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(given, F.lit(confidence)))).alias("confidence"))
