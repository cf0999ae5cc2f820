"""IO24: contracts of documents as they are exchanged: JSON Schemas, and what violates them in a column of JSON, found in one projection."""

from __future__ import annotations

import json
import re
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_URI, VERSION = "https://json-schema.org/draft/2020-12/schema", "0.2"
# Keys that say where something stands, which plans may not have.
NO_LAYOUT = ("bbox", "bounding_box", "x", "y", "x0", "y0", "x1", "y1", "width", "height", "page", "page_id", "page_index", "page_number", "top", "right", "bottom", "left")
# What fields may be.
ENUMS = {
    "role": "title abstract heading paragraph caption formula table figure footnote reference unknown",
    "input": "text image pdf docx",
    "source_role": "content layout_reference",
    "output": "translation typeset_document layout_reference summary_layout",
    "mode": "translate_only typeset_only translate_and_typeset",
    "scope": "all pages blocks",
    "style": "academic report handout slide_like plain",
    "run": "queued running completed failed canceled",
    "step": "pending running completed failed skipped repaired",
    "node": "read_input analyze_intent semantic_recognize build_plan validate_plan translate render evaluate_render repair export_pdf complete fail",
    "standard": "none gb_t_7713_1_2025",
    "display": "inline display",
    "region": "formula text page",
    "formula_source": "text_layer inline_text vector_candidate image_candidate mineru ocr mock unknown",
    "section": "cover title abstract keywords toc list_of_figures list_of_tables body heading figure table formula references appendix acknowledgements author_info department course_info experiment_metadata experiment_purpose experiment_theory experiment_steps experiment_results experiment_analysis result_analysis conclusion unknown",
    "intent": "normal compact emphasis preserve_asset",
    "usage": "preserve inline_reference background_reference ignore",
    "asset": "image pdf_asset reference ocr_text unknown",
    "page_asset": "figure formula table image unknown",
    "item": "text citation formula reference_marker asset_ref",
    "v1": "0.1",
    "v2": "0.1 0.2",
}
# The contracts and their parts. A field is `name: type`, with ! if it has to be there and ? if it may be null; types are str, int, num, bool, any, map (of strings), an enum (in <>), a part (by its name), or a list of
# these (in []); then >= or > and <= for numbers, and # for the least (and greatest) number of characters or entries. A part with - has no keys of NO_LAYOUT.
PARTS = {
    "box": "x0!: num >=0, y0!: num >=0, x1!: num >0, y1!: num >0",
    "size": "width!: num >0, height!: num >0",
    "seed": "font_size: num >0, font_name?: str, bold: bool, italic: bool, color: str",
    "span": "span_id!: str #1, page_id!: str #1, block_id!: str #1, line_id!: str #1, text: str, bbox!: box, font_name?: str, font_size?: num >0, flags?: int, color?: str, origin?: any",
    "line": "line_id!: str #1, page_id!: str #1, block_id!: str #1, text: str, bbox!: box, span_ids: [str]",
    "page_asset": "asset_id!: str #1, page_id!: str #1, kind: <page_asset>, bbox!: box, path?: str, alt_text?: str, formula_id?: str",
    "block": "block_id!: str #1, page_id!: str #1, role: <role>, bbox!: box, column: int >=0, reading_order!: int >=0, source_text: str, text_for_translation: str, formulas: [any], span_refs: [str], lines: [line], spans: [span], style_seed: seed, formula_id?: str",
    "formula": "formula_id!: str #1, page_id!: str #1, source_block_id?: str, anchor_block_id?: str, asset_id?: str, latex: str, source_text: str, source_text_range?: any, span_ids: [str], display_mode: <display>, confidence: num >=0 <=1, ocr_provider?: str, ocr_confidence?: num >=0 <=1, source_kind: <formula_source>, pdf_formula?: any, quality_flags: [str]",
    "page": "page_id!: str #1, size!: size, blocks: [block], assets: [page_asset]",
    "constraints": "page_width_pt: num >0, page_height_pt: num >0, target_font_size_pt: num >0, allow_continuation: bool, preserve_images: bool",
    "requirement-": "requirement_id!: str #1, label: str, category: str, required: bool, section_kinds: [<section>], evidence: [str], quality_flags: [str]",
    "step": "step_id!: str #1, name!: <node>, status!: <step>, progress: num >=0 <=1, attempt: int >=1, message: str, input_artifacts: [str], output_artifacts: [str], diagnostics: any, error?: str",
    "block_signal-": "source_block_id!: str #1, role_candidates: [<role>], section_hint?: str, confidence: num >=0 <=1, quality_flags: [str]",
    "asset_signal-": "asset_id!: str #1, usage_hint: str, text_hint: str, confidence: num >=0 <=1, quality_flags: [str]",
    "candidate-": "section_id!: str #1, kind: <section>, title: str, level: int >=1 <=6, source_block_ids: [str], required: bool, confidence: num >=0 <=1, quality_flags: [str]",
    "mapping-": "source_block_id!: str #1, section_id!: str #1, section_kind: <section>, confidence: num >=0 <=1, quality_flags: [str]",
    "intent_block-": "source_block_id!: str #1, role!: <role>, priority: int >=1 <=5, render_intent: <intent>, asset_refs: [str], quality_flags: [str]",
    "intent_asset-": "asset_id!: str #1, usage: <usage>, quality_flags: [str]",
    "source_block": "block_id!: str #1, role!: <role>, source_text!: str, nearby_titles: [str], preserve_tokens: [str], requires_translation: bool",
    "ratio": "max_output_ratio: num >0, require_all_blocks: bool, preserve_tokens: bool",
    "inline-": "kind: <item>, text: str, source_token?: str, asset_id?: str",
    "plan_block-": "source_block_id!: str #1, translated_text!: str, inline_items: [inline], role!: <role>, render_intent: <intent>, quality_flags: [str]",
}
CONTRACTS = {
    "article-brief-": "schema_version: <v1>, title: str, field: str, background: str, main_idea: str, contribution: str, key_terms: map, quality_flags: [str]",
    "document-ir": "doc_id!: str #1, pages!: [page] #1, formulas: [formula], extraction_backend: str, extraction_version?: str, quality_flags: [str]",
    "input-source": "source_id!: str #1, input_type!: <input>, source_role: <source_role>, filename?: str, mime_type?: str, size_bytes: int >=0, sha256?: str #64-64, artifact_path?: str, quality_flags: [str]",
    "asset-ir": "asset_id!: str #1, source_id!: str #1, kind: <asset>, mime_type?: str, path?: str, ocr_text: str, alt_text?: str, source_block_ids: [str], confidence?: num >=0 <=1, quality_flags: [str]",
    "edit-scope": "mode: <scope>, page_numbers: [int] >=1, block_ids: [str]",
    "formula-recognition-": "latex!: str, display_mode: <display>, confidence: num >=0 <=1, accepted_provider?: str, accepted_confidence?: num >=0 <=1, validator_status?: str, fallback_reason?: str, source_kind: <formula_source>, quality_flags: [str]",
    "ocr-recognition-": "text: str, latex: str, region_kind: <region>, confidence: num >=0 <=1, language?: str, provider: str, quality_flags: [str]",
    "user-intent-": "schema_version: <v2>, target_lang: str, workflow_mode: <mode>, output_kind: <output>, style_intent: <style>, typesetting_standard: <standard>, instruction: str, preserve_policy: [str], reference_assets: [str], constraints: constraints, column_layout: any, task_intent: any, output_targets: any, template_profile: any, bibliography_preference: any, requirements: [requirement]",
    "workflow-run": "workflow_id!: str #1, job_id?: str, doc_id!: str #1, status: <run>, current_step: <node>, progress: num >=0 <=1, input_sources: [input-source], user_intent: user-intent, steps: [step], artifacts: map, diagnostics: any, error?: str",
    "layout-intent-plan-": "schema_version: <v2>, plan_id!: str #1, doc_id!: str #1, target_lang: str, workflow_mode: <mode>, output_kind: <output>, style_intent: <style>, column_layout: any, document_profile: any, structure_plan: any, page_setup: any, style_system: any, numbering_plan: any, bibliography_plan: any, requirements: [requirement], blocks: [intent_block], assets: [intent_asset], quality_flags: [str]",
    "semantic-layout-analysis-": "schema_version: <v2>, analysis_id!: str #1, doc_id!: str #1, target_lang: str, block_signals: [block_signal], asset_signals: [asset_signal], section_hints: [str], structure_candidates: [candidate], block_section_mappings: [mapping], recognized_requirements: [requirement], missing_sections: [<section>], uncertain_sections: [str], confidence: num >=0 <=1, quality_flags: [str]",
    "translation-chunk": "chunk_id!: str #1, target_lang: str, source_blocks!: [source_block] #1, context: str, glossary: map, article_brief?: article-brief, render_defaults: any, constraints: ratio",
    "translation-layout-plan-": "schema_version: <v1>, chunk_id!: str #1, target_lang: str, blocks!: [plan_block] #1",
}
_ALL = {k.rstrip("-"): (k.endswith("-"), v) for k, v in (PARTS | CONTRACTS).items()}
NAMES = tuple(k.rstrip("-") for k in CONTRACTS)
_FIELD = re.compile(r"(?P<name>\w+)(?P<must>!?)(?P<null>\??): (?P<list>\[?)(?P<type><?[\w-]+>?)\]?(?: >=(?P<ge>\d+))?(?: >(?P<gt>\d+))?(?: <=(?P<le>\d+))?(?: #(?P<least>\d+)(?:-(?P<most>\d+))?)?$")
_KINDS = {"str": ("STRING",), "int": ("BIGINT",), "num": ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), "bool": ("BOOLEAN",), "map": ("OBJECT",)}


@cache
def fields(name: str) -> tuple[dict, ...]:
    """The fields of a contract or part."""
    return tuple(_FIELD.match(f).groupdict() for f in _ALL[name][1].split(", "))


# --- JSON Schema --------------------------------------------------------------------------------------------


def _schema_of(f: dict, parts: set[str]) -> dict:
    kind = f["type"]
    bounds = {k: int(f[n]) for k, n in (("minimum", "ge"), ("exclusiveMinimum", "gt"), ("maximum", "le")) if f[n]}
    if kind.startswith("<"):
        out = {"enum": ENUMS[kind[1:-1]].split()}
    elif kind in _ALL:
        parts.add(kind)
        out = {"$ref": f"#/$defs/{kind}"}
    else:
        out = {"str": {"type": "string"}, "int": {"type": "integer"}, "num": {"type": "number"}, "bool": {"type": "boolean"}, "map": {"type": "object", "additionalProperties": {"type": "string"}}, "any": {}}[kind] | bounds
    if f["list"]:
        out = {"type": "array", "items": out}
    noun = "Items" if f["list"] else "Length"
    out |= {f"{k}{noun}": int(f[n]) for k, n in (("min", "least"), ("max", "most")) if f[n]}
    return {"anyOf": [out, {"type": "null"}]} if f["null"] else out


def _object(name: str, parts: set[str]) -> dict:
    out = {"type": "object", "properties": {f["name"]: _schema_of(f, parts) for f in fields(name)}, "required": [f["name"] for f in fields(name) if f["must"]], "additionalProperties": False}
    return out | ({"not": {"anyOf": [{"required": [k]} for k in NO_LAYOUT]}} if _ALL[name][0] else {})


def json_schema(name: str) -> dict:
    """The JSON Schema of a contract, with the parts that it needs."""
    if name not in NAMES:
        raise ValueError(f"no contract {name!r}; there are {', '.join(NAMES)}")
    wanted: set[str] = set()
    out = {"$schema": SCHEMA_URI, "x-schema-version": VERSION, "title": name} | _object(name, wanted)
    done: dict[str, dict] = {}
    while rest := sorted(wanted - set(done)):
        for part in rest:
            done[part] = _object(part, wanted)
    return out | ({"$defs": done} if done else {})


def export(folder: str) -> list[str]:
    """IO24: a file `<contract>.schema.json` for each contract; their names."""
    where = Path(folder)
    where.mkdir(parents=True, exist_ok=True)
    for name in NAMES:
        (where / f"{name}.schema.json").write_text(json.dumps(json_schema(name), ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    return [f"{n}.schema.json" for n in NAMES]


# --- violations ---------------------------------------------------------------------------------------------

_NONE = "array<struct<path:string,code:string>>"


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def _hit(path: Column, code: str, when: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(path.alias("path"), F.lit(code).alias("code")))


def _value(v: Column, f: dict, path: Column) -> Column:
    """What is wrong with a value that is there and not null, by its field, but for its being a list."""
    kind = f["type"]
    if kind == "any":
        return F.array().cast(_NONE)
    if kind in _ALL:
        return F.when(_kind(v) == "OBJECT", _of_object(v, kind, path)).otherwise(F.array(F.struct(path.alias("path"), F.lit("type").alias("code"))))
    if kind.startswith("<"):
        known = F.try_variant_get(v, "$", "string").isin(*ENUMS[kind[1:-1]].split())
        return F.array_compact(F.array(_hit(path, "enum", (_kind(v) != "STRING") | ~known)))
    right = _kind(v).isin(*_KINDS[kind])
    number, length = F.try_variant_get(v, "$", "double"), F.char_length(F.try_variant_get(v, "$", "string"))
    out = [_hit(path, "type", ~right)]
    if kind == "map":
        out.append(_hit(path, "type", F.exists(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), lambda x: _kind(x) != "STRING")))
    for n, test in (("ge", lambda k: number < k), ("gt", lambda k: number <= k), ("le", lambda k: number > k)):
        if f[n]:
            out.append(_hit(path, "range", right & test(int(f[n]))))
    if not f["list"]:
        out += [_hit(path, "too_short", right & (length < int(f["least"])))] if f["least"] else []
        out += [_hit(path, "too_long", right & (length > int(f["most"])))] if f["most"] else []
    return F.array_compact(F.array(*out))


def _entry(f: dict, path: Column):
    """A function from an entry of a list and its place to what is wrong with it."""
    return lambda x, i: _value(x, f, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))


def _of_object(v: Column, name: str, path: Column) -> Column:
    """All that is wrong with an object: an array of `path` and `code`."""
    found = []
    for f in fields(name):
        x, at = F.try_variant_get(v, f"$.{f['name']}", "variant"), F.concat(path, F.lit(f".{f['name']}"))
        if f["list"]:
            each = F.try_variant_get(x, "$", "array<variant>")
            within = F.flatten(F.transform(each, _entry(f, at)))
            few = F.array_compact(F.array(_hit(at, "too_short", F.size(each) < int(f["least"])))) if f["least"] else F.array().cast(_NONE)
            told = F.when(_kind(x) == "ARRAY", F.concat(few, within)).otherwise(F.array(F.struct(at.alias("path"), F.lit("type").alias("code"))))
        else:
            told = _value(x, f, at)
        missing = F.array(F.struct(at.alias("path"), F.lit("missing").alias("code"))) if f["must"] else F.array().cast(_NONE)
        null = F.array().cast(_NONE) if f["null"] else F.array(F.struct(at.alias("path"), F.lit("type").alias("code")))
        found.append(F.when(x.isNull(), missing).when(_kind(x) == "VOID", null if f["type"] != "any" else F.array().cast(_NONE)).otherwise(told))
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    names = F.array(*[F.lit(f["name"]) for f in fields(name)])
    bans = F.array(*map(F.lit, NO_LAYOUT)) if _ALL[name][0] else F.array().cast("array<string>")
    other = F.transform(F.array_sort(F.array_except(keys, names)), lambda k: F.struct(F.concat(path, F.lit("."), k).alias("path"), F.when(F.array_contains(bans, k), "layout_key").otherwise("extra").alias("code")))
    return F.concat(*found, other)


def violations(rows: DataFrame, value: str, contract: str) -> DataFrame:
    """IO24: `rows` with `path` and `code` of each violation of a contract in the JSON texts of column `value`; rows without any have none.

    Codes: no_json, no_object, missing, type, enum, range, too_short, too_long, extra (a key that the contract doesn't have), layout_key (one that a plan may not have). The contract becomes one expression on a VARIANT,
    so a table is read once, and nothing is shuffled. A null text is no_json. Fields of type any aren't looked into.
    """
    if contract not in NAMES:
        raise ValueError(f"no contract {contract!r}; there are {', '.join(NAMES)}")
    v, root = F.try_parse_json(value), F.lit("$")
    whole = lambda code: F.array(F.struct(root.alias("path"), F.lit(code).alias("code")))
    found = F.when(v.isNull(), whole("no_json")).when(_kind(v) != "OBJECT", whole("no_object")).otherwise(_of_object(v, contract, root))
    return rows.withColumn("_v", F.explode(found)).select(*[c for c in rows.columns if c not in ("path", "code")], "_v.path", "_v.code")
