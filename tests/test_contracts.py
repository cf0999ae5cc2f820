"""Contracts as JSON Schemas and as violations."""

import json
import re

import pytest

from quire import contracts


def found(spark, contract, *values):
    rows = spark.createDataFrame([(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "i int, value string")
    return sorted((r["i"], r["path"], r["code"]) for r in contracts.violations(rows, "value", contract).collect())


def test_thirteen_schemas(tmp_path):
    names = contracts.export(str(tmp_path))
    assert len(names) == 13 and sorted(p.name for p in tmp_path.iterdir()) == sorted(names)
    for name in names:
        schema = json.loads((tmp_path / name).read_text())
        text = json.dumps(schema)
        assert schema["$schema"] == contracts.SCHEMA_URI and all(f'"{ref}"' in json.dumps(list(schema.get("$defs", {}))) for ref in set(re.findall(r"#/\$defs/([\w-]+)", text)))
    plan = contracts.json_schema("translation-layout-plan")
    assert plan["required"] == ["chunk_id", "blocks"] and plan["properties"]["blocks"]["minItems"] == 1 and {"required": ["x0"]} in plan["not"]["anyOf"]
    assert contracts.json_schema("input-source")["properties"]["sha256"] == {"anyOf": [{"type": "string", "minLength": 64, "maxLength": 64}, {"type": "null"}]}
    with pytest.raises(ValueError, match="no contract"):
        contracts.json_schema("none")


def test_violations(spark):
    good = {"chunk_id": "c", "blocks": [{"source_block_id": "b", "translated_text": "", "role": "title", "inline_items": [{"kind": "text", "source_token": None}]}]}
    bad = {"chunk_id": "", "blocks": [{"source_block_id": 7, "role": "titel", "x0": 1, "inline_items": [{"kind": None}, {"odd": 1}]}, "no object"], "target_lang": None}
    got = found(spark, "translation-layout-plan", good, bad, {"blocks": []}, "[1]", "no json", None)
    assert [g for g in got if g[0] == 0] == []
    assert [g[1:] for g in got if g[0] == 1] == sorted([
        ("$.chunk_id", "too_short"), ("$.target_lang", "type"), ("$.blocks[0].source_block_id", "type"), ("$.blocks[0].translated_text", "missing"), ("$.blocks[0].role", "enum"), ("$.blocks[0].x0", "layout_key"),
        ("$.blocks[0].inline_items[0].kind", "type"), ("$.blocks[0].inline_items[1].odd", "extra"), ("$.blocks[1]", "type"),
    ])
    assert [g for g in got if g[0] > 1] == [(2, "$.blocks", "too_short"), (2, "$.chunk_id", "missing"), (3, "$", "no_object"), (4, "$", "no_json"), (5, "$", "no_json")]


def test_numbers_and_nested_parts(spark):
    source = {"source_id": "s", "input_type": "pdf", "size_bytes": -1, "sha256": "short"}
    run = {"workflow_id": "w", "doc_id": "d", "progress": 1.5, "input_sources": [source], "steps": [{"step_id": "s", "name": "render", "status": "running", "attempt": 0}], "artifacts": {"a": 1}, "diagnostics": None}
    assert [g[1:] for g in found(spark, "workflow-run", run)] == [
        ("$.artifacts", "type"), ("$.input_sources[0].sha256", "too_short"), ("$.input_sources[0].size_bytes", "range"), ("$.progress", "range"), ("$.steps[0].attempt", "range"),
    ]
    box = {"x0": 0, "y0": 0.5, "x1": 0, "y1": 9}
    doc = {"doc_id": "d", "pages": [{"page_id": "p", "size": {"width": 1, "height": 2}, "blocks": [{"block_id": "b", "page_id": "p", "bbox": box, "reading_order": 1.5}]}]}
    assert [g[1:] for g in found(spark, "document-ir", doc)] == [("$.pages[0].blocks[0].bbox.x1", "range"), ("$.pages[0].blocks[0].reading_order", "type")]
    assert [g[1:] for g in found(spark, "edit-scope", {"mode": "pages", "page_numbers": [1, 0, "2"]})] == [("$.page_numbers[1]", "range"), ("$.page_numbers[2]", "type")]
    for name in contracts.NAMES:
        assert isinstance(found(spark, name, {}), list)
