"""Layout JSON of any shape from files."""

import json

from quire.sources import layout_tree


def put(folder, name, value):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))


def test_files_of_any_shape(spark, tmp_path):
    deep = {"content": [{"content": "third", "children": ["fourth", {"content": "fifth", "odd": {"x": 1}}]}]}
    tree = {"type": "list", "index": 2, "content": {"zeta": "first", "alpha": [{"content": "second", "children": [deep]}, "sixth"], "n": 5}}
    text = {"type": " Text ", "index": 1, "bbox": [1, 2, 3, 4], "lines": [{"spans": [{"content": "line"}, {"text": "text"}, {"latex": "x"}]}]}
    tables = [{"type": "table", "table_body": "<td>a</td> <b>b</b>", "strange": [[[1]]]}, "no object"]
    images = [{"type": "image", "image_caption": ["Fig", 1, " "], "bbox": "odd", "index": "2"}, {"type": "image", "text": "", "content": "not this"}]
    put(tmp_path / "a", "x_middle.json", {"pdf_info": [{"para_blocks": [tree, text, text], "tables": tables, "images": images}, {"para_blocks": []}, {}]})
    put(tmp_path / "a", "x_content_list_v2.json", [[{"content": "not used"}], [{"type": "title", "content": "from list", "bbox": [0, 9]}, {"text": "above", "bbox": [0, 3]}]])
    put(tmp_path / "down" / "b", "middle.json", {"pdf_info": [{"para_blocks": [{"type": "text", "blocks": [{"lines": [{"spans": [{"content": "in"}]}]}, {"x": 1}, {"lines": [{"spans": [{"content": "blocks"}]}]}], "text": "no"}]}]})
    put(tmp_path / "c", "middle.json", "{ not json")
    put(tmp_path / "c", "notes.txt", "nothing")
    got = layout_tree.items(layout_tree.read_files(spark, str(tmp_path))).orderBy("doc_id", "page_index", "pos").collect()
    assert [(r["doc_id"], r["page_index"], r["pos"], r["type"], r["text"]) for r in got] == [
        ("a", 0, 0, "text", "line text"), ("a", 0, 1, "list", "first second third fourth fifth sixth"), ("a", 0, 2, "table", "a b"), ("a", 0, 3, "image", "Fig 1"), ("a", 0, 4, "image", ""),
        ("a", 1, 0, "", "above"), ("a", 1, 1, "title", "from list"), ("b", 0, 0, "text", "in blocks"),
    ]
    assert got[0]["bbox"] == [1, 2, 3, 4] and got[3]["index"] is None and "strange" in json.loads(str(got[2]["item"].toJson()))


def test_files_are_read_once(spark, tmp_path, monkeypatch):
    """Files were read once for pages with items, once for those without, once for content lists, and all again for the depth of items."""
    seen = []
    monkeypatch.setattr(layout_tree, "store", lambda df, name: seen.append(df) or df)
    put(tmp_path / "a", "middle.json", {"pdf_info": [{"para_blocks": [{"type": "text", "text": "own"}, "x"]}, {}, {"tables": {}}]})
    put(tmp_path / "a", "content_list_v2.json", [[{"text": "not used"}], [{"text": "listed"}, 3], None, [{"text": "no such page"}]])
    put(tmp_path / "b", "middle.json", {"pdf_info": [{}]})
    layout_tree.items(layout_tree.read_files(spark, str(tmp_path)))
    (rows,) = seen
    assert [(r["doc_id"], r["page_index"], r["i"], json.loads(r["raw"])["text"]) for r in rows.orderBy("page_index").collect()] == [("a", 0, 0, "own"), ("a", 1, 0, "listed")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_files_are_written_by_all_tasks(spark, monkeypatch):
    """Spark put the tasks that write together by size, as few files as there are bytes."""
    from quire.cases import files

    folder = files.layout_files(spark, "/root/testdata/sf0.001")
    rows = spark.read.text(folder).groupBy("doc", "kind").count()
    docs = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id").distinct().count()
    parts = {p.rsplit("/", 1)[1].split("-")[1] for p in spark.read.text(folder).inputFiles()}
    assert rows.count() == 2 * docs and len(parts) > 1


def test_files_are_written_without_checksums(spark):
    """Hadoop's local writer made a second file for each, and started a process for the permissions of both."""
    import os

    from quire.cases import files

    folder = files.layout_files(spark, "/root/testdata/sf0.001")
    folder = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath()
    names = [f for _, _, found in os.walk(folder) for f in found]
    assert names and all(f.startswith("part-") for f in names)
