from pyspark.sql import functions as F

from quire.operators import paging, rollups, spans
from quire.plans import repair, styles

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_scripts_by_size_and_place(spark):
    def span(n, text, size, y0, y1, font="CM"):
        return ("d", "b", 0, n, text, font, size, (0.0, y0, 5.0, y1))

    rows = [span(0, "x", 10.0, 0.0, 10.0), span(1, "i", 6.0, 6.0, 12.0), span(2, "j", 6.0, 6.0, 12.0), span(3, " + y", 10.0, 0.0, 10.0), span(4, "2", 6.0, -2.0, 4.0), span(5, None, 6.0, 0.0, 1.0), span(6, " ", 10.0, 0.0, 10.0), span(7, "0", 6.0, -2.0, 4.0, "AdvP4C4E74")]
    df = spark.createDataFrame(rows, f"doc_id string, block_id string, line int, n int, text string, font string, size double, box {BOX}")
    assert spans.line_texts(df).first()["text"] == "x_{ij} + y^{2} '"
    alone = spark.createDataFrame([span(0, "2", 6.0, -2.0, 4.0), span(1, "= x", 10.0, 0.0, 10.0)], df.schema)
    assert spans.line_texts(alone).first()["text"] == "2= x"  # nothing to stand on
    assert spans.line_texts(df.limit(0)).count() == 0


def test_continuations_lose_no_word(spark):
    texts = ["one two three four five six seven eight nine ten " * 6, None, "", "a\n\nb\nc\nd", "图" * 40]
    rows = spark.createDataFrame([("d", i, t, 90.0, 40.0) for i, t in enumerate(texts)], "doc_id string, pos int, text string, width double, height double")
    got = {}
    for r in paging.continuations(rows, 10.0, 1.25).orderBy("pos", "fragment").collect():
        got.setdefault(r["pos"], []).append(r["text"])
    assert [" ".join(" ".join(got[i]).split()) for i in (0, 3)] == [" ".join(t.split()) for t in (texts[0], texts[3])]
    assert got[1] == got[2] == [""] and "".join(got[4]) == texts[4] and len(got[0]) > 3
    fits = spark.createDataFrame([(t, 90.0) for ts in got.values() for t in ts], "t string, w double").select(paging.text_height(F.col("t"), F.col("w"), F.lit(10.0), F.lit(1.25)).alias("h"))
    assert max(r["h"] for r in fits.collect()) <= 40.0


def test_repaired_answers(spark):
    sources = spark.createDataFrame([("d", 1, 0, "figure", "src", None, False), ("d", 1, 1, "paragraph", "x {{formula:a.b}}", ["{{formula:a.b}}", "Fig. 2"], True)], "doc_id string, chunk_no int, pos int, role string, text string, preserve_tokens array<string>, requires_translation boolean")
    answers = spark.createDataFrame([("d", 1, 1, 0, "y {formula:a.b}} {formula:aXb}}", None, None, [("odd", "t")], ["f", "f", ""]), ("d", 1, 9, 0, "made up", None, None, None, None)], f"doc_id string, chunk_no int, pos int, n int, translated_text string, role string, render_intent string, inline_items {repair.ITEMS}, quality_flags array<string>")
    got = {r["pos"]: r for r in repair.repaired(sources, answers).collect()}
    assert set(got) == {0, 1} and got[0]["translated_text"] == "src" and got[0]["render_intent"] == "preserve_asset"
    assert got[0]["quality_flags"] == ["repaired_layout_plan", "empty_translation_repaired", "missing_translation", "formula_cluster_preserved", "missing_block_repaired"]
    assert got[1]["translated_text"] == "y {{formula:a.b}} {formula:aXb}}"
    assert [tuple(i) for i in got[1]["inline_items"]] == [("text", "t"), ("reference_marker", "Fig. 2")]
    assert got[1]["quality_flags"] == ["f", "repaired_layout_plan", "formula_placeholder_syntax_repaired", "preserve_token_repaired"]


def test_layers_and_rows(spark):
    layer = lambda *rows: spark.createDataFrame(rows, "name string, value string")
    got = styles.layered({"defaults": layer(("a", "1"), ("b", "2")), "stored": layer(("a", "3"), ("b", None))})
    assert sorted(tuple(r) for r in got.collect()) == [("a", "3", "stored"), ("b", "2", "defaults")]
    shown = {r["name"]: r["value"] for r in styles.redacted(layer(("api_key", "s"), ("x_token", None), ("n", "4"))).collect()}
    assert shown == {"api_key": "[set]", "x_token": "[unset]", "n": "4"}
    rows = spark.createDataFrame([(1, None, 5), (2, None, 5), (3, "a", 5)], "n int, k string, v int")
    assert sorted(r["n"] for r in rollups.first_rows(rows, ["n"]).collect()) == [1, 3]


def test_workflow_repairs_are_bounded_and_failures_end(spark):
    from quire.scratch import store
    from quire.plans import workflow

    docs = spark.createDataFrame([("a", 0, None), ("b", 1, None), ("c", 9, None), ("d", 0, "lost")], "doc_id string, wants int, error string")
    nodes = {"evaluate_render": lambda rows: rows.withColumn("repair_recommended", F.col("attempt") < F.col("wants"))}
    final, steps = workflow.run(docs, nodes, store, max_repairs=2)
    assert {r["doc_id"]: (r["node"], r["attempt"]) for r in final.collect()} == {"a": ("end", 0), "b": ("end", 1), "c": ("end", 2), "d": ("end", 0)}
    log = {}
    for r in steps.orderBy("step").collect():
        log.setdefault(r["doc_id"], []).append(r["node"])
    assert log["d"] == ["read_input"] and log["a"] == ["read_input", "analyze_intent", "semantic_recognize", "build_layout_plan", "validate_layout_plan", "build_source_plans", "render_preview", "evaluate_render", "export_pdf", "complete"]
    assert log["c"].count("repair_layout_plan") == 2 and log["c"][-1] == "complete"
    none, no_steps = workflow.run(docs.limit(0), nodes, store)
    assert none.count() == no_steps.count() == 0


def test_one_bad_text_costs_only_itself(spark):
    from quire.plans import workflow

    def work(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [t.upper() for t in texts]

    rows = spark.createDataFrame([("a",), ("bad",), ("c",)], "text string").coalesce(1)
    assert {r["text"]: (r["result"], r["failure"]) for r in workflow.failures_kept(rows, work).collect()} == {"a": ("A", None), "bad": (None, "ValueError: no"), "c": ("C", None)}


def test_workflow_states_are_written_once_and_stay_off_the_driver(spark, tmp_path):
    from quire.cases.pages import ss04_ss05_workflows
    from quire.plans import workflow
    from quire.scratch import store

    written = {}

    def write(df, name):
        out = store(df, name)
        written[name] = out.count()
        return out

    docs = spark.createDataFrame([(i, "broken" if i % 2 else None) for i in range(10)], "doc_id int, breaks string")
    final, steps = workflow.run(docs, {"read_input": lambda rows: rows.withColumn("error", rows["breaks"])}, write)
    assert sum(written.values()) == 10 + steps.count() and final.count() == 10
    spark.range(100).selectExpr("id AS o_orderkey", "id AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    rows = ss04_ss05_workflows(spark, str(tmp_path))
    assert rows.count() == 100 and "Broadcast" not in rows._jdf.queryExecution().toString()
