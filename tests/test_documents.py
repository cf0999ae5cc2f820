from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import chunks, events, formulas, integrity, jobs, layout, sections
from quire.plans import translation
from quire.sources import layout_json
from quire.sources.text import text_blocks, virtual_pages

BLOCK = "doc_id string, pos int, role string, text string"


def blocks(spark, *rows):
    return spark.createDataFrame([("d", i, r, t) for i, (r, t) in enumerate(rows)], BLOCK)


def chunk_list(spark, cap, *rows):
    got = chunks.assign_chunks(blocks(spark, *rows), cap).orderBy("pos").collect()
    out = {}
    for r in got:
        out.setdefault(r["chunk_no"], []).append(r["text"])
    return list(out.values())


def test_blocks_and_empty_texts(spark):
    docs = spark.createDataFrame([("a", "Title\n\nFirst para.\r\n\r\n  Heading  here\n\n"), ("b", ""), ("c", None)], "doc_id string, text string")
    got = [(r["doc_id"], r["pos"], r["text"], r["role"]) for r in text_blocks(docs).orderBy("pos").collect()]
    assert got == [("a", 0, "Title", "title"), ("a", 1, "First para.", "paragraph"), ("a", 2, "Heading here", "heading")]


def test_virtual_pages_break(spark):
    rows = virtual_pages(blocks(spark, *[("paragraph", "x" * 900)] * 6)).orderBy("pos").collect()
    assert [r["page_no"] for r in rows] == [1, 1, 2, 2, 3, 3] and rows[2]["y0"] == 54.0


def test_chunk_size_cap(spark):
    assert chunk_list(spark, 13, ("paragraph", "aaaaaa"), ("paragraph", "bbbbbb"), ("paragraph", "cccccc")) == [["aaaaaa", "bbbbbb"], ["cccccc"]]


def test_chunk_sections_clusters_and_long_blocks(spark):
    assert chunk_list(spark, 100, ("heading", "h"), ("paragraph", "a"), ("heading", "i"), ("paragraph", "b")) == [["h", "a"], ["i", "b"]]
    assert chunk_list(spark, 3, *[("reference", "rrrr")] * 3) == [["rrrr"] * 3]
    assert chunk_list(spark, 3, ("paragraph", "x" * 50)) == [["x" * 50]]
    assert chunk_list(spark, 3, ("heading", "hh"), ("paragraph", "long text")) == [["hh", "long text"]]


def test_each_block_in_one_chunk_in_order(spark):
    rows = [("heading" if i % 7 == 0 else "paragraph", "w" * (i % 19 + 1)) for i in range(60)]
    got = chunks.assign_chunks(blocks(spark, *rows), 40).orderBy("pos").collect()
    numbers = [r["chunk_no"] for r in got]
    assert len(got) == 60 and numbers == sorted(numbers) and set(numbers) == set(range(1, max(numbers) + 1))


def test_deterministic_plan_has_no_issues(spark):
    src = chunks.source_blocks(blocks(spark, ("title", "T"), ("paragraph", "See Fig. 2 and {{formula:a}} now."), ("formula", "{{formula:b}}")))
    plan = translation.deterministic(src, "zh")
    assert translation.coverage_issues(src, plan).count() == 0
    got = {r["pos"]: r["translated_text"] for r in plan.collect()}
    assert got[0] == "【译】T" and got[2] == "{{formula:b}}"


def test_plan_issues_and_repair(spark):
    src = chunks.source_blocks(blocks(spark, ("title", "T"), ("paragraph", "See Fig. 2 here.")))
    plan = translation.deterministic(src, "fr").where("pos = 1").withColumn("translated_text", F.lit("rien")).withColumn("inline_items", F.slice("inline_items", 1, 0))
    assert sorted(r["code"] for r in translation.coverage_issues(src, plan).collect()) == ["missing_block", "missing_token"]
    fixed = translation.translate(src, "fr", lambda texts: [None if t == "T" else "perdu" for t in texts]).orderBy("pos").collect()
    assert [r["translated_text"] for r in fixed] == ["T", "See Fig. 2 here."]


def test_quality(spark):
    src = chunks.source_blocks(blocks(spark, ("paragraph", "the gradient " * 10)))
    plan = translation.deterministic(src, "zh").withColumn("translated_text", F.lit("kurz"))
    terms = spark.createDataFrame([("gradient", "梯度"), ("same", "Same")], "source_term string, target_term string")
    flags = {r["flag"] for r in translation.quality_issues(src, plan, "zh", terms).collect()}
    assert flags == {"translation_quality_suspiciously_short", "translation_quality_missing_key_term"}


def test_integrity(spark):
    texts = spark.createDataFrame([("d", "l", "{{formula:a}} {{formula:F9}} {{formula:z}}")], "doc_id string, location string, text string")
    known = spark.createDataFrame([("d", "a", "x")], "doc_id string, formula_id string, latex string")
    assert {(r["code"], r["ref_id"]) for r in integrity.reference_issues(texts, known).collect()} == {("stale_legacy_formula_ref", "F9"), ("unknown_formula_ref", "z")}
    put = integrity.substitute_refs(texts.withColumn("pos", F.lit(0)), known).first()["text"]
    assert put == "x {{formula:F9}} {{formula:z}}"


def test_ranges(spark):
    b = spark.createDataFrame([("d", "b1", "ab x = 1 cd", ["s1"])], "doc_id string, block_id string, text string, span_ids array<string>")
    f = spark.createDataFrame([("d", "f1", "b1", None, ["s2"], "x=1", 3, 8), ("d", "f2", "b1", None, [], "x=1", 3, 80), ("d", "f3", "b1", None, [], "y", 0, 2)], "doc_id string, formula_id string, source_block_id string, anchor_block_id string, span_ids array<string>, source_text string, start int, end int")
    assert {(r["ref_id"], r["code"]) for r in integrity.range_issues(f, b).collect()} == {("f1", "formula_unknown_span_ref"), ("f2", "formula_source_text_range_out_of_bounds"), ("f3", "formula_source_text_range_mismatch")}


BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_two_columns(spark):
    rows = [("r1", (300.0, 50.0, 500.0, 60.0)), ("l1", (50.0, 50.0, 250.0, 60.0)), ("l2", (50.0, 90.0, 250.0, 100.0)), ("top", (50.0, 10.0, 500.0, 20.0))]
    b = spark.createDataFrame([("d", "p", i, x) for i, x in rows], f"doc_id string, page_id string, block_id string, box {BOX}")
    pages = spark.createDataFrame([("d", "p", 560.0)], "doc_id string, page_id string, width double")
    assert [r["block_id"] for r in layout.reading_order(b, pages).orderBy("reading_order").collect()] == ["top", "l1", "l2", "r1"]


def test_captions_are_taken_once(spark):
    a = spark.createDataFrame([("d", "p", "a1", (0.0, 0.0, 10.0, 10.0)), ("d", "p", "a2", (0.0, 20.0, 10.0, 30.0))], f"doc_id string, page_id string, asset_id string, box {BOX}")
    c = spark.createDataFrame([("d", "p", "c1", (0.0, 12.0, 10.0, 15.0)), ("d", "p", "c2", (0.0, 32.0, 10.0, 35.0))], f"doc_id string, page_id string, caption_id string, box {BOX}")
    assert {(r["asset_id"], r["caption_id"]) for r in layout.caption_pairs(c, a).collect()} == {("a1", "c1"), ("a2", "c2")}


def test_bands_and_islands(spark):
    items = spark.createDataFrame([("d", "p", "a", (0.0, 0.0, 5.0, 10.0)), ("d", "p", "b", (0.0, 18.0, 5.0, 30.0)), ("d", "p", "c", (0.0, 60.0, 5.0, 70.0))], f"doc_id string, page_id string, item_id string, box {BOX}")
    assert [r["band"] for r in layout.bands(items).orderBy("item_id").collect()] == [1, 1, 2]
    assert [r["island"] for r in layout.islands(items, "item_id").orderBy("item_id").collect()] == [1, 1, 2]


def test_formulas(spark):
    b = blocks(spark, ("paragraph", "We set x_1=α+2 here for all."), ("formula", "E = m c^2 (3)"), ("paragraph", "No math at all."))
    got = formulas.recognise(formulas.detect(b)).orderBy("pos").collect()
    assert [(r["pos"], r["mode"], r["accepted"]) for r in got] == [(0, "inline", True), (1, "display", True)]
    assert got[1]["latex"].endswith("\\tag{3}") and r"\alpha" in got[0]["latex"]
    refs = formulas.with_refs(b, formulas.recognise(formulas.detect(b))).orderBy("pos").collect()
    assert refs[0]["text_with_refs"].startswith("We set {{formula:f") and refs[2]["text_with_refs"] == "No math at all."


def test_inline_formulas_take_their_scripts_and_end_at_prose(spark):
    rows = ("We have @u = @x + 2 and v[i] = 3 then y = (a+b) / c_{12} where z.", "the term k = a_1 ^{n+1}) holds", "∫ f_0 + g_{ij} = 2; next", "See Fig. 2 = good", "a = b, where c = d")
    got = formulas.inline_candidates(blocks(spark, *[("paragraph", x) for x in rows])).orderBy("pos", "n").collect()
    found = {}
    for r in got:
        assert rows[r["pos"]][r["start"] : r["end"]] == r["source_text"]
        found.setdefault(r["pos"], []).append(r["source_text"])
    assert found[0] == ["@u = @x + 2", "v[i] = 3", "y = (a+b) / c_{12}"]
    assert found[1] == ["k = a_1 ^{n+1})"] and found[2] == ["∫ f_0 + g_{ij} = 2"] and 3 not in found and found[4] == ["a = b", "c = d"]


def test_text_layers_are_mended(spark):
    cases = {
        "a |ffl{z ffi x1 } b": "a _{x1} b",
        "p |{ z } q": "p q",
        "Z I R^n f": r"\int_{\mathbb{R}^{n}} f",
        "Z f(x) = 2": r"\int f(x) = 2",
        "I R_2 = 0": r"\mathbb{R}^{2} = 0",
        "x 2 = y": "x2 = y",
        "E = m c^2, where m is": "E = m c^2",
        "A = b12.": "A = b12",
        "k = B2.34": "k = B2",
        "y = 3 n, dx": "y = 3",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["latex"] for r in formulas.with_latex(rows, "t").collect()}
    assert got == cases


def test_instructions_ask_for_requirements(spark):
    """The ten kinds of demands: what each document kind and each keyword asks for."""
    rows = {
        "graduation project proposal for a supervisor": {"formal_academic_style", "supervisor_submission", "clear_title", "main_text"},
        "thesis with cover page, abstract, keywords, table of contents, main text, references, acknowledgements": {"clear_title", "main_text", "references", "cover_page", "abstract", "keywords", "table_of_contents", "acknowledgements"},
        "course paper, consistent citations and references": {"academic_style", "clear_title", "readable_body_text", "consistent_citations_references", "references"},
        "lists of figures and tables": {"list_of_figures", "list_of_tables", "asset_alignment", "figure_numbering", "table_numbering", "formula_numbering"},
        "": set(),
    }
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, instruction string")
    got = {}
    for r in sections.requirements(df).collect():
        got.setdefault(r["doc_id"], set()).add(r["requirement_id"])
    assert [got.get(i, set()) for i in range(len(rows))] == list(rows.values())
    two = {r["requirement_id"]: r for r in sections.requirements(spark.createDataFrame([(1, "proposal report, professional, main text")], "doc_id int, instruction string")).collect()}
    assert two["main_text"]["section_kinds"] == ["body"] and two["formal_academic_style"]["category"] == "style"


def test_unfinished_jobs_go_on_only_with_their_chunks(spark):
    j = spark.createDataFrame([("a", "d1", "translating"), ("b", "d2", "translating"), ("c", "d3", "queued"), ("e", "d1", "queued"), ("f", None, "queued"), ("g", "d1", "completed")], "job_id string, doc_id string, state string")
    up = spark.createDataFrame([("d2",)], "doc_id string")
    art = spark.createDataFrame([("d1", "document-ir"), ("d1", "translation-chunks"), ("d2", "document-ir")], "doc_id string, name string")
    assert {r["job_id"]: r["action"] for r in jobs.resume_actions(j, up, art).collect()} == {"a": "continue", "b": "restart", "c": "fail", "e": "fail"}


def test_widths(spark):
    from quire.functions import text

    cases = {"aA1 ": 52 + 64 + 56 + 34, "\t": 200, "图é": 100 + 72, "ＡA": 164, "": 0, "x²": 52 + 56, "\u00a0": 34}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["w"] for r in df.select("t", text.width_hundredths(F.col("t")).alias("w")).collect()} == cases
    lines = lambda t, w: spark.createDataFrame([(t,)], "t string").select(text.wrapped_lines(F.col("t"), F.lit(w), F.lit(10.0)).alias("n")).first()["n"]
    assert [lines("", 50.0), lines("aaaa", 0.0), lines("a" * 20, 52.0), lines("a\n\nb\r\n", 52.0)] == [0, 1, 2, 3]


def test_balanced(spark):
    df = spark.createDataFrame([("(a))^",), ("[x",), ("{a}}b}",), ("",)], "t string")
    assert [r["t"] for r in formulas.balanced(df, "t").collect()] == ["(a)", "[x]", "{a}b", ""]


def test_sections_and_requirements(spark):
    b = blocks(spark, ("title", "My paper"), ("heading", "References"), ("paragraph", "The method is new"))
    assert [(r["section_id"], r["kind"]) for r in sections.sections(b).orderBy("pos").collect()] == [("title_01", "title"), ("references_02", "references"), ("experiment_steps_03", "experiment_steps")]
    want = spark.createDataFrame([("d", "with references and an abstract")], "doc_id string, instruction string")
    got = {r["requirement_id"]: r["status"] for r in sections.coverage(sections.requirements(want), sections.sections(b)).collect()}
    assert got == {"references": "satisfied", "abstract": "missing"}


def test_log_keeps_first_of_repeats_and_the_tail(spark):
    a = spark.createDataFrame([("j", "e1", 10, "x"), ("j", "e2", 20, "y")], "job_id string, id string, sequence long, m string")
    b = spark.createDataFrame([("j", "e1", 90, "late"), ("j", "e3", 30, "z")], a.schema)
    assert [(r["id"], r["m"]) for r in events.merge_events([a, b], "job_id", 2).orderBy("sequence").collect()] == [("e2", "y"), ("e3", "z")]


def test_canceled_stays(spark):
    u = spark.createDataFrame([("a", 1, "queued"), ("a", 2, "canceled"), ("a", 3, "completed"), ("b", 1, "queued"), ("b", 2, "completed")], "job_id string, seq long, state string")
    assert {r["job_id"]: r["state"] for r in jobs.sticky_status(u).collect()} == {"a": "canceled", "b": "completed"}


def test_streamed_states(spark, tmp_path):
    from quire.streaming.jobs import read_updates, run_states

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"job_id":"a","seq":1,"state":"canceled"}\n{"job_id":"a","seq":2,"state":"completed"}\n')
    run_states(read_updates(spark, str(tmp_path / "in")), "job_states", str(tmp_path / "ck")).awaitTermination(60)
    assert spark.table("job_states").first()["state"] == "canceled"


def test_layout_json(spark, tmp_path):
    (tmp_path / "doc1").mkdir()
    item = '{"type":"text","index":1,"bbox":[0,0,100,10],"lines":[{"bbox":[0,0,100,10],"spans":[{"type":"text","content":"Hello"},{"type":"inline_equation","content":"x=1"}]}]}'
    page = f'{{"page_idx":0,"page_size":[612,792],"para_blocks":[{item},{item}],"images":[],"tables":[],"interline_equations":[],"discarded_blocks":[{item}]}}'
    (tmp_path / "doc1" / "middle.json").write_text(f'{{"pdf_info":[{page}]}}')
    layout_ = layout_json.read_layout(spark, str(tmp_path / "*" / "*.json"))
    assert [(r["doc_id"], r["role"], r["text"]) for r in layout_json.blocks(layout_).collect()] == [("doc1", "paragraph", "Hello x=1")]
    assert [r["start"] for r in layout_json.spans(layout_).orderBy("n").collect()] == [0, 6]
    assert layout_json.discarded(layout_).first()["n_discarded"] == 1


def test_files(spark, tmp_path):
    from quire.sources import files

    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"nope")
    (tmp_path / "c.exe").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: r["reject"] for r in files.checked(files.read_files(spark, str(tmp_path))).collect()}
    assert got == {"a.pdf": None, "b.pdf": "wrong_content", "c.exe": "unsupported_type"}


def test_schemas():
    from quire import schemas

    assert schemas.schema("block")["box"].dataType["x0"] and '"plan_block"' in schemas.export()


def test_whole_plans_against_brute_force(spark, tmp_path):
    """All blocks and all codes, with signs, references and lost tokens."""
    import re

    from quire import registry

    some = ["A plain line", "x = y + z - 1", "See {{formula:F1}} and {{formula:F2}} here.", "{{formula:F1}}", "<b>well-known</b> a_b ^ c", "back\\slash * 2 / 3", "A long line about {{formula:F3}} that ends in a stop."]
    texts = {d: [some[(i * step) % 7] for i in range(60)] for d, step in ((1, 1), (2, 3))}
    spark.createDataFrame([(d, "\n".join(t)) for d, t in texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plans, shown, issues = set(), set(), set()
    for d, lines in texts.items():
        for i, t in enumerate(lines):
            refs = re.findall(r"\{\{formula:\w+\}\}", t)
            copied = refs and t == refs[0]
            plans.add((d, i, t if copied else "【译】" + t, "formula_preserved_without_translation" if copied else "mock_translation"))
            fr = t if copied else "[fr] " + t
            fr = " " if i % 11 == 5 else fr[:9] if i % 13 == 4 else fr
            if i % 17 == 3:
                issues.add((d, i, "missing_block", ""))
                shown.add((d, i, t, "missing_translation"))
            else:
                issues |= {(d, i, "missing_token", r) for r in refs if r not in fr}
                shown.add((d, i, t, "empty_translation") if fr == " " else (d, i, fr, ""))
    rows = lambda name, *cols: sorted(tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).select(*cols).collect())
    assert rows("u01_deterministic_plan", "doc_id", "pos", "translated_text", "flag") == sorted(plans)
    assert rows("j02_plan_coverage", "doc_id", "pos", "code", "detail") == sorted(issues)
    assert rows("j01_rendered_blocks", "doc_id", "pos", "shown_text", "flags") == sorted(shown)
    assert {c for *_, c, _ in issues} == {"missing_block", "missing_token"} and any(f.startswith("formula") for *_, f in plans)


def test_formulas_are_detected_in_one_pass(spark):
    """Whole blocks and places inside them come from one reading of the blocks, which costs most; rows that repeat a place keep their candidates."""
    b = blocks(spark, ("formula", "E = m c^2"), ("paragraph", "the value x_1=a+2 holds"), ("formula", "y = 1"))
    found = formulas.detect(b.unionByName(b.where("role = 'formula'")).localCheckpoint())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    got = sorted((r["pos"], r["n"], r["mode"], r["source_text"]) for r in found.collect())
    assert got == [(0, 0, "display", "E = m c^2")] * 2 + [(1, 1, "inline", "x_1=a+2")] + [(2, 0, "display", "y = 1")] * 2


def test_repair_leaves_nothing_out(spark):
    """What tells whether a text is repaired at all knows everything that the repair changes."""
    texts = [x + c + y for c in [*map(chr, range(0x250)), *text.PDF_REPLACEMENTS, "\u0304", "\u0307", "\u02d9", "\u2003", "\u2028", "\u3000", "  ", " "] for x in ("a", "") for y in ("b", "", " 1")]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    assert df.where(~text.repair(F.col("t")).eqNullSafe(text.squeeze(text.repair_fragment(F.col("t"))))).count() == 0


def test_a_log_is_dealt_out_once(spark):
    """Repeated ids and the tail of a log are told on the same partitions."""
    rows = spark.createDataFrame([("j", f"i{i % 4}", i, "x") for i in range(6)] + [("k", "i0", 1, "y")], "job_id string, id string, sequence long, title string").localCheckpoint()
    out = events.merge_events([rows, rows], "job_id", 2)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted((r["job_id"], r["id"], r["sequence"]) for r in out.collect()) == [("j", "i2", 2), ("j", "i3", 3), ("k", "i0", 1)]
