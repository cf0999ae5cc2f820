"""Inline formulas from spans and from texts, and formulas grown over the blocks of a page."""

from quire.operators import clusters, spanruns

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
BLOCK = f"doc_id string, block_id int, role string, text string, box {BOX}"
SPAN = f"doc_id string, block_id int, line int, n int, text string, font string, size double, box {BOX}"
LINE = f"doc_id string, block_id int, line int, text string, box {BOX}"
WHOLE = (0.0, 0.0, 100.0, 10.0)


def found(spark, *blocks, role="paragraph"):
    """blocks: each a list of lines, each a list of (text, font, size, y)."""
    b, s, lines = [], [], []
    for i, each in enumerate(blocks):
        if isinstance(each, str):
            b.append(("d", i, role, each, WHOLE))
            lines.append(("d", i, 0, each, WHOLE))
            continue
        texts = []
        for k, line in enumerate(each):
            for n, (text, font, size, y) in enumerate(line):
                s.append(("d", i, k, n, text, font, size, (n * 10.0, y, n * 10.0 + 9, y + size)))
            texts.append("".join(x[0] for x in line))
            lines.append(("d", i, k, texts[-1], WHOLE))
        b.append(("d", i, role, "\n".join(texts), WHOLE))
    out = spanruns.inline_runs(spark.createDataFrame(b, BLOCK), spark.createDataFrame(s, SPAN), spark.createDataFrame(lines, LINE)).collect()
    return {(r["block_id"], r["start"], r["source_text"]): r for r in out}


def t(text, font="Times New Roman", size=10.0, y=0.0):
    return (text, font, size, y)


def test_runs_by_font_sign_and_script(spark):
    got = found(
        spark,
        [[t("where "), t("v", "ABC+CMMI10"), t("s", "Times", 6.0, 6.0), t(" = "), t("k", "CMMI10"), t(" is the speed")]],
        [[t("∞", "Cambria Math"), t("and the limit holds.")]],  # prose goes on right behind it
        [[t("the value α"), t(" of it")], [t("then "), t("x^"), t("{2}"), t(", and more")]],
        [[t("42", "CMMI10")]],  # a number that is all of its block
        [[t("plain", "CMMI10"), t(" words")]],
        [[t("so "), t("(cid:12)", "Symbol"), t(" it")]],
    )
    one = got[0, 6, "vs = k"]
    assert one["spans"] == [1, 2, 3, 4] and one["end"] == 12
    assert one["flags"] == ["formula_inline_candidate", "formula_source_preserved", "formula_math_font_preserved", "formula_math_symbol_preserved", "formula_script_span_preserved"]
    assert {k[0] for k in got} == {0, 2, 5}
    assert (2, 23, "x^{2}") in got  # an open script is bridged
    assert "formula_cid_glyph_preserved" in got[5, 3, "(cid:12)"]["flags"]


def test_text_without_spans(spark):
    got = found(spark, "we set x = 12 and y_1 here", "nothing to see", "mail me@site.org today", "AB-1234 then", "")
    assert {k for k in got} == {(0, 7, "x = 12"), (0, 18, "y_1")}
    row = got[0, 7, "x = 12"]
    assert row["flags"] == ["formula_inline_text_only", "formula_estimated_bbox"] and abs(row["box"]["x0"] - 100 * 7 / 26) < 1e-9 and row["spans"] == []
    assert found(spark, "we set x = 12", role="heading") == {}


PART = f"doc_id string, page_id int, block_id int, ord int, column int, role string, text string, box {BOX}, formula_id string, independent boolean, display boolean"


def part(i, text, y, x=0.0, column=0, role="paragraph", high=10.0, display=False, page=0):
    return ("d", page, i, i, column, role, text, (x, y, x + 40.0, y + high), None, False, display)


def merged(spark, rows):
    return {r["block_id"]: r for r in clusters.merged(spark.createDataFrame(rows, PART)).collect()}


def test_a_chain_of_ten_parts_is_one_block(spark):
    chain = [part(i, f"x_{i} = {i}", 18.0 * i) for i in range(10)]  # each is within ten points of its neighbours only
    got = merged(spark, [*chain, part(10, "These words are prose and stay alone here", 185.0), part(11, "y = 2", 300.0), part(12, "z = 3", 0.0, page=1)])
    assert len(got) == 4 and got[0]["n_members"] == 10 and got[0]["members"] == list(range(10))
    assert got[0]["text"] == " ".join(f"x_{i} = {i}" for i in range(10)) and tuple(got[0]["box"]) == (0.0, 0.0, 40.0, 172.0)
    assert [got[i]["ord"] for i in (0, 10, 11)] == [0, 1, 2] and got[12]["ord"] == 0


def test_a_band_grows_up_and_keeps_to_its_column(spark):
    rows = [part(0, "k3", 0.0), part(1, "a = b", 30.0, column=0), part(2, "c = d", 15.0), part(3, "e = f", 30.0, x=400.0, column=1), part(4, "g = h", 30.0, x=100.0, column=1, display=True), part(5, "A heading = 1", 30.0, role="heading")]
    got = merged(spark, rows)
    # The seed is block 1: 2 is above it, 0 above that, 4 beside it in the other column; 3 stands apart, 5 has no fitting role.
    assert set(got) == {3, 4, 5} and got[4]["members"] == [0, 2, 1, 4] and got[4]["seed"] == 1 and got[4]["text"] == "k3 c = d a = b g = h"
    assert got[4]["ord"] == 0


def test_no_blocks(spark):
    assert merged(spark, []) == {} and found(spark, "x") == {}


def test_running_numbers(spark):
    import random

    from quire.operators import formulas

    draw, rows, want = random.Random(2), [], {}
    for doc in "ab":
        last = 0
        for pos in range(40):
            own = draw.choice([None, None, None, 3, last, last + 5])
            rows.append((doc, pos, 0, f"{doc}{pos}", f"x = {pos} ({own})" if own is not None else f"x = {pos}", "display" if pos % 9 else "inline"))
            if pos % 9:
                want[f"{doc}{pos}"] = own if own is not None else last + 1
                last = max(last, want[f"{doc}{pos}"])
    df = spark.createDataFrame(rows, "doc_id string, pos int, n int, formula_id string, source_text string, mode string")
    assert {r["formula_id"]: r["number"] for r in formulas.numbered(df).collect()} == want


def test_long_lines_of_prose(spark):
    from pyspark.sql import functions as F

    from quire.functions import predicates
    from quire.functions.fence import fenced
    from quire.operators import formulas

    rows = spark.createDataFrame([("word " * 20_000,), ("some words, here",), ("some words or here",)], "text string")
    told = fenced(rows, *formulas.cut_steps(F.col("text"), "c", raw=True)).select(predicates.prose(F.col("text")).alias("prose"), "c")
    assert [tuple(r) for r in told.collect()] == [(True, ""), (True, ""), (False, "some words or here")]


def test_accents_are_edges_of_words_as_in_the_sql(spark):
    math = "ABC+CMMI10"
    got = found(spark, [[t("des "), t("Iees ", math), t("ciónción ", math), t("+1", math), t(" al"), t("go")]])
    assert [k[2] for k in got] == ["Iees ciónción +1"]


def test_spans_in_their_lines_are_not_shuffled(spark):
    """Each word was a row of its own, shuffled and sorted by line: most of what the query put on disk."""
    from quire.cases import spanned

    folder = "/root/testdata/sf0.001"
    blocks, _, lines = spanned.word_spans(spark, folder)
    own = spanruns.inline_runs(blocks, None, lines)
    flat = spanruns.inline_runs(blocks, lines.selectExpr("doc_id", "block_id", "line", "inline(spans)"), lines.drop("spans"))
    assert sorted(map(str, own.collect())) == sorted(map(str, flat.collect())) != []
    plan = spanned.ar02_span_runs(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and not any("hashpartitioning" in x and "line#" in x for x in plan.splitlines())


def test_sources_of_candidates_are_made_once(spark):
    """Documents were read and cut into lines anew for each use of each of the five tables."""
    from quire.cases import spanned

    for rows in spanned.candidate_sources(spark, "/root/testdata/sf0.001"):
        assert not any("documents.parquet" in f for f in rows.inputFiles())
