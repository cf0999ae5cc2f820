"""Queries that read their source blocks more than once write them once, and chunks are cut as before."""

from quire.operators import chunks
from quire.plans import translation
from quire.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_source_blocks_are_made_once(spark):
    for name in ("plan_report", "j02_plan_coverage", "j19_quality_issues", "j19_u04_key_terms"):
        files = QUERIES[name](spark, FOLDER).inputFiles()
        assert files and not any("documents.parquet" in f for f in files), name


def test_chunks_are_cut_at_headings_and_sizes(spark):
    rows = [("a", i, r, t) for i, (r, t) in enumerate([("paragraph", "x" * 6), ("paragraph", "y" * 5), ("heading", "h"), ("paragraph", "z" * 30), ("paragraph", "w")])] + [("b", 7, "paragraph", "one")]
    got = chunks.assign_chunks(spark.createDataFrame(rows, "doc_id string, pos int, role string, text string"), 12).collect()
    assert sorted((r["doc_id"], r["pos"], r["chunk_no"]) for r in got) == [("a", 0, 1), ("a", 1, 1), ("a", 2, 2), ("a", 3, 2), ("a", 4, 3), ("b", 7, 1)]


def test_pieces_of_texts_are_not_shuffled(spark, monkeypatch):
    """A term is looked up where the pieces of a text are cut: they were dealt out by the piece, 21 million of them for 10,000 documents. A short glossary needs no pieces."""
    few = QUERIES["j19_u04_key_terms"](spark, FOLDER)
    monkeypatch.setattr(translation, "FEW_TERMS", 0, raising=False)
    many = QUERIES["j19_u04_key_terms"](spark, FOLDER)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "explode" in plan and "hashpartitioning(_key" not in plan
    assert sorted(few.collect()) == sorted(many.collect()) != []
