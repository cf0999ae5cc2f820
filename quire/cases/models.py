"""Cases of model answers, caches and providers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.cases.common import Options, query
from quire.functions import model_answers
from quire.operators import formulas, sections
from quire.plans import translation
from quire.registry import CHUNKS, FORMULA_BLOCKS, SECTIONS, formula_blocks, line_blocks, source_blocks
from quire.session import table

REPLIES = Options('Sure: ```{"a": 1} {"blocks": [1, 2]}``` done', '{"blocks": []}', "no json {here", '{"x": {"blocks": 3}}', '{"broken": {"blocks": [4]}', "", None)


@query("WITH " + REPLIES.sql() + r""" SELECT event_id, CASE WHEN text LIKE '%"blocks"%' THEN regexp_extract(text, '\{"blocks": (?:\[[^\]]*\]|\d)\}') END AS found FROM t""")
def js01_first_objects(spark, sf_dir):
    return REPLIES.rows(spark, sf_dir).select("event_id", model_answers.first_object(F.col("text"), "blocks").alias("found"))


@query(f"WITH {SECTIONS} SELECT doc_id, pos, kind || '_' || printf('%02d', row_number() OVER (PARTITION BY doc_id ORDER BY pos)) AS section_id FROM kinded")
def w11_section_ids(spark, sf_dir):
    return sections.sections(line_blocks(spark, sf_dir)).select("doc_id", "pos", "section_id")


@query(f"WITH RECURSIVE {CHUNKS}, k AS (SELECT doc_id, chunk_no, sha1(CAST(to_json(list({{'pos': pos, 'role': role, 'text': text}} ORDER BY pos)) AS VARCHAR)) AS cache_key FROM chunked GROUP BY doc_id, chunk_no), c AS (SELECT cache_key, arg_min(CASE WHEN doc_id % 3 = 0 THEN '{{\"n\": ' || chunk_no || '}}' ELSE '' END, doc_id * 100000 + chunk_no) AS p FROM k WHERE doc_id % 3 <> 2 GROUP BY cache_key) SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, k.cache_key, nullif(p, '') AS plan_json FROM k LEFT JOIN c ON k.cache_key = c.cache_key")
def j18_cached_plans(spark, sf_dir):
    """Chunks by the hash of their content; the cache has the plan of the first document of those with the same content, of two in three documents, every other one broken."""
    sources = source_blocks(spark, sf_dir)
    keyed = translation.cached(sources, spark.createDataFrame([], "cache_key string, plan_json string")).drop("plan_json")
    plan = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"n": '), F.col("chunk_no").cast("string"), F.lit("}"))).otherwise(F.lit('{"n": '))
    cache = keyed.where("doc_id % 3 <> 2").groupBy("cache_key").agg(F.min_by(plan, F.struct("doc_id", "chunk_no")).alias("plan_json"))
    return translation.cached(sources, cache).select("doc_id", "chunk_no", "cache_key", "plan_json")


@query(
    rf"""
WITH {FORMULA_BLOCKS} SELECT doc_id, pos, CASE WHEN whole AND pos % 8 = 0 THEN 'y = 1' WHEN whole THEN regexp_replace(text, ' \((\d)\)$', ' \\tag{{\1}}') WHEN pos % 3 = 0 THEN 'z = 2' ELSE replace(m, 'α', ' \alpha ') END AS latex,
  CASE WHEN whole AND pos % 8 = 0 THEN 'provider0' WHEN NOT whole AND pos % 3 = 0 THEN 'provider1' ELSE 'text' END AS provider, CASE WHEN whole AND pos % 8 = 0 THEN 0.9 WHEN NOT whole AND pos % 3 = 0 THEN 0.7 ELSE 0.96 END::DOUBLE AS confidence FROM found WHERE m <> ''
"""
)
def u05_u06_u07_providers(spark, sf_dir):
    """Two recognisers before the text path: the first accepted answer counts, prose and nothing are refused."""
    found = formulas.detect(formula_blocks(spark, sf_dir))
    answer = lambda latex, c: F.struct(latex.alias("latex"), F.lit(c).alias("confidence"))
    first = lambda source: answer(F.when((F.col("mode") == "display") & (F.col("pos") % 8 == 0), "y = 1").otherwise("only a few words of prose that is not a formula"), 0.9)
    second = lambda source: answer(F.when((F.col("mode") == "inline") & (F.col("pos") % 3 == 0), "z = 2").otherwise(""), 0.7)
    return formulas.recognise(found, [first, second]).select("doc_id", "pos", "latex", "provider", "confidence")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'RuntimeError: no answer' END AS failure, CASE WHEN event_id % 5 <> 0 THEN upper(event_type) || '!' END AS result FROM events")
def ss02_chunk_work(spark, sf_dir):
    """Work on batches of texts in which every fifth fails."""
    from quire.plans import workflow

    def shout(texts):
        if any(t.startswith("bad") for t in texts):
            raise RuntimeError("no answer")
        return [t.upper() + "!" for t in texts]

    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.when(F.col("event_id") % 5 == 0, "bad ").otherwise(""), "event_type").alias("text"))
    return workflow.failures_kept(e, shout).select("event_id", "result", "failure")
