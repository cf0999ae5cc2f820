"""Cases of translation by a model: segments and batches of lines, and a model that fails by a rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.cases.common import query
from quire.plans import attempts
from quire.registry import LINES, line_blocks


def chunked_lines(spark, sf_dir):
    """Lines of documents in chunks of ten."""
    b = line_blocks(spark, sf_dir)
    return b.select("doc_id", F.floor(F.col("pos") / 10).cast("int").alias("chunk_no"), "pos", "role", "text", (F.col("role") != "heading").alias("requires_translation"))


BUDGET = 400


@query(
    f"""
WITH {LINES} SELECT doc_id, CAST(pos // 10 AS INTEGER) AS chunk_no, pos, text, md5(text) AS joined, true AS within FROM lines
"""
)
def u02_round_trip(spark, sf_dir):
    """Lines cut into segments, packed, and put together again; `within`: no batch of the document has more than its budget."""
    parts = attempts.batches(attempts.segments(chunked_lines(spark, sf_dir), BUDGET // 2), BUDGET)
    full = parts.where("NOT kept").groupBy("doc_id", "batch").agg(F.sum(F.length("text")).alias("n")).groupBy("doc_id").agg((F.max("n") <= BUDGET).alias("within"))
    back = attempts.reassembled(parts)
    b = chunked_lines(spark, sf_dir)
    return b.join(back.withColumnRenamed("text", "_back"), ["doc_id", "chunk_no", "pos"]).join(full, "doc_id", "left").select("doc_id", "chunk_no", "pos", "text", F.md5(F.col("_back").cast("binary")).alias("joined"), F.coalesce("within", F.lit(True)).alias("within"))


def unreliable(prompts: list[str], attempt: int) -> list[str | None]:
    """A model that goes by the number of document and chunk: some answers can't be read at first or at all, some are the source text, some lack a block, some are too short until a revision is asked for (attempt 0)."""
    import json

    out: list[str | None] = []
    for prompt in prompts:
        p = json.loads(prompt)
        rule = (int(p["doc_id"]) + p["chunk_no"]) % 6
        blocks = [{"pos": b["pos"], "role": b["role"], "translated_text": "译" * (len(b["text"]) // 2 + 1)} for b in p["blocks"]]
        if rule == 0 and attempt == 1:
            out.append("I can't do that.")
        elif rule == 1 and attempt:
            out.append('{"blocks": [{"pos": ')
        elif rule == 2 and attempt == 1 or rule == 3 and attempt:
            out.append(json.dumps({"blocks": [b | {"translated_text": s["text"]} for b, s in zip(blocks, p["blocks"], strict=True)]}))
        elif rule == 4:
            out.append("Here it is:\n```json\n" + json.dumps({"blocks": blocks[1:] or blocks}) + "\n```")
        elif rule == 5 and attempt:
            out.append(json.dumps({"blocks": [b | {"translated_text": "译文"} for b in blocks]}))
        else:
            out.append(json.dumps({"blocks": blocks}))
    return out


LEAK = r"len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) < 2 AND len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) / greatest(len(regexp_replace(text, '\s+', '', 'g')), 1) < 0.03 AND len(regexp_extract_all(text, '[A-Za-z][A-Za-z''’\-]*')) >= 3"


@query(
    rf"""
WITH {LINES}, b AS (SELECT doc_id, pos, CAST(pos // 10 AS INTEGER) AS chunk_no, text, role, role <> 'heading' AS wanted, (doc_id + pos // 10) % 6 AS rule, {LEAK} AS leak FROM lines),
c AS (SELECT *, coalesce(bool_or(leak) FILTER (wanted) OVER (PARTITION BY doc_id, chunk_no), false) AS leaky, count(*) FILTER (wanted) OVER (PARTITION BY doc_id, chunk_no) AS many, row_number() OVER (PARTITION BY doc_id, chunk_no, wanted ORDER BY pos) = 1 AS first, len(text) >= 80 AND 2 / len(text) < 0.18 AS short FROM b),
s AS (SELECT *, coalesce(bool_or(short) FILTER (wanted) OVER (PARTITION BY doc_id, chunk_no), false) AS revised, bool_or(leak) FILTER (wanted AND first AND rule = 4 AND many > 1) OVER (PARTITION BY doc_id, chunk_no) AS dropped_leak FROM c)
SELECT doc_id, chunk_no, pos,
  CASE WHEN NOT wanted THEN 0 WHEN rule = 0 THEN 2 WHEN rule = 1 THEN 3 WHEN rule = 2 THEN CASE WHEN leaky THEN 2 ELSE 1 END WHEN rule = 3 THEN CASE WHEN leaky THEN 3 ELSE 1 END WHEN rule = 4 AND coalesce(dropped_leak, false) THEN 3 ELSE 1 END AS attempt,
  CASE WHEN NOT wanted THEN NULL WHEN rule = 1 THEN 'unparseable_response' WHEN rule = 3 AND leak THEN 'target_language_mismatch' WHEN rule = 4 AND first AND many > 1 AND coalesce(dropped_leak, false) THEN 'target_language_mismatch' END AS reason,
  CASE WHEN NOT wanted OR rule IN (1, 3) OR (rule = 2 AND NOT leaky) OR (rule = 4 AND first AND many > 1) THEN text WHEN rule = 5 AND NOT revised THEN '译文' ELSE repeat('译', len(text) // 2 + 1) END AS translated_text,
  wanted AND rule = 5 AND revised AS revised
FROM s
"""
)
def u03_u04_attempts(spark, sf_dir):
    """Chunks of lines translated into Chinese by a model that fails by a rule."""
    sources = chunked_lines(spark, sf_dir).withColumn("preserve_tokens", F.array().cast("array<string>"))
    out = attempts.translated(sources, unreliable, "zh-CN")
    return out.select("doc_id", "chunk_no", "pos", "attempt", "reason", "translated_text", F.array_contains("quality_flags", attempts.REVISED).alias("revised"))


