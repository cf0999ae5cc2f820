"""Cases of files, assets and artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.cases.common import query
from quire.registry import BOXES, LINES, boxes, line_blocks
from quire.session import table
from quire.sources import files


def uploads(spark, sf_dir):
    """Documents as uploaded files: `doc_id`, `path`, `length`, `content`; every seventh with a mark of its type, every ninth said to be too long."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    suffix = F.element_at(F.array(*map(F.lit, ("pdf", "docx", "png", "txt", "exe", "PDF"))), (n % 6 + 1).cast("int"))
    mark = F.when(n % 7 == 0, F.when(n % 6 == 1, F.unhex(F.lit("504B0304"))).otherwise(F.lit("%PDF-1.7").cast("binary"))).otherwise(F.lit("").cast("binary"))
    content = F.concat(mark, F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return d.select("doc_id", F.concat(F.lit("/in/d"), n.cast("string"), F.lit("/file."), suffix).alias("path"), F.when(n % 9 == 0, 60_000_000).otherwise(F.octet_length(content)).alias("length"), content.alias("content"))


UPLOADS = """u AS (SELECT doc_id, '/in/d' || doc_id || '/file.' || ['pdf', 'docx', 'png', 'txt', 'exe', 'PDF'][doc_id % 6 + 1] AS path, CASE WHEN doc_id % 7 <> 0 THEN ''::BLOB WHEN doc_id % 6 = 1 THEN '\\x50\\x4B\\x03\\x04'::BLOB ELSE encode('%PDF-1.7') END || encode(coalesce(text, '')) AS content FROM documents),
files AS (SELECT *, CASE WHEN doc_id % 9 = 0 THEN 60000000 ELSE octet_length(content) END AS length FROM u)"""


@query(
    rf"""
WITH {UPLOADS}, k AS (SELECT *, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'image' WHEN 3 THEN 'text' WHEN 5 THEN 'pdf' END AS kind FROM files)
SELECT doc_id, kind, CASE WHEN length > 52428800 THEN 'too_large' WHEN kind IS NULL THEN 'unsupported_type' WHEN kind = 'pdf' AND NOT contains(hex(content)[1:2048], '255044462D') THEN 'wrong_content' WHEN kind = 'docx' AND hex(content)[1:8] <> '504B0304' THEN 'wrong_content' END AS reject FROM k
"""
)
def io11_io12_checked_uploads(spark, sf_dir):
    return files.checked(uploads(spark, sf_dir)).select("doc_id", "kind", "reject")


@query(f"WITH {UPLOADS} SELECT path, string_split(path, '/')[4] AS filename, CAST(length AS BIGINT) AS size_bytes, sha256(content) AS sha256 FROM files")
def io14_hs03_manifest(spark, sf_dir):
    out = files.manifest(uploads(spark, sf_dir))
    return out.withColumn("size_bytes", F.col("size_bytes").cast("long"))


@query(f"WITH {UPLOADS} SELECT doc_id, md5('data:text/plain;base64,' || base64(content)) AS url_md5 FROM files")
def io23_data_urls(spark, sf_dir):
    return uploads(spark, sf_dir).select("doc_id", F.md5(files.data_url(F.lit("text/plain"), F.col("content")).cast("binary")).alias("url_md5"))


@query("WITH f AS (SELECT l_orderkey AS doc_id, CASE l_linenumber WHEN 1 THEN 'layout' WHEN 2 THEN 'content' WHEN 3 THEN 'source' ELSE 'other' END AS role, '/f/' || l_partkey AS path FROM lineitem), r AS (SELECT *, CASE role WHEN 'source' THEN 0 WHEN 'content' THEN 1 ELSE 2 END AS k FROM f WHERE role <> 'layout') SELECT doc_id, path FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k, path) = 1")
def io13_chosen_uploads(spark, sf_dir):
    n = F.col("l_linenumber")
    role = F.when(n == 1, "layout").when(n == 2, "content").when(n == 3, "source").otherwise("other")
    return files.chosen_upload(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), role.alias("role"), F.concat(F.lit("/f/"), F.col("l_partkey").cast("string")).alias("path")))


@query(
    f"""
WITH {LINES}, b AS (SELECT doc_id, count(*) AS n_blocks, string_agg(text, ' ' ORDER BY pos)[1:600] AS excerpt FROM lines GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN d.doc_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_sources, coalesce(n_blocks, 0) AS n_blocks, CAST(CASE WHEN d.doc_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_assets, coalesce(excerpt, '') AS excerpt, CASE WHEN d.doc_id % 2 = 0 THEN 'a,b,c' ELSE 'a,b' END AS flags FROM documents d LEFT JOIN b USING (doc_id)
"""
)
def io15_input_summaries(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    flags = lambda *x: F.array(*map(F.lit, x)).alias("flags")
    sources = d.select("doc_id", flags("a", "b")).unionByName(d.where("doc_id % 2 = 0").select("doc_id", flags("b", "c")))
    out = files.input_summary(sources, line_blocks(spark, sf_dir), d.where("doc_id % 3 = 0"))
    return out.withColumn("flags", F.array_join("flags", ",")).withColumns({c: F.col(c).cast("long") for c in ("n_sources", "n_blocks", "n_assets")})


@query("WITH f AS (SELECT DISTINCT user_id AS doc_id, event_type || '.json' AS filename FROM events WHERE event_id % 11 = 0), d AS (SELECT DISTINCT doc_id FROM f), s AS (SELECT unnest(['click', 'view', 'audit']) AS name) SELECT d.doc_id, s.name, s.name || '.json' AS filename, f.doc_id IS NOT NULL AS available FROM d CROSS JOIN s LEFT JOIN f ON f.doc_id = d.doc_id AND f.filename = s.name || '.json'")
def io18_catalogue(spark, sf_dir):
    from quire.operators.jobs import catalogue

    e = table(spark, sf_dir, "events").where("event_id % 11 = 0").select(F.col("user_id").alias("doc_id"), F.concat("event_type", F.lit(".json")).alias("filename"))
    return catalogue(e, [(n, f"{n}.json") for n in ("click", "view", "audit")])


@query(f"WITH {BOXES}, a AS (SELECT doc_id, page_id, item_id, CASE kind WHEN 'table' THEN 'vector' ELSE kind END AS kind, round(x0 / 100) * 100 AS x0, round(y0 / 100) * 100 AS y0, round(x1 / 100) * 100 AS x1, round(y1 / 100) * 100 AS y1 FROM boxes) SELECT doc_id, page_id, item_id FROM a WHERE kind <> 'vector' OR (x1 - x0) * (y1 - y0) >= 36 QUALIFY row_number() OVER (PARTITION BY doc_id, page_id, x0, y0, x1, y1 ORDER BY item_id, kind) = 1")
def io19_kept_assets(spark, sf_dir):
    far = lambda c: (F.round(F.col("box")[c] / 100) * 100).alias(c)
    kind = F.when(F.col("kind") == "table", "vector").otherwise(F.col("kind"))
    a = boxes(spark, sf_dir).select("doc_id", "page_id", "item_id", kind.alias("kind"), F.struct(*map(far, ("x0", "y0", "x1", "y1"))).alias("box")).withColumn("pos", F.struct("item_id", "kind"))
    return files.kept_assets(a).select("doc_id", "page_id", "item_id")


# --- files of layout extractors -----------------------------------------------------------------------------


def _put(root):
    """A task that writes its files below a folder that all machines share, as Spark's writer would. Hadoop starts a process for the permissions of each local file, and one more for its checksum's, which took most of the time. A task that runs again puts the same names in place."""

    def put(batches):
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():05d}-layout.txt"
        attempt = f".{TaskContext.get().taskAttemptId()}"
        for batch in batches:
            for row in batch.to_pylist():
                where = f"{root}/doc={row['doc']}/kind={row['kind']}"
                os.makedirs(where, exist_ok=True)
                with open(f"{where}/{attempt}", "w", encoding="utf-8", newline="") as f:
                    f.write(row["value"] + "\n")
                os.replace(f"{where}/{attempt}", f"{where}/{name}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return put


def layout_files(spark, sf_dir):
    """A folder of JSON files: a document per conversation, a page per four turns; turns as items with lines, with contents nested four levels deep, or with tags. Every third document has its items in a content list."""
    from quire import scratch

    q = lambda c: F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)  # noqa: E731  (a string as JSON)
    t, n = F.col("text"), F.col("turn")
    part = lambda i, k: q(F.substring(t, i, k))
    lines = F.concat(F.lit('{"type":"Text","index":'), (100 - n).cast("string"), F.lit(',"bbox":[1,2,3,4],"lines":[{"spans":[{"content":'), part(1, 12), F.lit('},{"text":'), q(F.substring(t, 13, 100_000)), F.lit('},{"latex":"x"}]}],"odd":{"a":[1]}}'))
    tree = F.concat(F.lit('{"type":"list","bbox":[5,'), n.cast("string"), F.lit(',9,9],"content":{"zz":'), part(1, 8), F.lit(',"aa":[{"content":'), part(9, 8), F.lit(',"children":[{"content":[{"content":'), part(17, 8), F.lit(',"children":['), q(F.substring(t, 25, 100_000)), F.lit(',{"content":7}]}]}]}],"level":3}}'))
    tags = F.concat(F.lit('{"type":"table","index":"no number","table_body":'), q(F.concat(F.lit("<td>"), F.col("role"), F.lit("</td> "), t)), F.lit("}"))
    item = F.when(n % 3 == 0, lines).when(n % 3 == 1, tree).otherwise(tags)
    c = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    pages = c.groupBy("conv_id", F.floor(n / 4).cast("int").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("item")))), lambda x: x["item"]), ",").alias("items"))
    docs = pages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("page", "items"))).alias("p"))
    joined = lambda f: F.array_join(F.transform("p", f), ",")
    listed = F.col("conv_id") % 3 == 0
    own = F.concat(F.lit('{"pdf_info":['), joined(lambda x: F.concat(F.lit('{"para_blocks":['), F.when(listed, "").otherwise(x["items"]), F.lit("]}"))), F.lit("]}"))
    other = F.concat(F.lit("["), joined(lambda x: F.concat(F.lit("["), x["items"], F.lit("]"))), F.lit("]"))
    files = docs.select(F.col("conv_id").alias("doc"), F.explode(F.array(F.struct(F.lit("pages").alias("kind"), own.alias("value")), F.struct(F.lit("contents").alias("kind"), other.alias("value")))).alias("x")).select("doc", "x.kind", "x.value")
    folder = scratch.new_folder(spark, "layouts")
    # A file costs its making, not its bytes: a fixed number of tasks, by a key that no exchange before has (else Spark leaves this one out and puts tasks together by size).
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = files.repartition(many, F.hash("doc"))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
        dealt.mapInArrow(_put(path.toUri().getPath()), "n long").agg(F.sum("n")).collect()
    else:  # each task moves its own files into place
        dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("doc", "kind").text(folder)
    return folder


@query(
    r"""
WITH t AS (SELECT conv_id, turn, turn // 4 AS page, turn % 3 AS k, role, text FROM conversations), i AS (
  SELECT *, CASE k WHEN 0 THEN 'text' WHEN 1 THEN 'list' ELSE 'table' END AS type, CASE WHEN k = 0 THEN 100 - turn END AS idx, CASE k WHEN 0 THEN 2 WHEN 1 THEN turn ELSE 0 END AS y, CASE k WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 0 END AS x,
    trim(regexp_replace(CASE k WHEN 0 THEN text[1:12] || ' ' || text[13:] WHEN 1 THEN text[1:8] || ' ' || text[9:16] || ' ' || text[17:24] || ' ' || text[25:] ELSE role || ' ' || text END, '\s+', ' ', 'g')) AS told FROM t
), once AS (SELECT *, row_number() OVER (PARTITION BY conv_id, page, type, idx, y, x, told[1:80] ORDER BY turn) AS again FROM i)
SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(page - first AS INTEGER) AS page_index, CAST(row_number() OVER (PARTITION BY conv_id, page ORDER BY coalesce(idx, 1000000), y, x, turn) - 1 AS INTEGER) AS pos, type, told AS text
FROM once JOIN (SELECT conv_id, min(turn // 4) AS first FROM conversations GROUP BY conv_id) USING (conv_id) WHERE again = 1
"""
)
def io02_io03_io04_files(spark, sf_dir):
    from quire.sources import layout_tree

    files = layout_tree.read_files(spark, layout_files(spark, sf_dir), "/kind=pages/", "/kind=contents/", r"/doc=([^/]+)/")
    return layout_tree.items(files).select("doc_id", "page_index", "pos", "type", "text")


# --- contracts ----------------------------------------------------------------------------------------------


@query(
    """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL), c AS (SELECT DISTINCT conv_id FROM t),
v AS (
  SELECT conv_id, '$.source_blocks[' || i || '].role' AS path, 'enum' AS code FROM t WHERE role <> 'user'
  UNION ALL SELECT conv_id, '$.source_blocks[' || i || '].block_id', 'too_short' FROM t WHERE turn % 5 = 4
  UNION ALL SELECT conv_id, '$.source_blocks[' || i || '].source_text', 'missing' FROM t WHERE text IS NULL OR len(text) % 7 = 0
  UNION ALL SELECT conv_id, '$.source_blocks[' || i || '].requires_translation', 'type' FROM t WHERE turn = 3
  UNION ALL SELECT conv_id, '$.source_blocks[' || i || '].x0', 'extra' FROM t WHERE conv_id % 4 = 1
  UNION ALL SELECT conv_id, '$.constraints.max_output_ratio', 'range' FROM c WHERE conv_id % 3 < 2
  UNION ALL SELECT conv_id, '$.chunk_id', 'missing' FROM c WHERE conv_id % 6 = 5
)
SELECT * FROM v
"""
)
def io24_violations(spark, sf_dir):
    """Conversations as chunks to translate, with what their roles, texts and numbers do to the contract."""
    from quire import contracts

    n = F.col("turn")
    block = F.struct(
        F.when(n % 5 == 4, "").otherwise(n.cast("string")).alias("block_id"), F.when(F.col("role") == "user", "paragraph").otherwise(F.col("role")).alias("role"), F.when(F.length("text") % 7 != 0, F.col("text")).alias("source_text"),
        F.when(n != 3, F.to_json(F.struct(F.lit(True).alias("x"))).substr(6, 4)).alias("requires_translation"), F.when(F.col("conv_id") % 4 == 1, 1).alias("x0"),
    )
    c = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("bs"))
    chunk = F.struct(F.when(F.col("conv_id") % 6 != 5, F.col("conv_id").cast("string")).alias("chunk_id"), F.transform("bs", lambda x: x["b"]).alias("source_blocks"), F.struct((F.col("conv_id") % 3 - 1).alias("max_output_ratio")).alias("constraints"))
    # Blocks say true as a word of JSON, and those of turn 3 as a text.
    text = F.regexp_replace(F.regexp_replace(F.to_json(chunk), '"requires_translation":"true"', '"requires_translation":true'), '("role":"[a-z]*"(?:,"source_text":"(?:[^"\\\\]|\\\\.)*")?)(,"x0":1)?\\}', '$1,"requires_translation":"yes"$2}')
    return contracts.violations(c.select("conv_id", text.alias("value")), "value", "translation-chunk").select("conv_id", "path", "code")


# --- logs ---------------------------------------------------------------------------------------------------


def job_sources(spark, sf_dir):
    """(jobs, workflows, chunks, progress, artifacts): orders as jobs of a document each; their lines are steps, chunks and artifacts. Every seventh workflow belongs to another job."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").distinct()
    k = F.col("o_orderkey")
    job, doc = k.cast("string"), F.concat(F.lit("d"), k.cast("string"))
    states = F.array(*[F.lit(x) for x in ("queued", "translating", "completed", "failed", "canceled")])
    jobs = o.select(job.alias("job_id"), doc.alias("doc_id"), F.get(states, (F.col("o_custkey") % 5).cast("int")).alias("status"), (F.col("o_custkey") % 4 / 4).alias("progress"), F.concat(F.lit("m"), job).alias("message"), F.when(F.col("o_custkey") % 5 == 3, "broken").alias("error"), F.concat(job, F.lit(".pdf")).alias("filename"), F.lit("zh").alias("target_lang"))
    i, n = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey")), F.col("l_linenumber")
    key, part = F.col("l_orderkey"), F.col("l_partkey")
    names = F.array(*[F.lit(x) for x in ("read_input", "translate", "odd_step", "render")])
    none = F.array().cast("array<string>")
    workflows = i.select(F.concat(F.lit("d"), key.cast("string")).alias("doc_id"), F.when(key % 7 == 0, "other").when(key % 2 == 0, key.cast("string")).alias("workflow_job"), (n - 1).alias("n"), F.lit("").alias("step_id"), F.get(names, (part % 4).cast("int")).alias("name"),
        F.when(n % 3 == 0, "failed").when(n % 3 == 1, "completed").otherwise("repaired").alias("status"), F.lit("").alias("message"), F.when(n % 3 == 0, F.concat(F.lit("e"), part.cast("string"))).alias("error"), (n * 0.5).alias("progress"), F.array(F.lit("in")).alias("inputs"), none.alias("outputs"), none.alias("flags"))
    chunk = lambda rows, owner, name: rows.select(owner.alias(name), F.concat(F.lit("c"), n.cast("string")).alias("chunk_id"), n.alias("index"), F.lit(9).alias("total"), F.when(part % 3 == 0, "").otherwise("completed").alias("status"), F.concat(F.lit("p"), part.cast("string")).alias("message"), F.lit(None).cast("string").alias("error"), F.lit(0.25).alias("progress"), F.array(F.lit(" a  b "), F.lit("")).alias("flags"))
    chunks = chunk(i.where(key % 3 == 0), key.cast("string"), "job_id")
    progress = chunk(i, F.concat(F.lit("d"), key.cast("string")), "doc_id")
    artifacts = i.select(F.concat(F.lit("d"), key.cast("string")).alias("doc_id"), n.alias("rank"), F.concat(F.lit("artifact"), n.cast("string")).alias("name"))
    return jobs, workflows, chunks, progress, artifacts


@query(
    """
WITH o AS (SELECT DISTINCT o_orderkey AS k, o_custkey AS c FROM orders), i AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
j AS (SELECT k, ['queued', 'translating', 'completed', 'failed', 'canceled'][c % 5 + 1] AS status, c % 4 / 4.0 AS progress, 'm' || k AS message, CASE WHEN c % 5 = 3 THEN 'broken' END AS error, k % 7 = 0 AND k IN (SELECT k FROM i) AS stale FROM o),
s AS (SELECT i.k, n, ['read_input', 'translate', 'odd_step', 'render'][p % 4 + 1] AS name, ['Read input', 'Translate chunks', 'Odd Step', 'Render preview'][p % 4 + 1] AS title, ['Read input', 'Translate chunks', 'odd_step', 'Render preview'][p % 4 + 1] AS message, CASE n % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'completed' ELSE 'repaired' END AS status, CASE WHEN n % 3 = 0 THEN 'e' || p END AS error FROM i JOIN j ON j.k = i.k WHERE NOT stale),
b AS (SELECT k, min(100 + (n - 1) * 100) AS base FROM s WHERE name = 'translate' GROUP BY k),
c AS (SELECT i.k, n, CASE WHEN p % 3 = 0 THEN 'queued' ELSE 'completed' END AS status, 'p' || p AS message FROM i JOIN j ON j.k = i.k WHERE NOT stale OR i.k % 3 = 0),
a AS (SELECT i.k, list('artifact' || n ORDER BY n) AS names FROM i JOIN j ON j.k = i.k WHERE NOT stale GROUP BY i.k),
e AS (
  SELECT k, concat_ws(chr(31), k, 'job', status, printf('%.4f', progress), message, coalesce(error, '')) AS raw, 10 AS sequence, 'job' AS source, CASE status WHEN 'completed' THEN 'success' WHEN 'failed' THEN 'error' WHEN 'canceled' THEN 'warning' ELSE 'info' END AS level,
    CASE status WHEN 'queued' THEN 'Job queued' WHEN 'translating' THEN 'Translating content' ELSE 'Job ' || status END AS title, coalesce(error, message) AS message, 'File: ' || k || '.pdf|Target: zh' AS details FROM j
  UNION ALL SELECT k, concat_ws(chr(31), k, 'workflow', n - 1, name, status, message, coalesce(error, '')), 100 + (n - 1) * 100, 'workflow', CASE status WHEN 'failed' THEN 'error' WHEN 'completed' THEN 'success' ELSE 'warning' END, title || ' ' || status, coalesce(error, message), 'Inputs: in' FROM s
  UNION ALL SELECT c.k, concat_ws(chr(31), c.k, 'chunk', 'c' || n, status, '0.2500', message), coalesce(base, 600) + 1 + n, 'chunk', CASE status WHEN 'completed' THEN 'success' ELSE 'info' END, 'Chunk ' || n || '/9: ' || status, message, 'a b' FROM c LEFT JOIN b ON b.k = c.k
  UNION ALL SELECT a.k, concat_ws(chr(31), a.k, 'artifact', array_to_string(names, chr(31))), 9000, 'artifact', CASE j.status WHEN 'completed' THEN 'success' ELSE 'info' END, 'Artifacts updated', len(names) || ' debug artifact(s) available', array_to_string(names, '|') FROM a JOIN j ON j.k = a.k
)
SELECT CAST(k AS VARCHAR) AS job_id, k || ':' || substr(sha1(raw), 1, 16) AS id, CAST(sequence AS BIGINT) AS sequence, source, level, title, message, details FROM e QUALIFY row_number() OVER (PARTITION BY k ORDER BY sequence DESC, id DESC) <= 8
"""
)
def w12_job_logs(spark, sf_dir):
    """The last eight events of each job."""
    from quire.operators import joblog

    out = joblog.job_logs(*job_sources(spark, sf_dir), limit=8)
    return out.select("job_id", "id", "sequence", "source", "level", "title", "message", F.array_join("details", "|").alias("details"))
