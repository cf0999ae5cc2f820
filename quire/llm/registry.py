"""Queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.llm import ann, bpe, hilbert, iso, jaccard, kmeans, langid, licences, lines, lm, mixing, repair, simhash
from quire.session import table


def op1_line_dedup(spark, sf_dir):
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


OP1_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents
), starts AS (
  SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS pos FROM split WHERE len(l) >= 3
), windows AS (
  SELECT doc_id, pos, l[pos + 1] || chr(10) || l[pos + 2] || chr(10) || l[pos + 3] AS w FROM starts
), ranked AS (
  SELECT doc_id, pos,
         first_value(doc_id) OVER t AS first_doc, first_value(pos) OVER t AS first_pos
  FROM windows WHERE replace(replace(w, chr(10), ''), ' ', '') <> ''
  WINDOW t AS (PARTITION BY w ORDER BY doc_id, pos)
), covered AS (
  SELECT DISTINCT doc_id, pos + k AS pos
  FROM ranked, (SELECT unnest([0, 1, 2]) AS k)
  WHERE doc_id > first_doc OR (doc_id = first_doc AND pos >= first_pos + 3)
), each_line AS (
  SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM split
), kept AS (
  SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.pos) AS text, count(*) AS n
  FROM each_line e ANTI JOIN covered c ON e.doc_id = c.doc_id AND e.pos = c.pos
  GROUP BY e.doc_id
)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS INTEGER) AS n_lines,
       CAST(coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(k.n, 0) AS INTEGER) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN md5(coalesce(k.text, '')) END AS kept_md5
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op4_source_mix(spark, sf_dir):
    out = mixing.plan_mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '|' || md5(coalesce(text, ''))) || '|quire-mix-1'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, CAST(source_size * 2 AS DOUBLE) AS cap,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w,
         1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS ask
  FROM sources
), levels AS (
  SELECT *, (ask - coalesce(sum(cap) OVER b, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS lv
  FROM weighed WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), filled AS (
  SELECT *, max(CASE WHEN cap / w > lv THEN lv END) OVER () AS water FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * w) END AS target FROM filled
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets
)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, r.source_size, r.target,
       CAST(d.size * (floor(r.rate) + CAST(d.draw < r.rate - floor(r.rate) AS INTEGER)) AS BIGINT) AS taken,
       CAST(floor(r.rate) + CAST(d.draw < r.rate - floor(r.rate) AS INTEGER) AS INTEGER) AS copies
FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source
"""

def op7_byte_bpe(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode(docs, tokens, public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"), carry=["doc_id"])


def op9_simhash(spark, sf_dir):
    out = simhash.near_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    out = langid.identify(docs, model, carry=["doc_id"])
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_media_columns(spark, sf_dir):
    digests = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return iso.media_columns(table(spark, sf_dir, "documents"), digests, carry=["doc_id"])


def op2_context_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = langid.held_out(parts=7, part=2)
    out = lm.score(docs, ~held, carry=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op5_one_bit_codes(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


def op8_hilbert_shards(spark, sf_dir):
    return hilbert.shard(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op10_license_scan(spark, sf_dir):
    out = licences.scan(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", "license", "dice", "first_word", "end_word", F.size("matches").alias("n_matches"))


def op11_kd_filter(spark, sf_dir):
    return kmeans.cluster(table(spark, sf_dir, "embeddings"))


def _op11_sql(k: int = 8, rounds: int = 10) -> str:
    nearest = """(SELECT * FROM (SELECT e.rid, e.vec_id, e.v, c.c, CAST(list_sum(list_transform(list_zip(e.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
  FROM kept e CROSS JOIN {c} c) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)"""
    steps = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < {k}
)"""]
    for i in range(rounds):
        steps.append(f"""a{i} AS MATERIALIZED {nearest.format(c=f"c{i}")}, m{i} AS MATERIALIZED (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS v
  FROM (SELECT c, pos, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(range(1, 65)) AS pos, unnest(v) AS x FROM a{i}) GROUP BY c, pos) GROUP BY c
), c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN m{i} m ON m.c = o.c)""")
    last = f"c{rounds}"
    steps.append(f"last AS MATERIALIZED {nearest.format(c=last)}")
    return "WITH " + ", ".join(steps) + f"""
SELECT l.vec_id, CAST(l.c AS INTEGER) AS cluster, l.d AS distance, CAST(sum(l.d) OVER (PARTITION BY l.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(l.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM last l JOIN {last} k ON k.c = l.c
"""


def op12_cost_layers(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return repair.repair(repair.damaged(rows).withColumnsRenamed({"conv": "conv_id"}), rows)


# The states nothing, s, u, a are z, s, u, a; each holds the least (cost, audit) so far. Closing inserts come last.
OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT conv_id, turn, xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)),
           lambda h, b: list_reduce(range(8), lambda k, i: xor(k >> 1, CASE WHEN k & 1 = 1 THEN 3988292384 ELSE 0 END), xor(h, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS d
  FROM (SELECT DISTINCT conv_id, turn FROM conversations)
), harmed AS (
  SELECT c.conv_id, c.turn, CASE WHEN d = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, unnest(range(0, CASE d WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM conversations c JOIN crc ON crc.conv_id IS NOT DISTINCT FROM c.conv_id AND crc.turn IS NOT DISTINCT FROM c.turn WHERE d <> 0
), rows AS MATERIALIZED (
  SELECT *, row_number() OVER o AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again, left(role, 1) AS r, lag(left(role, 1)) OVER o AS before
  FROM harmed WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), faults AS MATERIALIZED (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM rows
), best AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, {'c': CAST(0 AS BIGINT), 'e': ''} AS z, {'c': CAST(1000000000 AS BIGINT), 'e': ''} AS s, {'c': CAST(1000000000 AS BIGINT), 'e': ''} AS u, {'c': CAST(1000000000 AS BIGINT), 'e': ''} AS a
  FROM (SELECT DISTINCT conv_id FROM faults)
  UNION ALL
  SELECT conv_id, n,
         {'c': z.c + 3, 'e': z.e || 'D'},
         list_min([{'c': s.c + 3, 'e': s.e || 'D'}, {'c': z.c + keep_s, 'e': z.e || 'K'}]),
         list_min([{'c': u.c + 3, 'e': u.e || 'D'}, {'c': w.c + keep_u, 'e': w.e || 'K'}, {'c': w.c + title, 'e': w.e || 'R'}]),
         list_min([{'c': a.c + 3, 'e': a.e || 'D'}, {'c': u.c + keep_a, 'e': u.e || 'K'}, {'c': u.c + title, 'e': u.e || 'R'}])
  FROM (
    SELECT *, list_min([z, s, a]) AS w FROM (
      SELECT *, list_min([a0, {'c': u.c + 2, 'e': u.e || 'I'}]) AS a FROM (
        SELECT b.conv_id, f.n, b.z, b.s, b.a AS a0,
               list_min([b.u, {'c': b.z.c + 2, 'e': b.z.e || 'I'}, {'c': b.s.c + 2, 'e': b.s.e || 'I'}, {'c': b.a.c + 2, 'e': b.a.e || 'I'}]) AS u,
               CASE WHEN r = 's' THEN c ELSE 1000000000 END AS keep_s, CASE WHEN r = 'u' THEN c ELSE 1000000000 END AS keep_u, CASE WHEN r = 'a' THEN c ELSE 1000000000 END AS keep_a, c + 2 AS title
        FROM best b JOIN (SELECT *, CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 1 ELSE 1000000000 END AS c FROM faults) f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.n = b.n + 1
      )
    )
  )
), ended AS MATERIALIZED (
  SELECT conv_id, list_min([z, a, {'c': u.c + 2, 'e': u.e || 'I'}, {'c': s.c + 4, 'e': s.e || 'II'}]) AS x
  FROM best QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1
), letters AS (
  SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS n FROM (SELECT conv_id, x.e AS audit, unnest(range(1, len(x.e) + 1)) AS i, unnest(string_split(x.e, '')) AS e FROM ended WHERE x.e <> '')
), kept AS (
  SELECT l.conv_id, l.i, l.e, f.role, f.text, max(CASE WHEN l.e = 'K' AND f.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS first_s, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.i) AS k
  FROM letters l LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.n = l.n AND l.e <> 'I' WHERE l.e <> 'D'
), told AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (k - first_s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY i)) AS sha FROM kept GROUP BY conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (n > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(c.blank, 0) AS BIGINT) AS blank, CAST(coalesce(c.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(c.truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(c.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(e.x.c, 0) AS BIGINT) AS cost, coalesce(e.x.e, '') AS audit, coalesce(t.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def op13_size_aware(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g
  FROM split
), grams AS MATERIALIZED (
  SELECT doc_id, CAST(len(g) AS BIGINT) AS n, hash(unnest(g)) AS h FROM sets
), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION
  SELECT e.y, r.r FROM reach r JOIN (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links) e ON e.x = r.doc_id
)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(r.r) AS component_id FROM sets s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.g
"""


QUERIES = {"op13_size_aware": op13_size_aware, "op12_cost_layers": op12_cost_layers, "op11_kd_filter": op11_kd_filter, "op10_license_scan": op10_license_scan, "op5_one_bit_codes": op5_one_bit_codes, "op8_hilbert_shards": op8_hilbert_shards, "op2_context_mixing": op2_context_mixing, "op3_language_id": op3_language_id, "op6_media_columns": op6_media_columns, "op9_simhash": op9_simhash, "op7_byte_bpe": op7_byte_bpe, "op1_line_dedup": op1_line_dedup, "op4_source_mix": op4_source_mix}
ORACLES = {"op13_size_aware": OP13_SQL, "op12_cost_layers": OP12_SQL, "op11_kd_filter": _op11_sql(), "op1_line_dedup": OP1_SQL, "op4_source_mix": OP4_SQL}
