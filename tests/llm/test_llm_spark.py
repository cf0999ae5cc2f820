"""The operators on small tables with nulls, empty and long texts, repeats, and clashing names."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quire.llm import ann, bpe, common, components, hilbert, iso, langid, licences, lines, lm, mixing, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINES = "one line here\ntwo line here\nthree line here"
ROWS = [
    (1, LINES + "\nfour", "en", "a", 1),
    (2, "start\n" + LINES + "\nend", "en", "a", 1),
    (3, "", "en", "b", 0),
    (4, None, None, None, None),
    (5, "word " * 20_000, "en", "b", 1),
    (6, LINES + "\nfour", "en", None, 1),
    (6, LINES + "\nfour", "en", None, 1),
    (None, "no id", "en", "b", 1),
    (8, " \n \n \n \n ", None, "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_lines(rows):
    """First occurrences by (id, text hash aside, position); later windows that don't overlap the first are removed."""
    seen, out = {}, {}
    for doc_id, text in sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        parts = text.split("\n")
        gone = set()
        for i in range(len(parts) - 2):
            w = "\n".join(parts[i : i + 3])
            if not w.replace("\n", "").replace(" ", ""):
                continue
            first = seen.setdefault(w, (doc_id, i))
            if first[0] != doc_id or i >= first[1] + 3:
                gone |= {i, i + 1, i + 2}
        out[doc_id] = "\n".join(p for i, p in enumerate(parts) if i not in gone)
    return out


def test_line_dedup(docs, empty):
    got = lines.dedup_lines(docs.withColumn("n_lines", F.lit("clash")))
    rows = got.collect()
    assert len(rows) == len(ROWS) and got.columns[:5] == docs.columns
    want = brute_lines(ROWS)
    assert all(r["text"] == want.get(r["doc_id"]) for r in rows)
    assert {r["doc_id"]: r["n_removed"] for r in rows}[2] == 3 and {r["doc_id"]: r["n_lines"] for r in rows}[4] == 0
    assert lines.dedup_lines(empty).count() == 0


def test_line_dedup_inside_a_text(spark):
    text = "\n".join(["a", "b", "c", "d", "a", "b", "c", "e"] + ["r"] * 7)
    df = spark.createDataFrame([(1, text, None, None, 0)], SCHEMA)
    assert lines.dedup_lines(df).first()["text"] == brute_lines([(1, text)])[1]


def test_mix(spark, docs, empty):
    many = spark.createDataFrame([(i, "w " * (i % 9 + 1), "en", f"s{i % 5}", 1) for i in range(3000)], SCHEMA).unionByName(docs)
    got = mixing.plan_mix(many).collect()
    assert len(got) == 3000 + len(ROWS) and all(r["taken"] <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        t = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        t[0] += r["taken"]
        t[1] += r["size"]
    assert all(v[1] == v[3] and v[2] <= 2 * v[3] for v in by.values())
    assert abs(sum(v[2] for v in by.values()) - 1.5 * sum(v[3] for v in by.values())) < 1e-6 * sum(v[3] for v in by.values())
    assert all(abs(by[f"s{i}"][0] - by[f"s{i}"][2]) < 0.1 * by[f"s{i}"][2] for i in range(5))
    assert mixing.mix(many).count() == sum(r["copies"] for r in got)
    nameless = spark.createDataFrame([(None, f"text {i} of one", "en", "ab"[i % 2], 1) for i in range(2000)], SCHEMA)
    sums = {r["source"]: (r["t"], r["w"]) for r in mixing.plan_mix(nameless).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()}
    assert all(abs(t - w) < 0.1 * w for t, w in sums.values())
    assert mixing.plan_mix(empty).count() == 0


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5200)] + [(7, 7)]
    parent = {n: n for ab in links for n in ab}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(n, n) == find(n) for n in parent)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_components(spark, docs, empty):
    from test_llm_units import components as join_all
    from test_llm_units import fingerprint

    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in rng.integers(0, 50, 300)]
    rows = [(i + 100, " ".join(base[: 300 - i % 7]) + (" tail" if i % 5 == 0 else ""), "en", "a", 1) for i in range(40)]
    rows += [(i + 200, " ".join(f"v{x}" for x in rng.integers(0, 900, 60)), "en", "a", 1) for i in range(30)] + ROWS
    got = simhash.near_components(spark.createDataFrame(rows, SCHEMA)).collect()
    fps = [fingerprint(r[1]) for r in rows]
    root = join_all(len(rows), [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if (fps[a] ^ fps[b]).bit_count() <= 4])
    least = {}
    for r, c in zip(rows, root, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = sorted(((r[0] if r[0] is not None else -1), f, least.get(c, -1)) for r, f, c in zip(rows, fps, root, strict=True))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fp"] % (1 << 64), r["component_id"] if r["component_id"] is not None else -1) for r in got) == want
    assert simhash.near_components(empty).count() == 0
    clash = simhash.near_components(docs.withColumn("FP", F.lit("x")).withColumn("component_id", F.lit("y")), carry=["doc_id", "FP", "component_id"])
    assert clash.columns == ["doc_id", "fp", "root", "component_id"] and clash.count() == len(ROWS)


def test_large_buckets_lose_no_link(spark):
    from test_llm_units import components as join_all

    rng = np.random.default_rng(9)
    f = {int(rng.integers(0, 1 << 62)) for _ in range(60)}
    centre = int(rng.integers(0, 1 << 62))
    for _ in range(250):
        x = centre
        for b in rng.integers(0, 62, 4):
            x ^= 1 << int(b)
        f.add(x)
    f = sorted(f)
    place = {v: i for i, v in enumerate(f)}
    got = simhash.bucket_links(spark.createDataFrame([(v,) for v in f], "fp long"), len(f), chunk=20).collect()
    brute = [(i, j) for i in range(len(f)) for j in range(i + 1, len(f)) if (f[i] ^ f[j]).bit_count() <= 4]
    assert join_all(len(f), [(place[r["a"]], place[r["b"]]) for r in got]) == join_all(len(f), brute)


def test_search(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 32)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(600, None, 0), (620, [0.0] * 32, 0), (640, [float("nan")] * 32, 0), (660, [1.0, None], 0), (None, x[0].tolist(), 0), (680, [1.0, 2.0], 0), (681, [2.0, 1.0], 0)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 600, 20)) | {680} and sorted(by[680]) == [(1, 681, 4.0)]
    wide, hit = x.astype(float), 0
    for q in range(0, 600, 20):
        s = (wide * wide[q]).sum(axis=1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -s))[:20]
        found = sorted(by[q])
        assert [f[0] for f in found] == list(range(1, 21)) and all(f[2] == s[f[1]] for f in found)
        hit += len({f[1] for f in found} & set(best.tolist()))
    assert hit / (30 * 20) >= 0.9
    tied = [r[1] for r in sorted(by[100]) if r[2] == by[100][0][2]]  # 60 rows are equal: the smaller ids, in order
    assert tied == sorted(tied) and set(tied) <= set(range(101, 160)) and tied[0] == 101
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_media(docs, empty):
    got = iso.media_columns(docs.withColumn("feature", F.lit("clash")), ("media", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")).collect()
    for r in got:
        raw = (r["text"] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
    assert len(got) == len(ROWS) and iso.media_columns(empty).count() == 0
    scanned = iso.scan_media(iso.media_columns(docs, ("media",), carry=["doc_id"]).withColumnRenamed("media", "content")).collect()
    assert all(r["codec"] == "raw" and r["samples"] > 0 and r["keyframes"] for r in scanned)


def test_bpe(docs, empty):
    import tiktoken

    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    got = bpe.encode(docs, tokens, public_tokenizers.PATTERN, ("ids", "n_tokens", "ids_sha256", "decoded")).collect()
    for r in got:
        ids = enc.encode_ordinary(r["text"] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == (r["text"] or "").encode()
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert len(got) == len(ROWS) and bpe.encode(empty, tokens, public_tokenizers.PATTERN).count() == 0
    for table in (0, 3, 1000):  # words merged for the corpus, in the task, or both: the ids are the same
        some = bpe.encode(docs, tokens, public_tokenizers.PATTERN, ("ids", "decoded_sha256"), table=table).collect()
        assert sorted(r["ids"] for r in some) == sorted(enc.encode_ordinary(r[1] or "") for r in ROWS)
        assert {r["decoded_sha256"] for r in some} == {hashlib.sha256((r[1] or "").encode()).hexdigest() for r in ROWS}
    back = bpe.decode(bpe.encode(docs, tokens, public_tokenizers.PATTERN, carry=["doc_id"]), tokens)
    assert {r["text"] for r in back.collect()} == {r[1] or "" for r in ROWS}


def test_common_words_are_bounded(spark):
    counts = spark.createDataFrame([("a", 9), ("b", 5), ("c", 5), ("d", 1 << 40)], "word string, n long")
    for most, want in ((0, ""), (1, "d"), (2, "ad"), (3, "ad"), (4, "abcd")):
        assert "".join(sorted(r["word"] for r in common.commonest(counts, most)[0].collect())) == want


def test_shards(spark, docs, empty):
    rows = [(i, f"text {i % 300} " * (i % 300 % 11 + 1), "en" if i % 3 else None, f"s{i % 4}", 1) for i in range(900)]
    got = hilbert.shard(spark.createDataFrame(rows, SCHEMA).unionByName(docs), carry=["doc_id", "text"]).collect()
    total = sum(r["size"] for r in got)
    sums, slots, places = {}, {}, {}
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((r["text"] or "").encode())
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        places.setdefault(r["text"], set()).add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == 900 + len(ROWS)
    assert all(len(v) == 1 for v in places.values())
    even = hilbert.shard(spark.createDataFrame([(i, f"{i:06d}", "en", "s", 1) for i in range(800)], SCHEMA)).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert len(even) == 8 and max(r["s"] for r in even) - min(r["s"] for r in even) <= 7 * 2 and total
    assert hilbert.shard(empty).count() == 0


def test_order_prunes_files(spark):
    """A shard covers a compact part of the dimensions: fewer pairs of language and source stand in it than in all."""
    rows = [(i, "w" * (i % 97 + 1) + f" {i}", f"l{i * 7 % 5}", f"s{i * 11 % 8}", 1) for i in range(4000)]
    got = hilbert.shard(spark.createDataFrame(rows, SCHEMA).repartition(5), carry=["lang", "source"])
    pairs = [r["n"] for r in got.groupBy("shard").agg(F.count_distinct("lang", "source").alias("n")).collect()]
    assert len(pairs) == 8 and sum(pairs) / 8 < 40 / 2


def test_a_large_group_of_short_texts_is_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "SALTED", 50)
    rows = [(i % 700 if i % 3 else None, None if i % 2 else "", "en", "s", 1) for i in range(1400)] + [(9000 + i, "long text " * 40 + str(i), "en", "s", 1) for i in range(100)]
    got = hilbert.shard(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    slots, sums = {}, {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
    assert len(got) == 1500 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(sums) == 8 and max(sums.values()) < 1.3 * min(sums.values())


def test_large_group_is_cut(spark):
    rows = [(i, "same text" if i < 600 else f"other {i}", "en", "s", 1) for i in range(1000)]
    got = hilbert.shard(spark.createDataFrame(rows, SCHEMA)).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sizes = [r["s"] for r in got]
    assert len(sizes) == 8 and max(sizes) < 1.2 * min(sizes)


def test_language(spark, docs, empty):
    words = {"x": "the of and to with from that", "y": "der die und das mit von nicht"}
    rows = [(i, " ".join(np.random.default_rng(i).choice(words["xy"[i % 2]].split(), 30)), "xy"[i % 2], "s", 1) for i in range(200)]
    train = spark.createDataFrame(rows, SCHEMA)
    model = langid.learn(train.where(~langid.held_out()))
    got = langid.identify(train, model).where(langid.held_out()).collect()
    assert len(got) > 20 and all(r["lang"] == r["lang_pred"] and 0.5 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert odd[3] == odd[4] == odd[8] == "und" and odd[1] in "xy"
    assert langid.identify(docs, langid.learn(empty)).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(empty, model).count() == 0


def test_executors_need_no_installed_package(tmp_path):
    """From another folder, with the repository on the driver's path only: the workers can't import the package."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from quire.llm import bpe, langid, licences, lm, simhash
from pyspark.sql import functions as F
docs = spark.createDataFrame([(i, f"some words of text {{i}}", "en") for i in range(30)], "doc_id long, text string, lang string")
print(langid.identify(docs, langid.learn(docs)).where("lang_pred = 'en'").count(), lm.score(docs, F.col("doc_id") > 3).count(), simhash.near_components(docs).count(), licences.scan(docs).count())
spark.stop()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.split() == ["30"] * 4, out.stderr[-3000:]


def test_scan(docs, empty, spark):
    some = spark.createDataFrame([(1, "Some words.\nReleased under the MIT License.\nMore.", None, None, 0)], SCHEMA)
    r = licences.scan(some.withColumn("dice", F.lit("clash"))).first()
    assert (r["license"], r["dice"], r["first_word"], r["end_word"]) == ("MIT", 1.0, 2, 7)
    assert licences.scan(docs).where("license is not null").count() == 0 and licences.scan(empty).count() == 0


def test_scores(spark, empty, monkeypatch):
    monkeypatch.setattr(lm, "HEAVY", 40)  # so that both ways of looking up tokens are taken
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 40) % 200), "en", "s", 1) for i in range(150)] + ROWS
    docs = spark.createDataFrame(rows, SCHEMA)
    held = langid.held_out(parts=7, part=2)
    got = lm.score(docs.withColumn("score", F.lit("clash")).withColumn("N_tokens", F.lit("clash")), ~held).drop("lang", "source", "n_chars")
    assert sorted(c.lower() for c in got.columns) == sorted(["doc_id", "text", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])
    got = got.collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    from collections import Counter

    words = lambda t: [*lm.tokens_of(t), lm.END]
    c = Counter(w for r in rows if not out(r[0]) for w in words(r[1]))
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for r in got:
        t = words(r["text"])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert r["score"] < 0 and np.isfinite(r["score"]) and r["bits_per_byte"] > 0
    assert lm.score(empty, F.lit(True)).count() == 0
    untaught = lm.score(docs.where("doc_id = 1"), F.lit(False)).first()
    assert untaught["n_known"] == untaught["train_tokens"] == 0 and np.isfinite(untaught["score"])


def test_known_words_are_coded_in_context(spark):
    """Known words cost what their neighbours make of them: the same words in an order never seen cost more, over many texts."""
    rng = np.random.default_rng(5)
    pairs = [(f"{chr(97 + i)}lpha{i}", f"{chr(122 - i)}eta{i}") for i in range(12)]
    rows = [(i, " ".join(w for x in rng.permutation(12)[:8] for w in pairs[x]), True) for i in range(200)]
    for i in range(20):
        some = [pairs[x] for x in rng.permutation(12)[:8]]
        rows += [(1000 + i, " ".join(w for p in some for w in p), False), (2000 + i, " ".join(w for k, p in enumerate(some) for w in (p[0], some[k - 1][1])), False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, taught boolean")
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, F.col("taught"), carry=["doc_id"]).collect()}
    assert sum(got[1000 + i] for i in range(20)) > 0.8 * sum(got[2000 + i] for i in range(20))


def test_long_texts_are_coded_whole(monkeypatch):
    """Every byte is coded once, with the words before it as context, however a text is cut into pieces and runs."""
    monkeypatch.setattr(lm, "PIECE", 64)
    monkeypatch.setattr(lm, "SPAN", 16)
    texts = ["one two three four five six seven eight " * 9, None, "short one", "x" * 100]
    sizes = np.zeros(len(texts), int)
    for laid in lm.laid_out(texts):
        np.add.at(sizes, laid.owner, laid.length)
        assert laid.length.max() <= 16 and laid.coded.sum() == laid.length.sum()
    assert sizes.tolist() == [sum(len(w) + 1 for w in lm.tokens_of(t)) + 1 for t in texts]


def test_shared_folder_is_read_from_the_session(spark, tmp_path, monkeypatch):
    class Elsewhere:
        class sparkContext:
            applicationId = "app"
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda key, default: None)

    with pytest.raises(ValueError):
        common.shared_dir(Elsewhere)
    assert common.shared_dir(spark) == common.shared_dir(spark)

    class Told(Elsewhere):
        class conf:
            get = staticmethod(lambda key, default: {"spark.checkpoint.dir": "hdfs://n/folder/"}[key])

    assert common.shared_dir(Told) == "hdfs://n/folder"
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    kept = common.store(spark.range(3), "numbers")
    assert kept.count() == 3 and list(tmp_path.glob("quire-*/numbers/*.parquet"))
    common.free(kept)
    assert not list(tmp_path.glob("quire-*"))
    common.free(spark.range(3))


def test_near_dedup_keeps_one_row_of_each_group(spark):
    import corpus_pipeline as c

    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    n = "null id " + " ".join(f"c{i}" for i in range(60))
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, a, "de", "s", 1), (None, a, "en", "s", 1), (None, n, "en", "s", 1), (None, n, "en", "t", 1), (7, "z y x w v", "en", "s", 1), (7, "z y x w v", "en", "s", 1)]
    got = c.near_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()
    assert sorted(((r["doc_id"] or 0), r["text"][:4]) for r in got) == [(0, "null"), (1, "a0 a"), (1, "b0 b"), (7, "z y ")]


def test_pipeline_stages(docs, empty):
    import corpus_pipeline as c

    spark, at = docs.sparkSession, docs
    assert [n for n, _ in c.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "mixing", "byte-level BPE"]
    for name, stage in c.STAGES[:-1]:
        at = common.store(stage(spark, at, ""), "stage")
        assert at.columns == list(c.COLUMNS), name
    left = at.select("doc_id").distinct().collect()
    assert {r["doc_id"] for r in left} <= {1, 2, 5, None} and 3 not in {r["doc_id"] for r in left}
    last = c.tokens(spark, at, "")
    assert last.count() == at.count()
    at = empty
    for _, stage in c.STAGES:
        at = stage(spark, at, "")
    assert at.count() == 0
