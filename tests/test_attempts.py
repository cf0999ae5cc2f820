"""Segments, batches, and translation by models that fail."""

import json
import random

from quire.plans import attempts
from quire.scratch import store

SOURCE = "doc_id string, chunk_no int, pos int, role string, text string, preserve_tokens array<string>, requires_translation boolean"
LONG = "A sentence of many words goes on and on for quite some time here. " * 3


def sources(spark, *rows):
    return spark.createDataFrame([("d", c, p, "paragraph", t, k, w) for c, p, t, k, w in rows], SOURCE)


def ran(spark, rows, model, **more):
    out = attempts.translated(sources(spark, *rows), model, "zh", **more).collect()
    return {(r["chunk_no"], r["pos"]): r for r in out}


def answering():
    """A function of its own for each model: tasks can't import this module."""

    def answer(prompt, text):
        import json

        return json.dumps({"blocks": [{"pos": b["pos"], "role": b["role"], "translated_text": text(b)} for b in json.loads(prompt)["blocks"]]})

    return answer


def test_segments_and_batches(spark):
    texts = ["See [1] and {{formula:a}} then Fig. 3 ends.", "x" * 95, "word " * 60, "", None, "kept as it is [2]", "a\nb  c\n"]
    df = sources(spark, *[(0, i, t, [], i != 5) for i, t in enumerate(texts)])
    parts = attempts.batches(attempts.segments(df, 20), 40)
    assert {r["pos"]: r["text"] for r in attempts.reassembled(parts).collect()} == {i: t for i, t in enumerate(texts) if t}
    rows = parts.collect()
    assert max(len(r["text"]) for r in rows if not r["kept"]) <= 20 and {r["text"] for r in rows if r["kept"] and r["pos"] == 0} == {"[1]", "{{formula:a}}", "Fig. 3"}
    sums: dict = {}
    for r in rows:
        if not r["kept"]:
            sums[r["batch"]] = sums.get(r["batch"], 0) + len(r["text"])
    assert max(sums.values()) <= 40 and all(r["batch"] is None for r in rows if r["kept"])


def test_only_what_fails_is_asked_again(spark, tmp_path):
    log = str(tmp_path / "asked")
    answer = answering()

    def model(prompts, attempt):
        import json

        out = []
        for p in prompts:
            q = json.loads(p)
            with open(log, "a") as f:
                f.write(f"{q['chunk_no']} {attempt} {q.get('previous_error')}\n")
            out.append(None if q["chunk_no"] == 1 and attempt == 1 else answer(p, lambda b: "这是译文 " + " ".join(b["preserve_tokens"])))
        return out

    got = ran(spark, [(0, 0, "Some words of text [1]", ["[1]"], True), (1, 0, "Other words of text", [], True), (1, 1, "E = m", [], False)], model)
    assert sorted(open(log).read().split("\n")[:-1]) == ["0 1 None", "1 1 None", "1 2 unparseable_response"]
    assert [got[k]["attempt"] for k in sorted(got)] == [1, 2, 0] and got[0, 0]["quality_flags"] == [] and got[1, 1]["translated_text"] == "E = m"
    assert all(r["reason"] is None for r in got.values())


def test_a_model_that_raises_gives_the_source_text(spark):
    def model(prompts, attempt):
        raise OSError("no connection")

    got = ran(spark, [(0, 0, "Some words of text", [], True), (0, 1, None, None, None)], model, attempts=2)
    assert got[0, 0]["translated_text"] == "Some words of text" and got[0, 0]["attempt"] == 2
    assert got[0, 0]["reason"] == "unparseable_response" and "retry_attempt_2" in got[0, 0]["quality_flags"] and got[0, 1]["translated_text"] == ""


def test_wrong_language_falls_back_by_block(spark):
    answer = answering()

    def model(prompts, attempt):
        return [answer(p, lambda b: b["text"] if b["pos"] == 0 else "这是一段译文") for p in prompts]

    got = ran(spark, [(0, 0, "Some words of text here", [], True), (0, 1, "More words of text here", [], True)], model)
    assert got[0, 0]["reason"] == "target_language_mismatch" and "target_language_mismatch" in got[0, 0]["quality_flags"] and got[0, 0]["attempt"] == 3
    assert got[0, 1]["reason"] is None and got[0, 1]["translated_text"] == "这是一段译文"


def test_one_revision(spark):
    answer = answering()

    def model(prompts, attempt):
        import json

        out = []
        for p in prompts:
            q = json.loads(p)
            if attempt:
                out.append(answer(p, lambda b: "译文"))
            else:
                assert q["blocks"][0]["issues"] == ["translation_quality_suspiciously_short"] and q["blocks"][0]["translated_text"] == "译文"
                out.append(answer(p, lambda b: "译" * 60) if q["chunk_no"] == 0 else "no")
        return out

    got = ran(spark, [(0, 0, LONG, [], True), (1, 0, LONG, [], True)], model)
    assert got[0, 0]["translated_text"] == "译" * 60 and got[0, 0]["quality_flags"] == [attempts.REVISED]
    assert got[1, 0]["translated_text"] == "译文" and got[1, 0]["quality_flags"] == ["translation_quality_suspiciously_short", attempts.REVISION_FAILED]


def test_answers_are_read_once_and_texts_judged_in_one_pass(spark):
    """A model's answer went through Python twice an attempt, and each judgement of a text was worked out again in its filter."""
    answer = answering()
    rows = [(0, p, "Some words of text here", [], True) for p in range(3)]
    asked = attempts._read(attempts.asked(attempts.prompts(sources(spark, *rows), "zh"), lambda ps, n: [answer(p, lambda b: "这是译文") for p in ps], 1))
    judged = attempts._judged(sources(spark, *rows), store(asked, "answers"), "zh", 1)
    assert [r["reason"] for r in judged.collect()] == [None] * 3 and "find(" not in str(judged._jdf.queryExecution().analyzed())
    assert [f.name for f in asked.schema] == ["doc_id", "chunk_no", "blocks", "bad"]


def test_untranslated_by_the_rule_spelled_out(spark):
    import re

    from pyspark.sql import functions as F

    from quire.functions.predicates import untranslated

    def slow(source, text):
        latin = r"[A-Za-z][A-Za-z'’\-]*"
        han, dense, words = len(re.findall("[一-鿿]", text)), len(re.sub(r"\s+", "", text)), re.findall(latin, text)
        if text.strip(" ") == "":
            return True
        if han >= 2 or han / max(dense, 1) >= 0.03 or len(words) < 3:
            return False
        mine = {w.lower() for w in words}
        return len(mine & {w.lower() for w in re.findall(latin, source)}) / max(len(mine), 1) >= 0.5 or len(words) >= 5

    draw, rows = random.Random(4), []
    for _ in range(3000):
        one = lambda: "".join(draw.choice(["a", "B'c", "-", "’", " ", "  ", "\t", "1", "é", "the-end", "one ", "two ", "é" * 30] + ["译"] * (draw.random() < 0.2)) for _ in range(draw.randrange(14)))
        rows.append((one(), one()))
    got = spark.createDataFrame(rows, "s string, t string").select("s", "t", untranslated(F.col("s"), F.col("t")).alias("x")).collect()
    assert all(r["x"] == slow(r["s"], r["t"]) for r in got) and len({r["x"] for r in got}) == 2


def test_nothing_to_translate(spark):
    never = lambda prompts, attempt: 1 / 0
    assert ran(spark, [], never) == {}
    assert ran(spark, [(0, 0, "E", [], False)], never)[0, 0]["attempt"] == 0


def test_disk_is_given_back(spark):
    """Tables of attempts stayed to the end, and so did all that was shuffled for any written table."""
    import time

    from quire import scratch
    from quire.cases import translated

    env = spark._jvm.org.apache.spark.SparkEnv.get()
    dirs = [str(d) for d in env.blockManager().diskBlockManager().localDirsString()]
    shuffled = lambda: {f.name for d in dirs for f in __import__("pathlib").Path(d).rglob("shuffle_*.data")}
    before, known = shuffled(), len(scratch._written)
    out = translated.u03_u04_attempts(spark, "/root/testdata/sf0.001")
    assert {p.rsplit("/", 1)[1] for _, p in scratch._written[known:]} == {"sources", "first", "issues", "revisions", "revised"}
    for _ in range(40):
        left = shuffled() - before
        if not left:
            break
        time.sleep(0.25)
    assert not left and out.count() > 0
