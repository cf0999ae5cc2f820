from pyspark.sql import functions as F

from quire.functions import ids, predicates, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_repair(spark):
    assert one(spark, "a ¼ b þ c­\x02 d", text.repair) == "a = b + c d"
    assert one(spark, "x̄ is", text.repair) == r"\bar{x} is"
    assert one(spark, None, text.repair) is None


def test_tokens_in_order_of_place(spark):
    found = one(spark, "Eq. 2, y = f(x), (Smith, 2024), Fig. 3, [7; 9]", text.preserve_tokens)
    assert [found.index(t) for t in ("Eq. 2", "(Smith, 2024)", "Fig. 3", "[7; 9]")] == sorted(found.index(t) for t in ("Eq. 2", "(Smith, 2024)", "Fig. 3", "[7; 9]"))
    assert one(spark, None, text.preserve_tokens) == []


def test_refs(spark):
    assert one(spark, "a {formula:x1}} b {{formula:y}}", text.repair_refs) == "a {{formula:x1}} b {{formula:y}}"
    assert one(spark, "{{formula:a}} {{formula:b}} {{formula:a}}", text.formula_refs) == ["a", "b"]
    assert len(one(spark, "{{formula:a}} {{formula:b}} {{formula:a}}", text.formula_tokens)) == 3


def test_compact(spark):
    assert one(spark, "abc  def", lambda c: text.compact(c, 7)) == "abc def"
    assert one(spark, "abc defg", lambda c: text.compact(c, 5)) == "abc…"


def test_redact_and_tags(spark):
    assert one(spark, "<think>x</think>Bearer abc.def sk-abcdefgh", text.redact) == "Bearer [redacted] sk-[redacted]"
    assert one(spark, "<p>a<b>c</b></p>", text.strip_tags) == "a c"


def test_hyphens(spark):
    assert one(spark, "inter- nation- al law", text.join_hyphenated) == "international law"


def test_roles(spark):
    rows = [("Abstract", 0, 1, "abstract"), ("Figure 2. A plot", 0, 2, "caption"), ("[12] A. Author", 1, 0, "reference"), ("E = m", 1, 1, "formula"), ("1.2 Methods", 1, 2, "heading"), ("Anything", 0, 0, "title"), ("Plain words that go on.", 1, 3, "paragraph")]
    df = spark.createDataFrame([(t, p, b) for t, p, b, _ in rows], "t string, p int, b int")
    got = df.select("t", predicates.block_role(F.col("t"), F.col("p"), F.col("b"), F.lit(10.0)).alias("r")).collect()
    assert {r["t"]: r["r"] for r in got} == {t: r for t, _, _, r in rows}


def test_table_and_noise(spark):
    assert one(spark, "a  b  c\nd  e  f", predicates.table_like)
    assert not one(spark, "a b c\nd e f", predicates.table_like)
    assert one(spark, "× - +", predicates.noise) and one(spark, "", predicates.noise)
    assert not one(spark, "x = 1", predicates.noise)


def test_columns_and_gap(spark):
    assert one(spark, "use single column, no, two columns", predicates.column_count) == 2
    assert one(spark, "column gap: 5 mm then column gap 1cm", predicates.column_gap) == 28.35
    assert one(spark, "", predicates.column_gap) == 18.0


def test_untranslated(spark):
    f = lambda s: one(spark, s, lambda c: predicates.untranslated(F.lit("the model of the data is large"), c))
    assert f("the model of the data") and not f("模型很大") and f(" ")


def test_ids(spark):
    import hashlib

    got = one(spark, "a", lambda c: ids.stable_id(F.lit("p"), c, F.lit(3)))
    assert got == "p" + hashlib.sha1(b"a|3").hexdigest()[:12]
    assert spark.range(1).select(ids.ordered_distinct(F.array(*[F.lit(x) for x in ("b", "", "a", "b")])).alias("x")).first()["x"] == ["b", "a"]


def test_widths_search_a_text_once_and_make_no_string_of_each_match(spark):
    width = text.width_hundredths(F.col("t"))
    assert "regexp_count" not in str(width) and str(width).count("regexp_replace(t,") == 1
    cases = {"": 0, "ab": 104, "A1\t ": 64 + 56 + 200 + 34, "é表　²": 72 + 100 + 34 + 56, "Éz": 64 + 52, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["w"] for r in df.select("t", width.alias("w")).collect()} == cases


def test_blanks_are_what_squeezing_changes(spark):
    import random
    import re

    from pyspark.sql import functions as F

    from quire.functions.text import BLANKS, squeeze

    draw = random.Random(5)
    texts = ["".join(draw.choice("ab  \t\n\r\u00a0\u3000\u2003\u0085") for _ in range(draw.randrange(12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", squeeze(F.col("t")).alias("x"), squeeze(F.col("t")).rlike(BLANKS).alias("again"))
    for r in df.collect():
        assert r["x"] == re.sub(r"\s+", " ", r["t"]).strip(" ") and not r["again"]
