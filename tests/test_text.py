from pyspark.sql import functions as F

from linkmill.functions import text as t


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_variants(spark):
    v = lambda m: one(spark, m, t.search_variants)
    assert v("للجزائر").primary == ["للجزائر", "الجزائر"]
    assert "القاهرة" in v("بالقاهرة").primary
    assert "برشلونة" in v("وبرشلونة").primary
    assert v("لمصر").fallback == ["مصر"]
    assert v("بغداد").primary == ["بغداد"] and v("بغداد").fallback == ["غداد"]
    assert v(" ") == ([], [])


def test_normal_forms(spark):
    assert one(spark, "إِسْلامِيّة", t.normalize_text) == "اسلاميه"
    assert one(spark, "الجزائر", t.name_tokens) == one(spark, "جزائر", t.name_tokens) == ["جزاير"]
    assert [one(spark, m, t.mention_script) for m in ("PSG", "الأهلي", "CR بلوزداد", "12")] == ["latin", "arabic", "mixed", "arabic"]
    assert [one(spark, m, t.norm_gold) for m in ("http://x/Q12", "none", None)] == ["Q12", "NIL", "NIL"]
    assert [one(spark, m, t.norm_type) for m in ("b-person", "GPE", "I-misc", "", None)] == ["PER", "GPE", "MISC", None, None]


def test_parse_answer(spark):
    p = lambda s: one(spark, s, t.parse_answer)
    assert p('```json\n{"action":"select","qid":"q1"}\n```').qid == "Q1"
    assert p('so {"action": "nil", "confidence": 9} ok').confidence == 1.0
    assert p("<think>{}</think>{\"qid\": \"Q5\"}").action == "select"
    assert p('{"action": "select"}').action == "invalid"
    assert p('{"confidence": "x"}').confidence == 0.5
    assert p("nope") is None and p(None) is None


def test_context(spark):
    df = spark.createDataFrame([("a" * 400 + "PSG" + "b" * 10, "PSG", None, None), ("PSG won", "PSG", 0, 3), ("none", "PSG", 1, 2), ("x PSG", "PSG", 0, 3)], "t string, m string, s int, e int")
    got = [r[0] for r in df.select(t.doc_context(F.col("t"), F.col("m"), F.col("s"), F.col("e"), 5)).collect()]
    assert got == ["…aaaaa⟦PSG⟧bbbbb…", "⟦PSG⟧ won", "none", "x ⟦PSG⟧"]


def test_tidy_mentions_are_left_as_trimming_leaves_them(spark):
    odd = ["", " ", "x", "الكتاب", "«وال كتاب»", "a\u0085", " a", "a \n", "كِتاب", "ab.", "(ab", "a b", "a  b", " ab", "ab ", "a.b", "٣:", "ab-", "-ab", "﻿ab", None]
    rows = spark.createDataFrame([(x,) for x in odd], "x string")
    trimmed = rows.select("x", t.edge_trim(t.strip_marks(F.col("x"))).alias("y"), F.coalesce(F.col("x").rlike(t.UNTIDY), F.lit(False)).alias("untidy")).collect()
    assert all(r.untidy or r.y == (r.x or "") for r in trimmed) and sum(not r.untidy for r in trimmed) >= 6
    assert rows.filter(t.search_variants(F.col("x"))["primary"] != t.search_variants(t.edge_trim(t.strip_marks(F.col("x"))))["primary"]).isEmpty()
