"""The pipeline's stages: columns, whole tables, and planted cases."""

import random

from pyspark.sql import functions as F

import corpus_pipeline

ITEM = "Seven wizards quietly boil forty purple turnips while the lazy dog watches a quick brown fox jump over"
LINE = "a notice of more than forty characters that many documents share"


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    words = [f"{a}{b}{c}" for a in ("ba", "ko", "mi", "tu") for b in ("ra", "len", "os") for c in ("n", "st", "a")]
    text = lambda n=80: " ".join(rng.choices(words, k=n))
    rows = [(i, text()) for i in range(100)]
    rows += [(100 + i, f"{text(40)} idiot {text(20)} moron {text(10)} scum") for i in range(40)]
    rows += [(200 + i, f"{text()}\n{LINE}") for i in range(6)]
    base = text(300)
    rows += [(300, base), (301, base), (302, base + " end"), (400, f"{text()} {ITEM} {text()}"), (500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 130)) for i in range(130)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("score", F.lit(7))
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path)).persist()
        if name != "packing":
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
            docs = out
            ids.append({r.doc_id for r in docs.collect()})
    everything = {i for i, _ in rows}
    assert ids[0] == everything - set(range(100, 140))
    assert ids[1] == ids[0] and docs.filter(F.col("text").contains(LINE)).count() == 1
    assert {301, 302} & ids[2] == set() and 300 in ids[2] and set(range(100)) <= ids[2]
    assert ids[3] == ids[2] - {400}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == ids[3]


def test_stages_with_odd_columns_and_empty_tables(spark, tmp_path):
    """Columns named with dots or in other case, null ids, repeated rows; and no rows at all."""
    spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, f"some words of text {i} " * 5 + ("idiot moron scum" if i % 2 else "")) for i in range(40)]
    rows += [(None, "no id at all"), (None, None), (50, ""), (51, f"said {ITEM} again"), (None, f"{ITEM}"), (60, "the same row"), (60, "the same row"), (61, "x" * 200_000)]
    odd = spark.createDataFrame(rows, "doc_id long, Text string").withColumns({"a.b": F.lit(1), "key": F.lit("x"), "score": F.lit(None).cast("double"), "_key": F.lit(0)})
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert name == "packing" or out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
            kept = out.collect()
            assert docs is odd or not kept
            if docs is odd and name == "decontamination":
                assert {r.doc_id for r in kept} >= {50, 60, 61} and 51 not in {r.doc_id for r in kept} and not any(r.Text == ITEM for r in kept)
            if docs is odd and name == "line_dedup":
                assert len(kept) == len(rows)
            if docs is odd and name == "near_dedup":
                assert sum(r.doc_id == 60 for r in kept) == 1
            if docs is odd and name == "packing":
                assert sum(r.doc_id is None for r in kept) >= 3 and sum(r.length for r in kept if r.doc_id == 60) == 2 * next(r.doc_tokens for r in kept if r.doc_id == 60)
