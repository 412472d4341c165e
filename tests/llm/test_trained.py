"""Trained operators on the given tables' held-out documents, their features by counting one by one, and bounds of samples."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkmill.llm import language, learning, quality, toxicity
from linkmill.llm.common import in_fold, word_hashes, word_spans

SF = "/root/testdata/sf0.1"


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.filter(in_fold(5, 0)).select("doc_id", F.col("quality").alias("good"))
    rows = quality.quality_rules(docs.join(held, "doc_id", "left_semi").unionByName(docs.join(held, "doc_id", "left_anti")), labels.filter(~in_fold(5, 0))).join(held, "doc_id").filter("NOT base_failed").collect()
    assert len(rows) > 500 and sum(r.kept == bool(r.good) for r in rows) / len(rows) > 0.99


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = language.language_id(docs).join(docs, "doc_id").filter("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").select("lang", "lang_pred").collect()
    assert len(rows) > 2000 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.99


@pytest.mark.parametrize("text", ["", "a", "Ein Wort, zwei  Wörter\nund\t mehr", "日本語 text", "x " * 300, "naïve " + "y" * 5000])
def test_language_features_one_by_one(text):
    data = b" " + re.sub(rb"[ \t-\r]+", b" ", text.lower().encode()).strip(b" ") + b" "
    want = Counter()
    for word in data.split():
        values, starts, ends = word_spans(word)
        want[int(learning.word_grams(word_hashes(values, starts, ends), 1, language.BITS)[0])] += 1
    for n in (2, 3, 4):
        for k in range(len(data) - n + 1):
            want[int(learning.byte_grams(np.frombuffer(data[k : k + n], np.uint8), n, language.BITS)[0])] += 1
    index, share = language.shares(text)
    total = sum(want.values())
    assert dict(zip(index.tolist(), (share * total).round().astype(int).tolist(), strict=True)) == dict(want)


def test_equal_probabilities_go_to_the_first_language_by_name():
    model = language.Model(["aa", "bb"], np.zeros((1 << language.BITS, 2)), np.zeros(2))
    assert model.predict("words") == ("aa", 0.5, True) and model.predict("12 34") == ("und", 0.0, False)


def test_samples_are_bounded_in_classes_and_in_each(spark):
    rng = random.Random(1)
    rows = [(i, "text", f"junk{i}") for i in range(900)] + [(1000 + i, "text", rng.choice(["de", "fr"])) for i in range(300)] + [(2000, "text", None), (None, "text", "de"), (2001, None, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = Counter(r.lang for r in learning.sample(docs.select("doc_id", "text"), docs, "lang", 50, most_classes=20).collect())
    assert got["de"] == got["fr"] == 50 and len(got) == 20


def test_margins_take_a_bounded_memory():
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(size=toxicity.FEATURE_SPACE).astype(np.float32), 0.1, np.ones(toxicity.FEATURES + 1))
    strings = ["".join(rng.choice(list("abcdefghij"), 20)) for _ in range(4096)]
    tracemalloc.start()
    got = model.plain_margins(strings)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert all(got[k] == model.plain_margins([strings[k]])[0] for k in range(0, 4096, 512))
