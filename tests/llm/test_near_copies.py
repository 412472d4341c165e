"""Near copies of the pipeline against all pairs."""

import random
import re

import pytest

import corpus_pipeline
from linkmill.llm import components, near_copies, simhash
from linkmill.llm.common import cut_lineage


def brute(rows, words=5):
    """Component of each row, by comparing all pairs of sets of words."""

    def parts(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    found = [parts(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(found):
        for j, b in enumerate(found[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def corpus():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = rng.choices(vocabulary, k=60)
    rows = [(1, None), (2, ""), (3, "one two"), (4, "One  TWO"), (5, "one two three")]
    for i in range(40):
        base = rng.choices(vocabulary, k=rng.choice((8, 30, 200, 900)))
        if i % 4 == 0:
            base = passage + base
        rows.append((100 * i + 100, " ".join(base)))
        for k in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((100 * i + 101 + k, " ".join(copy)))
    return rows


def test_all_similar_pairs_are_linked(spark):
    rows = corpus()
    group = brute(rows)
    least = {g: min(i for (i, _), h in zip(rows, group, strict=True) if h == g) for g in group}
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert got == {i: least[g] for (i, _), g in zip(rows, group, strict=True)}
    assert near_copies.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stage_drops_all_copies_at_four_fifths(spark):
    rows = corpus()
    group = brute(rows)
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    want = {min(i for (i, _), h in zip(rows, group, strict=True) if h == g) for g in group}
    assert {r.doc_id for r in kept.collect()} == want


@pytest.mark.parametrize(("leaders", "hot", "block"), [(1, 1, 2), (2, 3, 4), (1, 100, 256)])
def test_dense_groups_at_the_threshold(spark, leaders, hot, block):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(copy)))
    group = brute(rows)
    least = {g: min(i for (i, _), h in zip(rows, group, strict=True) if h == g) for g in group}
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), leaders=leaders, hot=hot, block=block)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: least[g] for (i, _), g in zip(rows, group, strict=True)}
    assert 3 < len(set(group)) < 60


def test_stage_judges_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, "another text of the same id"), (1, text), (2, text + " more"), (None, text), (None, "alone here"), (3, None), (4, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, `a.b` int")
    kept = corpus_pipeline.drop_near_copies(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(1, text), (1, rows[1][1]), (None, "alone here"), (3, None)]))
    assert corpus_pipeline.drop_near_copies(spark, df.limit(0), "").count() == 0


def test_no_plan_holds_many_steps(spark, monkeypatch):
    sizes = []
    count = lambda df: len(re.findall(r"\bExchange\b", df._jdf.queryExecution().executedPlan().toString()))
    for module in (near_copies, components, simhash):
        monkeypatch.setattr(module, "cut_lineage", lambda df: (sizes.append(count(df)), cut_lineage(df))[1])
    near_copies.near_copies(spark.createDataFrame(corpus(), "doc_id long, text string"))
    assert max(sizes) < 16
