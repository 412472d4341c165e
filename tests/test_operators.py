"""Corpora, knowledge base, linking, reviews, sources and streams on small tables."""

import gzip
import hashlib
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkmill.functions.text import token_key
from linkmill.operators import corpus, kb, linking, review
from linkmill.schemas import ENTITY, POOLED_REVIEW, RAW_ENTITY, SINGLE_REVIEW
from linkmill.sources import readers
from linkmill.streaming import jobs
from tests.test_scoring import runs, trace

PEOPLE = [
    ("Q3783", "نهر الأمازون", "Amazon River", ["الأمازون", "أمازون"], ["Q4022"], 200), ("Q3884", "أمازون", "Amazon", [], ["Q4830453"], 150), ("Q1", "أمازون (توضيح)", "Amazon (disambiguation)", [], ["Q4167410"], 30),
    ("Q90", "باريس", "Paris", [], ["Q515"], 300), ("Q47899", "باريس هيلتون", "Paris Hilton", [], ["Q5"], 90), ("Q262", "الجزائر", "Algeria", [], ["Q6256"], 260), ("Q7156", "نادي برشلونة", "FC Barcelona", ["برشلونة"], ["Q476028"], 180),
]
EDGES = [("Q6979593", "Q43229"), ("Q4022", "Q618123"), ("Q515", "Q486972"), ("Q476028", "Q847017"), ("Q847017", "Q43229"), ("Q4830453", "Q43229"), ("Q6256", "Q56061"), ("Q43229", "Q476028")]


@pytest.fixture(scope="module")
def snapshot(spark):
    names = spark.createDataFrame([], ENTITY).schema.names
    entities = spark.createDataFrame([tuple({"qid": q, "label_ar": a, "label_en": e, "aliases_ar": al, "p31": c, "facts": {"P17": ["Q6256"]}, "sitelinks": n}.get(x) for x in names) for q, a, e, al, c, n in PEOPLE], ENTITY)
    page = spark.createDataFrame([("باريس", "Q90", False), ("أمازون", None, True), ("الجزائر", "Q262", False), ("نهر الأمازون", "Q3783", False)], "title string, qid string, is_disambiguation boolean")
    moved = spark.createDataFrame([("مدينة الأنوار", "باريس")], "from_title string, to_title string")
    link = spark.createDataFrame([("أمازون", "نهر الأمازون", 1), ("أمازون", "أمازون", 2)], "from_title string, to_title string, pos int")
    roots = kb.type_roots(spark)
    closure = kb.class_closure(spark.createDataFrame(EDGES, "class string, parent string"), roots).persist()
    return entities, page, moved, link, closure, roots


def mentions(spark, *rows):
    return spark.createDataFrame([(str(i), m, t) for i, (m, t) in enumerate(rows)], "id string, mention string, type string")


def test_candidates(spark, snapshot):
    entities, page, moved, link, *_ = snapshot
    asked = mentions(spark, ("أمازون", None), ("للجزائر", None), ("مدينة الأنوار", None), ("Paris", None), ("مجهول", None))
    got = {}
    for r in kb.generate_candidates(asked, entities, page, moved, link).orderBy("pos").collect():
        got.setdefault(r.mention, []).append(r.qid)
    assert {"Q3884", "Q3783"} <= set(got["أمازون"]) and "Q1" not in got["أمازون"]
    assert got["للجزائر"][0] == "Q262" and got["مدينة الأنوار"] == ["Q90"] and got["Paris"] == ["Q90", "Q47899"] and "مجهول" not in got


def test_baselines(spark, snapshot):
    entities, page, moved, link, *_ = snapshot
    asked = mentions(spark, ("أمازون", None), ("باريس", None), ("مجهول", None))
    cands = kb.generate_candidates(asked, entities, page, moved, link)
    answers = lambda df: {r.mention: r.qid for r in df.collect()}
    assert answers(linking.link_search_top1(asked, entities)) == {"أمازون": "Q3783", "باريس": "Q90", "مجهول": "NIL"}
    assert answers(linking.link_popularity(asked, cands))["باريس"] == "Q90"
    assert answers(linking.link_exact_popularity(asked, cands, entities))["أمازون"] in ("Q3783", "Q3884")
    weak = {r.mention: r.weak for r in linking.needs_expansion(asked, cands, entities).collect()}
    assert weak["مجهول"] and weak["باريس"]  # two candidates only


def test_closure_and_types(spark, snapshot):
    entities, *_, closure, roots = snapshot
    pairs = spark.createDataFrame([("Q7156", "ORG"), ("Q90", "ORG"), ("Q90", "GPE"), ("Q404", "ORG"), ("Q90", "DATE")], "qid string, type string")
    got = {(r.qid, r.type): r.is_type for r in kb.is_instance_of(pairs, entities, closure, roots).collect()}
    assert got == {("Q7156", "ORG"): True, ("Q90", "ORG"): False, ("Q90", "GPE"): True, ("Q404", "ORG"): None, ("Q90", "DATE"): None}


def test_nil_rule(spark, snapshot):
    entities, *_, closure, roots = snapshot
    rows = runs(spark, [
        {"run": "a", "id": "1", "mention": "باريس هيلتون", "type": "PER", "gold": "x", "qid": "NIL", "candidates": ["Q90", "Q47899"]},
        {"run": "a", "id": "2", "mention": "باريس", "type": "PER", "gold": "x", "qid": "NIL", "candidates": ["Q90"]}, {"run": "a", "id": "3", "mention": "باريس", "type": "PER", "gold": "x", "qid": "Q90", "candidates": ["Q90"]}])
    got = {r.id: r for r in linking.apply_nil_rule(rows, entities, closure, roots).collect()}
    assert [got[i].qid for i in "123"] == ["Q47899", "NIL", "Q90"] and got["1"].initial_qid == "NIL" and got["1"].trace[0].issues[0].check == "NIL_RULE"


def test_verification_and_loop(spark, snapshot):
    entities, *_, closure, roots = snapshot
    rows = [("1", "باريس", "LOC", "select", "Q90", 0.9), ("2", "باريس", "LOC", "select", "Q47899", 0.9), ("3", "باريس", "LOC", "nil", "", 0.5), ("4", "باريس", "LOC", "select", "Q5555", 0.9), ("5", "x", "LOC", "invalid", "", 0.5), ("6", "أمازون", "MISC", "select", "Q1", 0.9)]
    d = spark.createDataFrame(rows, "id string, mention string, type string, action string, qid string, confidence double")
    cands = spark.createDataFrame([(i, p, q) for i in "123456" for p, q in enumerate(("Q90", "Q47899", "Q1"))], "id string, pos int, qid string")
    got = {r.id: [i.check for i in r.issues] for r in linking.verify_answers(d, cands, entities, closure, roots).collect()}
    assert got == {"1": [], "2": ["TYPE"], "3": ["NIL"], "4": ["CANDIDATE"], "5": ["FORMAT"], "6": ["NOT_ENTITY"]}

    def decide(open_rows):
        def batch(it):
            for pdf in it:
                yield pd.DataFrame({"id": pdf["id"], "new_action": ["confirm" if i in "25" else "select" for i in pdf["id"]], "new_qid": "Q90", "new_confidence": 0.9})

        return open_rows.select("id").mapInPandas(batch, "id string, new_action string, new_qid string, new_confidence double")

    out = {r.id: r for r in linking.correction_loop(d, cands, entities, closure, roots, decide).collect()}
    assert {i: r.qid for i, r in out.items()} == {"1": "Q90", "2": "Q47899", "3": "Q90", "4": "Q90", "5": "NIL", "6": "Q90"}
    assert (out["1"].rounds, out["2"].flagged, out["5"].flagged, out["3"].corrected) == (1, False, True, True)


def test_searches_that_a_critic_suggests(spark, snapshot):
    entities, *_, closure, roots = snapshot
    d = spark.createDataFrame([(i, "باريس", "LOC", "select", "Q90", 0.9) for i in "12"], "id string, mention string, type string, action string, qid string, confidence double")
    cands = spark.createDataFrame([(i, p, q) for i in "12" for p, q in enumerate(("Q90", "Q47899"))], "id string, pos int, qid string")

    def critic(rows):
        return rows.filter("id = '1' AND qid = 'Q90'").selectExpr("id", "'another one' AS msg", "named_struct('q', 'أمازون', 'lang', CAST(NULL AS STRING)) AS suggest")

    def decide(rows):
        return rows.select("id", F.when(F.size("added") > 0, "select").otherwise("confirm").alias("new_action"), F.get("added", 0).alias("new_qid"), F.lit(0.95).alias("new_confidence"))

    index = kb.name_index(entities)
    out = {r.id: r for r in linking.correction_loop(d, cands, entities, closure, roots, decide, critic=critic, index=index).collect()}
    assert {i: (r.qid, r.corrected, r.rounds, r.flagged) for i, r in out.items()} == {"1": ("Q3783", True, 2, False), "2": ("Q90", False, 1, False)}
    rows = linking.criticised(linking.verify_answers(d, cands, entities, closure, roots), critic)
    more = linking.suggested_candidates(rows, cands.filter("qid <> 'Q47899'"), index, entities).orderBy("pos").collect()
    assert [tuple(r) for r in more] == [("1", 1, "Q3783"), ("1", 2, "Q3884")]
    assert linking.suggested_candidates(rows, cands, index, entities, most=1).count() == 1


def test_hints_cases_and_resuming(spark):
    cases = spark.createDataFrame([(k, "a", "Q1", f"Q{k}", "") for k in range(5)], "seq long, mention string, wrong string, right string, why string").withColumn("key", token_key(F.col("mention")))
    assert [h.right for h in linking.correction_hints(mentions(spark, ("A", None)), cases).first().hints] == ["Q2", "Q3", "Q4"]
    rows = runs(spark, [{"run": "a", "id": "1", "mention": "a b", "gold": "g", "qid": "Q1", "initial_qid": "NIL", "reason": "r" * 400, "trace": trace("TYPE", "LABEL") + trace("NIL")}, {"run": "a", "id": "2", "gold": "g", "qid": "Q1", "initial_qid": "NIL", "flagged": True}])
    (case,) = linking.collect_cases(rows).collect()
    assert (case.checks, len(case.why), case.key) == ("LABEL,TYPE", 300, "a b")
    asked = spark.createDataFrame([("1", "d1"), ("2", "d1"), ("3", "d2"), ("4", "d3")], "id string, doc_id string")
    done = spark.createDataFrame([("1", "Q1"), ("3", "Q1"), ("4", "ERROR")], "id string, qid string")
    assert {(r.id, r.answered) for r in linking.pending_mentions(asked, done).collect()} == {("1", True), ("2", False), ("4", False)}


def test_entities_from_raw(spark):
    claim = lambda kind, value, rank="normal": {"rank": rank, "mainsnak": {"datavalue": {"type": kind, "value": value}}}
    raw = {"id": "Q41421", "labels": {"ar": {"value": "مايكل"}}, "descriptions": {}, "aliases": {"ar": [{"value": str(i)} for i in range(12)]}, "sitelinks": {"arwiki": {"title": "t"}, "enwiki": {"title": "u"}},
           "claims": {"P31": [claim("wikibase-entityid", {"id": "Q1"}, "deprecated"), claim("wikibase-entityid", {"id": "Q5"})], "P569": [claim("time", {"time": "+1963-02-17T00:00:00Z"})]}}
    e = kb.ingest_entities(spark.createDataFrame([(json.dumps(raw),)], "j string").select(F.inline(F.array(F.from_json("j", RAW_ENTITY))))).first()
    assert (e.p31, e.facts, e.sitelinks, e.arwiki, len(e.aliases_ar), e.label_en) == (["Q5"], {"P569": ["1963-02-17"]}, 2, "t", 10, None)


def test_layouts(spark):
    nested = spark.createDataFrame([(1, "PSG won", [("PSG", "Q1", "ORG", 0, 3), (None, None, "LOC", 4, 7)]), (2, " ", [("x", "Q2", "ORG", 0, 1)]), (3, "none", [])], "sent_id int, sentence string, entities array<struct<text: string, wikidata: string, label: string, start: int, end: int>>")
    roles = corpus.detect_roles(nested)
    assert (roles["layout"], roles["text"], roles["qid"], roles["start"], roles["type"], roles["mention"]) == ("nested", "sentence", "wikidata", "start", "label", "text")
    assert [(r.id, r.mention, r.gold) for r in corpus.mentions_from_nested(nested, roles).orderBy("id").collect()] == [("1-0", "PSG", "Q1"), ("1-1", "won", "NIL")]
    bio = spark.createDataFrame([(7, "le PSG gagne à Paris S".split(), ["O", "B-ORG", "I-ORG", "O", "I-LOC", "S-LOC"], [None, "Q1", "Q9", None, "-", "Q3"])], "id int, tokens array<string>, tags array<string>, qids array<string>")
    roles = corpus.detect_roles(bio)
    rows = corpus.mentions_from_bio(bio, roles).orderBy("start").collect()
    assert roles["layout"] == "bio" and [(r.id, r.mention, r.type, r.gold, r.start, r.end) for r in rows] == [("7-0", "PSG gagne", "ORG", "Q1", 3, 12), ("7-1", "Paris", "LOC", "NIL", 15, 20), ("7-2", "S", "LOC", "Q3", 21, 22)]
    flat = spark.createDataFrame([("PSG won", "PSG", "Q1", "ORG"), ("he", "", None, None)], "context string, span string, qid string, ner string")
    roles = corpus.detect_roles(flat)
    assert [(r.mention, r.gold, r.type) for r in corpus.mentions_from_flat(flat, roles).collect()] == [("PSG", "Q1", "ORG")]


def test_links(spark):
    filler = "z" * 40
    html = f"""<p>In <a href="/wiki/P" title="باريس">العاصمة الفرنسية</a><sup><a href="/wiki/N" title="note">1</a></sup> <a href="/wiki/Y" title="1999">1999</a> <a href="/w?redlink=1" title="red">red one</a>
      <a href="/wiki/C" title="Category:x">cat</a> and <a href="/wiki/H" title="باريس هيلتون"> باريس هيلتون</a> {filler}</p><table><tr><td><p><a href="/wiki/T" title="T">table</a> {filler}</p></td></tr></table><p>short <a href="/wiki/S" title="S">short</a></p>"""
    links = corpus.link_mentions(spark.createDataFrame([("A", html)], "title string, html string"))
    rows = links.collect()
    assert {(r.anchor, r.target) for r in rows} == {("العاصمة الفرنسية", "باريس"), ("باريس هيلتون", "باريس هيلتون")} and all(r.text[r.start : r.end] == r.anchor for r in rows)
    titles = spark.createDataFrame([("باريس", "Q90"), ("باريس هيلتون", "Q47899")], "target string, gold string")
    assert {(r.mention, r.gold, r.surface) for r in corpus.build_link_set(links, titles, None, None, 10).collect()} == {("العاصمة الفرنسية", "Q90", "alias"), ("باريس هيلتون", "Q47899", "title")}


def test_sampling_and_profile(spark):
    rows = spark.createDataFrame([(f"{d}-{k}", d, f"text {d} alpha", "alpha" if k else "ألف", None, None, "NIL" if d == "a" else "Q1", "LOC") for d in "abc" for k in range(3)], "id string, doc_id string, text string, mention string, start int, end int, gold string, type string")
    assert corpus.sample_by_doc(rows, 4, 2).select("doc_id").distinct().count() == 2
    dev, test = corpus.split_by_doc(rows, 0.4)
    assert (dev.select("doc_id").distinct().count(), test.select("doc_id").distinct().count()) == (1, 2)
    numbers = spark.range(10_000)
    assert corpus.uniform_sample(numbers, 50, "id").distinct().count() == 50 and corpus.uniform_sample(numbers.limit(3), 10, "id").count() == 3
    assert sorted(corpus.uniform_sample(numbers, 50, "id").collect()) == sorted(corpus.uniform_sample(numbers.repartition(9), 50, "id").collect())
    prof = {r.measure: r.value for r in corpus.corpus_profile(rows, rows.select("doc_id", "text").distinct()).collect()}
    assert prof["sentences"] == 3 and prof["share of mentions labeled NIL"] == 0.3333 and prof["mentions per sentence with mentions"] == 3 and prof["type LOC"] == 1
    spans = spark.createDataFrame([("k", 0, 6, "B-LOC", 1), ("k", 4, 12, "PERSON", 2)], "text_key string, start int, end int, entity_group string, ord int")
    m = spark.createDataFrame([("1", "k", "text of it", "of", 5, 7, ""), ("2", "k", "text of it", "text", None, None, ""), ("3", "z", "t", "t", 0, 1, "X")], "id string, text_key string, text string, mention string, start int, end int, type string")
    assert {r.id: r.type for r in kb.assign_ner_types(m, spans).collect()} == {"1": "PER", "2": "LOC", "3": None}


def sheet(spark, rows):
    return spark.createDataFrame([tuple({"group": "disagreement", "options": "Q1|Q2", "sources": '{"gold":"Q1"}', "status": "done", **r}.get(c, "") for c in POOLED_REVIEW) for r in rows], ", ".join(f"`{c}` string" for c in POOLED_REVIEW))


def test_pooled_review_life_cycle(spark):
    rows = [{"run": r, "id": str(i), "gold": "Q1", "qid": "Q2" if (r == "b" and i < 4) else "Q1"} for r in ("a", "b") for i in range(40)]
    first = review.pooled_review(runs(spark, rows), audit=5)
    cells = {r.id: r for r in first.collect()}
    assert sum(r.group == "audit" for r in cells.values()) == 5 and all(set(cells[str(i)].options.split("|")) == {"Q1", "Q2"} for i in range(4))
    judged = first.withColumns({"status": F.lit("done"), "accepted": F.lit("Q1"), "annotator": F.lit("A")})
    more = rows + [{"run": "c", "id": str(i), "gold": "Q1", "qid": "Q3" if i in (0, 9) else "Q1"} for i in range(40)]
    second = {r.id: r for r in review.pooled_review(runs(spark, more), previous=judged, audit=5).collect()}
    assert [second[i].status for i in ("0", "1", "9")] == ["", "done", ""]
    kept = {i for i, r in second.items() if r.group == "audit"} & {i for i, r in cells.items() if r.group == "audit"}
    assert len(kept) >= 4
    single = spark.createDataFrame([tuple({"id": "0", "gold": "Q1", "agent": "Q2", "search": "Q3", "verdict": "both_ok"}.get(c, "") for c in SINGLE_REVIEW)], ", ".join(f"`{c}` string" for c in SINGLE_REVIEW))
    third = {r.id: r for r in review.pooled_review(runs(spark, more), previous=judged, carry_from=single, audit=5).collect()}
    assert (third["0"].status, third["0"].accepted, third["0"].carried) == ("done", "Q1|Q2", "yes")


def test_labels_agreement_and_corrections(spark):
    a = sheet(spark, [{"id": "1", "accepted": "Q1"}, {"id": "2", "accepted": "Q2"}, {"id": "3", "accepted": ""}, {"id": "4", "status": "unclear"}, {"id": "5", "accepted": "Q1|Q2"}, {"id": "6", "accepted": "Q1", "group": "audit"}, {"id": "7", "status": ""}])
    b = sheet(spark, [{"id": "1", "accepted": "Q1"}, {"id": "2", "accepted": "Q1"}, {"id": "3", "accepted": ""}, {"id": "5", "accepted": "Q2|Q1"}])
    got = review.annotator_agreement(a, b).first()
    assert (got.rows, got.exact, got.judgements, got.equal) == (4, 3, 8, 6) and 0 < got.cohen_kappa < 1
    rows = spark.createDataFrame([(str(i), f"d{i}", f"text {i}", "m", None, None, "LOC", "head", 3, "Q1") for i in range(1, 9)], "id string, doc_id string, text string, mention string, start int, end int, type string, category string, sitelinks int, gold string")
    out = review.corrected_dataset(rows, a)
    assert {r.id: (r.label_status, r.gold_corrected) for r in out.collect()} == {
        "1": ("confirmed", ["Q1"]), "2": ("corrected", ["Q2"]), "3": ("corrected", []), "4": ("unclear", None), "5": ("alternatives_acceptable", ["Q1", "Q2"]), "6": ("audited_confirmed", ["Q1"]), "7": ("not_reviewed", ["Q1"]), "8": ("unreviewed_agreement", ["Q1"])}
    texts = spark.createDataFrame([("d1", "text 1"), ("d2", "changed")], "doc_id string, text string")
    back = {r.doc_id: (r.text, r.restored) for r in review.restore_texts(out.drop("text"), texts).collect()}
    assert back["d1"] == ("text 1", True) and back["d2"] == back["d3"] == (None, False)
    summary = {r.group: r for r in review.pooled_summary(a).collect()}
    assert (summary["disagreement"].reviewed, summary["disagreement"].gold_wrong, summary["gold NIL"].rows, summary["gold NIL"].low) == (4, 2, 0, None)


RECORDS = [{"id": 1, "text": "a"}, {"id": 2, "text": "b ] } ,"}]


@pytest.mark.parametrize(("name", "text", "n"), [
    ("array", json.dumps(RECORDS), 2), ("arrays", json.dumps(RECORDS) + json.dumps(RECORDS), 4), ("lines", "\n".join(map(json.dumps, RECORDS)), 2), ("pretty", "\n".join(json.dumps(r, indent=2) for r in RECORDS), 2),
    ("wrapped", json.dumps({"data": RECORDS}), 2), ("keyed", json.dumps({"x": RECORDS[0], "y": RECORDS[1]}), 2), ("marked", "﻿" + json.dumps(RECORDS), 2), ("cut", json.dumps(RECORDS * 100)[:-3], 199), ("literal", str(RECORDS), 2)])
def test_odd_json(spark, tmp_path, name, text, n):
    (tmp_path / "x.json").write_bytes(gzip.compress(text.encode()) if name in ("array", "cut") else text.encode())
    rows = readers.read_records(spark, str(tmp_path / "x.json"), "id int, text string").collect()
    assert len(rows) == n and all(r.text for r in rows)


def records(spark, tmp_path, data, schema="id string, sentence string", name="x.json"):
    (tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    return [tuple(r) for r in readers.read_records(spark, str(tmp_path / name), schema).collect()]


def test_lines_with_lists_are_records(spark, tmp_path):
    rows = [{"id": str(i), "qid": "Q1", "trace": [{"step": "verify", "issues": []}]} for i in range(3)]
    schema, want = "id string, qid string", [(str(i), "Q1") for i in range(3)]
    text = "\n".join(map(json.dumps, rows))
    assert records(spark, tmp_path, text, schema) == records(spark, tmp_path, gzip.compress(text.encode()), schema) == want
    assert records(spark, tmp_path, json.dumps(rows), schema) == records(spark, tmp_path, json.dumps({"meta": {"v": 1}, "data": rows}), schema) == want


def test_broken_and_foreign_files_raise(spark, tmp_path):
    rows = [{"id": f"e{i}", "sentence": f"a sentence of number {i} that says something"} for i in range(6)]
    pretty = json.dumps(rows, indent=2)
    assert len(records(spark, tmp_path, pretty[:-6])) == 5
    for data, said in (
        (pretty.replace('"sentence": "a sentence of number 2', '"sentence": a sentence of number 2', 1), "2 records were read before"), (b"PK\x03\x04rest", "ZIP archive"),
        ("\r\n<!DOCTYPE html><html></html>", "HTML web page"), ("\n\n", "white space"), ("plain words", "unknown format")):
        with pytest.raises(Exception, match=said):
            records(spark, tmp_path, data)


def test_records_by_content(spark, tmp_path):
    tokens = "# s\nMessi\tB-PER\tQ615\nmarka\tO\t_\nPSG\tB-ORG\tQ483020\n\nx\tO\tO\nS\tB-ORG\tQ1090717\n"
    schema = "tokens array<string>, tags array<string>, qids array<string>"
    want = [(["Messi", "marka", "PSG"], ["B-PER", "O", "B-ORG"], ["Q615", None, "Q483020"]), (["x", "S"], ["O", "B-ORG"], [None, "Q1090717"])]
    assert records(spark, tmp_path, tokens, schema, "f.txt") == records(spark, tmp_path, gzip.compress(tokens.encode()), schema, "g.conll.gz") == want
    assert records(spark, tmp_path, "id,sentence\n1,\"a, b\"\n", name="c.csv") == records(spark, tmp_path, "id\tsentence\n1\ta, b\n", name="c.tsv") == [("1", "a, b")]


def test_rows_without_ids_and_repeated_ids(spark):
    nested = spark.createDataFrame([("PSG won", [("PSG", "Q1")])] * 2, "sentence string, entities array<struct<text: string, wikidata: string>>")
    roles = {"id": None, "text": "sentence", "entities": "entities", "mention": "text", "qid": "wikidata"}
    assert sorted((r.mention, r.doc_id, r.id) for r in corpus.mentions_from_nested(nested, roles).collect()) == [("PSG", "0", "0-0"), ("PSG", "1", "1-0")]
    flat = spark.createDataFrame([(None, "a b", "a", "Q1"), ("7", "a b", "b", "Q2"), (None, "a b", "b", "Q2")], "id string, text string, mention string, qid string").coalesce(1)
    assert [(r.id, r.mention) for r in corpus.mentions_from_flat(flat, {k: k for k in ("id", "text", "mention", "qid")}).orderBy("id").collect()] == [("0-0", "a"), ("2-0", "b"), ("7-0", "b")]
    one = ("7", ["a", "b", "c"], ["B-PER", "I-PER", "I-LOC"], ["Q1", None, "x"])
    bio = spark.createDataFrame([one, one, (None, ["z"], ["S-ORG"], [None]), ("8", [], [], []), ("9", None, None, None)], "id string, tokens array<string>, tags array<string>, qids array<string>").coalesce(1)
    got = [(r.id, r.mention, r.type, r.gold) for r in corpus.mentions_from_bio(bio, {k: k for k in ("id", "tokens", "tags", "qids")}).collect()]
    assert sorted(got) == [("2-0", "z", "ORG", "NIL")] + [("7-0", "a b", "PER", "Q1")] * 2 + [("7-1", "c", "LOC", "NIL")] * 2


def test_split_is_the_first_of_all_by_hash(spark):
    names = [f"d{i}" for i in range(500)]
    rows = spark.createDataFrame([(f"{d}-{k}", d, "text") for d in names for k in range(2)], "id string, doc_id string, text string")
    for share in (0.0, 0.2, 0.5, 1.0):
        dev, test = corpus.split_by_doc(rows, share)
        n = max(1, int(500 * share))
        want = sorted(names, key=lambda d: (hashlib.md5(f"13-{d}".encode()).hexdigest(), d))
        assert {r.doc_id for r in dev.collect()} == set(want[:n]) and {r.doc_id for r in test.collect()} == set(want[n:]) and dev.count() == 2 * n


def test_files(spark, tmp_path):
    tokens = "# c\nle\tO\t-\nPSG\tB-ORG\tQ1\n\nx\tO\n"
    for name, data in {"a.conll": tokens.encode(), "b.gz": gzip.compress(b"x"), "c.json": b' [{"a": 1}]', "d.html": b"<!DOCTYPE html><p>", "e.txt": b" \n", "none.txt": b"", "f.zip": b"PK\x03\x04x", "g.txt": b"plain words", "h.txt": b"a\tb\n", "i.htm": b"\xef\xbb\xbf <div>x", "j.txt": b"x B-PER"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: r.format for r in readers.sniff_files(spark, str(tmp_path)).collect()}
    assert got == {"a.conll": "conll", "b.gz": "gzip", "c.json": "json", "d.html": "html", "e.txt": "empty", "none.txt": "empty", "f.zip": "zip", "g.txt": "unknown", "h.txt": "conll", "i.htm": "html", "j.txt": "conll"}
    rows = readers.read_conll(spark, str(tmp_path / "a.conll")).orderBy("id").collect()
    assert [(r.tokens, r.tags, r.qids) for r in rows] == [(["le", "PSG"], ["O", "B-ORG"], [None, "Q1"]), (["x"], ["O"], [None])]


def test_run_files_and_sheets(spark, tmp_path):
    line = lambda i, q: json.dumps({"id": i, "gold": "Q1", "qid": q}) + "\n"
    for name, data in {"a.jsonl": line("1", "Q1"), "b@r2.jsonl": line("1", "Q1") + line("2", "ERROR"), "dev_c.jsonl": line("1", "Q1")}.items():
        (tmp_path / name).write_text(data)
    (tmp_path / "a.jsonl.gz").write_bytes(gzip.compress((line("1", "Q7") + line("2", "Q8")).encode()))
    got = {(r.run, r.id): r.qid for r in readers.read_runs(spark, str(tmp_path)).collect()}
    assert got == {("a", "1"): "Q7", ("a", "2"): "Q8", ("b@r2", "1"): "Q1", ("b@r2", "2"): "ERROR"}
    rows = sheet(spark, [{"id": "1", "text": 'say "x", and\nmore', "sources": '{"gold": "Q1"}', "accepted": ""}])
    readers.write_review(rows, str(tmp_path / "sheet"))
    assert readers.read_review(spark, str(tmp_path / "sheet"), POOLED_REVIEW).collect() == rows.collect()
    (tmp_path / "bom.csv").write_bytes("﻿id,status\n1,\n".encode())
    assert readers.read_review(spark, str(tmp_path / "bom.csv"), ("id", "status", "accepted")).first() == ("1", "", "")


def test_streams(spark, tmp_path):
    source, schema = tmp_path / "in", "run string, ord long, id string, qid string"
    source.mkdir()

    def land(name, *rows):
        (source / name).write_text("".join(json.dumps(dict(zip(("run", "ord", "id", "qid"), r, strict=True))) + "\n" for r in rows))

    def go():
        jobs.stream_runs(spark, str(source), schema, str(tmp_path / "table"), str(tmp_path / "c1")).awaitTermination()
        jobs.stream_sample(spark, str(source), schema, 2, "id", str(tmp_path / "kept"), str(tmp_path / "c2")).awaitTermination()

    land("1.json", ("a", 1, "1", "Q1"), ("a", 2, "2", "ERROR"))
    go()
    land("2.json", ("a", 3, "1", "Q9"), ("a", 4, "2", "Q2"), ("a", 5, "3", "Q3"))
    go()
    stored = jobs.read_runs_table(spark, str(tmp_path / "table"), schema)
    assert sorted((r.id, r.qid) for r in stored.collect()) == [("1", "Q1"), ("2", "ERROR"), ("2", "Q2"), ("3", "Q3")]
    kept = jobs.read_sample(spark, str(tmp_path / "kept"), schema, 2, "id")
    assert sorted(r.id for r in kept.collect()) == sorted(sorted(["1", "2", "1", "2", "3"], key=lambda i: hashlib.md5(f"13-{i}".encode()).hexdigest())[:2])


def test_stream_profile(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "table")
    source.mkdir()

    def add(name, *rows):
        (source / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
        jobs.stream_profile(spark, str(source), jobs.PROFILED, table, str(tmp_path / "state")).awaitTermination()

    add("1.json", {"text": "PSG in باريس", "mentions": [{"mention": "PSG", "type": "ORG", "gold": "NIL"}, {"mention": "باريس", "gold": "Q90"}]}, {"text": " "}, {})
    add("2.json", {"text": "none"})
    assert {r.measure: r.value for r in jobs.read_profile(spark, table).collect()} == {
        "sentences": 2, "mentions": 2, "share of mentions labeled NIL": 0.5, "share of mentions in Latin script": 0.5, "share of sentences without Arabic script": 0.5,
        "mean sentence length (chars)": 8, "mentions per sentence with mentions": 2, "type ORG": 0.5, "type None": 0.5}
    assert jobs.profile_counts(spark.createDataFrame([], jobs.PROFILED)).count() == 0


def test_search_under_a_shared_prefix(spark):
    names = [(f"the long shared name {i}", f"Q{i}", i % 1000) for i in range(20_000)] + [("the", "Q7", 7)]
    index = spark.createDataFrame([("en", n, q, s) for n, q, s in names], "lang string, name_norm string, qid string, sitelinks int").repartition(8)
    asked = ["the", "The  long", "the long shared name 1999", "the long shared name 19999", "the long shared name 199990", "th", "name", " "]
    got = kb.search_names(spark.createDataFrame([("en", q) for q in asked], "lang string, query string"), index).orderBy("query", "rank").collect()
    for q in asked:
        found = {(-s, i) for n, i, s in names if q.strip() and n.startswith(" ".join(q.lower().split()))}
        assert [(-r.sitelinks, r.qid) for r in got if r.query == q] == sorted(found)[:7], q
