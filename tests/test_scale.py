"""Record numbers, long rows and texts, merged ids, files of odd sizes and long-running streams."""

import gzip
import json
import random
import time
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkmill.operators import corpus, kb, linking, merging
from linkmill.plans import queries
from linkmill.sources import formats, readers
from linkmill.sources.numbering import numbered
from linkmill.streaming import jobs
from linkmill.streaming.tables import BatchTable

# --- record numbers --------------------------------------------------------------------------------------------------


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def lines_of(tmp_path, sizes):
    for k, n in enumerate(sizes):
        (tmp_path / f"part-{k:05d}.json").write_text("".join(json.dumps({"text": "the same sentence", "mention": f"m{k}-{i}", "pad": "x" * (i % 50)}) + "\n" for i in range(n)))
    return [f"m{k}-{i}" for k, n in enumerate(sizes) for i in range(n)]


def test_numbers_follow_files_and_not_tasks(spark, tmp_path, small_splits):
    want = lines_of(tmp_path, [30, 500, 0, 1, 200])
    for size in ("2000", "700", "1g"):  # many splits a file, more, one split of several files
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = numbered(spark.read.schema("text string, mention string, pad string").json(str(tmp_path)), "n")
        assert [r.mention for r in rows.orderBy("n").collect()] == want and sorted(r.n for r in rows.collect()) == list(range(len(want)))


def test_files_split_anew_between_the_passes_raise(spark, tmp_path, small_splits):
    lines_of(tmp_path, [500, 500])
    rows = numbered(spark.read.schema("mention string").json(str(tmp_path)), "n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3001")
    with pytest.raises(Exception, match="split otherwise"):
        rows.collect()


def test_numbers_of_rows_that_are_in_no_file(spark):
    rows = numbered(spark.range(1000).repartition(7).withColumn("a.b", F.lit(1)), "n")
    assert sorted(r.n for r in rows.collect()) == list(range(1000)) and rows.columns == ["id", "a.b", "n"]
    assert numbered(spark.range(0), "n").count() == 0


def test_flat_rows_of_one_sentence_keep_apart(spark, tmp_path, small_splits):
    want = lines_of(tmp_path, [300, 40])
    df = spark.read.schema("text string, mention string, pad string").json(str(tmp_path))
    rows = corpus.mentions_from_flat(df, {"id": None, "text": "text", "mention": "mention"}).collect()
    assert {r.mention: r.id for r in rows} == {m: f"{k}-0" for k, m in enumerate(want)}


def test_the_later_part_file_wins(spark, tmp_path):
    folder = tmp_path / "a.jsonl"
    folder.mkdir()
    line = lambda i, q, pad="": json.dumps({"id": str(i), "gold": "Q1", "qid": q, "text": pad}) + "\n"
    (folder / "part-00000").write_text(line(7, "Q_old") + line(8, "Q8"))
    (folder / "part-00001").write_text(line(7, "Q_new") + "".join(line(i, "Q1", "x" * 500) for i in range(100, 400)))  # larger, so Spark reads it first
    (folder / "part-100000").write_text(line(8, "Q_last"))
    for f in folder.iterdir():
        f.rename(f.with_name(f.name + ".json"))
    rows = readers.read_runs(spark, str(tmp_path), ["id", "qid"])
    last = {r.id: r.qid for r in rows.orderBy("ord").collect()}
    assert rows.select("run").distinct().collect() == [("a",)] and (last["7"], last["8"]) == ("Q_new", "Q_last")


# --- long rows -------------------------------------------------------------------------------------------------------


def spans_of(tokens, tags, qids):
    """Spans by a loop over the tokens."""
    out, at, kind = [], 0, None
    for j, token in enumerate(tokens):
        tag = tags[j] if j < len(tags) and tags[j] is not None else "O"
        q = qids[j] if j < len(qids) and qids[j] and formats.ITEM.match(qids[j].strip()) else None
        if tag[:2] in ("B-", "S-", "I-", "E-"):
            if tag[:2] in ("B-", "S-") or kind != tag[2:]:
                out.append([at, at + len(token), tag[2:], q, token])
            else:
                out[-1] = [out[-1][0], at + len(token), out[-1][2], out[-1][3] or q, f"{out[-1][4]} {token}"]
            kind = tag[2:]
        else:
            kind = None
        at += len(token) + 1
    return out


def test_spans_against_a_loop(spark):
    rng = random.Random(1)
    pick = lambda n: (rng.choices(["a", "نهر", "", "wörd"], k=n), rng.choices(["O", "B-PER", "I-PER", "I-LOC", "E-LOC", "S-X", None], k=n), rng.choices([None, "-", "Q1", "http://www.wikidata.org/entity/Q22", "q"], k=n))
    rows = [(str(i), *pick(rng.randint(0, 12))) for i in range(300)]
    rows += [("short tags", ["a", "b"], ["B-X"], []), ("long tags", ["a"], ["O", "B-X"], ["Q1", "Q2"])]
    df = spark.createDataFrame(rows, "id string, tokens array<string>, tags array<string>, qids array<string>").repartition(3)
    got = corpus.mentions_from_bio(df, {k: k for k in ("id", "tokens", "tags", "qids")}).collect()
    want = [(f"{i}-{k}", m, t, s, e, "NIL" if q is None else q.rsplit("/", 1)[-1]) for i, *x in rows for k, (s, e, t, q, m) in enumerate(spans_of(*x))]
    assert sorted((r.id, r.mention, r.type, r.start, r.end, r.gold) for r in got) == sorted(want) and all(r.text[r.start : r.end] == r.mention for r in got)


def test_a_row_of_80000_tokens(spark):
    roles = {k: k for k in ("id", "tokens", "tags", "qids")}
    rows = lambda n: spark.range(1).selectExpr("'d' AS id", f"transform(sequence(1, {n}), i -> concat('token', i)) AS tokens", f"transform(sequence(1, {n}), i -> CASE i % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'B-PER' ELSE 'I-PER' END) AS tags", f"transform(sequence(1, {n}), i -> concat('Q', i)) AS qids")
    corpus.mentions_from_bio(rows(10), roles).drop("text").collect()
    began = time.time()
    got = corpus.mentions_from_bio(rows(80_000), roles).drop("text").agg(F.count("*"), F.max("end"), F.max(F.length("mention"))).first()
    assert got[0] == 26667 and got[2] == 21 and time.time() - began < 4


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(3)
    some = lambda n: [(f"{k}", rng.choice("ab"), s := rng.randint(-1, 300), s + rng.choice([-1, 0, 1, 3, 10, 64, 500])) for k in range(n)]
    m, s = some(120), some(150)
    got = kb.overlaps(spark.createDataFrame(m, "id string, k string, start int, end int"), spark.createDataFrame([(k, a, b, i) for i, k, a, b in s], "k string, _a int, _b int, i string"), "k")
    assert Counter((r.id, r.i) for r in got.collect()) == Counter((x[0], y[0]) for x in m for y in s if x[1] == y[1] and y[2] < x[3] and y[3] > x[2])


def test_a_text_of_100000_spans(spark):
    spans = spark.range(100_000).selectExpr("'t' AS text_key", "CAST(id * 10 AS INT) AS start", "CAST(id * 10 + 8 AS INT) AS end", "CASE WHEN id % 2 = 0 THEN 'LOC' ELSE 'ORG' END AS entity_group", "id AS ord")
    spans = spans.unionByName(spark.range(1).selectExpr("'t'", "0", "1000000", "'PERSON'", "-1L").toDF(*spans.columns))
    mentions = spark.range(100_000).selectExpr("CAST(id AS STRING) AS id", "'t' AS text_key", "'' AS text", "'' AS mention", "CAST(id * 10 + 7 AS INT) AS start", "CAST(id * 10 + 12 AS INT) AS end", "'' AS type")
    met = kb.overlaps(mentions.select("id", "text_key", "start", "end"), spans.select("text_key", F.col("start").alias("_a"), F.col("end").alias("_b")), "text_key")
    assert met.count() == 100_000 + 99_999 + 100_000
    assert {r[0]: r[1] for r in kb.assign_ner_types(mentions, spans).groupBy("type").count().collect()} == {"PER": 100_000}


def test_names_of_1000_characters(spark):
    rng = random.Random(4)
    names = ["".join(rng.choices("ab", k=1000)) for _ in range(300)] + ["ab" * 500 + str(i) for i in range(200)] + ["a", "ab", "aba"]
    index = spark.createDataFrame([("en", n, f"Q{k}", k % 7) for k, n in enumerate(names)], "lang string, name_norm string, qid string, sitelinks int")
    asked = [n[:k] for n in names[:40] for k in (1, 2, 3, 4, 17, 999)] + ["ab" * 400, "ab" * 500, "ab" * 500 + "7", "zz", "ab" * 501]
    got = kb.search_names(spark.createDataFrame([("en", q) for q in set(asked)], "lang string, query string"), index).collect()
    found = {q: [h.qid for h in sorted((r for r in got if r.query == q), key=lambda r: r.rank)] for q in asked}
    for q in asked:
        assert found[q] == [i for _, i in sorted((-(k % 7), f"Q{k}") for k, n in enumerate(names) if n.startswith(q))][:7], q


# --- merged ids ------------------------------------------------------------------------------------------------------


def ends(pairs):
    least = {}
    for o, n in pairs:
        if o is not None and n is not None and o != n:
            least[o] = min(least.get(o, n), n, key=lambda x: (len(x), x))
    out = {}
    for o in least:
        seen, at = [o], least[o]
        while at in least and at not in seen:
            seen.append(at)
            at = least[at]
        out[o] = min(seen[seen.index(at) :], key=lambda x: (len(x), x)) if at in least else at
    return out


def test_chains_and_circles_of_redirects(spark):
    rng = random.Random(5)
    pairs = [(f"C{i}", f"C{i + 1}") for i in range(1000)] + [("R1", "R2"), ("R2", "R3"), ("R3", "R1"), ("T1", "R2"), ("T0", "T1"), ("S", "S"), (None, "Q1"), ("Q1", None), ("D", "Q10"), ("D", "Q9")]
    pairs += [(f"L{i}", f"L{(i + 1) % 77}") for i in range(77)] + [(f"A{i}", f"L{i % 77}") for i in range(20)] + [(f"X{i}", f"X{rng.randint(0, 300)}") for i in range(300)]
    got = merging.merged_ids(spark.createDataFrame(pairs, "old string, new string")).collect()
    assert {r.old: r.current for r in got} == ends(pairs) and len(got) == len(ends(pairs))
    assert merging.merged_ids(spark.createDataFrame([], "old string, new string")).count() == 0


def test_old_ids_reach_their_item_once(spark):
    merged = merging.merged_ids(spark.createDataFrame([("Q5", "Q6"), ("Q6", "Q7")], "old string, new string"))
    runs = spark.createDataFrame([("r", "1", "Q5", "Q6", None, ["Q5", "Q7", "Q9"]), ("r", "2", "NIL", "ERROR", "Q1", None), ("r", None, "Q1", "Q5", "NIL", [])], "run string, id string, gold string, qid string, initial_qid string, candidates array<string>")
    got = {r.id: tuple(r)[2:] for r in merging.current_run(runs, merged).collect()}
    assert got == {"1": ("Q7", "Q7", None, ["Q7", "Q9"]), "2": ("NIL", "ERROR", "Q1", None), None: ("Q1", "Q7", "NIL", [])}
    entities = spark.createDataFrame([("Q7", "river", 3), ("Q8", "river bank", 2)], "qid string, label_en string, sitelinks int").selectExpr(
        "qid", "CAST(NULL AS STRING) AS label_ar", "label_en", "CAST(NULL AS STRING) AS label_fr", *(f"CAST(NULL AS array<string>) AS aliases_{x}" for x in ("ar", "en", "fr")), "CAST(NULL AS array<string>) AS p31", "sitelinks")
    page = spark.createDataFrame([("river", "Q5", False), ("bank", "Q8", False), ("River", None, True)], "title string, qid string, is_disambiguation boolean")
    nothing = spark.createDataFrame([], "from_title string, to_title string")
    got = kb.generate_candidates(spark.createDataFrame([("river",)], "mention string"), entities, page, nothing, nothing.withColumn("pos", F.lit(1)), merged=merged).orderBy("pos").collect()
    assert [(r.pos, r.qid) for r in got] == [(1, "Q7"), (2, "Q8")]


# --- files -----------------------------------------------------------------------------------------------------------


def test_heads_of_a_huge_file_and_of_an_empty_one(spark, tmp_path):
    with open(tmp_path / "huge.json", "wb") as f:
        f.write(b"[{")
        f.truncate(3 << 30)  # sparse: no blocks on disk
    (tmp_path / "none.txt").write_bytes(b"")
    (tmp_path / "_SUCCESS").write_bytes(b"")
    began = time.time()
    got = {r.path.rsplit("/", 1)[-1]: (r.length, r.format) for r in readers.sniff_files(spark, str(tmp_path)).collect()}
    assert got == {"huge.json": (3 << 30, "json"), "none.txt": (0, "empty")} and time.time() - began < 20
    assert [r.format for r in readers.sniff_files(spark, f"file://{tmp_path}/no*").collect()] == ["empty"]


def test_a_long_list_is_read_in_pieces():
    record = json.dumps({"id": 1, "text": 'a "quoted" sentence, with [brackets] ' * 20})
    part = (record + ",\n").encode() * 1000

    def parts():
        yield b"[" + part
        for _ in range(120):  # about 90 MB
            yield part
        yield record.encode() + b"]"

    tracemalloc.start()
    n = sum(1 for _ in formats.records(parts, "x.json"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 121_001 and peak < 20e6


def test_json_cut_at_every_place():
    rows = [{"id": 1, "t": "a longer text with \\ and \" and [ in it"}, {"id": 2, "t": "x", "l": [[1, {"a": {}}]]}]
    for text in (json.dumps(rows), "\n".join(map(json.dumps, rows)), json.dumps({"v": 1, "rows": rows}), "﻿" + json.dumps(rows, indent=1)):
        data = text.encode()
        for k in range(1, len(data)):
            assert list(formats.records(lambda k=k: iter([data[:k], data[k:]]), "x")) == rows  # noqa: B023


def test_records_are_numbered_over_all_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"t": "a0"}, {"t": "a1"}]))
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(b'{"t": "b0"}\n{"t": "b1"}'))
    rows = readers.read_records(spark, str(tmp_path), "t string", number="n")
    assert [(r.t, r.n) for r in rows.orderBy("n").collect()] == [("a0", 0), ("a1", 1), ("b0", 2), ("b1", 3)]
    flat = corpus.mentions_from_flat(rows.withColumn("m", F.lit("x")), {"id": None, "text": "t", "mention": "m", "number": "n"})
    assert sorted((r.text, r.id) for r in flat.collect()) == [("a0", "0-0"), ("a1", "1-0"), ("b0", "2-0"), ("b1", "3-0")]


def test_token_files_split_and_roles_by_sentence(spark, tmp_path, small_splits):
    sentence = lambda i: f"w{i}\tB-PER\tQ{i}\nx\tO\t_" if i % 3 else f"w{i} Q{i} O\n# note\ny extra"
    (tmp_path / "a.conll").write_text("\n\n".join(map(sentence, range(400))) + "\n")
    (tmp_path / "b.conll").write_bytes("\r\n\r\n".join(sentence(i).replace("\n", "\r\n") for i in range(400)).encode())
    (tmp_path / "c.conll").write_bytes("﻿# only a note\n\nz z\tO\n \nq\u0085\tS-X\n\n\n\n".encode())
    rows = readers.read_conll(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() > 4
    got = {r.id: (r.tokens, r.tags, r.qids) for r in rows.collect()}
    assert len(got) == 802 and got["c.conll-0"] == (["z z"], ["O"], [None]) and got["c.conll-1"] == (["q\u0085"], ["S-X"], [None])
    for i in range(400):
        want = ([f"w{i}", "x"], ["B-PER", "O"], [f"Q{i}", None]) if i % 3 else ([f"w{i}", "y"], ["O", "O"], [f"Q{i}", None])
        assert got[f"a.conll-{i}"] == got[f"b.conll-{i}"] == want


def test_small_tables_are_written_as_csv(spark, tmp_path):
    readers.write_tables({"one": spark.range(3), "two": spark.createDataFrame([("a,\"b\"",)], "x string")}, str(tmp_path))
    assert [p.suffix for p in (tmp_path / "one").glob("*.csv")] == [".csv"] and spark.read.csv(str(tmp_path / "two"), header=True, quote='"', escape='"').first()[0] == 'a,"b"'


# --- links and flags -------------------------------------------------------------------------------------------------


def test_links_of_classes_that_are_no_names_are_left_out(spark):
    links = spark.createDataFrame([("A", 0, "x y z", w, w, 2 * k, 2 * k + 1) for k, w in enumerate("xyz")], "doc_id string, para int, text string, anchor string, target string, start int, end int")
    titles = spark.createDataFrame([("x", "Q1"), ("y", "Q2"), ("z", "Q3")], "target string, gold string")
    closure = spark.createDataFrame([("person", "Q5"), ("writer", "Q5")], "class string, root string")
    instances = spark.createDataFrame([("Q1", "writer"), ("Q1", "hobby"), ("Q2", "hobby")], "qid string, class string")
    assert {r.gold for r in corpus.build_link_set(links, titles, closure, instances, 10).collect()} == {"Q1", "Q3"}  # Q3's class isn't known
    assert {r.gold for r in corpus.build_link_set(links, titles, None, None, 10).collect()} == {"Q1", "Q2", "Q3"}


def test_flags_of_a_batch_come_back_to_their_mentions(spark):
    answers = spark.createDataFrame([("d", "1-0", 0, "Paris", "Q90"), ("d", "1-1", 1, "Lyon", "Q456"), ("d", "1-2", 2, "x", "NIL"), ("e", "2-0", 0, "alone", "Q1")], "doc_id string, id string, pos int, mention string, qid string").withColumns({"type": F.lit("LOC"), "text": F.lit("t")})
    flags = spark.createDataFrame([("d", 1, None), ("d", 7, "no such place"), ("e", 0, "not in a batch"), ("d", 0, "wrong town")], "doc_id string, pos int, reason string")
    got = linking.coherence_flags(linking.coherence_batches(answers), flags).collect()
    assert {r.id: r.reason for r in got} == {"1-0": "wrong town", "1-1": "inconsistent with the other entities in the text"}


# --- streams ---------------------------------------------------------------------------------------------------------

RUN = "run string, ord long, id string, qid string"


def test_state_is_read_by_what_a_batch_brings(spark, tmp_path):
    source, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    source.mkdir()

    def go(name, rows):
        (source / name).write_text("".join(json.dumps(dict(zip(("run", "ord", "id", "qid"), r, strict=True))) + "\n" for r in rows))
        stream = jobs.stream_runs(spark, str(source), RUN, table, state)
        stream.awaitTermination()
        return stream.recentProgress[-1].stateOperators[0]

    go("1.json", [("a", k, str(k), "Q1") for k in range(2000)])
    for k in range(3):
        kept = go(f"more{k}.json", [("a", 5000, "7", "Q9"), ("a", 5001, f"new{k}", "ERROR"), ("a", 5002, f"new{k}", "Q2"), ("a", 5003, f"new{k}", "Q3")])
        assert kept.numRowsUpdated == 2 and kept.numRowsTotal == 2001 + k
    stored = {r.id: r.qid for r in jobs.read_runs_table(spark, table, RUN).collect()}
    assert len(stored) == 2003 and stored["7"] == "Q1" and {stored[f"new{k}"] for k in range(3)} == {"Q3"}


def test_state_of_runs_is_on_disk_and_packed(spark, tmp_path, monkeypatch):
    schema = "run string, ord long, id string, qid string, row string, m map<string,int>"
    source = tmp_path / "in"
    source.mkdir()
    line = {"run": "a", "ord": 2, "id": "1", "qid": "Q1", "row": "x", "m": {"k": 1}}
    (source / "1.json").write_text("".join(json.dumps(x) + "\n" for x in (line, line | {"ord": 1, "qid": "Q2"}, {"run": "a", "ord": 5, "id": "2"})))
    stream = jobs.stream_runs(spark, str(source), schema, str(tmp_path / "table"), str(tmp_path / "state"))
    stream.awaitTermination()
    assert any(k.startswith("rocksdb") for k in stream.recentProgress[-1].stateOperators[0].customMetrics)
    assert not set(jobs.ON_DISK) & set(spark.conf.getAll)
    stored = jobs.read_runs_table(spark, str(tmp_path / "table"), schema)
    assert sorted((tuple(r) for r in stored.collect()), key=lambda r: r[2]) == [("a", 2, "1", "Q1", "x", {"k": 1}), ("a", 5, "2", None, None, None)]

    monkeypatch.setattr(queries, "shared_folder", lambda spark: str(tmp_path / "query"))
    assert queries.stream_runs(spark, "/root/testdata/sf0.001").count()
    assert {p.suffix for p in (tmp_path / "query" / "in").glob("part-*")} == {".gz"}


def test_snapshots_of_many_batches(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"), "n long")
    for k in range(25):
        table.write(spark.createDataFrame([(k,)], "n long").coalesce(1), k)
    everything = lambda: sorted(r.n for r in table.read().collect())
    assert everything() == list(range(25))
    table.snapshot(24)  # a compaction that broke off before its manifest
    assert everything() == list(range(25))
    table.compact(24)
    assert everything() == list(range(25)) and table.read().select(F.input_file_name()).distinct().count() == 1
    table.write(spark.createDataFrame([(999,)], "n long"), 24)  # a batch that runs again after it was merged
    table.write(spark.createDataFrame([(25,)], "n long"), 25)
    assert everything() == list(range(26))
    assert BatchTable(spark, str(tmp_path / "none"), "n long").read().count() == 0


def test_old_folders_go_one_compaction_later(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"), "n long")
    for k in range(6):
        table.write(spark.createDataFrame([(k,)], "n long"), k)
        if k % 2:
            before = table.read()
            table.compact(k)
            assert sorted(r.n for r in before.collect()) == list(range(k + 1))  # who began to read before goes on
    assert sorted(p.name for p in (tmp_path / "t" / "batches").iterdir()) == ["batch=4", "batch=5"]
    assert sorted(p.name for p in (tmp_path / "t" / "snapshots").iterdir()) == ["upto=3", "upto=5"]
    assert sorted(r.n for r in table.read().collect()) == list(range(6))


def test_streams_compact_as_they_go(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "table")
    source.mkdir()
    for k in range(5):
        (source / f"{k}.json").write_text(json.dumps({"text": f"text {k}", "mentions": [{"mention": "m", "type": "ORG", "gold": "NIL"}] * k}) + "\n")
        jobs.stream_profile(spark, str(source), jobs.PROFILED, table, str(tmp_path / "s1"), every=2).awaitTermination()
        jobs.stream_sample(spark, str(source), "text string", 3, "text", str(tmp_path / "kept"), str(tmp_path / "s2"), every=2).awaitTermination()
    assert {r.measure: r.value for r in jobs.read_profile(spark, table).collect()}["mentions"] == 10
    kept = {r.text for r in jobs.read_sample(spark, str(tmp_path / "kept"), "text string", 3, "text").collect()}
    assert kept == {r.text for r in corpus.uniform_sample(spark.createDataFrame([(f"text {k}",) for k in range(5)], "text string"), 3, "text").collect()}


def words_of(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / name / "documents.parquet"))
    return str(tmp_path / name)


def test_rows_of_two_files_meet_without_being_moved(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "shared_folder", lambda spark: str(tmp_path / "out"))
    rows = queries.read_rows(spark, words_of(spark, tmp_path, "in", [(k, f'a "quoted, {k}\nline b') for k in range(40)] + [(7, "again"), (7, "again")]))
    assert "Exchange" not in plan_of(rows)
    found = Counter((r.id, r.mention) for r in rows.collect())
    assert len(found) == 40 * 4 + 1 and found["7-1", "again"] == 2 and found["7-3", "7\nline"] == 1  # ids that come again don't multiply
    assert {p.suffix for p in (tmp_path / "out" / "rows.csv").glob("part-*")} == {".gz"}


def test_contexts_move_no_entities(spark, tmp_path):
    rows = [(k, f"the {k} th of  many texts") for k in range(40)]
    whole = queries.doc_context(spark, words_of(spark, tmp_path, "pieces", rows))
    assert "Exchange" not in plan_of(whole)
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "one" / "documents.parquet"))
    one = queries.doc_context(spark, str(tmp_path / "one"))  # fewer pieces than cores: the texts alone are dealt out
    assert (below := plan_of(one).partition("Exchange")[2]) and "transform" not in below
    found = [sorted(map(tuple, rows.collect())) for rows in (whole, one)]
    assert found[0] == found[1] and len(found[0]) == 240 and ("7-6", "the 7 th of  ⟦many⟧ texts") in found[0]


def test_texts_land_packed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "shared_folder", lambda spark: str(tmp_path / "out"))
    rows = [(k, "some words of a text, " * 50) for k in range(400)]
    got = {r.measure: r.value for r in queries.stream_profile(spark, words_of(spark, tmp_path, "in", rows)).collect()}
    assert got["sentences"] == 400 and got["mentions"] == 400 * 250
    landed = list((tmp_path / "out" / "in").glob("part-*"))
    assert {p.suffix for p in landed} == {".gz"} and sum(p.stat().st_size for p in landed) < 400 * 250 * 10


def test_common_rows(spark):
    rows = [("1", "a", None), ("1", "a", None), ("2", None, "a"), ("3", "x", "y"), (None, "n", "n"), *[(f"k{i}", "m", "g") for i in range(200)]]
    same = [("1", "a", None), ("2", "a", None), ("3", "x", "z"), (None, "n", "n"), *rows[5:]]
    one, other = (spark.createDataFrame(x, "id string, m string, g string") for x in (rows, same))
    want = Counter(rows) & Counter(same)
    for slices in (1, 16, 4096):
        assert Counter(map(tuple, readers.common_rows(one, other.select("g", "m", "id"), "id", slices).collect())) == want
        assert Counter(map(tuple, readers.common_rows(one, one, "id", slices).collect())) == Counter(rows)
    assert not readers.common_rows(one, other.limit(0), "id").count() and not readers.common_rows(one.limit(0), other, "id").count()


# --- larger tables ---------------------------------------------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_are_chosen_without_their_texts(spark):
    links = spark.range(400).selectExpr("CAST(id % 3 AS STRING) AS doc_id", "CAST(id AS INT) AS para", "concat('the text ', id) AS text", "'name' AS anchor", "concat('t', id % 9) AS target", "4 AS start", "8 AS end")
    links = links.unionByName(links.filter("para < 9"))  # repeated rows
    titles = spark.range(9).selectExpr("concat('t', id) AS target", "concat('Q', id) AS gold")
    got = corpus.build_link_set(links, titles, None, None, 7)
    assert "Window" not in plan_of(got)  # the texts are read for the chosen links alone
    rows = got.collect()
    assert len(rows) == 7 and len({(r.doc_id, r.gold) for r in rows}) == 7
    texts = {r.text: r for r in links.collect()}
    assert all(r.target_title == texts[r.text].target and r.doc_id == texts[r.text].doc_id for r in rows)


def test_contexts_of_mentions_are_those_of_each_alone(spark):
    from linkmill.functions import text

    rnd = random.Random(5)
    rows = []
    for i in range(30):
        words = [rnd.choice(["aé", "é", "نهر", "b😀", "xx"]) for _ in range(rnd.randint(0, 40))]
        t = " ".join(words) if i else None
        spans = [(f"{i}-{k}", rnd.choice([*words, "none", "", None]), rnd.choice([None, 0, 3, 7]), rnd.choice([None, 4, 5, 900])) for k in range(20)]
        rows.append((t, [(a, t[s:e] if t and s is not None and e is not None and rnd.random() < 0.5 else m, s, e) for a, m, s, e in spans]))
    docs = spark.createDataFrame(rows, "text string, mentions array<struct<id: string, mention: string, start: int, end: int>>")
    each = docs.select("text", F.inline("mentions")).select("id", text.doc_context(F.col("text"), F.col("mention"), F.col("start"), F.col("end"), 6).alias("context"))
    assert sorted(map(str, corpus.mention_contexts(docs, 6).collect())) == sorted(map(str, each.collect()))


def test_contexts_of_a_long_text_take_time_by_its_words(spark):
    docs = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda n: F.concat(F.lit("word"), n % 3000)), " ").alias("text"))
    entity = lambda w, i: F.struct(i.cast("string").alias("id"), w.alias("mention"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    began = time.time()
    assert corpus.mention_contexts(docs.select("text", F.transform(F.split("text", " "), entity).alias("mentions"))).filter("context LIKE '%⟦word7⟧%'").count() >= 33
    assert time.time() - began < 20


def test_rows_are_not_dealt_out_by_run(spark, tmp_path):
    from linkmill.operators import scoring

    runs = spark.range(60).selectExpr("concat('r', id % 3) AS run", "id AS ord", "CAST(id % 20 AS STRING) AS id", "'Q1' AS qid")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables whose size Spark can't tell beforehand
    try:
        runs.filter("run = 'r0'").select("id", "qid").write.json(str(tmp_path / "r0.jsonl"))
        for rows in (scoring.answered_by_all(runs), readers.read_runs(spark, str(tmp_path), ["id", "qid"], least=1)):
            assert "SortMergeJoin [run" not in plan_of(rows) and rows.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_long_sentence_of_token_lines_takes_time_by_its_tokens():
    rows = [f"w{i}\tO\t{'-' if i % 9 else 'Q5'}" if i % 7 else f"w{i}" for i in range(60_000)]
    began = time.time()
    got = formats.sentence(rows)
    assert time.time() - began < 10
    assert len(got["tokens"]) == 60_000 and got["tags"] == ["O"] * 60_000 and got["qids"][9] == "Q5" and got["qids"][0] is None


def test_spans_of_a_full_batch_are_cut_in_slices():
    rows = [[{"t": f"w{i}", "g": ("B-PER", "I-PER", "O", "I-LOC")[(i + k) % 4], "q": f"Q{i}" if i % 3 == 0 else "-"} for i in range(n)] for k, n in enumerate([0, 500, 3, 700, 0] * 200)]
    tokens = pa.array([*rows, None], pa.list_(pa.struct([("t", pa.string()), ("g", pa.string()), ("q", pa.string())])))
    tracemalloc.start()
    got = corpus._spans(tokens)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == len(tokens) and peak < 20 << 20  # a quarter of a million tokens
    at = [1, 2, 3, 500, 601, 703, 998, 1000]
    assert [got[k].as_py() for k in at] == [corpus._spans(tokens.slice(k, 1))[0].as_py() for k in at]
    assert corpus._spans(tokens.slice(0, 0)).to_pylist() == []


def test_token_rows_are_dealt_out_and_heads_of_them_are_not(spark):
    from linkmill.plans import bindings, queries

    sf = "/root/testdata/sf0.001"
    assert "REPARTITION_BY_NUM" in plan_of(queries._bio(spark, sf))
    assert "REPARTITION_BY_NUM" not in plan_of(queries._bio(spark, sf, deal=False)) + plan_of(bindings.mentions(spark, sf, deal=False))
