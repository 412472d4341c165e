"""One query an operator, over views of the given tables (:mod:`.bindings`)."""

from __future__ import annotations

import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import stats, text
from ..operators import corpus, kb, linking, merging, review, scoring
from ..schemas import POOLED_REVIEW
from ..sources import readers
from ..streaming import jobs
from . import bindings as b

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder beside the checkpoints, which all executors see."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return f"{base}/{uuid.uuid4().hex}"


def joined(column: str) -> F.Column:
    return F.array_join(F.array_sort(column), "|").alias(column)


# --- scoring ---------------------------------------------------------------------------------------------------------

@query
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.run_metrics(b.runs(spark, sf_dir))


@query
def metrics_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.metrics_by(b.runs(spark, sf_dir), "category")


@query
def common_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.common_mentions(b.runs(spark, sf_dir))


@query
def common_mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = review.pooled_labels(b.review(spark, sf_dir))
    return scoring.common_mention_counts(b.runs(spark, sf_dir), labels.filter("unclear"))


@query
def answer_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = review.pooled_labels(b.review(spark, sf_dir)).filter("NOT unclear")
    return scoring.answer_correctness(b.runs(spark, sf_dir), labels).select("run", "id", "ok", "init_ok")


@query
def paired_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = review.pooled_labels(b.review(spark, sf_dir))
    return scoring.paired_table(b.runs(spark, sf_dir), "alpha", labels.filter("NOT unclear"), labels.filter("unclear"), n_boot=0).drop("diff_low", "diff_high")


@query
def paired_table_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.paired_table(b.runs(spark, sf_dir), "alpha")


@query
def paired_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.paired_by(b.runs(spark, sf_dir), "category", "alpha")


@query
def by_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.by_script(b.runs(spark, sf_dir), "alpha")


@query
def within_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = review.pooled_labels(b.review(spark, sf_dir))
    return scoring.within_run(b.runs(spark, sf_dir), labels.filter("NOT unclear"), labels.filter("unclear"))


@query
def llm_only_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.llm_only_spread(b.runs(spark, sf_dir)).select("run", F.round("value", 6).alias("value"))


@query
def multi_run_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.multi_run_summary(b.runs(spark, sf_dir), "alpha")[0]


@query
def multi_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.multi_run_summary(b.runs(spark, sf_dir), "alpha")[1]


@query
def check_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.check_attribution(b.runs(spark, sf_dir))


@query
def gold_source_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = b.runs(spark, sf_dir)
    return scoring.gold_source_check(runs.filter("run = 'alpha'"), runs.filter("run = 'full_beta'"))


@query
def answer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.answer_changes(b.runs(spark, sf_dir))


@query
def nil_rule_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.nil_rule_analysis(b.runs(spark, sf_dir)).select("run", "id", "gold", "initial", "final", "rule", "exact_matches", "agent_kept_nil", "agent_right", "rule_right", "same_answer")


@query
def nil_rule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.nil_rule_summary(scoring.nil_rule_analysis(b.runs(spark, sf_dir)))


@query
def unseen_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.unseen_initial(b.runs(spark, sf_dir), b.review(spark, sf_dir))


@query
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.error_summary(b.runs(spark, sf_dir)).withColumn("nth", F.col("nth").cast("long"))


@query
def errors_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.errors_table(b.runs(spark, sf_dir), b.entities(spark, sf_dir), ["alpha", "partial"]).select("run", "id", "gold", "gold_label", "agent", "agent_desc", "gold_in_candidates", "checks_fired", "alpha", "partial")


@query
def exact_sign_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = b.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 100).alias("g")).agg(F.count_if(F.expr("o_orderkey % 3 = 0")).alias("b"), F.count_if(F.expr("o_orderkey % 5 = 0")).alias("c"))
    return counts.select("g", "b", "c", F.round(stats.exact_sign_p("b", "c"), 5).alias("p"))


@query
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = b.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 100).alias("g")).agg(F.count_if(F.expr("o_orderkey % 3 = 0")).alias("k"), F.count("*").alias("n"))
    ci = stats.wilson_interval("k", "n")
    return counts.select("g", ci["low"].alias("low"), ci["high"].alias("high"))


@query
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = b.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(F.expr("o_orderkey % 7 = 0")).alias("wins"), F.count_if(F.expr("o_orderkey % 7 = 1")).alias("losses"), F.count("*").alias("n"))
    return counts.withColumn("ci", stats.bootstrap_ci()("wins", "losses", "n")).select("o_orderpriority", "ci.low", "ci.high")


# --- text ------------------------------------------------------------------------------------------------------------


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"\n")).alias("line")).filter("line <> ''")
    return rows.select("doc_id", F.translate("line", b.LATIN, b.ARABIC_LETTERS).alias("line")).distinct()


@query
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("doc_id", text.normalize_text(F.col("line")).alias("norm"))


@query
def name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("doc_id", F.array_join(text.name_tokens(F.col("line")), "|").alias("tokens"))


def _arabic_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.mentions(spark, sf_dir).select("id", F.concat(F.element_at(F.array(*map(F.lit, ("", "و", "لل", "بال", "ل"))), (F.col("pos") % 5 + 1).cast("int")), F.translate("mention", b.LATIN, b.ARABIC_LETTERS)).alias("mention"))


@query
def search_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = text.search_variants(F.col("mention"))
    return _arabic_mentions(spark, sf_dir).select("id", F.array_join(v["primary"], "|").alias("prim"), F.array_join(v["fallback"], "|").alias("fall"))


@query
def mention_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.runs(spark, sf_dir).groupBy(text.mention_script(F.col("mention")).alias("script"), "run").agg(F.count("*").alias("mentions"))


@query
def norm_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.runs(spark, sf_dir).select("run", "id", text.norm_gold(F.concat(F.lit("see "), "qid", F.lit("!"))).alias("gold"))


@query
def norm_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.mentions(spark, sf_dir).select("id", text.norm_type(F.col("type")).alias("type"))


@query
def is_date_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.runs(spark, sf_dir).select("run", "id", text.is_date_mention(F.col("type"), F.col("mention")).alias("is_date"))


@query
def split_run_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.runs(spark, sf_dir).select("run").distinct().select("run", F.inline(F.array(text.split_run_tag(F.col("run")))))


@query
def parse_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.expr("""CASE turn % 4 WHEN 0 THEN concat('<think>hm</think>{"action": "select", "qid": "q', conv_id, '", "confidence": 7}')
        WHEN 1 THEN concat('so: {"qid": "Q', conv_id, '", "lang": "english"} fine') WHEN 2 THEN '```json\n{"action": "nil", "confidence": 0.25}\n```' ELSE role END""")
    rows = b.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.parse_answer(reply).alias("a"))
    return rows.select("conv_id", "turn", "a.action", "a.qid", "a.lang", "a.confidence")


@query
def text_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").select("doc_id", text.text_sha1(F.col("text")).alias("sha1"))


@query
def doc_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.annotated(spark, sf_dir, deal=True)
    entity = lambda e: F.struct(F.concat("doc_id", F.lit("-"), e["pos"]).alias("id"), e["mention"].alias("mention"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    return corpus.mention_contexts(docs.select("text", F.transform("entities", entity).alias("mentions")), 40)


# --- corpora ---------------------------------------------------------------------------------------------------------


@query
def mentions_from_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.mentions_from_nested(b.annotated(spark, sf_dir), {"id": "doc_id", "text": "text", "entities": "entities", "mention": "mention", "qid": "gold", "type": "type"})
    return rows.select("id", "doc_id", "mention", "type", "gold")


@query
def mentions_from_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.mentions_from_flat(b.mentions(spark, sf_dir).drop("doc_id"), {"id": "id", "text": "text", "mention": "mention", "qid": "gold", "type": "type"}).select("id", "mention", "type", "gold")


@query
def mentions_without_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines in several part files, read back: each record, whatever repeats, is named by its number over all files."""
    folder = shared_folder(spark)
    docs = b.table(spark, sf_dir, "documents").selectExpr("doc_id", "'the same sentence' AS text", "concat('Q', doc_id) AS qid")
    docs.repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id").select("text", F.lit("sentence").alias("mention"), "qid").write.json(folder)
    rows = readers.read_records(spark, folder, "text string, mention string, qid string", lines=True, number="n")
    return corpus.mentions_from_flat(rows, {"id": None, "text": "text", "mention": "mention", "qid": "qid", "number": "n"}).select("id", "mention", "gold")


@query
def last_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run in part files of which later ones answer again what earlier ones did: the last record of each mention by the readers' order."""
    folder = shared_folder(spark)
    rows = b.runs(spark, sf_dir).filter("run = 'alpha'").select("id", "qid", F.col("ord").alias("k"))
    again = rows.filter("k % 4 = 0").withColumns({"qid": F.lit("Q_new"), "k": F.col("k") + (1 << 40)})
    rows.unionByName(again).repartitionByRange(5, "k").sortWithinPartitions("k").drop("k").write.json(f"{folder}/again.jsonl")
    return scoring.answered_by_all(readers.read_runs(spark, folder, ["id", "qid"])).select("id", "qid")


@query
def mentions_from_bio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.mentions_from_bio(_bio(spark, sf_dir), {"id": "doc_id", "tokens": "tokens", "tags": "tags", "qids": "qids"}).drop("text", "source")


def _bio(spark: SparkSession, sf_dir: str, deal: bool = True) -> DataFrame:
    words = F.filter(F.split("text", " "), lambda w: w != "")
    tag = lambda w, i: F.when(i % 7 == 0, "B-PER").when(i % 7 == 1, "I-PER").when(i % 7 == 3, "I-LOC").when(i % 7 == 4, "E-ORG").when(i % 7 == 6, "S-LOC").otherwise("O")
    docs = b.table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = b.dealt(docs) if deal else docs
    return docs.select("doc_id", words.alias("tokens"), F.transform(words, tag).alias("tags"), F.transform(words, lambda w, i: F.when(i % 3 == 0, F.concat(F.lit("Q"), i)).otherwise("-")).alias("qids"))


@query
def detect_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guesses from a bounded head of each layout, applied to all of it: mentions by layout."""
    nested = b.annotated(spark, sf_dir, mention="entity", gold="wikidata", type="label")
    bio = lambda deal: _bio(spark, sf_dir, deal)  # noqa: E731  # a head of dealt rows would deal all of them first
    flat = lambda deal: b.mentions(spark, sf_dir, deal).select("id", F.col("text").alias("context"), F.col("mention").alias("span"), F.col("gold").alias("qid"), F.col("type").alias("ner"))
    parts = [corpus.mentions_from_nested(nested, corpus.detect_roles(nested), "nested"), corpus.mentions_from_bio(bio(True), corpus.detect_roles(bio(False)), "bio"), corpus.mentions_from_flat(flat(True), corpus.detect_roles(flat(False)), "flat")]
    return reduce(DataFrame.unionByName, [p.select("source", "gold", "type") for p in parts]).groupBy("source", "type").agg(F.count("*").alias("mentions"), F.count_if(F.col("gold") == "NIL").alias("nil"))


@query
def link_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.link_mentions(b.table(spark, sf_dir, "pages"), "page_id", container="nav", prefix="/", least=0)


@query
def build_link_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A silver set of links of which items of classes that are no names are left out."""
    links, titles = b.links(spark, sf_dir)
    instances = titles.filter("gold IS NOT NULL").select(F.col("gold").alias("qid"), F.when(F.substring("gold", -1, 1).isin("3", "7"), "hobby").otherwise("writer").alias("class")).distinct()
    closure = spark.sql("SELECT 'person' AS class, 'Q5' AS root UNION ALL SELECT 'writer', 'Q5'")
    got = corpus.build_link_set(links, titles, closure, instances, 1500)
    return got.select("id", "doc_id", F.sha1("text").alias("text"), "mention", "start", "end", "gold", "target_title", "surface")


@query
def links_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = link_mentions(spark, sf_dir)
    titles = links.select("target").distinct().select("target", F.concat(F.lit("Q"), F.pmod(F.crc32(F.col("target").cast("binary")), F.lit(1000))).alias("gold"))
    return corpus.build_link_set(links, titles, None, None, 10_000).drop("text")


@query
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents").select("doc_id", "text")
    return corpus.corpus_profile(b.mentions(spark, sf_dir), docs).select("measure", F.round("value", 2).alias("value"))


@query
def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = b.table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.expr("CASE WHEN doc_id % 5 = 0 THEN -doc_id - 1 ELSE doc_id END").alias("doc_id"), F.expr("CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE text END").alias("text"))
    return corpus.coverage_check(sample, docs)


@query
def split_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    dev, test = corpus.split_by_doc(b.mentions(spark, sf_dir))
    return dev.select("id", F.lit("dev").alias("part")).unionByName(test.select("id", F.lit("test").alias("part")))


@query
def sample_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.sample_by_doc(b.mentions(spark, sf_dir), 200, 3, linked_only=True, order="pos").select("id")


@query
def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.uniform_sample(b.table(spark, sf_dir, "documents").select("doc_id"), 100, "doc_id")


@query
def label_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.label_crosstab(b.runs(spark, sf_dir).filter("run = 'alpha'"), review.pooled_labels(b.review(spark, sf_dir)))


# --- knowledge base --------------------------------------------------------------------------------------------------


@query
def ingest_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = b.table(spark, sf_dir, "part").select(F.expr("""from_json(concat(
        '{"id":"Q', p_partkey, '","labels":{"en":{"value":"', p_name, '"}},"aliases":{"ar":[{"value":"', p_brand, '"},{"value":"x"}]},"sitelinks":{"arwiki":{"title":"t', p_size, '"},"enwiki":{"title":"u"}},',
        '"claims":{"P31":[{"rank":"deprecated","mainsnak":{"datavalue":{"type":"wikibase-entityid","value":{"id":"Q1"}}}},{"rank":"normal","mainsnak":{"datavalue":{"type":"wikibase-entityid","value":{"id":"T_', p_type, '"}}}}],',
        '"P569":[{"mainsnak":{"datavalue":{"type":"time","value":{"time":"+0', 900 + p_size, '-02-17T00:00:00Z"}}}}]}}'), '""" + kb_raw() + "') AS e")).select("e.*")
    return kb.ingest_entities(raw).select("qid", "label_en", F.array_join("aliases_ar", "|").alias("aliases"), F.array_join("p31", "|").alias("p31"), F.array_join(F.col("facts")["P569"], "|").alias("born"), "sitelinks", "arwiki")


def kb_raw() -> str:
    from ..schemas import RAW_ENTITY

    return RAW_ENTITY


@query
def name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.name_index(b.entities(spark, sf_dir)).select("lang", "name_norm", "name_key", "qid", "is_label", "sitelinks")


@query
def search_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = b.asked(spark, sf_dir).select(F.lit("ar").alias("lang"), F.col("mention").alias("query")).distinct()
    return kb.search_names(asked, kb.name_index(b.entities(spark, sf_dir))).select("query", "qid", "sitelinks", F.col("rank").cast("long").alias("rank"))


@query
def resolve_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, moved, _ = b.titles(spark, sf_dir)
    return kb.resolve_titles(b.asked(spark, sf_dir).select("id", F.col("mention").alias("title")), page, moved).select("id", "final_title", "qid")


@query
def disambiguation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, _, link = b.titles(spark, sf_dir)
    return kb.disambiguation_links(page.filter("is_disambiguation"), link, page, 3).select("title", "qid")


@query
def generate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates where pages still name two thirds of their items by ids that were merged into others."""
    page, moved, link = b.titles(spark, sf_dir)
    merged = merging.merged_ids(b.redirects(spark, sf_dir))
    return kb.generate_candidates(b.asked(spark, sf_dir), b.entities(spark, sf_dir), b.old_pages(page), moved, link, merged=merged)


@query
def merged_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.merged_ids(b.redirects(spark, sf_dir))


@query
def current_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that answer by old ids, in terms of current ones."""
    old = lambda c: F.when(F.col(c).startswith("Q") & (F.length("id") % 2 == 0), F.concat(F.lit("M"), F.substring(c, 2, 20))).otherwise(F.col(c))
    runs = b.runs(spark, sf_dir).withColumns({"qid": old("qid"), "gold": F.regexp_replace("gold", "^Q", "N")})
    runs = runs.withColumn("candidates", F.array_union("candidates", F.array("qid")))
    got = merging.current_run(runs, merging.merged_ids(b.redirects(spark, sf_dir)))
    return got.select("run", "id", "gold", "qid", "initial_qid", F.array_join("candidates", "|").alias("candidates"))


@query
def label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = b.asked(spark, sf_dir).select("id", "mention", F.concat(F.lit("Q"), "id").alias("qid")).join(b.entities(spark, sf_dir), "qid")
    return pairs.select("id", kb.label_match(F.col("mention"), True).alias("exact"), kb.label_match(F.col("mention"), False).alias("loose"))


@query
def class_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = b.table(spark, sf_dir, "part").selectExpr("CAST(p_partkey AS STRING) AS class", "CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING) AS parent").filter("class <> parent")
    tree = tree.unionByName(tree.limit(1).selectExpr("'3' AS class", "'6' AS parent"))
    return kb.class_closure(tree, tree.limit(1).select(F.explode(F.array(F.lit("3"), F.lit("5"), F.lit("100"))).alias("root")))


def _closed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    roots = b.roots(spark)
    return kb.class_closure(b.classes(spark, sf_dir), roots), roots


@query
def is_instance_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    closure, roots = _closed(spark, sf_dir)
    pairs = b.asked(spark, sf_dir).select("id", "gold", text.norm_type(F.col("type")).alias("type")).withColumnRenamed("gold", "qid")
    return kb.is_instance_of(pairs, b.entities(spark, sf_dir), closure, roots).select("id", "qid", "type", "is_type")


@query
def popularity_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.popularity_bucket(b.asked(spark, sf_dir), b.entities(spark, sf_dir), 30, 10).select("id", "category", "sitelinks")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS text_key", "CAST(least(l_partkey % 100, l_suppkey % 100) AS INT) AS start", "CAST(greatest(l_partkey % 100, l_suppkey % 100) + 1 AS INT) AS end",
                                                         "CASE l_partkey % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'B-LOC' ELSE 'MISC' END AS entity_group", "l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS ord")


@query
def assign_ner_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = b.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderkey AS text_key", "'' AS text", "'' AS mention", "CAST(o_custkey % 90 AS INT) AS start", "CAST(o_custkey % 90 + 10 AS INT) AS end", "'' AS type")
    return kb.assign_ner_types(mentions, _spans(spark, sf_dir)).select("id", "type")


@query
def first_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.first_created(_revisions(spark, sf_dir))


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "events").selectExpr("concat('Q', user_id) AS qid", "ts")


@query
def candidate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = b.table(spark, sf_dir, "part").selectExpr("concat('T_', p_type) AS qid", "lower(p_type) AS label").distinct()
    return kb.candidate_evidence(_cands(spark, sf_dir), b.entities(spark, sf_dir), names)


def _cands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.generate_candidates(b.asked(spark, sf_dir), b.entities(spark, sf_dir), *b.titles(spark, sf_dir))


# --- linking ---------------------------------------------------------------------------------------------------------


@query
def link_search_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.link_search_top1(b.asked(spark, sf_dir), b.entities(spark, sf_dir)).select("id", "qid")


@query
def link_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.link_popularity(b.asked(spark, sf_dir), _cands(spark, sf_dir)).select("id", "qid")


@query
def link_exact_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.link_exact_popularity(b.asked(spark, sf_dir), _cands(spark, sf_dir), b.entities(spark, sf_dir)).select("id", "qid")


def _given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two candidates a mention: the part itself and the next one."""
    return b.asked(spark, sf_dir).select("id", F.posexplode(F.array(F.concat(F.lit("Q"), "id"), F.concat(F.lit("Q"), (F.col("id").cast("long") + 1).cast("string")))).alias("pos", "qid"))


@query
def apply_nil_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    closure, roots = _closed(spark, sf_dir)
    runs = b.asked(spark, sf_dir).selectExpr("'r' AS run", "id", "CAST(id AS BIGINT) AS ord", "mention", "type", "'NIL' AS qid", "'NIL' AS initial_qid", "array(concat('Q', id), concat('Q', CAST(id AS BIGINT) + 1)) AS candidates",
                                             f"CAST(NULL AS {b.TRACE}) AS trace")
    return linking.apply_nil_rule(runs, b.entities(spark, sf_dir), closure, roots).select("id", "qid", F.coalesce(F.get(scoring.fired_checks(F.col("trace")), 0), F.lit("")).alias("fired"))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.asked(spark, sf_dir).selectExpr("id", "mention", "type", "CASE CAST(id AS BIGINT) % 5 WHEN 0 THEN 'nil' WHEN 4 THEN 'invalid' ELSE 'select' END AS action",
                                             "CASE CAST(id AS BIGINT) % 5 WHEN 1 THEN concat('Q', id) WHEN 2 THEN concat('Q', CAST(id AS BIGINT) + 1) WHEN 3 THEN 'Q999999999' ELSE '' END AS qid", "CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 0.5D ELSE 0.9D END AS confidence")


@query
def verify_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    closure, roots = _closed(spark, sf_dir)
    got = linking.verify_answers(_decisions(spark, sf_dir), _given(spark, sf_dir), b.entities(spark, sf_dir), closure, roots)
    return got.select("id", F.array_join(F.transform("issues", lambda i: i["check"]), "|").alias("checks"), F.exists("issues", lambda i: i["hard"]).alias("hard"))


@query
def correction_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    closure, roots = _closed(spark, sf_dir)

    def decide(rows: DataFrame) -> DataFrame:
        def batch(it):
            for pdf in it:  # stands for a user's batch scorer: confirms what it may, else takes the mention's own item
                yield pd.DataFrame({"id": pdf["id"], "new_action": ["confirm" if x == "select" else "select" for x in pdf["action"]], "new_qid": "Q" + pdf["id"], "new_confidence": 0.9})

        return rows.select("id", "action").mapInPandas(batch, "id string, new_action string, new_qid string, new_confidence double")

    return linking.correction_loop(_decisions(spark, sf_dir), _given(spark, sf_dir), b.entities(spark, sf_dir), closure, roots, decide)


@query
def needs_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.needs_expansion(b.asked(spark, sf_dir), _cands(spark, sf_dir), b.entities(spark, sf_dir))


@query
def coherence_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = b.mentions(spark, sf_dir).withColumnRenamed("gold", "qid")
    return linking.coherence_batches(answers).select("doc_id", F.size("links").cast("long").alias("n_links"), F.array_join(F.transform("links", lambda x: x["qid"]), "|").alias("qids"))


@query
def correction_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = b.table(spark, sf_dir, "events").selectExpr("event_id AS seq", "event_type AS mention", "concat('Q', user_id) AS wrong", "concat('Q', user_id + 1) AS right", "props AS why").withColumn("key", text.token_key(F.col("mention")))
    asked = b.table(spark, sf_dir, "events").select("event_type").distinct().select(F.col("event_type").alias("id"), F.initcap("event_type").alias("mention"))
    return linking.correction_hints(asked, cases).select("id", F.array_join(F.transform("hints", lambda h: h["wrong"]), "|").alias("wrong"))


@query
def collect_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.collect_cases(b.runs(spark, sf_dir)).select("run", "id", "wrong", "right", "checks", "why")


@query
def pending_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = b.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CAST(o_custkey AS STRING) AS doc_id")
    return linking.pending_mentions(asked, b.runs(spark, sf_dir).filter("run = 'alpha'")).select("id", "doc_id", "answered")


@query
def assemble_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = b.runs(spark, sf_dir).filter("run = 'partial'").select("id", "qid", "initial_qid", "flagged")
    asked = b.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "concat('wikidata:Q', o_custkey) AS gold", "o_orderpriority AS category")
    return linking.assemble_run(asked, answers).select("id", "gold", "category", "qid", "initial_qid", "flagged")


# --- reviews ---------------------------------------------------------------------------------------------------------


@query
def pooled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.pooled_labels(b.review(spark, sf_dir)).select("id", "unclear", F.array_join("accepted", "|").alias("accepted"))


@query
def pooled_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.pooled_summary(b.review(spark, sf_dir))


@query
def reviewed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.reviewed_labels(b.single_review(spark, sf_dir)).select("id", "unclear", F.array_join("accepted", "|").alias("accepted"))


@query
def reviewed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.reviewed_summary(b.single_review(spark, sf_dir))


@query
def rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.rescore(b.runs(spark, sf_dir), b.single_review(spark, sf_dir), "alpha", 0, pooled=False)[0].drop("diff_low", "diff_high")


@query
def label_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = b.review(spark, sf_dir)
    dates = sheet.filter(text.is_date_mention(F.col("type"), F.col("mention"))).select("id")
    return review.label_review(sheet, dates)


@query
def agreement_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.agreement_sample(b.review(spark, sf_dir)).select("id", "status", "accepted", "options")


@query
def annotator_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.annotator_agreement(b.review(spark, sf_dir), b.second_review(spark, sf_dir))


@query
def corrected_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.runs(spark, sf_dir).filter("run = 'alpha'").selectExpr("id", "id AS doc_id", "text", "mention", "CAST(NULL AS INT) AS start", "CAST(NULL AS INT) AS end", "type", "category", "CAST(NULL AS INT) AS sitelinks", "gold")
    return review.corrected_dataset(rows, b.review(spark, sf_dir)).select("id", "gold_original", F.array_join("gold_corrected", "|").alias("gold_corrected"), "label_status", "annotator", "text_sha1")


@query
def corrected_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.runs(spark, sf_dir).filter("run = 'alpha'").selectExpr("id", "id AS doc_id", "text", "mention", "CAST(NULL AS INT) AS start", "CAST(NULL AS INT) AS end", "type", "category", "CAST(NULL AS INT) AS sitelinks", "gold")
    return review.corrected_labels(review.corrected_dataset(rows, b.review(spark, sf_dir))).select("id", "unclear", F.array_join("accepted", "|").alias("accepted"))


@query
def restore_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.selectExpr("CAST(doc_id AS STRING) AS doc_id", "CASE WHEN doc_id % 7 = 0 THEN '' ELSE sha1(text) END AS text_sha1")
    return review.restore_texts(rows, docs).select("doc_id", "restored", F.char_length("text").cast("long").alias("n_chars"))


@query
def nil_label_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.nil_label_timing(b.review(spark, sf_dir), _revisions(spark, sf_dir), "2024-01-02").select("id", "accepted", "earliest", "status")


@query
def review_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = b.runs(spark, sf_dir)
    got = review.review_sheet(runs.filter("run = 'full_beta'"), b.entities(spark, sf_dir), runs.filter("run = 'alpha'"), b.single_review(spark, sf_dir))
    return got.select("id", "group", "gold", "gold_label", "agent", "search", "initial", "checks_fired", "verdict", "correct_qid")


@query
def pooled_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = review.pooled_review(b.runs(spark, sf_dir), None, b.review(spark, sf_dir), b.single_review(spark, sf_dir))
    return got.select("id", "group", joined_options(), "status", "accepted", "annotator", "carried")


def joined_options() -> F.Column:
    return F.array_join(F.array_sort(F.split("options", r"\|")), "|").alias("options")


@query
def pooled_review_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = review.pooled_review(b.runs(spark, sf_dir), b.entities(spark, sf_dir), b.review(spark, sf_dir), None, include_initial=True, reopen_carried=True)
    return got.select("id", "group", joined_options(), "status", "carried", "sources", "option_info")


# --- sources and sinks -----------------------------------------------------------------------------------------------


@query
def read_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    for name in ("alpha", "dev_beta", "gamma@r2"):
        rows = b.runs(spark, sf_dir).filter("run = 'alpha'" if name == "alpha" else "run = 'full_beta'").drop("run", "ord")
        readers.write_run(rows, folder, name)
    got = readers.read_runs(spark, folder, ["id", "qid", "trace"]).withColumn("steps", F.size("trace"))
    return got.groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.col("qid") == "ERROR").alias("errors"), F.count_if(F.col("steps") > 0).alias("traced"))


@query
def read_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, schema = shared_folder(spark), "id string, mention string, gold string"
    rows = b.mentions(spark, sf_dir).select("id", "mention", "gold")
    readers.write_rows(rows, f"{folder}/rows.jsonl")
    rows.write.options(header=True, quote='"', escape='"').csv(f"{folder}/rows.csv", compression="gzip")
    return readers.common_rows(*(readers.read_rows(spark, f"{folder}/rows.{kind}", schema) for kind in ("jsonl", "csv")), "id")


@query
def read_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as arrays in many files (one of an id range each), read back record by record."""
    folder = shared_folder(spark)
    docs = b.table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = docs.groupBy(F.floor(F.col("doc_id") / 200).alias("g")).agg(F.to_json(F.collect_list(F.struct("doc_id", "text"))).alias("value"))
    packed.repartition("g").select("value").write.text(folder)
    return readers.read_records(spark, f"{folder}/part-*", "doc_id long, text string").select("doc_id", F.char_length("text").cast("long").alias("n_chars"))


@query
def sniff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as files of five kinds, forty in all, and what their first bytes say."""
    folder = shared_folder(spark)
    part = b.table(spark, sf_dir, "part").withColumn("nth", F.col("p_partkey") % 40)
    kinds = {"lines": F.to_json(F.struct("p_partkey", "p_name")), "packed": F.to_json(F.struct("p_name")), "pages": F.concat(F.lit("<p>"), "p_name"), "tokens": F.concat_ws("\t", F.lit("x"), "p_name"), "blank": F.lit("  ")}
    for k, (kind, line) in enumerate(kinds.items()):
        rows = part.filter(F.col("p_partkey") % 5 == k).select("nth", line.alias("value")).repartition(1)
        rows.write.partitionBy("nth").text(f"{folder}/{kind}", compression="gzip" if kind == "packed" else "none")
    found = readers.sniff_files(spark, f"{folder}/*/nth=*/part-*")
    return found.groupBy(F.element_at(F.split("path", "/"), -3).alias("kind"), "format").agg(F.count("*").alias("files"))


@query
def read_conll(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    bio = _bio(spark, sf_dir).filter("size(tokens) > 0").select("doc_id", F.transform("tokens", lambda w: F.regexp_replace(w, r"\s|#", "_")).alias("tokens"), "tags", "qids")
    bio.select(F.concat(F.array_join(F.transform(F.arrays_zip("tokens", "tags", "qids"), lambda z: F.concat_ws("\t", z["tokens"], z["tags"], z["qids"])), "\n"), F.lit("\n"))).write.text(folder)
    got = readers.read_conll(spark, f"{folder}/part-*")
    return got.select(F.size("tokens").cast("long").alias("n_tokens"), F.size(F.filter("tags", lambda t: t != "O")).cast("long").alias("n_tagged"), F.size(F.filter("qids", lambda q: q != "-")).cast("long").alias("n_items"))


@query
def read_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    b.review(spark, sf_dir).write.options(header=True, quote='"', escape='"', emptyValue="").csv(folder)
    return readers.read_review(spark, folder, POOLED_REVIEW).select("id", "group", "options", "sources", "status", "accepted", "carried")


# --- streams ---------------------------------------------------------------------------------------------------------


def _land(rows: DataFrame, folder: str, most: int = 1_000_000) -> None:
    """JSON lines in packed files of at most ``most`` rows: such a file is a task of the stream that reads it."""
    rows.write.mode("append").option("maxRecordsPerFile", most).json(f"{folder}/in", compression="gzip")


def _landed(rows: DataFrame, spark: SparkSession, most: int = 1_000_000) -> tuple[str, StructType]:
    folder = shared_folder(spark)
    _land(rows, folder, most)
    return folder, rows.schema


@query
def stream_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.annotated(spark, sf_dir, deal=True).select("text", F.transform("entities", lambda e: F.struct(e["mention"].alias("mention"), e["type"].alias("type"), e["gold"].alias("gold"))).alias("mentions"))
    folder, schema = _landed(docs, spark, 5_000)  # some hundred megabytes as JSON
    jobs.stream_profile(spark, f"{folder}/in", schema, f"{folder}/table", f"{folder}/state").awaitTermination()
    return jobs.read_profile(spark, f"{folder}/table").select("measure", F.round("value", 2).alias("value"))


@query
def stream_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that land in two goes: the second brings new answers, answers to what was answered before, and a file once more."""
    rows = b.runs(spark, sf_dir).select("run", "ord", "id", "qid")
    folder, schema = shared_folder(spark), rows.schema
    first = F.col("ord") % 3 != 0
    for part in (rows.filter(first), rows.withColumn("qid", F.when(first & (F.col("qid") != "ERROR"), "Q0").otherwise(F.when(F.col("qid") == "ERROR", "Q1").otherwise(F.col("qid"))))):
        _land(part, folder)
        jobs.stream_runs(spark, f"{folder}/in", schema, f"{folder}/table", f"{folder}/state", every=2).awaitTermination()
    return jobs.read_runs_table(spark, f"{folder}/table", schema).select("run", "id", "qid")


@query
def stream_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, schema = _landed(b.table(spark, sf_dir, "documents").select("doc_id"), spark)
    jobs.stream_sample(spark, f"{folder}/in", schema, 100, "doc_id", f"{folder}/kept", f"{folder}/state").awaitTermination()
    return jobs.read_sample(spark, f"{folder}/kept", schema, 100, "doc_id")
