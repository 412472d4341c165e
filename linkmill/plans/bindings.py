"""Views of the star-schema and document tables as runs, review sheets, a knowledge base and annotated documents.

Expressions that both engines share are written once: :data:`RUN_SQL` and the like are the DuckDB views, and the Spark
views select the same expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TRACE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- runs ------------------------------------------------------------------------------------------------------------

_GOLD = "CASE WHEN o_custkey % 9 = 0 THEN 'NIL' ELSE concat('Q', o_custkey % 50) END"
_NEXT = "concat('Q', (o_custkey + 1) % 50)"
_SAID = f"CASE WHEN (o_orderkey + r) % 41 = 0 THEN 'ERROR' WHEN (o_orderkey * 7 + r * 3) % 10 IN (0,1,2,3,4,5,8) THEN {_GOLD} WHEN (o_orderkey * 7 + r * 3) % 10 = 6 THEN 'NIL' WHEN (o_orderkey * 7 + r * 3) % 10 = 7 THEN {_NEXT} ELSE concat('Q', (o_custkey + 7) % 50) END"
RUN_COLUMNS = {
    "run": "CASE r WHEN 0 THEN 'alpha' WHEN 1 THEN 'full_beta' WHEN 2 THEN 'alpha@r2' WHEN 3 THEN 'full_beta@r2' ELSE 'partial' END",
    "ord": "o_orderkey",
    "id": "CAST(o_orderkey AS STRING)",
    "mention": "CASE o_orderkey % 4 WHEN 0 THEN 'نهر' WHEN 1 THEN 'river' WHEN 2 THEN 'CR نهر' ELSE '1962' END",
    "text": "concat('text of ', o_orderkey)",
    "type": "o_orderstatus",
    "category": "CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE o_orderpriority END",
    "gold": _GOLD,
    "qid": _SAID,
    "initial_qid": f"CASE WHEN (o_orderkey * 3 + r) % 8 < 6 THEN {_SAID} WHEN (o_orderkey * 3 + r) % 8 = 6 THEN 'NIL' ELSE {_NEXT} END",
    "flagged": "(o_orderkey + r) % 6 = 0",
    "reason": "CASE WHEN (o_orderkey + r) % 41 = 0 THEN concat('timeout ', o_orderkey % 5) ELSE 'fine' END",
    "candidates": f"split(concat({_GOLD}, ',', {_NEXT}), ',')",
    "llm_calls": "CAST((o_orderkey + r) % 4 AS DOUBLE)",
    "seconds": "CAST((o_orderkey * 3 + r) % 7 AS DOUBLE) / 2",
}
_RUN_ROWS = "(o_orderkey * 31 + r * 17) % 97 <> 0 AND (r < 4 OR o_orderkey % 2 = 0)"
RUN_SQL = f"b_runs AS (SELECT o_orderkey AS k, r, o_custkey AS c, {', '.join(f'{e} AS {c}' for c, e in RUN_COLUMNS.items())} FROM orders, range(5) t(r) WHERE {_RUN_ROWS})"
#: Checks of a mention's trace by its key modulo 5: (rest, place, check).
CHECKS = ((1, 0, "TYPE"), (2, 0, "LABEL"), (2, 1, "NIL"), (3, 0, "NIL"), (4, 0, "TYPE"), (4, 1, "LABEL"))
CHECK_SQL = f"b_checks(m, pos, check_name) AS (VALUES {', '.join(map(str, CHECKS))})"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(4)))).filter(_RUN_ROWS)
    issue = lambda check: f"named_struct('check', '{check}', 'msg', concat('matches: Q', o_custkey % 50, ' (x), Q', (o_custkey + 3) % 50, ' (y)'), 'hard', false, 'suggest', CAST(NULL AS struct<q: string, lang: string>))"
    step = lambda *checks: f"named_struct('step', 'verify', 'issues', array({', '.join(map(issue, checks))}))"
    trace = f"CASE o_orderkey % 5 WHEN 1 THEN array({step('TYPE')}) WHEN 2 THEN array({step('LABEL', 'NIL')}) WHEN 3 THEN array({step('NIL')}) WHEN 4 THEN array({step('TYPE')}, {step('TYPE', 'LABEL')}) END"
    return rows.selectExpr(*[f"{e} AS {c}" for c, e in RUN_COLUMNS.items()], f"from_json(to_json({trace}), '{TRACE}') AS trace")


# --- reviews ---------------------------------------------------------------------------------------------------------

_STATUS = "CASE WHEN o_orderkey % 13 <= 8 THEN 'done' WHEN o_orderkey % 13 = 9 THEN 'unclear' ELSE '' END"
REVIEW_COLUMNS = {
    "id": "CAST(o_orderkey AS STRING)",
    "group": f"CASE WHEN o_orderkey % 7 = 0 THEN 'audit' WHEN {_GOLD} = 'NIL' THEN 'gold NIL' ELSE 'disagreement' END",
    "mention": RUN_COLUMNS["mention"],
    "text": RUN_COLUMNS["text"],
    "type": RUN_COLUMNS["type"],
    "category": RUN_COLUMNS["category"],
    "options": f"concat({_GOLD}, '|', {_NEXT}, '|Q77')",
    "option_info": "'[]'",
    "sources": f"concat('{{\"gold\":\"', {_GOLD}, '\"}}')",
    "status": _STATUS,
    "accepted": f"CASE WHEN o_orderkey % 13 <= 3 THEN {_GOLD} WHEN o_orderkey % 13 <= 5 THEN concat({_GOLD}, '|', {_NEXT}) WHEN o_orderkey % 13 = 6 THEN {_NEXT} WHEN o_orderkey % 13 = 8 THEN 'NIL' ELSE '' END",
    "annotator": f"CASE WHEN {_STATUS} = '' THEN '' ELSE 'A' END",
    "carried": "CASE WHEN o_orderkey % 5 = 0 THEN 'yes' ELSE '' END",
}
_REVIEW_ROWS = "true"
SECOND = {"accepted": f"CASE WHEN o_orderkey % 4 = 0 THEN {_NEXT} WHEN o_orderkey % 13 <= 5 THEN {_GOLD} ELSE '' END", "status": "CASE WHEN o_orderkey % 13 <= 6 THEN 'done' ELSE '' END"}
SINGLE_COLUMNS = {
    "id": "CAST(o_orderkey AS STRING)",
    "group": "CASE WHEN o_orderkey % 7 = 0 THEN '9 audit: gold = agent' ELSE '5 other disagreement' END",
    "gold": _GOLD, "agent": _NEXT, "search": "'Q77'",
    "verdict": "CASE o_orderkey % 8 WHEN 0 THEN 'gold' WHEN 1 THEN 'agent_wrong' WHEN 2 THEN 'gold_wrong' WHEN 3 THEN 'both_ok' WHEN 4 THEN 'none' WHEN 5 THEN 'unclear' WHEN 6 THEN 'search' ELSE '' END",
    "correct_qid": "CASE WHEN o_orderkey % 16 = 4 THEN ' q5' ELSE '' END",
    "error_type": "'x'",
}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f'{e} AS "{c}"' for c, e in columns.items())


REVIEW_SQL = f"b_review AS (SELECT o_orderkey AS k, {_select(REVIEW_COLUMNS)}, {_GOLD} AS gold, {_NEXT} AS nxt FROM orders WHERE {_REVIEW_ROWS})"
LABEL_SQL = """b_labels AS (SELECT id, status = 'unclear' AS unclear, CASE WHEN status = 'done' THEN list_distinct(list_filter(string_split(accepted, '|'), lambda x: x <> '')) END AS accepted
  FROM b_review WHERE status IN ('done', 'unclear'))"""
SINGLE_SQL = f"b_single AS (SELECT o_orderkey AS k, {_select(SINGLE_COLUMNS)} FROM orders)"


def _sheet(spark: SparkSession, sf_dir: str, columns: dict[str, str], where: str = "true") -> DataFrame:
    return table(spark, sf_dir, "orders").filter(where).selectExpr(*[f"{e} AS `{c}`" for c, e in columns.items()])


def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sheet(spark, sf_dir, REVIEW_COLUMNS, _REVIEW_ROWS)


def second_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sheet(spark, sf_dir, REVIEW_COLUMNS | SECOND, _REVIEW_ROWS)


def single_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sheet(spark, sf_dir, SINGLE_COLUMNS)


# --- knowledge base --------------------------------------------------------------------------------------------------

KB_SQL = """b_kb AS (SELECT concat('Q', p_partkey) AS qid, p_name AS label, p_brand AS alias, concat('T_', p_type) AS class, p_size AS sitelinks, p_partkey AS k FROM part)"""
ROOTS = {"PER": ["A"], "ORG": ["B"]}
CLASS_SQL = "b_class(class, root, type) AS (VALUES ('T_ECONOMY','A','PER'), ('T_PROMO','A','PER'), ('T_SMALL','B','ORG'), ('T_MEDIUM','B','ORG'))"
_ASKED = {
    "id": "CAST(p_partkey AS STRING)",
    "mention": "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN substring(p_name, 1, 4) ELSE concat(p_name, ' x') END",
    "type": "CASE p_partkey % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'B-ORG' ELSE 'DATE' END",
    "gold": "CASE WHEN p_partkey % 6 = 0 THEN 'NIL' WHEN p_partkey % 6 = 1 THEN concat('Q', p_partkey + 1000000) ELSE concat('Q', p_partkey) END",
    "doc_id": "CAST(p_partkey % 97 AS STRING)",
    "text": "concat('about ', p_name)",
}
ASKED_SQL = f"b_asked AS (SELECT p_partkey AS k, {', '.join(f'{e} AS {c}' for c, e in _ASKED.items())} FROM part)"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "concat('Q', p_partkey) AS qid", "p_name AS label_ar", "p_name AS label_en", "CAST(NULL AS STRING) AS label_fr", "CAST(NULL AS STRING) AS desc_ar", "concat('made as ', p_type) AS desc_en",
        "array(p_brand) AS aliases_ar", "array(p_brand) AS aliases_en", "CAST(NULL AS array<string>) AS aliases_fr", "array(concat('T_', p_type)) AS p31",
        "map('P17', array(concat('T_', p_type))) AS facts", "p_size AS sitelinks", "CAST(NULL AS STRING) AS arwiki")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {c}" for c, e in _ASKED.items()])


def roots(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('PER', 'A'), ('ORG', 'B') AS t(type, root)")


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subclass edges of the part types; PROMO lies under ECONOMY, and A and ECONOMY in a circle."""
    kinds = table(spark, sf_dir, "part").selectExpr("concat('T_', p_type) AS class").distinct()
    parents = {"T_ECONOMY": "A", "T_PROMO": "T_ECONOMY", "T_SMALL": "B", "T_MEDIUM": "T_SMALL"}
    known = F.create_map(*[F.lit(x) for pair in parents.items() for x in pair])
    edges = kinds.select("class", F.element_at(known, F.col("class")).alias("parent")).filter("parent IS NOT NULL")
    return edges.unionByName(spark.sql("SELECT 'A' AS class, 'T_ECONOMY' AS parent"))


def titles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages: one a part name, for its smallest key, names ending in ``ring`` being disambiguation pages; redirects from brands; links."""
    part = table(spark, sf_dir, "part")
    page = part.groupBy(F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("k")).selectExpr("title", "concat('Q', k) AS qid", "title LIKE '%ring' AS is_disambiguation")
    moved = part.groupBy(F.col("p_brand").alias("from_title")).agg(F.min("p_name").alias("to_title"))
    link = part.groupBy("p_name").agg(F.min("p_brand").alias("b")).join(page.select("title"), F.expr("substring(title, 1, 2) = substring(p_name, 1, 2)")).selectExpr("p_name AS from_title", "title AS to_title", "length(title) AS pos")
    return page, moved, link


_LINKS = """SELECT CAST(l_orderkey % 997 AS STRING) AS doc_id, CAST(l_orderkey * 10 + l_linenumber AS INT) AS para, concat('line ', l_linenumber, ' of ', l_orderkey, repeat(' and so on', CAST(l_partkey % 150 AS INT))) AS text,
concat('name ', l_suppkey % 9) AS anchor, CASE WHEN l_partkey % 3 = 0 THEN concat('Name ', l_suppkey % 9, ' (place)') ELSE concat('title ', l_partkey % 40) END AS target, CAST(l_partkey % 1000 AS INT) AS start, CAST(l_partkey % 1000 + 6 AS INT) AS end FROM lineitem"""
_LINK_TITLES = "SELECT target, CASE WHEN target LIKE 'title 1%' THEN NULL ELSE concat('Q', length(target) * 100 + CAST(regexp_extract(target, '([0-9]+)', 1) AS INT) % 11) END AS gold FROM (SELECT DISTINCT target FROM {links})"
LINK_SQL = f"b_links AS ({_LINKS.replace(' AS end', ' AS "end"')}), b_titles AS ({_LINK_TITLES.format(links='b_links')})"


def links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order lines as links of articles, aliases and plain ones, and the items of their titles, of which some are unknown."""
    found = spark.sql(_LINKS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    return found, spark.sql(_LINK_TITLES.replace("{links}", "{found}"), found=found)


#: Redirects of ids: each part's to that of half its key, but 2 and 3 form a circle with 5, and old page ids (M and N) to the part's own.
_REDIRECTS = """SELECT concat('P', p_partkey) AS old, concat('P', CASE p_partkey WHEN 2 THEN 5 WHEN 3 THEN 2 WHEN 5 THEN 3 ELSE CAST(floor(p_partkey / 2) AS BIGINT) END) AS new FROM part WHERE p_partkey > 0
UNION ALL SELECT concat('M', p_partkey), concat('N', p_partkey) FROM part UNION ALL SELECT concat('N', p_partkey), concat('Q', p_partkey) FROM part"""
REDIRECT_SQL = f"b_redirect AS ({_REDIRECTS})"


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_REDIRECTS.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))


def old_pages(page: DataFrame) -> DataFrame:
    """Pages of which two thirds carry the id that their item had before it was merged."""
    return page.withColumn("qid", F.expr("concat(CASE CAST(substring(qid, 2) AS BIGINT) % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'N' ELSE 'Q' END, substring(qid, 2))"))


PAGE_SQL = """b_page AS (SELECT p_name AS title, concat('Q', min(p_partkey)) AS qid, p_name LIKE '%ring' AS is_disambiguation FROM part GROUP BY p_name),
b_moved AS (SELECT p_brand AS from_title, min(p_name) AS to_title FROM part GROUP BY p_brand),
b_link AS (SELECT a.p_name AS from_title, b.title AS to_title, length(b.title) AS pos FROM (SELECT DISTINCT p_name FROM part) a JOIN b_page b ON substring(b.title, 1, 2) = substring(a.p_name, 1, 2))"""

# --- documents -------------------------------------------------------------------------------------------------------

MENTION_SQL = """b_word AS (SELECT doc_id, text, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents),
b_mentions AS (SELECT concat(doc_id, '-', pos) AS id, CAST(doc_id AS STRING) AS doc_id, text, word AS mention, pos,
  CASE doc_id % 5 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'LOC' WHEN 2 THEN 'ORG' WHEN 3 THEN 'DATE' ELSE 'B-GPE' END AS type,
  CASE WHEN (doc_id + pos) % 4 = 0 THEN 'NIL' ELSE concat('Q', (doc_id * 3 + pos) % 100) END AS gold FROM b_word WHERE word <> '')"""


def dealt(docs: DataFrame) -> DataFrame:
    """``docs`` dealt out by id, as a file of long texts is many words, if it is read in fewer pieces than there are cores; else no text is moved."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(4 * cores, "doc_id")


def mentions(spark: SparkSession, sf_dir: str, deal: bool = True) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = dealt(docs) if deal else docs
    docs = docs.select("doc_id", "text", F.posexplode(F.split("text", " ")).alias("p", "mention")).filter("mention <> ''")
    return docs.selectExpr(
        "concat(doc_id, '-', p + 1) AS id", "CAST(doc_id AS STRING) AS doc_id", "text", "mention", "p + 1 AS pos", "CAST(NULL AS INT) AS start", "CAST(NULL AS INT) AS end",
        "CASE doc_id % 5 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'LOC' WHEN 2 THEN 'ORG' WHEN 3 THEN 'DATE' ELSE 'B-GPE' END AS type",
        "CASE WHEN (doc_id + p + 1) % 4 = 0 THEN 'NIL' ELSE concat('Q', (doc_id * 3 + p + 1) % 100) END AS gold")


def annotated(spark: SparkSession, sf_dir: str, deal: bool = False, **names: str) -> DataFrame:
    """``doc_id, text, entities``: the same mentions inside their documents' rows, made there, so that no text stands beside each of its words.

    With ``deal`` texts are dealt out (:func:`dealt`) before they have entities, which are many times as large. ``names`` renames the entities' fields ``mention``, ``gold`` and ``type``; ``pos`` comes first.
    """
    field = lambda c: names.get(c, c)
    entity = f"""named_struct('pos', p + 1, '{field("mention")}', w, '{field("gold")}', CASE WHEN (doc_id + p + 1) % 4 = 0 THEN 'NIL' ELSE concat('Q', (doc_id * 3 + p + 1) % 100) END,
        '{field("type")}', CASE doc_id % 5 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'LOC' WHEN 2 THEN 'ORG' WHEN 3 THEN 'DATE' ELSE 'B-GPE' END)"""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").filter("text IS NOT NULL")
    docs = dealt(docs) if deal else docs
    return docs.selectExpr("CAST(doc_id AS STRING) AS doc_id", "text", f"filter(transform(split(text, ' '), (w, p) -> {entity}), e -> e.{field('mention')} <> '') AS entities")


#: Latin letters to Arabic ones, so that documents exercise the Arabic rules.
LATIN, ARABIC_LETTERS = "abcdefghiklmnoprstuw", "ابتثجحخلرزسشصوىةفكيء"
