"""URL filter: rules by host and path, and trust that spreads over links between hosts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower, cut_lineage

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
URL = r"://([^/?#]*)([^?#]*)"
#: Targets on other hosts of anchors; other elements and attributes that end in href don't count.
LINK = r"""(?i)<a\s(?:[^<>]*\s)?href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none fits. Of two equally long rules the blocking one wins."""
    name = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block", r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def with_host(pages: DataFrame, url_col: str = "url") -> DataFrame:
    part = lambda k: F.coalesce(F.regexp_extract(F.col(url_col), URL, k), F.lit(""))
    return pages.withColumns({"host": ascii_lower(part(1)), "path": part(2)})


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """``src, dst, w``: links from one host's pages to another host, and both ways between a host and its parent domain."""
    links = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to"))
    links = links.select(F.col("host").alias("src"), ascii_lower(F.col("to")).alias("dst"))
    parent = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1).alias("dst"))
    parent = parent.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi").select("src", "dst")
    both = links.unionByName(parent).unionByName(parent.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.filter("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("w"))


def host_trust(pages: DataFrame, damping: float = 0.85, rounds: int = 10, lineage: int = 5) -> DataFrame:
    """``host, trust, distrust``. A host's seed is the share of its rule-judged pages that rules allow, or block.

    Trust follows edges forward, distrust backward (who links to blocked hosts is suspect). Both walk in one table with
    a ``kind`` column; each round joins ranks with edges on (kind, host) and sums by target. The rank of a host with
    no edges is its seed. Lineage is cut every ``lineage`` rounds. Ranks, edges and hosts stay distributed.
    """
    judged = pages.filter("host <> ''").groupBy("host").agg(
        F.count_if(F.col("rule_verdict") == "allow").alias("allow"), F.count_if(F.col("rule_verdict") == "block").alias("block"))
    judged = cut_lineage(judged)
    edges = host_edges(pages, judged.select("host"))
    forward = edges.select(F.lit("trust").alias("kind"), "src", "dst", "w")
    backward = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    edges = forward.unionByName(backward)
    out = edges.groupBy("kind", "src").agg(F.sum("w").alias("total"))
    edges = cut_lineage(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("w") / F.col("total")).alias("p")))
    share = lambda c: F.col(c) / (F.col("allow") + F.col("block"))
    seeds = judged.filter("allow + block > 0").select("host", F.explode(F.create_map(
        F.lit("trust"), share("allow"), F.lit("distrust"), share("block"))).alias("kind", "score"))
    seeds = cut_lineage(seeds.filter("score > 0").select("kind", "host", "score"))
    ranks = seeds
    for i in range(rounds):
        passed = ranks.join(edges, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("p") * damping).alias("score"))
        start = seeds.select("kind", "host", (F.col("score") * (1 - damping)).alias("score"))
        ranks = passed.unionByName(start).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        ranks = cut_lineage(ranks) if i % lineage == lineage - 1 else ranks
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return ranks.groupBy("host").agg(of("trust"), of("distrust"))


def url_filter(pages: DataFrame, rules=RULES, ratio: float = 2.0, rounds: int = 10) -> DataFrame:
    """Per row of ``pages``: ``page_id, host, path, rule, verdict``.

    The longest fitting rule decides. Where none fits, a host is blocked if its distrust is more than ``ratio`` times
    its trust, else allowed; unknown hosts, and pages without a host, are allowed. Null urls and urls without ``://``
    have an empty host and path. Null ``html`` has no links. Repeated rows get the same result; an empty table an empty one.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = with_host(rows)
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "rule_verdict": verdict})
    bad = host_trust(rows, rounds=rounds).filter(F.col("distrust") > ratio * F.col("trust")).select("host", F.lit(True).alias("bad"))
    return rows.join(bad, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))


def sql(rules=RULES, ratio: float = 2.0, rounds: int = 10, damping: float = 0.85) -> str:
    """The same in DuckDB, one common table expression a round."""
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1]))
    name = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in order) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{k}'" for k, h, p in order) + " END"
    link = LINK.replace("'", "''")
    steps = "".join(f"""
r{i} AS MATERIALIZED (SELECT kind, host, sum(score) AS score FROM (
  SELECT e.kind, e.dst AS host, r.score * e.p * {damping} AS score FROM r{i - 1} r JOIN edge e ON r.kind = e.kind AND r.host = e.src
  UNION ALL SELECT kind, host, score * {1 - damping} FROM r0) GROUP BY ALL),""" for i in range(1, rounds + 1))
    lower = lambda x: f"translate({x}, '{UPPER}', '{UPPER.lower()}')"
    return f"""
WITH p0 AS (SELECT page_id, html, {lower(f"coalesce(regexp_extract(url, '{URL}', 1), '')")} AS host,
                   coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages),
p AS (SELECT *, {name} AS rule, {verdict} AS rule_verdict FROM p0),
judged AS (SELECT host, count(*) FILTER (rule_verdict = 'allow') AS allow, count(*) FILTER (rule_verdict = 'block') AS block
           FROM p WHERE host <> '' GROUP BY host),
parent AS (SELECT host AS src, regexp_extract(host, '^[^.]+\\.(.+\\..+)$', 1) AS dst FROM judged),
pair AS (SELECT src, dst FROM parent WHERE dst IN (SELECT host FROM judged)),
flat AS (SELECT src, dst, count(*) AS w FROM (
  SELECT host AS src, {lower("unnest(regexp_extract_all(html, '" + link + "', 1))")} AS dst FROM p
  UNION ALL SELECT src, dst FROM pair UNION ALL SELECT dst, src FROM pair) WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL),
two AS (SELECT 'trust' AS kind, src, dst, w FROM flat UNION ALL SELECT 'distrust', dst, src, w FROM flat),
edge AS MATERIALIZED (SELECT kind, src, dst, w / sum(w) OVER (PARTITION BY kind, src) AS p FROM two),
r0 AS MATERIALIZED (SELECT * FROM (
  SELECT 'trust' AS kind, host, allow / (allow + block) AS score FROM judged WHERE allow + block > 0
  UNION ALL SELECT 'distrust', host, block / (allow + block) FROM judged WHERE allow + block > 0) WHERE score > 0),{steps}
bad AS (SELECT host FROM r{rounds} GROUP BY host
        HAVING coalesce(sum(score) FILTER (kind = 'distrust'), 0) > {ratio} * coalesce(sum(score) FILTER (kind = 'trust'), 0))
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM p
"""
