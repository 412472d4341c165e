"""A knowledge-base snapshot as tables: names, titles, classes; retrieval, matching and typing as joins.

Tables: entities (:data:`linkmill.schemas.ENTITY`), ``edges(class, parent)``, ``wp_page(title, qid, is_disambiguation)``,
``wp_redirect(from_title, to_title)``, ``wp_link(from_title, to_title, pos)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import all_variants, edge_trim, has_latin, let, name_tokens, norm_type, normalize_text, search_variants, token_key
from .lineage import cut_lineage
from .merging import current_ids

# Classes that define the entity types, and classes of pages that are no entities.
_PLACES = ["Q2221906", "Q618123", "Q56061", "Q486972", "Q6256", "Q17334923", "Q1048835"]
TYPE_ROOTS = {
    "PER": ["Q5", "Q95074", "Q15632617"],
    "LOC": _PLACES,
    "GPE": [*_PLACES, "Q7275"],
    "ORG": ["Q43229", "Q4830453", "Q7278", "Q847017"],
    "FAC": ["Q13226383", "Q41176", "Q811979"],
    "EVENT": ["Q1656682", "Q1190554"],
}
BAD_CLASSES = {
    "Q4167410": "Wikimedia disambiguation page", "Q22808320": "Wikimedia human name disambiguation page",
    "Q4167836": "Wikimedia category", "Q11266439": "Wikimedia template", "Q13406463": "Wikimedia list article",
}
FACTS = {
    "P17": "country", "P131": "located in", "P106": "occupation", "P27": "citizenship", "P569": "born", "P570": "died", "P571": "inception",
    "P159": "headquarters", "P641": "sport", "P118": "league", "P452": "industry", "P39": "position held", "P279": "subclass of",
}
LANGS = ("ar", "en", "fr")


def type_roots(spark: SparkSession, roots: dict[str, list[str]] | None = None) -> DataFrame:
    """``type, root``: a fixed list of some twenty rows."""
    return spark.createDataFrame([(t, r) for t, rs in (roots or TYPE_ROOTS).items() for r in rs], "type string, root string")


def property_values(claims: Column, k: int) -> Column:
    """The first ``k`` values of a property's claims that aren't deprecated: ids, dates, texts and amounts as strings."""
    value = lambda c: c["mainsnak"]["datavalue"]
    live = F.filter(F.coalesce(claims, F.array().cast("array<struct<rank: string, mainsnak: struct<datavalue: struct<type: string, value: string>>>>")),
                    lambda c: ~F.coalesce(c["rank"] == "deprecated", F.lit(False)) & value(c)["type"].isin("wikibase-entityid", "time", "monolingualtext", "string", "quantity"))

    def text(c: Column) -> Column:
        kind, raw = value(c)["type"], value(c)["value"]
        time = F.get_json_object(raw, "$.time")
        day = F.regexp_replace(F.substring(time, 2, 10), "^0+", "")
        return (F.when(kind == "wikibase-entityid", F.get_json_object(raw, "$.id")).when(kind == "time", F.coalesce(F.nullif(day, F.lit("")), time))
                .when(kind == "monolingualtext", F.get_json_object(raw, "$.text")).when(kind == "quantity", F.get_json_object(raw, "$.amount")).otherwise(raw))

    return F.filter(F.transform(F.slice(live, 1, k), text), lambda v: v.isNotNull() & (v != ""))


def ingest_entities(raw: DataFrame) -> DataFrame:
    """Entity records (:data:`linkmill.schemas.RAW_ENTITY`) to compact entities: names by language, classes, facts, number of site links."""
    names = lambda lang, k: F.coalesce(F.slice(F.transform(F.col("aliases")[lang], lambda a: a["value"]), 1, k), F.array().cast("array<string>"))
    facts = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, FACTS)), F.array(*[property_values(F.col("claims")[p], 3) for p in FACTS])), lambda _, v: F.size(v) > 0)
    return raw.select(
        F.col("id").alias("qid"), *[F.col("labels")[x]["value"].alias(f"label_{x}") for x in LANGS], *[F.col("descriptions")[x]["value"].alias(f"desc_{x}") for x in ("ar", "en")],
        names("ar", 10).alias("aliases_ar"), names("en", 6).alias("aliases_en"), names("fr", 6).alias("aliases_fr"), property_values(F.col("claims")["P31"], 5).alias("p31"),
        facts.alias("facts"), F.coalesce(F.size(F.map_keys("sitelinks")), F.lit(0)).alias("sitelinks"), F.col("sitelinks")["arwiki"]["title"].alias("arwiki"))


def name_index(entities: DataFrame) -> DataFrame:
    """``lang, name_norm, name_key, qid, is_label, sitelinks``: each distinct normalised name of each entity."""

    def of(x: str) -> Column:
        entry = lambda name, is_label: F.struct(F.lit(x).alias("lang"), name.alias("name"), F.lit(is_label).alias("is_label"))
        return F.concat(F.array(entry(F.col(f"label_{x}"), True)), F.transform(F.coalesce(f"aliases_{x}", F.array().cast("array<string>")), lambda a: entry(a, False)))

    names = F.concat(*map(of, LANGS))
    rows = entities.select("qid", "sitelinks", F.inline(names)).filter("name IS NOT NULL")
    rows = rows.select("lang", normalize_text(F.col("name")).alias("name_norm"), token_key(F.col("name")).alias("name_key"), "qid", "is_label", "sitelinks").filter("name_norm <> ''")
    return rows.groupBy("lang", "name_norm", "qid").agg(F.min("name_key").alias("name_key"), F.bool_or("is_label").alias("is_label"), F.max("sitelinks").alias("sitelinks"))


def search_names(queries: DataFrame, index: DataFrame, limit: int = 7, head: int = 3) -> DataFrame:
    """``lang, query`` and its hits ``qid, sitelinks, rank``: names that begin with the query, most site links first, at most ``limit``.

    Queries come first. Under each of their first ``head`` characters (fewer where a query is shorter) stand the lengths that are
    asked for, and a name gets a row for those of its prefixes alone that are as long; of these stay the ones that
    some query is. So a name of a thousand characters costs a row a length asked under its first characters, never one a
    character. An entity counts once under a prefix; tasks keep the best ``limit`` of a prefix before the exchange, so a
    prefix that many names share costs no more than others.
    """
    asked = cut_lineage(queries.select("lang", "query", normalize_text(F.col("query")).alias("prefix")).filter("prefix <> ''").distinct())
    wanted = asked.select("lang", "prefix").distinct()
    lengths = wanted.groupBy("lang", F.substring("prefix", 1, head).alias("head")).agg(F.collect_set(F.char_length("prefix")).alias("lengths"))
    heads = F.transform(F.sequence(F.lit(1), F.least(F.lit(head), F.char_length("name_norm"))), lambda n: F.substring("name_norm", F.lit(1), n))
    names = index.select("lang", "qid", "sitelinks", "name_norm", F.explode(heads).alias("head")).join(lengths, ["lang", "head"])
    fitting = F.filter("lengths", lambda n: n <= F.char_length("name_norm"))
    held = names.select("lang", "qid", "sitelinks", F.explode(F.transform(fitting, lambda n: F.substring("name_norm", F.lit(1), n))).alias("prefix"))
    held = held.join(wanted, ["lang", "prefix"], "left_semi").groupBy("lang", "prefix", "qid").agg(F.max("sitelinks").alias("sitelinks"))
    order = W.partitionBy("lang", "prefix").orderBy(F.col("sitelinks").desc(), "qid")
    best = held.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return asked.join(best, ["lang", "prefix"]).select("lang", "query", "qid", "sitelinks", "rank")


def resolve_titles(df: DataFrame, wp_page: DataFrame, wp_redirect: DataFrame, title: str = "title") -> DataFrame:
    """Adds ``final_title``, ``qid`` (null for disambiguation pages and unknown titles) and ``is_disambiguation``."""
    moved = wp_redirect.select(F.col("from_title").alias("_from"), F.col("to_title").alias("_to"))
    page = wp_page.select(F.col("title").alias("final_title"), F.col("qid").alias("_qid"), "is_disambiguation")
    rows = df.join(moved, F.col(title) == F.col("_from"), "left").withColumn("final_title", F.coalesce("_to", title)).drop("_from", "_to")
    rows = rows.join(page, "final_title", "left")
    return rows.withColumn("qid", F.when(~F.coalesce("is_disambiguation", F.lit(False)), F.col("_qid"))).drop("_qid")


def disambiguation_links(titles: DataFrame, wp_link: DataFrame, wp_page: DataFrame, limit: int = 30) -> DataFrame:
    """``title, qid, pos``: the first ``limit`` items linked from a page, themselves no disambiguation pages."""
    page = wp_page.filter("qid IS NOT NULL AND NOT is_disambiguation").select(F.col("title").alias("to_title"), "qid")
    rows = titles.select("title").distinct().join(wp_link, F.col("title") == F.col("from_title")).join(page, "to_title")
    order = W.partitionBy("title").orderBy("pos", "to_title")
    return rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= limit).select("title", "qid", "pos")


def class_closure(edges: DataFrame, roots: DataFrame, max_rounds: int = 64, every: int = 4) -> DataFrame:
    """``class, root`` of all classes at or under the roots (column ``root``), walking down from them; cycles are harmless.

    Only the classes found in the last round are joined with the edges again. Each round, and every few rounds all that
    was found, goes to the checkpoint folder, so that plans stay short.
    """
    edges = cut_lineage(edges.select("class", "parent").distinct()).select(F.col("class").alias("child"), "parent")
    found = front = cut_lineage(roots.select("root").distinct()).select(F.col("root").alias("class"), "root")
    for i in range(1, max_rounds + 1):
        new = front.join(edges, F.col("class") == F.col("parent")).select(F.col("child").alias("class"), "root").distinct()
        front = cut_lineage(new.join(found, ["class", "root"], "left_anti"))
        if front.isEmpty():
            return found
        found = found.unionByName(front)
        found = found if i % every else cut_lineage(found)
    raise RuntimeError(f"classes go on under {max_rounds} levels")


def is_instance_of(pairs: DataFrame, entities: DataFrame, closure: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds ``is_type`` to ``qid, type``: true, false, or null where it is unknown (no such entity, no class, no such type)."""
    kinds = closure.join(roots, "root").select("class", "type").distinct().withColumn("_hit", F.lit(True))
    classes = entities.select("qid", F.explode("p31").alias("class"))
    asked = pairs.select("qid", "type").distinct().join(roots.select("type").distinct(), "type")
    got = asked.join(classes, "qid").join(kinds, ["class", "type"], "left").groupBy("qid", "type").agg(F.bool_or(F.coalesce("_hit", F.lit(False))).alias("is_type"))
    return pairs.join(got, ["qid", "type"], "left")


def popularity_bucket(mentions: DataFrame, entities: DataFrame, head: int = 50, tail: int = 10) -> DataFrame:
    """Replaces ``sitelinks`` and ``category`` by the gold entity's links and bucket; NIL never meets the entities."""
    known = entities.select(F.col("qid").alias("gold"), F.col("sitelinks").alias("_links"))
    linked = mentions.filter("gold <> 'NIL'").join(known, "gold", "left").withColumn("sitelinks", F.coalesce("_links", F.lit(0))).drop("_links")
    n = F.col("sitelinks")
    linked = linked.withColumn("category", F.when(n >= head, "head").when(n < tail, "tail").otherwise("torso"))
    nil = mentions.filter("gold = 'NIL' OR gold IS NULL").withColumns({"sitelinks": F.lit(None).cast("int"), "category": F.lit("nil")})
    return linked.unionByName(nil)


def _beyond(level: Column, strict: bool):
    return (lambda n: n > level) if strict else (lambda n: n >= level)


def overlaps(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Pairs of intervals of the same ``key`` that overlap: all columns of ``left`` (``key, start, end``) and of ``right`` (``key, _a, _b``).

    An interval's *level* is the power of two that is as wide as it is; at its level and above it covers two bins at most. A pair
    meets at the wider one's level, in the bin of the later start alone, which both cover: so each pair is made once. The
    narrower one stands at those levels alone that the other side has in its text. What meets in a bin lies within a
    bin's width, so what is joined grows with the true overlaps and not with the square of a text's intervals.
    """
    def placed(df: DataFrame, start: str, end: str) -> DataFrame:
        width = F.greatest(F.col(end) - F.col(start), F.lit(1))
        return df.withColumns({"_s": F.col(start), "_e": F.col(start) + width, "_level": F.ceil(F.log2(width)).cast("int")})

    def binned(df: DataFrame, level: Column) -> DataFrame:
        place = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), "_at")).cast("long")
        return df.withColumn("_at", level).withColumn("_last", F.floor((F.col("_e") - 1) / F.pow(F.lit(2.0), "_at")).cast("long")).withColumn("_bin", F.explode(F.sequence(place("_s"), F.col("_last")))).drop("_last")

    x, y = placed(left, "start", "end"), placed(right, "_a", "_b")
    met = None
    for own, other, strict in ((y, x, False), (x, y, True)):
        levels = own.groupBy(F.col(key).alias("_k")).agg(F.collect_set("_level").alias("_levels"))
        above = F.filter("_levels", _beyond(F.col("_level"), strict))
        narrow = binned(other.join(levels, F.col(key) == F.col("_k")).drop("_k"), F.explode(above)).drop("_levels", "_level", "_e")
        wide = binned(own, F.col("_level")).drop("_level", "_e")
        # in both turns the right side's columns get new names, as the key and the bins stand on both
        named = {c: f"{c}_2" for c in (key, "_s", "_at", "_bin")}
        a, b = (narrow, wide.withColumnsRenamed(named)) if not strict else (wide, narrow.withColumnsRenamed(named))
        at = F.pow(F.lit(2.0), "_at")
        pairs = a.join(b, (F.col(key) == F.col(f"{key}_2")) & (F.col("_at") == F.col("_at_2")) & (F.col("_bin") == F.col("_bin_2")))
        pairs = pairs.filter((F.col("_a") < F.col("end")) & (F.col("_b") > F.col("start")) & (F.col("_bin") == F.floor(F.greatest("_s", "_s_2") / at)))
        pairs = pairs.drop("_s", "_at", "_bin", *named.values())
        met = pairs if met is None else met.unionByName(pairs)
    return met


def assign_ner_types(mentions: DataFrame, spans: DataFrame) -> DataFrame:
    """Replaces ``type`` by that of the span (``text_key, start, end, entity_group, ord``) with the largest overlap; null without one.

    Mentions (``id, text_key, text, mention, start, end``) and spans meet where they overlap (:func:`overlaps`); ties go to the first
    span. The best of a mention is a partial maximum before the exchange.
    """
    m = mentions.withColumn("_from", F.coalesce("start", F.instr("text", F.col("mention")) - 1)).withColumn("_to", F.coalesce("end", F.col("_from") + F.char_length("mention")))
    s = spans.select("text_key", F.col("start").alias("_a"), F.col("end").alias("_b"), "entity_group", "ord")
    hits = overlaps(m.select("id", "text_key", F.col("_from").alias("start"), F.col("_to").alias("end")), s, "text_key")
    best = hits.groupBy("id").agg(F.max(F.struct((F.least("end", "_b") - F.greatest("start", "_a")).alias("overlap"), (-F.col("ord")).alias("first"), F.col("entity_group"))).alias("best"))
    return m.drop("type", "_from", "_to").join(best.select("id", norm_type(F.col("best.entity_group")).alias("type")), "id", "left")


def first_created(revisions: DataFrame) -> DataFrame:
    return revisions.groupBy("qid").agg(F.min("ts").alias("created"))


def entity_names(latin: Column) -> Column:
    """The names that a mention may match: Arabic ones, and for mentions with Latin letters English and French ones too."""
    of = lambda x: F.concat(F.array(f"label_{x}"), F.coalesce(f"aliases_{x}", F.array().cast("array<string>")))
    names = F.when(latin, F.concat(of("ar"), of("en"), of("fr"))).otherwise(of("ar"))
    return F.filter(names, lambda n: n.isNotNull() & (n != ""))


def label_match(mention: Column, exact: bool, unknown: bool | None = None) -> Column:
    """Does a mention match the entity in the same row? Some variant's tokens equal a name's, or (not exact) are among them.

    Entities without usable names count as matched if not exact, unless ``unknown`` says otherwise.
    """

    def compare(names: Column, tried: Column) -> Column:
        hit = F.exists(tried, lambda v: F.exists(names, lambda n: (v == n) if exact else (v == n) | (F.size(F.array_except(v, n)) == 0)))
        return F.when(F.size(names) == 0, F.lit((not exact) if unknown is None else unknown)).otherwise(hit)

    names = F.transform(entity_names(has_latin(mention)), name_tokens)
    tried = F.filter(F.transform(all_variants(mention), name_tokens), lambda v: F.size(v) > 0)
    return let(F.struct(names.alias("names"), tried.alias("tried")), lambda x: compare(x["names"], x["tried"]))


def generate_candidates(mentions: DataFrame, entities: DataFrame, wp_page: DataFrame, wp_redirect: DataFrame, wp_link: DataFrame, most: int = 10, least: int = 3, limit: int = 7, extra: DataFrame | None = None,
                        merged: DataFrame | None = None) -> DataFrame:
    """``mention, pos, qid, sitelinks``: ordered candidates of each distinct mention.

    Sources, in this order: for each primary variant its title and then its name hits; the same for fallback variants,
    only where fewer than ``least`` items are known so far; name hits in English and French for mentions with Latin
    letters; ``extra`` queries (``mention, query, lang``). An item keeps its first place; ids that ``merged`` (:func:`linkmill.operators.merging.merged_ids`)
    knows as old count as the item that they became, once. Items of page classes and items
    missing from the snapshot go; ``most`` stay; free places are filled from disambiguation pages by site links.
    Everything runs on distinct mentions, of which join results are capped before entities are read.
    """
    index = name_index(entities)
    asked = mentions.select("mention").filter("mention <> ''").distinct()
    v = asked.select("mention", search_variants(F.col("mention")).alias("v"))
    ways = v.select("mention", F.lit(0).alias("tier"), F.posexplode("v.primary").alias("nth", "query")).unionByName(v.select("mention", F.lit(1).alias("tier"), F.posexplode("v.fallback").alias("nth", "query"))).withColumn("lang", F.lit("ar"))
    latin = asked.filter(has_latin(F.col("mention"))).select("mention", F.lit(2).alias("tier"), edge_trim(F.col("mention")).alias("query"), F.posexplode(F.array(F.lit("en"), F.lit("fr"))).alias("nth", "lang"))
    ways = ways.unionByName(latin)
    if extra is not None:
        ways = ways.unionByName(extra.select("mention", F.lit(3).alias("tier"), F.lit(0).alias("nth"), "query", F.coalesce("lang", F.lit("en")).alias("lang")))
    named = ways.join(search_names(ways.select("lang", "query"), index, limit).select("lang", "query", "qid", "rank"), ["lang", "query"]).select("mention", "tier", "nth", F.col("rank"), "qid")
    titled = resolve_titles(ways.filter("tier < 2").select("mention", "tier", "nth", F.col("query").alias("title")), wp_page, wp_redirect)
    direct = titled.filter("qid IS NOT NULL").select("mention", "tier", "nth", F.lit(0).alias("rank"), "qid")
    now = lambda df: df if merged is None else current_ids(df, merged, "qid")
    rows = now(named.unionByName(direct)).groupBy("mention", "qid").agg(F.min(F.struct("tier", "nth", "rank")).alias("at"))
    strong = F.count_if(F.col("at.tier") == 0).over(W.partitionBy("mention"))
    rows = rows.withColumn("_first", strong).filter((F.col("at.tier") != 1) | (F.col("_first") < least))
    bad = F.array(*map(F.lit, BAD_CLASSES))
    real = entities.filter(~F.coalesce(F.arrays_overlap("p31", bad), F.lit(False))).select("qid", "sitelinks")
    order = W.partitionBy("mention").orderBy("at", "qid")
    kept = rows.join(real, "qid").withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= most).select("mention", "pos", "qid", "sitelinks")
    doubtful = titled.filter(F.coalesce("is_disambiguation", F.lit(False))).join(rows.select("mention", "_first").distinct(), "mention", "left").filter((F.col("tier") == 0) | (F.coalesce("_first", F.lit(0)) < least))
    more = doubtful.select("mention", F.col("final_title").alias("title")).distinct().join(disambiguation_links(doubtful.select(F.col("final_title").alias("title")), wp_link, wp_page), "title")
    more = now(more.select("mention", "qid")).distinct().join(real, "qid").join(kept.select("mention", "qid"), ["mention", "qid"], "left_anti")
    have = kept.groupBy("mention").agg(F.count("*").alias("have"))
    more = more.join(have, "mention", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    more = more.withColumn("pos", F.col("have") + F.row_number().over(W.partitionBy("mention").orderBy(F.desc("sitelinks"), "qid"))).filter(F.col("pos") <= most)
    return kept.withColumn("pos", F.col("pos").cast("long")).unionByName(more.select("mention", F.col("pos").cast("long").alias("pos"), "qid", "sitelinks"))


def candidate_evidence(cands: DataFrame, entities: DataFrame, names: DataFrame) -> DataFrame:
    """``mention, evidence``: a line per candidate, in order; ``names`` (``qid, label``) say what classes and facts are called."""
    rows = cands.select("mention", "pos", "qid").join(entities, "qid")
    facts = F.map_entries("facts")
    used = rows.select("mention", "pos", F.explode(F.concat(
        F.transform(F.slice("p31", 1, 3), lambda t: F.struct(F.lit("type").alias("p"), t.alias("v"))),
        F.flatten(F.transform(facts, lambda f: F.transform(f["value"], lambda v: F.struct(f["key"].alias("p"), v.alias("v"))))))).alias("u"))
    used = used.select("mention", "pos", "u.v").distinct().join(names.select(F.col("qid").alias("v"), "label"), "v")
    known = used.groupBy("mention", "pos").agg(F.map_from_entries(F.collect_list(F.struct("v", "label"))).alias("called"))
    rows = rows.join(known, ["mention", "pos"], "left").withColumn("called", F.coalesce("called", F.create_map().cast("map<string, string>")))
    say = lambda v: F.coalesce(F.element_at("called", v), v)
    or_dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    filled = lambda *cs: F.filter(F.array(*cs), lambda x: x.isNotNull() & (x != ""))
    titles = F.create_map(*[F.lit(x) for pair in FACTS.items() for x in pair])
    told = F.array_join(F.transform(facts, lambda f: F.concat(F.element_at(titles, f["key"]), F.lit("="), F.array_join(F.transform(f["value"], say), ", "))), "; ")
    line = F.concat(
        F.lit("["), F.col("pos") - 1, F.lit("] "), "qid", F.lit(" | "), or_dash(F.array_join(F.array_distinct(filled("label_ar", "label_en", "label_fr")), " / ")),
        F.lit(" | aliases: "), or_dash(F.array_join(F.slice("aliases_ar", 1, 4), ", ")), F.lit(" | desc: "), or_dash(F.array_join(filled("desc_ar", "desc_en"), " / ")),
        F.lit(" | type: "), or_dash(F.array_join(F.transform(F.slice("p31", 1, 3), say), ", ")), F.when(told != "", F.concat(F.lit(" | "), told)).otherwise(""), F.lit(" | wiki-links: "), "sitelinks")
    lines = rows.groupBy("mention").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    return lines.select("mention", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("evidence"))
