"""Linking systems without a model, checks of answers, the correction loop, and the bookkeeping of runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import all_variants, norm_gold, norm_type, token_key
from .kb import BAD_CLASSES, TYPE_ROOTS, is_instance_of, label_match, name_index, search_names
from .lineage import cut_lineage

KEPT = ("qid", "label", "initial_qid", "corrected", "flagged", "rounds", "confidence", "reason", "candidates", "llm_calls", "seconds", "trace")
_SUGGEST = "struct<q: string, lang: string>"


def link_search_top1(mentions: DataFrame, entities: DataFrame, limit: int = 7) -> DataFrame:
    """``id, qid``: the best hit of the first query variant that has any, else NIL; searched once per distinct mention."""
    ways = mentions.select("mention").distinct().select("mention", F.posexplode(all_variants(F.col("mention"))).alias("nth", "query")).withColumn("lang", F.lit("ar"))
    hits = ways.join(search_names(ways, name_index(entities), limit).select("lang", "query", "qid", "rank"), ["lang", "query"])
    best = hits.groupBy("mention").agg(F.min(F.struct("nth", "rank", "qid")).alias("b")).select("mention", F.col("b.qid").alias("_qid"))
    return mentions.join(best, "mention", "left").select("id", "mention", F.coalesce("_qid", F.lit("NIL")).alias("qid"))


def _best(mentions: DataFrame, cands: DataFrame, *order: Column) -> DataFrame:
    top = cands.groupBy("mention").agg(F.max(F.struct(*order, F.col("sitelinks").alias("s"), (-F.col("pos")).alias("p"), F.col("qid").alias("q"))).alias("b"))
    return mentions.join(top, "mention", "left").select("id", "mention", F.coalesce("b.q", F.lit("NIL")).alias("qid"))


def link_popularity(mentions: DataFrame, cands: DataFrame) -> DataFrame:
    """The candidate with the most site links, the first one on ties; NIL without candidates."""
    return _best(mentions, cands)


def link_exact_popularity(mentions: DataFrame, cands: DataFrame, entities: DataFrame) -> DataFrame:
    """The same among exact name matches, where there are any."""
    rows = cands.join(entities.drop("sitelinks"), "qid").withColumn("exact", label_match(F.col("mention"), exact=True))
    return _best(mentions, rows, F.col("exact").alias("x"))


def _typed(rows: DataFrame, entities: DataFrame, closure: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds ``known_type`` (the type has root classes) and ``is_type``; ``rows`` have ``qid`` and a normal ``type``."""
    rows = is_instance_of(rows, entities, closure, roots)
    return rows.withColumn("known_type", F.coalesce(F.col("type").isin(*TYPE_ROOTS), F.lit(False)))


def apply_nil_rule(runs: DataFrame, entities: DataFrame, closure: DataFrame, roots: DataFrame) -> DataFrame:
    """NIL answers become the first candidate with exactly the mention's name and no contradicting type.

    The initial answer is then NIL, and the trace one verification step with a NIL_RULE issue. Only candidates of NIL
    rows are expanded.
    """
    nil = runs.filter("qid = 'NIL'").select("run", "id", "ord", "mention", norm_type(F.col("type")).alias("type"), F.posexplode("candidates").alias("pos", "qid"))
    rows = _typed(nil, entities, closure, roots).join(entities, "qid").filter(label_match(F.col("mention"), exact=True))
    rows = rows.filter(~F.col("known_type") | F.coalesce("is_type", F.lit(True)))
    found = rows.groupBy("run", "id", "ord").agg(F.min(F.struct("pos", "qid")).alias("f")).select("run", "id", "ord", F.col("f.qid").alias("_rule"))
    out = runs.join(found, ["run", "id", "ord"], "left")
    fired = F.col("_rule").isNotNull()
    trace = out.schema["trace"].dataType
    note = F.from_json(F.to_json(F.array(F.struct(F.lit("verify").alias("step"), F.array(F.struct(F.lit("NIL_RULE").alias("check"), F.col("_rule").alias("msg"), F.lit(False).alias("hard"))).alias("issues")))), trace)
    return out.withColumns({"initial_qid": F.when(fired, "NIL").otherwise(F.col("initial_qid")), "qid": F.when(fired, F.col("_rule")).otherwise(F.col("qid")), "trace": F.when(fired, note).otherwise(F.col("trace"))}).drop("_rule")


def _issue(check: str, msg: Column, hard: bool = False, suggest: Column | None = None) -> Column:
    return F.struct(F.lit(check).alias("check"), msg.alias("msg"), F.lit(hard).alias("hard"), (F.lit(None) if suggest is None else suggest).cast(_SUGGEST).alias("suggest"))


def verify_answers(decisions: DataFrame, cands: DataFrame, entities: DataFrame, closure: DataFrame, roots: DataFrame, sure: float = 0.7) -> DataFrame:
    """Adds ``issues`` to decisions (``id, mention, type, action, qid, confidence``) on candidates ``id, pos, qid``.

    Hard: no valid answer (FORMAT), an item outside the candidates (CANDIDATE), a page and no entity (NOT_ENTITY).
    Soft: a contradicting type (TYPE); no matching name, if confidence is under ``sure`` or there are other issues (LABEL);
    NIL although candidates have exactly that name and no contradicting type (NIL, the first three named).
    """
    d = decisions.withColumn("type", norm_type(F.col("type")))
    info = _typed(cands.join(d.select("id", "mention", "type"), "id"), entities, closure, roots).join(entities, "qid", "left")
    name = F.coalesce("label_ar", "label_en", F.lit("None"))
    page = F.create_map(*[F.lit(x) for pair in BAD_CLASSES.items() for x in pair])
    bad = F.filter("p31", lambda c: F.array_contains(F.map_keys(page), c))
    info = info.withColumns({"exact": label_match(F.col("mention"), True), "loose": label_match(F.col("mention"), False), "name": name, "page": F.element_at(page, F.get(bad, 0)), "classes": F.array_join(F.slice("p31", 1, 3), ", ")})
    one = info.select("id", "qid", F.struct("is_type", "known_type", "loose", "name", "page", "classes").alias("c")).dropDuplicates(["id", "qid"])
    strong = info.filter(F.col("exact") & (~F.col("known_type") | F.coalesce("is_type", F.lit(True))))
    strong = strong.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", F.concat("qid", F.lit(" ("), "name", F.lit(")")).alias("t")))).alias("s"))
    strong = strong.select("id", F.array_join(F.transform(F.slice("s", 1, 3), lambda x: x["t"]), ", ").alias("matches"))
    rows = d.join(one, ["id", "qid"], "left").join(strong, "id", "left")
    c = F.col("c")
    some = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    first = some(
        F.when(c["page"].isNotNull(), _issue("NOT_ENTITY", F.concat("qid", F.lit(" is a "), c["page"], F.lit(", not a real-world entity.")), True)),
        F.when(c["known_type"] & (c["is_type"] == False), _issue("TYPE", F.concat("qid", F.lit(" is an instance of ["), c["classes"], F.lit("], which does not go with the type "), "type"))))  # noqa: E712
    label = F.when(~c["loose"] & ((F.coalesce("confidence", F.lit(0.5)) < sure) | (F.size(first) > 0)), _issue("LABEL", F.concat(F.lit("«"), "mention", F.lit("» matches no name of "), "qid", F.lit(" ("), c["name"], F.lit(")"))))
    nil = some(F.when(F.col("matches").isNotNull(), _issue("NIL", F.concat(F.lit("NIL, but these candidates match the mention exactly: "), "matches"))))
    none = F.filter(F.array(_issue("", F.lit(""))), lambda x: F.lit(False))
    issues = (F.when(F.col("action") == "invalid", F.array(_issue("FORMAT", F.lit("The answer was not a valid action or item."), True)))
              .when((F.col("action") == "select") & c.isNull(), F.array(_issue("CANDIDATE", F.concat("qid", F.lit(" is not in the candidate list.")), True)))
              .when(F.col("action") == "select", F.concat(first, some(label))).when(F.col("action") == "nil", nil).otherwise(none))
    return rows.withColumn("issues", issues).drop("c", "matches")


def needs_expansion(mentions: DataFrame, cands: DataFrame, entities: DataFrame, least: int = 3) -> DataFrame:
    """Distinct mentions with ``weak``: fewer than ``least`` candidates, or none whose name matches."""
    rows = cands.join(entities.drop("sitelinks"), "qid").withColumn("hit", label_match(F.col("mention"), False, unknown=False))
    got = rows.groupBy("mention").agg(F.count("*").alias("n"), F.bool_or("hit").alias("hit"))
    return mentions.select("mention").distinct().join(got, "mention", "left").select("mention", F.coalesce("n", F.lit(0)).alias("n_candidates"), (F.coalesce("n", F.lit(0)) < least).__or__(~F.coalesce("hit", F.lit(False))).alias("weak"))


Decider = Callable[[DataFrame], DataFrame]


def criticised(rows: DataFrame, critic: Decider) -> DataFrame:
    """Adds a soft CRITIC issue to the answers without hard issues that ``critic`` objects to (``id, msg, suggest``, a search)."""
    rows = cut_lineage(rows)
    asked = rows.filter(F.col("action").isin("select", "nil") & ~F.exists("issues", lambda i: i["hard"]))
    said = critic(asked).select("id", F.array(_issue("CRITIC", F.col("msg"), suggest=F.col("suggest"))).alias("_said"))
    return rows.join(said, "id", "left").withColumn("issues", F.when(F.col("_said").isNull(), F.col("issues")).otherwise(F.concat("issues", "_said"))).drop("_said")


def suggested_candidates(rows: DataFrame, cands: DataFrame, index: DataFrame, entities: DataFrame, limit: int = 7, most: int = 5) -> DataFrame:
    """``id, pos, qid``: what the searches that issues suggest add after the candidates that a row has.

    Each search adds its first ``most`` hits that are known entities, no pages, and no candidates yet; a hit of several
    searches counts in the first. Distinct searches run once.
    """
    asks = rows.select("id", F.posexplode("issues").alias("nth", "i")).select("id", "nth", F.coalesce("i.suggest.lang", F.lit("ar")).alias("lang"), F.col("i.suggest.q").alias("query")).filter("query <> ''")
    hits = asks.join(search_names(asks, index, limit), ["lang", "query"]).select("id", "nth", "rank", "qid")
    page = F.exists(F.coalesce("p31", F.array().cast("array<string>")), lambda c: c.isin(*BAD_CLASSES))
    new = hits.join(entities.filter(~page).select("qid"), "qid").join(cands.select("id", "qid"), ["id", "qid"], "left_anti")
    new = new.withColumn("k", F.row_number().over(W.partitionBy("id", "nth").orderBy("rank"))).filter(F.col("k") <= most)
    new = new.groupBy("id", "qid").agg(F.min(F.struct("nth", "rank")).alias("at")).join(cands.groupBy("id").agg(F.max("pos").alias("last")), "id", "left")
    return new.select("id", (F.coalesce("last", F.lit(-1)) + F.row_number().over(W.partitionBy("id").orderBy("at"))).cast("int").alias("pos"), "qid")


def correction_loop(decisions: DataFrame, cands: DataFrame, entities: DataFrame, closure: DataFrame, roots: DataFrame, decide: Decider, max_rounds: int = 3, critic: Decider | None = None, index: DataFrame | None = None) -> DataFrame:
    """Verifies and re-decides until clean, confirmed, or out of rounds: ``id, qid, initial_qid, corrected, flagged, rounds, n_issues``.

    ``decide`` takes the open rows with their ``issues`` and returns ``id, new_action, new_qid, new_confidence`` (a
    ``mapInPandas`` around the user's batch scorer, say). Issues that came with a decision (column ``extra``) count in the
    first round only. ``confirm`` clears soft issues and closes the row; on hard ones the old decision stays open. After the
    last round one more verification judges; a row whose issues are still hard becomes NIL. Closed rows never travel again.
    ``critic`` objects to answers that pass the rules (:func:`criticised`). With a name ``index``, the searches that issues
    suggest are made before re-deciding; what they find joins the candidates, and ``decide`` sees it in ``added``.
    """
    cands = cands.select("id", F.col("pos").cast("int").alias("pos"), "qid")
    base = ["id", "mention", "type", "action", "qid", "confidence"]
    open_ = decisions.select(*base, F.when(F.col("action") == "select", F.col("qid")).otherwise("NIL").alias("initial_qid"), *(["extra"] if "extra" in decisions.columns else []))
    closed = None
    hard = F.exists("issues", lambda i: i["hard"])

    def close(rows: DataFrame, n: int) -> None:
        nonlocal closed
        final = F.when((F.col("action") == "select") & ~hard, F.col("qid")).otherwise("NIL")
        done = rows.select("id", final.alias("qid"), "initial_qid", (final != F.col("initial_qid")).alias("corrected"), (F.size("issues") > 0).alias("flagged"), F.lit(n).alias("rounds"), F.size("issues").alias("n_issues"))
        closed = done if closed is None else closed.unionByName(done)

    def verified() -> DataFrame:
        rows = verify_answers(open_, cands, entities, closure, roots)
        return rows if critic is None else criticised(rows, critic)

    for n in range(1, max_rounds + 1):
        rows = verified()
        if "extra" in rows.columns:
            rows = rows.withColumn("issues", F.concat("issues", F.transform("extra", lambda m: _issue("COHERENCE", m)))).drop("extra")
        rows = cut_lineage(rows)
        close(rows.filter(F.size("issues") == 0), n)
        rest = rows.filter(F.size("issues") > 0)
        if rest.isEmpty():
            return closed
        if index is not None:
            more = cut_lineage(suggested_candidates(rest, cands, index, entities))
            cands = cut_lineage(cands.unionByName(more))
            found = more.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "qid"))), lambda x: x["qid"]).alias("added"))
            rest = rest.join(found, "id", "left")
        new = rest.join(decide(rest).select("id", "new_action", "new_qid", "new_confidence"), "id", "left")
        new = cut_lineage(new.withColumn("_confirm", F.col("new_action") == "confirm"))  # the decider runs once a round
        none = F.filter("issues", lambda i: F.lit(False))
        close(new.filter(F.col("_confirm") & ~hard).withColumn("issues", none), n)
        still = new.filter(~(F.coalesce("_confirm", F.lit(False)) & ~hard))
        use = ~F.coalesce("_confirm", F.lit(True))
        open_ = still.select("id", "mention", "type", *[F.when(use, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("action", "qid", "confidence")], "initial_qid")
    close(verified(), max_rounds)
    return closed


def coherence_batches(answers: DataFrame, most_chars: int = 3000) -> DataFrame:
    """``doc_id, text, links`` of documents with two linked mentions or more, in mention order, for a batch scorer."""
    links = F.sort_array(F.collect_list(F.struct("pos", "id", "mention", norm_type(F.col("type")).alias("type"), "qid")))
    rows = answers.filter("qid <> 'NIL' AND qid <> 'ERROR'").groupBy("doc_id").agg(links.alias("links"), F.min("text").alias("text"))
    return rows.filter(F.size("links") >= 2).select("doc_id", F.substring("text", 1, most_chars).alias("text"), "links")


def coherence_flags(batches: DataFrame, flags: DataFrame) -> DataFrame:
    """Flags (``doc_id, pos, reason``) back to mentions: ``id, reason``; places that don't exist are ignored."""
    rows = batches.select("doc_id", F.inline("links"))
    return rows.join(flags, ["doc_id", "pos"]).select("id", F.coalesce("reason", F.lit("inconsistent with the other entities in the text")).alias("reason"))


def correction_hints(mentions: DataFrame, cases: DataFrame, k: int = 3) -> DataFrame:
    """``id, hints``: the last ``k`` corrections of mentions with the same tokens, oldest first."""
    last = cases.withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy(F.col("seq").desc()))).filter(F.col("nth") <= k)
    hints = last.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("seq", "wrong", "right", "why"))).alias("hints"))
    return mentions.withColumn("key", token_key(F.col("mention"))).join(hints, "key").select("id", "mention", "hints")


def collect_cases(runs: DataFrame) -> DataFrame:
    """Corrections that ended without an open issue: the checks of the first step with issues, reasons cut to 300 characters."""
    rows = runs.filter("qid <> 'ERROR' AND qid <> initial_qid AND NOT coalesce(flagged, false)")
    first = F.get(F.filter("trace", lambda t: (t["step"] == "verify") & (F.size(t["issues"]) > 0)), 0)["issues"]
    checks = F.array_sort(F.array_distinct(F.transform(F.coalesce(first, F.filter(F.flatten(F.transform("trace", lambda t: t["issues"])), lambda i: F.lit(False))), lambda i: i["check"])))
    return rows.select("run", "id", token_key(F.col("mention")).alias("key"), "mention", F.col("initial_qid").alias("wrong"), F.col("qid").alias("right"), F.array_join(checks, ",").alias("checks"), F.substring(F.coalesce("reason", F.lit("")), 1, 300).alias("why"))


def pending_mentions(mentions: DataFrame, done: DataFrame) -> DataFrame:
    """All mentions of documents with one unanswered or failed mention at least; ``answered`` marks those that need no work."""
    ok = done.filter("qid <> 'ERROR'").select(F.col("id").cast("string").alias("id")).distinct()
    rows = mentions.withColumn("id", F.col("id").cast("string"))
    todo = rows.join(ok, "id", "left_anti").select("doc_id").distinct()
    return rows.join(todo, "doc_id", "left_semi").join(ok.withColumn("answered", F.lit(True)), "id", "left").withColumn("answered", F.coalesce("answered", F.lit(False)))


def assemble_run(mentions: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers beside their mentions: string ids, normal gold, the answer's fields; mentions without an answer become ERROR."""
    got = answers.select(F.col("id").cast("string").alias("id"), *[c for c in KEPT if c in answers.columns]).withColumnRenamed("qid", "_qid")
    rows = mentions.withColumn("id", F.col("id").cast("string")).drop(*[c for c in KEPT if c in answers.columns and c != "qid"])
    return rows.join(got, "id", "left").withColumn("gold", norm_gold(F.col("gold"))).withColumn("qid", F.coalesce("_qid", F.lit("ERROR"))).drop("_qid")
