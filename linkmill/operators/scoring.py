"""Scores of systems' answers: per run, paired on the mentions that all runs answered, and by cause.

A *run table* has one row per run and mention (:data:`linkmill.schemas.RUN` with ``run`` and ``ord``, the row's place in
its file). ``qid`` is ``ERROR`` where a system failed; such rows are never scored. Labels are ``id, accepted``; a mention
without a label row is judged by its own ``gold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import bootstrap_ci, exact_sign_p, ratio
from ..functions.text import mention_script, split_run_tag

CHECKED = ("fired", "fired_first", "changed_answer", "fixed", "broken", "kept_right", "still_wrong")


def _answered(runs: DataFrame) -> DataFrame:
    return runs.withColumn("id", F.col("id").cast("string")).filter("qid <> 'ERROR'")


def _without(runs: DataFrame, exclude: DataFrame | None) -> DataFrame:
    return runs if exclude is None else runs.join(exclude.select(F.col("id").cast("string")).distinct(), "id", "left_anti")


def run_metrics(runs: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Counts and measures per run; rows are not deduplicated."""
    return _measures(runs.groupBy(*by), by)


def metrics_by(runs: DataFrame, key: str) -> DataFrame:
    """The same per run and value of ``key`` (missing or empty: ``-``), and over all of them as ``ALL``; one pass."""
    rows = runs.withColumn("group", F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit("-")))
    sets = rows.groupingSets([["run", "group"], ["run"]], "run", "group")
    got = _measures(sets, ("run", "group", "_all"), F.grouping("group").alias("_all"))
    return got.withColumn("group", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("group"))).drop("_all")


def _measures(groups, by: tuple[str, ...], *more: Column) -> DataFrame:
    live = F.col("qid") != "ERROR"
    right, first = F.col("qid") == F.col("gold"), F.coalesce(F.col("initial_qid") == F.col("gold"), F.lit(False))
    inside = (F.col("gold") != "NIL") & F.coalesce(F.array_contains("candidates", F.col("gold")), F.lit(False))
    flagged = F.coalesce("flagged", F.lit(False))
    n_if = lambda name, c: F.count_if(live & c).alias(name)
    out = groups.agg(
        *more, F.count_if(live).alias("n"), n_if("n_right", right), n_if("n_initial_right", first),
        n_if("fixed", ~first & right), n_if("broken", first & ~right),
        n_if("n_non_nil", F.col("gold") != "NIL"), n_if("n_non_nil_right", (F.col("gold") != "NIL") & right),
        n_if("n_in_candidates", inside), n_if("n_in_candidates_right", inside & right),
        n_if("n_said_nil", F.col("qid") == "NIL"), n_if("n_gold_nil", F.col("gold") == "NIL"), n_if("n_nil_right", right & (F.col("gold") == "NIL")),
        n_if("n_flagged", flagged), n_if("n_flagged_right", flagged & right),
        F.sum(F.when(live, F.coalesce("llm_calls", F.lit(0.0)))).alias("calls"), F.sum(F.when(live, F.coalesce("seconds", F.lit(0.0)))).alias("secs"),
        F.count_if(~live).alias("errors"))
    return out.select(
        *by, "n", "n_right", "n_initial_right", "fixed", "broken", "n_non_nil", "n_in_candidates", "n_said_nil", "n_gold_nil", "n_nil_right", "n_flagged", "errors",
        ratio("n_right", "n").alias("accuracy"), ratio("n_initial_right", "n").alias("initial_accuracy"),
        exact_sign_p("fixed", "broken").alias("sign_test_p"),
        ratio("n_non_nil_right", "n_non_nil").alias("acc_non_nil"), ratio("n_in_candidates", "n_non_nil").alias("candidate_recall"),
        ratio("n_in_candidates_right", "n_in_candidates").alias("acc_when_gold_in_candidates"),
        ratio("n_nil_right", "n_said_nil").alias("nil_precision"), ratio("n_nil_right", "n_gold_nil").alias("nil_recall"),
        ratio("n_flagged", "n").alias("flagged_rate"),
        ratio(F.col("n_right") - F.col("n_flagged_right"), F.col("n") - F.col("n_flagged")).alias("acc_unflagged"),
        ratio("n_flagged_right", "n_flagged").alias("acc_flagged"),
        ratio("calls", "n").alias("avg_llm_calls"), ratio("secs", "n").alias("avg_seconds"))


def answered_by_all(runs: DataFrame, exclude: DataFrame | None = None, min_coverage: float = 0.9, by: tuple[str, ...] = (), ref: str | None = None) -> DataFrame:
    """The last answer of each run to each mention that every sufficiently complete run answered, with ``ref_run``.

    Runs with fewer answered mentions than ``min_coverage`` of the largest run's drop out first. All of it happens inside
    each value of ``by``. Rows are dealt out by mention once; deduplication, intersection and pairing reuse that. The table of
    complete runs, a row a run and value, goes to all tasks: a join by run would give a task all rows of one run.
    ``ref_run`` is ``ref``, or the first remaining run by name where ``ref`` is missing.
    """
    rows = _complete(runs, min_coverage, by, ref).filter("_have = _runs")
    return _without(rows.drop("_have", "_runs"), exclude)


def _complete(runs: DataFrame, min_coverage: float, by: tuple[str, ...] = (), ref: str | None = None) -> DataFrame:
    """The last answers of complete runs, with the number of runs that answered the mention (``_have``) and of all (``_runs``)."""
    last = W.partitionBy(*by, "id", "run").orderBy(F.col("ord").desc())
    rows = _answered(runs).repartition("id").withColumn("_nth", F.row_number().over(last)).filter("_nth = 1").drop("_nth")
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    kept = rows.groupBy(*by, "run").count().withColumn("_top", F.max("count").over(group)).filter(F.col("count") >= min_coverage * F.col("_top"))
    kept = kept.select(*by, "run", F.count("*").over(group).alias("_runs"), F.coalesce(F.max(F.when(F.col("run") == ref, F.col("run"))).over(group), F.min("run").over(group)).alias("ref_run"))
    return rows.join(F.broadcast(kept), [*by, "run"]).withColumn("_have", F.count("*").over(W.partitionBy(*by, "id")))


def common_mentions(runs: DataFrame, exclude: DataFrame | None = None, min_coverage: float = 0.9) -> DataFrame:
    """``id`` of the mentions that every sufficiently complete run answered."""
    return answered_by_all(runs, exclude, min_coverage).select("id").distinct()


def common_mention_counts(runs: DataFrame, exclude: DataFrame | None = None, min_coverage: float = 0.9) -> DataFrame:
    """One row: ``n_runs`` compared, ``n_union`` mentions that any of them answered, ``n_common`` of those compared, ``n_dropped`` of those not."""
    ids = _complete(runs, min_coverage).groupBy("id").agg(F.max("_runs").alias("_runs"), F.max("_have").alias("_have")).withColumn("_in", F.col("_have") == F.col("_runs"))
    if exclude is not None:
        ids = ids.join(exclude.select(F.col("id").cast("string"), F.lit(True).alias("_out")).distinct(), "id", "left").withColumn("_in", F.col("_in") & F.col("_out").isNull())
    got = ids.agg(F.coalesce(F.max("_runs"), F.lit(0)).alias("n_runs"), F.count("*").alias("n_union"), F.count_if("_in").alias("n_common"))
    return got.withColumn("n_dropped", F.col("n_union") - F.col("n_common"))


def answer_correctness(runs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Adds ``ok`` and ``init_ok``. An empty accepted set makes every answer wrong; a missing row leaves it to ``gold``."""
    runs = runs.withColumn("id", F.col("id").cast("string"))
    if labels is None:
        rows, accepted = runs, F.lit(None).cast("array<string>")
    else:
        rows = runs.join(labels.filter("accepted IS NOT NULL").select(F.col("id").cast("string").alias("_label"), F.col("accepted").alias("_accepted")), F.col("id") == F.col("_label"), "left")
        accepted = F.col("_accepted")
    good = lambda c: F.coalesce(F.when(accepted.isNotNull(), F.array_contains(accepted, F.col(c))).otherwise(F.col(c) == F.col("gold")), F.lit(False))
    return rows.withColumns({"ok": good("qid"), "init_ok": good("initial_qid")}).drop("_label", "_accepted")


def _paired_counts(runs: DataFrame, ref, labels, exclude, min_coverage, by) -> DataFrame:
    rows = answer_correctness(answered_by_all(runs, exclude, min_coverage, by, ref), labels)
    rows = rows.withColumn("ref_ok", F.max(F.when(F.col("run") == F.col("ref_run"), F.col("ok"))).over(W.partitionBy(*by, "id")))
    return rows.groupBy(*by, "run").agg(
        F.count("*").alias("n"), F.count_if("ok").alias("n_right"), F.count_if("init_ok").alias("n_initial_right"),
        F.count_if(~F.col("init_ok") & F.col("ok")).alias("fixed"), F.count_if(F.col("init_ok") & ~F.col("ok")).alias("broken"),
        F.count_if(F.col("ok") & ~F.col("ref_ok")).alias("wins"), F.count_if(~F.col("ok") & F.col("ref_ok")).alias("losses"),
        F.sum(F.coalesce("llm_calls", F.lit(0.0))).alias("calls"), F.first("ref_run").alias("ref_run"))


def paired_table(runs: DataFrame, ref: str | None = None, labels: DataFrame | None = None, exclude: DataFrame | None = None, n_boot: int = 2000, seed: int = 13, min_coverage: float = 0.9, by: tuple[str, ...] = ()) -> DataFrame:
    """Per run, on the mentions of :func:`answered_by_all`: accuracy, changes, and wins and losses against ``ref``."""
    got = _paired_counts(runs, ref, labels, exclude, min_coverage, by).withColumn("_ci", bootstrap_ci(n_boot, seed)("wins", "losses", "n"))
    return got.select(
        *by, "run", "n", "n_right", "n_initial_right", "fixed", "broken", "wins", "losses",
        ratio("n_right", "n").alias("accuracy"), ratio("n_initial_right", "n").alias("initial_accuracy"),
        exact_sign_p("fixed", "broken").alias("sign_test_p"), exact_sign_p("wins", "losses").alias("p_vs_ref"),
        F.col("_ci.low").alias("diff_low"), F.col("_ci.high").alias("diff_high"), ratio("calls", "n").alias("avg_llm_calls"))


def paired_by(runs: DataFrame, key: str, ref: str | None = None, labels: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """The comparison inside every value of ``key``; missing and empty values are left out."""
    rows = runs.withColumn("group", F.col(key).cast("string")).filter("group <> ''")
    got = _paired_counts(rows, ref, labels, exclude, 0.9, ("group",))
    return got.select("group", "run", "n", "n_right", "n_initial_right", "fixed", "broken", ratio("n_right", "n").alias("accuracy"), ratio("n_initial_right", "n").alias("initial_accuracy"))


def by_script(runs: DataFrame, ref: str | None = None, labels: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    return paired_by(runs.withColumn("_script", mention_script(F.col("mention"))), "_script", ref, labels, exclude)


def within_run(runs: DataFrame, labels: DataFrame | None = None, exclude: DataFrame | None = None, prefix: str = "^(full|grounded|critic)") -> DataFrame:
    """Runs whose name matches ``prefix``, each on its own mentions."""
    last = W.partitionBy("run", "id").orderBy(F.col("ord").desc())
    rows = _without(_answered(runs.filter(F.col("run").rlike(prefix))), exclude).withColumn("_nth", F.row_number().over(last)).filter("_nth = 1")
    got = answer_correctness(rows, labels).groupBy("run").agg(
        F.count("*").alias("n"), F.count_if("ok").alias("n_right"), F.count_if("init_ok").alias("n_initial_right"),
        F.count_if(~F.col("init_ok") & F.col("ok")).alias("fixed"), F.count_if(F.col("init_ok") & ~F.col("ok")).alias("broken"))
    return got.select("*", ratio("n_right", "n").alias("accuracy"), ratio("n_initial_right", "n").alias("initial_accuracy"), exact_sign_p("fixed", "broken").alias("sign_test_p"))


def llm_only_spread(runs: DataFrame, labels: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """``run, value``: the initial accuracy of each run without a tag or with a repeat tag, then count, mean, sd and quartiles over them."""
    main = runs.filter(split_run_tag(F.col("run"))["main"])
    per = _paired_counts(main, None, labels, exclude, 0.9, ()).select("run", F.bround(F.col("n_initial_right") / F.col("n"), 4).alias("value"))
    stats = per.agg(
        F.count("*").cast("double").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        *[F.percentile("value", F.lit(p)).alias(f"{int(100 * p)}%") for p in (0.25, 0.5, 0.75)], F.max("value").alias("max"))
    names = stats.columns
    return per.unionByName(stats.select(F.inline(F.array(*[F.struct(F.lit(c).alias("run"), F.col(f"`{c}`").alias("value")) for c in names]))))


def multi_run_summary(runs: DataFrame, ref: str, labels: DataFrame | None = None, exclude: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs named ``system`` or ``system@tag``: a row per system and tag, then means and spreads per system.

    Every tag is compared inside itself, against the tag's own run of the reference system (null where it has none).
    """
    tagged = runs.withColumns({"tag": F.coalesce(split_run_tag(F.col("run"))["tag"], F.lit("(first)")), "run": split_run_tag(F.col("run"))["config"]})
    got = _paired_counts(tagged, ref, labels, exclude, 0.9, ("tag",))
    acc = ratio("n_right", "n")
    per = got.withColumn("accuracy", acc).withColumn("_ref", F.max(F.when(F.col("run") == ref, F.col("accuracy"))).over(W.partitionBy("tag")))
    per = per.select(F.col("run").alias("system"), "tag", "n", "accuracy", ratio("n_initial_right", "n").alias("initial_accuracy"), "fixed", "broken", "wins", "losses",
                     exact_sign_p("fixed", "broken").alias("sign_test_p"), exact_sign_p("wins", "losses").alias("p_vs_ref"), ratio("calls", "n").alias("avg_llm_calls"), (F.col("accuracy") - F.col("_ref")).alias("diff_vs_ref"))
    four = lambda c, name: F.bround(c, 4).alias(name)
    total = per.groupBy("system").agg(
        F.count("*").alias("runs"), four(F.avg("accuracy"), "acc_mean"), four(F.stddev_samp("accuracy"), "acc_sd"), four(F.min("accuracy"), "acc_min"), four(F.max("accuracy"), "acc_max"),
        four(F.avg("diff_vs_ref"), "diff_vs_ref_mean"), four(F.stddev_samp("diff_vs_ref"), "diff_vs_ref_sd"), F.sum("fixed").alias("fixed_total"), F.sum("broken").alias("broken_total"), four(F.avg("avg_llm_calls"), "calls"))
    return per, total


def fired_checks(trace: Column) -> Column:
    """The different checks of all verification steps, in the order in which they fired first."""
    steps = F.filter(trace, lambda t: t["step"] == "verify")
    return F.array_distinct(F.flatten(F.transform(steps, lambda t: F.transform(t["issues"], lambda i: i["check"]))))


def check_attribution(runs: DataFrame, labels: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Per run and check: how often it fired, and what became of those mentions; a check counts once a mention."""
    rows = answer_correctness(_without(_answered(runs), exclude), labels)
    rows = rows.select("run", "ok", "init_ok", (~F.col("qid").eqNullSafe(F.col("initial_qid"))).alias("changed"), F.posexplode(fired_checks(F.col("trace"))).alias("pos", "check"))
    ok, init = F.col("ok"), F.col("init_ok")
    conditions = dict(zip(CHECKED, (F.lit(True), F.col("pos") == 0, F.col("changed"), ~init & ok, init & ~ok, init & ok, ~init & ~ok), strict=True))
    got = rows.groupBy("run", "check").agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])
    return got.select("*", ratio("fixed", "fired", 3).alias("fix_rate"), ratio("broken", "fired", 3).alias("break_rate"))


PATTERNS = ("all three agree", "gold = agent ≠ search", "gold = search ≠ agent", "agent = search ≠ gold", "all differ")


def gold_source_check(agent: DataFrame, search: DataFrame) -> DataFrame:
    """``pattern, mentions``: who agrees with whom; patterns without mentions are kept."""
    last = W.partitionBy("id").orderBy(F.col("ord").desc())
    other = _answered(search).withColumn("_nth", F.row_number().over(last)).filter("_nth = 1").select("id", F.col("qid").alias("_search"))
    g, a, b = F.col("gold"), F.col("qid"), F.col("_search")
    kind = F.when((a == g) & (g == b), PATTERNS[0]).when((g == b) & (b != a), PATTERNS[2]).when((g == a) & (a != b), PATTERNS[1]).when((a == b) & (b != g), PATTERNS[3]).otherwise(PATTERNS[4])
    found = _answered(agent).join(other, "id").groupBy(kind.alias("pattern")).agg(F.count("*").alias("mentions"))
    return found.unionByName(_listed(agent, PATTERNS)).groupBy("pattern").agg(F.sum("mentions").alias("mentions"))


def _listed(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("pattern"), F.lit(0).cast("long").alias("mentions"))


def answer_changes(runs: DataFrame, labels: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Every repair and break: ``run, id, mention, gold, initial, final, accepted, change, kind``."""
    rows = answer_correctness(_without(_answered(runs), exclude), labels).filter("ok <> init_ok")
    if labels is not None:
        rows = rows.join(labels.select("id", F.array_join(F.array_sort("accepted"), "|").alias("accepted")), "id", "left")
    else:
        rows = rows.withColumn("accepted", F.lit(None).cast("string"))
    side = lambda c: F.when(F.col(c) == "NIL", "NIL").otherwise("QID")
    return rows.select(
        "run", "id", "mention", "gold", F.col("initial_qid").alias("initial"), F.col("qid").alias("final"), F.coalesce("accepted", "gold").alias("accepted"),
        F.when(F.col("ok"), "fixed").otherwise("broken").alias("change"), F.concat(side("initial_qid"), F.lit("→"), side("qid")).alias("kind"))


def nil_rule_analysis(runs: DataFrame, labels: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Mentions whose trace has a NIL issue: the answer against the first candidate that the issue names."""
    steps = F.filter("trace", lambda t: t["step"] == "verify")
    issues = F.flatten(F.transform(steps, lambda t: F.transform(t["issues"], lambda i: F.struct(i["check"].alias("check"), i["msg"].alias("msg")))))
    first = F.get(F.filter(issues, lambda i: i["check"] == "NIL"), 0)
    rows = _without(_answered(runs), exclude).withColumn("_nil", first).filter("_nil IS NOT NULL")
    rows = rows.withColumn("_named", F.regexp_extract_all(F.coalesce("_nil.msg", F.lit("")), F.lit(r"\b(Q\p{Nd}+)\b"), F.lit(1)))
    rows = rows.withColumn("rule", F.coalesce(F.get("_named", 0), F.lit("NIL")))
    rows = answer_correctness(rows, labels).withColumnRenamed("ok", "agent_right").drop("init_ok")
    rows = answer_correctness(rows.withColumnsRenamed({"qid": "final", "rule": "qid"}), labels).drop("init_ok")
    return rows.select("run", "id", "mention", "gold", F.col("initial_qid").alias("initial"), "final", F.col("qid").alias("rule"), F.array_join("_named", "|").alias("exact_matches"),
                       (F.col("final") == "NIL").alias("agent_kept_nil"), "agent_right", F.col("ok").alias("rule_right"), (F.col("final") == F.col("qid")).alias("same_answer"))


def nil_rule_summary(cases: DataFrame) -> DataFrame:
    """One row per run with the counts of :func:`nil_rule_analysis` and the exact sign test of agent against rule."""
    kept, agent, rule = F.col("agent_kept_nil"), F.col("agent_right"), F.col("rule_right")
    got = cases.groupBy("run").agg(
        F.count("*").alias("fired"), F.count_if(kept).alias("kept"), F.count_if(kept & agent & ~rule).alias("kept_nil_right"), F.count_if(kept & ~agent & rule).alias("kept_rule_right"),
        F.count_if(kept & ~agent & ~rule).alias("kept_both_wrong"), F.count_if(kept & agent & rule).alias("kept_both_right"), F.count_if(~kept).alias("switched"),
        F.count_if(~kept & F.col("same_answer")).alias("switched_to_rule"), F.count_if(agent).alias("agent_right"), F.count_if(rule).alias("rule_right"),
        F.count_if(agent & ~rule).alias("agent_only"), F.count_if(rule & ~agent).alias("rule_only"))
    return got.withColumn("sign_p", exact_sign_p("agent_only", "rule_only"))


def unseen_initial(runs: DataFrame, review: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Per run: repairs and breaks, and how many rest on an initial answer that reviewers never saw, or on an unreviewed mention.

    ``labels`` default to those of the sheet; its unclear mentions are left out.
    """
    from .review import pooled_labels

    labels = pooled_labels(review) if labels is None else labels
    shown = review.select("id", F.split("options", r"\|").alias("_shown"))
    rows = _without(_answered(runs), labels.filter("unclear")).filter("initial_qid IS NOT NULL AND initial_qid <> qid")
    rows = answer_correctness(rows, labels.filter("NOT unclear")).filter("ok <> init_ok").join(shown, "id", "left")
    seen = F.array_contains("_shown", F.col("initial_qid"))
    parts = []
    for kind, c in (("fixed", F.col("ok")), ("broken", ~F.col("ok"))):
        parts += [F.count_if(c).alias(kind), F.count_if(c & F.col("_shown").isNotNull() & ~seen).alias(f"{kind}_unseen_initial"), F.count_if(c & F.col("_shown").isNull()).alias(f"{kind}_not_reviewed")]
    return rows.groupBy("run").agg(*parts)


def error_summary(runs: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` commonest failure messages of each run (their first 160 characters)."""
    found = runs.filter("qid = 'ERROR'").groupBy("run", F.substring(F.coalesce("reason", F.lit("")), 1, 160).alias("message")).agg(F.count("*").alias("mentions"))
    order = W.partitionBy("run").orderBy(F.col("mentions").desc(), "message")
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)


def errors_table(runs: DataFrame, entities: DataFrame, others: list[str]) -> DataFrame:
    """Every disagreement with gold, with names of both entities, the checks fired, and what the runs ``others`` answered."""
    info = entities.select("qid", F.coalesce("label_ar", "label_en", "label_fr", F.lit("")).alias("label"), F.coalesce("desc_en", "desc_ar", F.lit("")).alias("desc"))
    side = lambda p: info.select(F.col("qid").alias(p), F.col("label").alias(f"{p}_label"), F.col("desc").alias(f"{p}_desc"))
    bad = runs.filter("qid <> 'ERROR' AND qid <> gold").withColumnRenamed("qid", "agent").withColumn("id", F.col("id").cast("string"))
    bad = bad.join(side("gold"), "gold", "left").join(side("agent"), "agent", "left")
    wide = runs.filter(F.col("run").isin(others)).groupBy(F.col("id").cast("string").alias("id")).pivot("run", others).agg(F.max("qid"))
    steps = F.filter("trace", lambda t: t["step"] == "verify")
    checks = F.array_join(F.flatten(F.transform(steps, lambda t: F.transform(t["issues"], lambda i: i["check"]))), ",")
    named = lambda p: [F.coalesce(c, F.lit("")).alias(c) for c in (f"{p}_label", f"{p}_desc")]
    return bad.join(wide, "id", "left").select(
        "run", "id", "mention", "type", "gold", *named("gold"), "agent", *named("agent"), F.col("initial_qid").alias("initial"), "flagged",
        F.coalesce(F.array_contains("candidates", F.col("gold")), F.lit(False)).alias("gold_in_candidates"), F.coalesce(checks, F.lit("")).alias("checks_fired"),
        F.col("reason").alias("agent_reason"), *[F.coalesce(f"`{o}`", F.lit("")).alias(o) for o in others], "category")
