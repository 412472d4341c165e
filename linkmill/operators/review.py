"""Review sheets, agreement of annotators, and corrected labels.

Sheets are string tables (:data:`linkmill.schemas.POOLED_REVIEW`, :data:`linkmill.schemas.SINGLE_REVIEW`) in which empty
cells are empty strings and sets are joined by ``|``. Random choices follow a hash of seed and id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import ratio, wilson_interval
from ..functions.text import norm_gold
from .corpus import draw
from .scoring import _answered, answered_by_all, paired_table

# Names of groups, verdicts and statuses in the sheets.
GROUPS = ("1 gold NIL, agent linked", "2 agent = search ≠ gold", "3 gold = search ≠ agent", "4 agent NIL, gold linked", "5 other disagreement", "9 audit: gold = agent")
OLD_VERDICTS = {"agent_wrong": "gold", "gold_wrong": "agent", "both_ok": "gold+agent"}
POOL_GROUPS = ("gold NIL", "disagreement", "audit")


def split_set(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(F.coalesce(col, F.lit("")), r"\|"), lambda x: x != "")


def _gold(sources: Column | str = "sources") -> Column:
    return F.get_json_object(sources, "$.gold")


def _accepted(verdict: Column) -> Column:
    """The accepted items that a verdict of the single-run sheet means; null for no verdict, an unclear or an unknown one."""
    other = F.upper(F.trim("correct_qid"))
    one = lambda *c: F.array_sort(F.array_distinct(F.array(*c)))
    return (F.when(verdict == "gold", one("gold")).when(verdict == "agent", one("agent")).when(verdict == "search", one("search")).when(verdict == "gold+agent", one("gold", "agent"))
            .when(verdict == "none", F.when(other != "", F.array(other)).otherwise(F.array().cast("array<string>"))))


def _verdict() -> Column:
    v = F.trim("verdict")
    names = F.create_map(*[F.lit(x) for pair in OLD_VERDICTS.items() for x in pair])
    return F.coalesce(F.element_at(names, v), v)


def pooled_labels(review: DataFrame) -> DataFrame:
    """``id, accepted, unclear`` of judged rows; an empty set means that no answer is right."""
    return review.filter(F.col("status").isin("done", "unclear")).select(
        "id", F.when(F.col("status") == "done", F.array_sort(F.array_distinct(split_set("accepted")))).alias("accepted"), (F.col("status") == "unclear").alias("unclear"))


def pooled_summary(review: DataFrame) -> DataFrame:
    """Per group: rows, reviewed, wrong gold labels, their share and its Wilson interval; groups without rows are kept."""
    done = F.col("status") == "done"
    wrong = done & ~F.coalesce(F.array_contains(split_set("accepted"), _gold()), F.lit(False))
    got = review.filter(F.col("group").isin(*POOL_GROUPS)).groupBy("group").agg(F.count("*").alias("rows"), F.count_if(done).alias("reviewed"), F.count_if(wrong).alias("gold_wrong"))
    zero = review.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, POOL_GROUPS))).alias("group"), *[F.lit(0).cast("long").alias(c) for c in ("rows", "reviewed", "gold_wrong")])
    return _with_rate(got.unionByName(zero).groupBy("group").agg(*[F.sum(c).alias(c) for c in ("rows", "reviewed", "gold_wrong")]))


def _with_rate(df: DataFrame) -> DataFrame:
    ci = wilson_interval("gold_wrong", "reviewed")
    return df.select("*", ratio("gold_wrong", "reviewed").alias("rate"), ci["low"].alias("low"), ci["high"].alias("high"))


def reviewed_labels(review: DataFrame) -> DataFrame:
    """The same labels from a single-run sheet; unknown verdicts are ignored."""
    rows = review.withColumn("_v", _verdict()).withColumn("accepted", _accepted(F.col("_v")))
    return rows.filter("_v = 'unclear' OR accepted IS NOT NULL").select("id", "accepted", (F.col("_v") == "unclear").alias("unclear"))


def reviewed_summary(review: DataFrame) -> DataFrame:
    """One row of counts of a single-run sheet, and two rates."""
    rows = review.withColumn("_v", _verdict()).withColumn("_a", _accepted(F.col("_v")))
    audit, judged = F.startswith("group", F.lit("9")), F.col("_a").isNotNull()
    right, many = F.coalesce(F.array_contains("_a", F.col("gold")), F.lit(False)), F.size("_a") > 1
    got = rows.agg(
        F.count_if(~audit).alias("disagreements"), F.count_if(~audit & judged).alias("reviewed"), F.count_if(~audit & judged & right & ~many).alias("gold_right"),
        F.count_if(~audit & judged & ~right).alias("gold_wrong"), F.count_if(~audit & judged & right & many).alias("both_acceptable"), F.count_if(~audit & (F.col("_v") == "unclear")).alias("unclear"),
        F.count_if(audit & judged).alias("audit_reviewed"), F.count_if(audit & judged & ~right).alias("audit_wrong"))
    return got.select("*", ratio("gold_wrong", "reviewed").alias("gold_wrong_rate"), ratio("audit_wrong", "audit_reviewed").alias("audit_error_rate"))


def rescore(runs: DataFrame, review: DataFrame, ref: str | None = None, n_boot: int = 2000, pooled: bool = True) -> tuple[DataFrame, DataFrame]:
    """The paired comparison under reviewed labels, unclear mentions left out; and one row with the number of unreviewed mentions."""
    labels = pooled_labels(review) if pooled else reviewed_labels(review)
    rows = review if pooled else review.filter(~F.startswith("group", F.lit("9")))
    left = rows.join(labels, "id", "left_anti").agg(F.count("*").alias("unreviewed"))
    return paired_table(runs, ref, labels.filter("NOT unclear"), labels.filter("unclear"), n_boot), left


def label_review(review: DataFrame, dates: DataFrame) -> DataFrame:
    """Judged and wrong labels of NIL dates, other NIL, other disagreements and the audit; and all but dates and audit."""
    rows = review.filter("status = 'done'").join(dates.select("id").distinct().withColumn("_date", F.lit(True)), "id", "left")
    nil = _gold() == "NIL"
    kind = F.when(F.col("group") == "audit", "audit of agreements").when(nil & F.coalesce("_date", F.lit(False)), "dates labelled NIL").when(nil, "other NIL").otherwise("other disagreements")
    wrong = ~F.coalesce(F.array_contains(split_set("accepted"), _gold()), F.lit(False))
    got = rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("reviewed"), F.count_if(wrong).alias("gold_wrong"))
    total = got.filter("kind IN ('other NIL', 'other disagreements')").agg(F.lit("all without dates").alias("kind"), F.sum("reviewed").alias("reviewed"), F.sum("gold_wrong").alias("gold_wrong"))
    return _with_rate(got.unionByName(total))


def agreement_sample(review: DataFrame, n: int = 60, seed: int = 7) -> DataFrame:
    """``n`` judged rows with blank verdicts, for a second annotator."""
    blank = {c: F.lit("") for c in ("status", "accepted", "annotator", "carried")}
    return review.filter("status = 'done'").orderBy(draw(seed, "id"), "id").limit(n).withColumns(blank)


def annotator_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows that both judged, share of equal sets, judgements of options, observed agreement, Cohen's kappa."""
    side = lambda df, s: df.filter("status = 'done'").select("id", F.array_sort(F.array_distinct(split_set("accepted"))).alias(s), *([split_set("options").alias("o")] if s == "sa" else []))
    rows = side(a, "sa").join(side(b, "sb"), "id")
    judged = rows.select("id", "sa", "sb", F.explode_outer(F.array_union(F.array_union("o", "sa"), "sb")).alias("q"))
    x, y = F.array_contains("sa", F.col("q")), F.array_contains("sb", F.col("q"))
    per = judged.groupBy("id").agg(F.first(F.col("sa") == F.col("sb")).alias("same"), F.count("q").alias("n"), F.count_if(x == y).alias("eq"), F.count_if(x).alias("na"), F.count_if(y).alias("nb"))
    got = per.agg(F.count("*").alias("rows"), F.count_if("same").alias("exact"), F.sum("n").alias("judgements"), F.sum("eq").alias("equal"), F.sum("na").alias("yes_a"), F.sum("nb").alias("yes_b"))
    n = F.col("judgements")
    po, pa, pb = F.col("equal") / n, F.col("yes_a") / n, F.col("yes_b") / n
    pe = pa * pb + (1 - pa) * (1 - pb)
    return got.select("*", ratio("exact", "rows").alias("exact_agreement"), ratio("equal", "judgements").alias("observed_agreement"), F.bround(F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(F.when(n > 0, 1.0)), 4).alias("cohen_kappa"))


def corrected_dataset(rows: DataFrame, review: DataFrame, include_text: bool = True) -> DataFrame:
    """Mention rows with the original and the corrected labels and how they came about; unclear ones have none."""
    labels = pooled_labels(review).select(F.col("id").alias("_id"), "accepted", "unclear")
    sheet = review.select(F.col("id").alias("_rid"), F.col("group").alias("_group"), F.col("annotator").alias("_annotator"))
    m = rows.withColumns({"id": F.col("id").cast("string"), "gold_original": norm_gold(F.col("gold"))})
    m = m.join(sheet, F.col("id") == F.col("_rid"), "left").join(labels, F.col("id") == F.col("_id"), "left")
    ok = F.array_contains("accepted", F.col("gold_original"))
    status = (F.when(F.col("unclear"), "unclear").when(F.col("accepted").isNotNull() & ~ok, "corrected").when(F.col("accepted").isNotNull() & (F.col("_group") == "audit"), "audited_confirmed")
              .when(F.col("accepted").isNotNull(), F.when(F.size("accepted") == 1, "confirmed").otherwise("alternatives_acceptable")).when(F.col("_group").isNotNull(), "not_reviewed").otherwise("unreviewed_agreement"))
    return m.select(
        "id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), *(["text"] if include_text else []), "mention", "start", "end", "type", F.col("category").alias("popularity"), "sitelinks", "gold_original",
        F.when(F.coalesce("unclear", F.lit(False)), F.lit(None)).otherwise(F.coalesce("accepted", F.array("gold_original"))).alias("gold_corrected"), status.alias("label_status"),
        F.when(F.col("_id").isNotNull(), F.coalesce("_annotator", F.lit(""))).otherwise("").alias("annotator"), F.sha1(F.coalesce("text", F.lit(""))).alias("text_sha1"))


def corrected_labels(df: DataFrame) -> DataFrame:
    return df.select("id", F.col("gold_corrected").alias("accepted"), F.col("gold_corrected").isNull().alias("unclear"))


def restore_texts(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """Rows published without text, with ``text`` (null if not found or changed) and ``restored``; texts must have the stored hash.

    The corpus (``doc_id, text``) is first cut down to the wanted documents.
    """
    texts = corpus.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_t")).join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id", F.sha1("_t").alias("text_sha1")).agg(F.min("_t").alias("text"))
    return rows.drop("text").join(texts, ["doc_id", "text_sha1"], "left").withColumn("restored", F.col("text").isNotNull())


def nil_label_timing(review: DataFrame, revisions: DataFrame, cutoff: str) -> DataFrame:
    """Wrong NIL labels: when the accepted items were created, against ``cutoff`` (an ISO date)."""
    rows = review.filter("status = 'done'").withColumn("_a", split_set("accepted")).filter((_gold() == "NIL") & ~F.array_contains("_a", F.lit("NIL")))
    rows = rows.select("id", "mention", F.array_sort(F.filter("_a", lambda q: q.rlike(r"^Q\p{Nd}+$"))).alias("qids"))
    created = revisions.groupBy("qid").agg(F.min("ts").alias("ts"))
    dated = rows.select("id", "mention", F.array_join("qids", "|").alias("accepted"), F.explode_outer("qids").alias("qid")).join(created, "qid", "left")
    got = dated.groupBy("id", "mention", "accepted").agg(F.min("ts").alias("first"))
    day = F.date_format("first", "yyyy-MM-dd")
    status = F.when(F.col("accepted") == "", "no QID accepted").when(F.col("first").isNull(), "creation date unknown").when(day < cutoff, "item existed before cutoff").otherwise("item created after cutoff")
    return got.select("id", "mention", "accepted", F.coalesce(day, F.lit("")).alias("earliest"), status.alias("status"))


def _named(df: DataFrame, entities: DataFrame, column: str) -> DataFrame:
    info = entities.select(F.col("qid").alias(column), F.coalesce("label_ar", "label_en", "label_fr", F.lit("")).alias(f"{column}_label"), F.coalesce("desc_en", "desc_ar", F.lit("")).alias(f"{column}_desc"))
    return df.join(info, column, "left").fillna("", [f"{column}_label", f"{column}_desc"])


def review_sheet(run: DataFrame, entities: DataFrame, search: DataFrame | None = None, previous: DataFrame | None = None, audit: int = 40, seed: int = 13) -> DataFrame:
    """One run's disagreements in five groups, most telling first, and ``audit`` agreements; earlier verdicts are kept."""
    rows = _answered(run)
    if search is None:
        rows = rows.withColumn("search", F.lit(None).cast("string"))
    else:
        last = W.partitionBy("id").orderBy(F.col("ord").desc())
        found = _answered(search).withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("id", F.col("qid").alias("search"))
        rows = rows.join(found, "id", "left")
    g, a, b = F.col("gold"), F.col("qid"), F.col("search")
    group = F.when(a == g, GROUPS[5]).when(g == "NIL", GROUPS[0]).when(b.isNotNull() & (a == b), GROUPS[1]).when(b.isNotNull() & (g == b), GROUPS[2]).when(a == "NIL", GROUPS[3]).otherwise(GROUPS[4])
    rows = rows.withColumn("group", group)
    rows = rows.filter("qid <> gold").unionByName(rows.filter("qid = gold").orderBy(draw(seed, "id"), "id").limit(audit))
    steps = F.filter("trace", lambda t: t["step"] == "verify")
    rows = rows.withColumnRenamed("qid", "agent").withColumns({"search": F.coalesce("search", F.lit("")), "checks_fired": F.coalesce(F.array_join(F.flatten(F.transform(steps, lambda t: F.transform(t["issues"], lambda i: i["check"]))), ","), F.lit(""))})
    for column in ("gold", "agent", "search"):
        rows = _named(rows, entities, column)
    if previous is None:
        rows = rows.withColumns({c: F.lit("") for c in ("verdict", "correct_qid", "error_type")})
    else:
        rows = rows.join(previous.select("id", _verdict().alias("verdict"), "correct_qid", "error_type"), "id", "left").fillna("", ["verdict", "correct_qid", "error_type"])
    return rows.select(
        "id", "group", "text", "mention", "type", F.coalesce("category", F.lit("")).alias("category"), "gold", "gold_label", "gold_desc", "agent", "agent_label", "agent_desc", "search", "search_label", "search_desc",
        F.col("initial_qid").alias("initial"), "checks_fired", F.coalesce("reason", F.lit("")).alias("agent_reason"), "verdict", "correct_qid", "error_type").orderBy("group", "id")


def pooled_review(runs: DataFrame, entities: DataFrame | None = None, previous: DataFrame | None = None, carry_from: DataFrame | None = None, audit: int = 40, include_initial: bool = False, seed: int = 13, reopen_carried: bool = False) -> DataFrame:
    """The blind sheet: mentions on which any run differs from gold, and ``audit`` others on which none does.

    Options are the distinct answers in a hashed order. A verdict in ``previous`` stays if every option was shown then;
    else one of ``carry_from`` (a single-run sheet) is taken over under the same rule, else the row is open. Audit rows
    of ``previous`` come first when they still agree. ``reopen_carried`` opens rows whose verdict had been taken over.
    The gold and other fields come from the first run by name.
    """
    rows = answered_by_all(runs)
    initial = F.when(~F.coalesce(F.col("initial_qid").isin("", "ERROR"), F.lit(True)), F.array("initial_qid")).otherwise(F.array().cast("array<string>"))
    answers = F.concat(F.array("qid"), initial) if include_initial else F.array("qid")
    source = F.array(F.struct(F.col("run").alias("key"), F.col("qid").alias("value")))
    source = F.concat(source, F.array(F.struct(F.concat("run", F.lit("#initial")).alias("key"), F.col("initial_qid").alias("value")))) if include_initial else source
    top = F.min(F.struct("run", "gold", "text", "mention", "type", "category"))
    per = rows.groupBy("id").agg(top.alias("f"), F.array_distinct(F.flatten(F.collect_list(answers))).alias("said"), F.array_sort(F.flatten(F.collect_list(source))).alias("sources"))
    per = per.select("id", "f.gold", "f.text", "f.mention", "f.type", "f.category", "said", "sources")
    differs = F.exists("said", lambda a: a != F.col("gold"))
    agree = per.filter(~differs)
    if previous is not None:
        agree = agree.join(previous.filter("group = 'audit'").select("id", F.lit(0).alias("_first")), "id", "left")
    else:
        agree = agree.withColumn("_first", F.lit(None).cast("int"))
    picked = agree.orderBy(F.coalesce("_first", F.lit(1)), draw(seed, "id"), "id").limit(audit).drop("_first")
    pool = per.filter(differs).withColumn("group", F.when(F.col("gold") == "NIL", "gold NIL").otherwise("disagreement")).unionByName(picked.withColumn("group", F.lit("audit")))
    shuffled = F.array_sort(F.transform(F.array_union(F.array("gold"), "said"), lambda q: F.struct(F.md5(F.concat_ws("-", F.lit(str(seed)), "id", q)).alias("h"), q.alias("q"))))
    pool = pool.withColumn("_options", F.transform(shuffled, lambda x: x["q"]))
    none = F.lit(None)
    if previous is not None:
        before = previous.filter("status <> ''").select("id", F.col("status").alias("_ps"), F.col("accepted").alias("_pa"), F.col("annotator").alias("_pn"), F.col("carried").alias("_pc"), split_set("options").alias("_po"))
        if reopen_carried:
            before = before.filter("_pc <> 'yes'")
        pool = pool.join(before, "id", "left")
    else:
        pool = pool.withColumns({c: none.cast("string") for c in ("_ps", "_pa", "_pn", "_pc")} | {"_po": none.cast("array<string>")})
    if carry_from is not None:
        shown = F.filter(F.array("gold", "agent", "search", F.upper(F.trim("correct_qid"))), lambda x: x.isNotNull() & (x != ""))
        old = carry_from.withColumn("_v", _verdict()).withColumn("_acc", _accepted(F.col("_v"))).filter("_v = 'unclear' OR _acc IS NOT NULL")
        pool = pool.join(old.select("id", (F.col("_v") == "unclear").alias("_cu"), F.array_join(F.array_sort("_acc"), "|").alias("_ca"), shown.alias("_co")), "id", "left")
    else:
        pool = pool.withColumns({"_cu": none.cast("boolean"), "_ca": none.cast("string"), "_co": none.cast("array<string>")})
    covered = lambda c: F.coalesce(F.size(F.array_except("_options", c)) == 0, F.lit(False))
    stays = F.col("_ps").isNotNull() & covered("_po")
    taken = ~stays & F.col("_co").isNotNull() & covered("_co")
    pick = lambda kept, carried: F.when(stays, kept).when(taken, carried).otherwise("")
    pool = pool.select(
        "id", "group", "text", "mention", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("category", F.lit("")).alias("category"), F.array_join("_options", "|").alias("options"), F.col("_options"),
        F.to_json(F.map_from_entries(F.concat(F.array(F.struct(F.lit("gold").alias("key"), F.col("gold").alias("value"))), "sources"))).alias("sources"),
        pick(F.col("_ps"), F.when(F.col("_cu"), "unclear").otherwise("done")).alias("status"), pick(F.col("_pa"), F.when(F.col("_cu"), "").otherwise(F.col("_ca"))).alias("accepted"),
        pick(F.col("_pn"), F.lit("first_pass")).alias("annotator"), pick(F.col("_pc"), F.lit("yes")).alias("carried"))
    if entities is None:
        info = pool.withColumn("option_info", F.to_json(F.transform("_options", lambda q: F.array(q, F.lit(""), F.lit("")))))
    else:
        names = entities.select("qid", F.coalesce("label_ar", "label_en", "label_fr", F.lit("")).alias("label"), F.coalesce("desc_en", "desc_ar", F.lit("")).alias("desc"))
        each = pool.select("id", F.posexplode("_options").alias("pos", "qid")).join(names, "qid", "left").fillna("", ["label", "desc"])
        each = each.groupBy("id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("pos", "qid", "label", "desc"))), lambda x: F.array(x["qid"], x["label"], x["desc"]))).alias("option_info"))
        info = pool.join(each, "id", "left")
    return info.select("id", "group", "text", "mention", "type", "category", "options", "option_info", "sources", "status", "accepted", "annotator", "carried").orderBy(draw(seed, F.lit("sheet"), "id"), "id")
