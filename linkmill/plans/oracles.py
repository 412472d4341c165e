"""The queries of :mod:`.queries` in DuckDB SQL. Those that SQL can't express (files of odd forms, resampling, user code) have none."""

from __future__ import annotations

from ..functions import text as t
from ..operators.kb import FACTS
from . import bindings as b

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str, *views: str) -> None:
    ORACLES[name] = (f"WITH RECURSIVE {', '.join(views)} " if views else "") + sql


RUNS, CHECK, REVIEW, LABELS, SINGLE = b.RUN_SQL, b.CHECK_SQL, b.REVIEW_SQL, b.LABEL_SQL, b.SINGLE_SQL
KB, ASKED, CLASS, PAGE, MENTION = b.KB_SQL, b.ASKED_SQL, b.CLASS_SQL, b.PAGE_SQL, b.MENTION_SQL


def rate(a: str, b: str, digits: int = 4) -> str:
    """The ratio of two whole numbers, rounded half to even by integers alone; null over 0."""
    one, q, r = 10**digits, f"(({a}) * {10**digits} // ({b}))", f"(({a}) * {10**digits} % ({b}))"
    return f"CASE WHEN ({b}) <> 0 THEN ({q} + CASE WHEN 2 * {r} > ({b}) OR (2 * {r} = ({b}) AND {q} % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / {one} END"


def sign_p(x: str, y: str) -> str:
    """Two-sided exact binomial p at one half."""
    terms = f"list_transform(range(least({x}, {y}) + 1), lambda i: exp(lgamma({x} + {y} + 1) - lgamma(i + 1) - lgamma({x} + {y} - i + 1) - ({x} + {y}) * ln(2)))"
    return f"CASE WHEN {x} + {y} = 0 THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE, 2 * list_sum({terms})), 6) END"


def wilson(k: str, n: str) -> str:
    """``low, high`` of the 95 % interval of a share."""
    z, p = "(1.96::DOUBLE * 1.96::DOUBLE)", f"({k}::DOUBLE / {n})"
    d = f"(1 + {z} / {n})"
    h = f"1.96::DOUBLE * sqrt({p} * (1 - {p}) / {n} + {z} / (4::DOUBLE * {n} * {n})) / {d}"
    side = lambda f, s, edge: f"CASE WHEN {n} <> 0 THEN round_even({f}({edge}::DOUBLE, ({p} + {z} / (2::DOUBLE * {n})) / {d} {s} {h}), 4) END"
    return f"{side('greatest', '-', 0)} AS low, {side('least', '+', 1)} AS high"


def resampled(source: str, n_boot: int = 2000, seed: int = 13) -> list[str]:
    """``b_ci``: the percentile interval of wins less losses over n for each ``wins, losses, n`` of ``source``, as the library draws it."""
    spread = "(12 * sqrt({n} * {p} * (1 - {p})) + 12)"

    def table(name: str, rows: str) -> list[str]:
        """``name``: the distribution functions of ``rows`` (``key, n, p``), with a place before the first one."""
        s = spread.format(n="n", p="p")
        term = "exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(greatest(p, 1e-300)) + (n - k) * ln(greatest(1 - p, 1e-300)))"
        return [f"{name}_at AS (SELECT *, greatest(0, floor(n * p - {s}))::BIGINT AS lo, least(n, ceil(n * p + {s}))::BIGINT AS hi FROM ({rows}))",
                f"{name}_k AS (SELECT key, n, p, hi, unnest(range(lo, hi + 1)) AS k FROM {name}_at)",
                f"{name} AS (SELECT key, hi, k, sum(CASE WHEN p <= 0 THEN (CASE WHEN k = 0 THEN 1 ELSE 0 END) WHEN p >= 1 THEN (CASE WHEN k = n THEN 1 ELSE 0 END) ELSE {term} END) OVER (PARTITION BY key ORDER BY k) AS cdf FROM {name}_k UNION ALL SELECT key, hi, lo - 1, -1 FROM {name}_at)"]

    return [
        f"b_counts AS (SELECT DISTINCT wins, losses, n, concat(wins, '-', losses, '-', n) AS c FROM {source} WHERE n > 0)",
        f"b_hash AS (SELECT *, i, md5(concat('{seed}-', c, '-', i)) AS h FROM b_counts, range({n_boot}) t(i))",
        "b_draw AS (SELECT * EXCLUDE (h), ('0x' || substring(h, 1, 13))::BIGINT / 4503599627370496::DOUBLE AS u1, ('0x' || substring(h, 14, 13))::BIGINT / 4503599627370496::DOUBLE AS u2 FROM b_hash)",
        *table("b_one", "SELECT c AS key, n, (wins + losses)::DOUBLE / n AS p FROM b_counts"),
        "b_differ AS (SELECT d.*, least(o.k + 1, o.hi) AS differ FROM b_draw d ASOF JOIN b_one o ON d.c = o.key AND d.u1 >= o.cdf)",
        *table("b_two", "SELECT DISTINCT concat(c, '/', differ) AS key, differ AS n, CASE WHEN differ > 0 THEN wins::DOUBLE / (wins + losses) ELSE 0 END AS p FROM b_differ"),
        "b_won AS (SELECT d.*, least(o.k + 1, o.hi) AS won FROM b_differ d ASOF JOIN b_two o ON concat(d.c, '/', d.differ) = o.key AND d.u2 >= o.cdf)",
        f"b_ci AS (SELECT wins, losses, n, l[{int(0.025 * n_boot) + 1}]::DOUBLE / n AS low, l[{int(0.975 * n_boot)}]::DOUBLE / n AS high FROM (SELECT wins, losses, n, list_sort(list(2 * won - differ)) AS l FROM b_won GROUP BY ALL))"]


def common(source: str = "b_runs", by: str = "", exclude: str = "") -> str:
    """``b_common``: the answers of complete runs to mentions that all of them answered, inside each value of ``by``."""
    g = f"{by}, " if by else ""
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    return f"""b_size AS (SELECT {g}run, count(*) AS n FROM {source} WHERE qid <> 'ERROR' GROUP BY {g}run),
b_kept AS (SELECT *, count(*) {over} AS n_runs FROM (SELECT *, max(n) {over} AS top FROM b_size) WHERE n >= 0.9 * top),
b_in AS (SELECT a.*, k.n_runs FROM {source} a JOIN b_kept k ON a.run = k.run {f"AND a.{by} = k.{by}" if by else ""} WHERE a.qid <> 'ERROR'),
b_common AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {g}id) AS have FROM b_in) WHERE have = n_runs {exclude})"""


def judged(source: str, labels: bool) -> str:
    """``b_ok``: adds ``ok`` and ``init_ok``."""
    if not labels:
        return f"b_ok AS (SELECT *, qid = gold AS ok, coalesce(initial_qid = gold, false) AS init_ok FROM {source})"
    return f"""b_ok AS (SELECT s.*, CASE WHEN l.accepted IS NOT NULL THEN list_contains(l.accepted, s.qid) ELSE s.qid = s.gold END AS ok,
  CASE WHEN l.accepted IS NOT NULL THEN list_contains(l.accepted, s.initial_qid) ELSE s.initial_qid = s.gold END AS init_ok
  FROM {source} s LEFT JOIN (SELECT * FROM b_labels WHERE NOT unclear) l ON s.id = l.id)"""


_COUNTS = "count(*) AS n, count(*) FILTER (ok) AS n_right, count(*) FILTER (init_ok) AS n_initial_right, count(*) FILTER (NOT init_ok AND ok) AS fixed, count(*) FILTER (init_ok AND NOT ok) AS broken"
_ACCURACY = f"{rate('n_right', 'n')} AS accuracy, {rate('n_initial_right', 'n')} AS initial_accuracy"
_SIGN = f"{sign_p('fixed', 'broken')} AS sign_test_p"
_PAIRS = f"{_ACCURACY}, {_SIGN}, {sign_p('wins', 'losses')} AS p_vs_ref, {rate('calls', 'n')} AS avg_llm_calls"
_CALLS = "sum(llm_calls)::BIGINT AS calls"
_WINS = "count(*) FILTER (ok AND NOT ref_ok) AS wins, count(*) FILTER (NOT ok AND ref_ok) AS losses"


def referenced(by: str = "", ref: str = "alpha") -> str:
    g = f"{by}, " if by else ""
    r = f"coalesce(max(CASE WHEN run = '{ref}' THEN run END) OVER ({f'PARTITION BY {by}' if by else ''}), min(run) OVER ({f'PARTITION BY {by}' if by else ''}))"
    return f"b_ref AS (SELECT *, bool_or(CASE WHEN run = ref_run THEN ok END) OVER (PARTITION BY {g}id) AS ref_ok FROM (SELECT *, {r} AS ref_run FROM b_ok))"


_NOT_UNCLEAR = "AND id NOT IN (SELECT id FROM b_labels WHERE unclear)"
_live = "qid <> 'ERROR'"
_METRICS = f"""count(*) FILTER ({_live}) AS n, count(*) FILTER ({_live} AND qid = gold) AS n_right, count(*) FILTER ({_live} AND initial_qid = gold) AS n_initial_right,
 count(*) FILTER ({_live} AND initial_qid <> gold AND qid = gold) AS fixed, count(*) FILTER ({_live} AND initial_qid = gold AND qid <> gold) AS broken,
 count(*) FILTER ({_live} AND gold <> 'NIL') AS n_non_nil, count(*) FILTER ({_live} AND gold <> 'NIL' AND list_contains(candidates, gold)) AS n_in_candidates,
 count(*) FILTER (qid = 'NIL') AS n_said_nil, count(*) FILTER ({_live} AND gold = 'NIL') AS n_gold_nil, count(*) FILTER (qid = 'NIL' AND gold = 'NIL') AS n_nil_right,
 count(*) FILTER ({_live} AND flagged) AS n_flagged, count(*) FILTER (qid = 'ERROR') AS errors"""
_MORE = f"""count(*) FILTER ({_live} AND gold <> 'NIL' AND qid = gold) AS non_nil_right, count(*) FILTER ({_live} AND gold <> 'NIL' AND list_contains(candidates, gold) AND qid = gold) AS in_right,
 count(*) FILTER ({_live} AND flagged AND qid = gold) AS flagged_right, coalesce(sum(llm_calls) FILTER ({_live}), 0)::BIGINT AS calls, coalesce(sum(2 * seconds) FILTER ({_live}), 0)::BIGINT AS halves"""
_MEASURES = ", ".join(f"{rate(x, y)} AS {name}" for name, x, y in (
    ("acc_non_nil", "non_nil_right", "n_non_nil"), ("candidate_recall", "n_in_candidates", "n_non_nil"), ("acc_when_gold_in_candidates", "in_right", "n_in_candidates"), ("nil_precision", "n_nil_right", "n_said_nil"),
    ("nil_recall", "n_nil_right", "n_gold_nil"), ("flagged_rate", "n_flagged", "n"), ("acc_unflagged", "n_right - flagged_right", "n - n_flagged"), ("acc_flagged", "flagged_right", "n_flagged"), ("avg_llm_calls", "calls", "n"), ("avg_seconds", "halves", "2 * n")))
_MEASURED = f"SELECT * EXCLUDE (non_nil_right, in_right, flagged_right, calls, halves), {_ACCURACY}, {_SIGN}, {_MEASURES}"
oracle("run_metrics", f"{_MEASURED} FROM (SELECT run, {_METRICS}, {_MORE} FROM b_runs GROUP BY run)", RUNS)
oracle("metrics_by", f"{_MEASURED} FROM (SELECT run, CASE WHEN grouping(g) = 1 THEN 'ALL' ELSE g END AS \"group\", {_METRICS}, {_MORE} FROM (SELECT *, coalesce(nullif(category, ''), '-') AS g FROM b_runs) GROUP BY GROUPING SETS ((run, g), (run)))", RUNS)
oracle("common_mentions", "SELECT DISTINCT id FROM b_common", RUNS, common())
oracle("common_mention_counts", "SELECT *, n_union - n_common AS n_dropped FROM (SELECT (SELECT count(*) FROM b_kept) AS n_runs, (SELECT count(DISTINCT id) FROM b_in) AS n_union, (SELECT count(DISTINCT id) FROM b_common) AS n_common)", RUNS, REVIEW, LABELS, common(exclude=_NOT_UNCLEAR))
oracle("answer_correctness", "SELECT run, id, ok, init_ok FROM b_ok", RUNS, REVIEW, LABELS, judged("b_runs", True))
oracle("paired_table", f"SELECT * EXCLUDE (calls), {_PAIRS} FROM (SELECT run, {_COUNTS}, {_WINS}, {_CALLS} FROM b_ref GROUP BY run)", RUNS, REVIEW, LABELS, common(exclude=_NOT_UNCLEAR), judged("b_common", True), referenced())
oracle("paired_table_intervals", f"SELECT p.* EXCLUDE (calls), {_PAIRS}, i.low AS diff_low, i.high AS diff_high FROM b_paired p JOIN b_ci i USING (wins, losses, n)", RUNS, common(), judged("b_common", False), referenced(),
       f"b_paired AS (SELECT run, {_COUNTS}, {_WINS}, {_CALLS} FROM b_ref GROUP BY run)", *resampled("b_paired"))
_GROUPED = "b_src AS (SELECT *, category AS g FROM b_runs WHERE category <> '')"
_SCRIPT = "CASE WHEN regexp_matches(mention, '[A-Za-z]') AND regexp_matches(mention, '[\\x{0600}-\\x{06FF}]') THEN 'mixed' WHEN regexp_matches(mention, '[A-Za-z]') THEN 'latin' ELSE 'arabic' END"
for name, source in (("paired_by", _GROUPED), ("by_script", f"b_src AS (SELECT *, {_SCRIPT} AS g FROM b_runs)")):
    oracle(name, f'SELECT *, {_ACCURACY} FROM (SELECT g AS "group", run, {_COUNTS} FROM b_ok GROUP BY g, run)', RUNS, source, common("b_src", "g"), judged("b_common", False))
oracle("within_run", f"SELECT *, {_ACCURACY}, {_SIGN} FROM (SELECT run, {_COUNTS} FROM b_ok GROUP BY run)", RUNS, REVIEW, LABELS, f"b_src AS (SELECT * FROM b_runs WHERE {_live} AND regexp_matches(run, '^(full|grounded|critic)') {_NOT_UNCLEAR})", judged("b_src", True))
oracle("llm_only_spread", """SELECT run, round(value, 6) AS value FROM (SELECT run, value FROM b_per UNION ALL SELECT 'count', count(*)::DOUBLE FROM b_per UNION ALL SELECT 'mean', avg(value) FROM b_per UNION ALL SELECT 'std', stddev_samp(value) FROM b_per
 UNION ALL SELECT 'min', min(value) FROM b_per UNION ALL SELECT '25%', quantile_cont(value, 0.25) FROM b_per UNION ALL SELECT '50%', quantile_cont(value, 0.5) FROM b_per UNION ALL SELECT '75%', quantile_cont(value, 0.75) FROM b_per UNION ALL SELECT 'max', max(value) FROM b_per)""",
       RUNS, "b_src AS (SELECT * FROM b_runs WHERE NOT contains(run, '@') OR regexp_matches(run, '@r[0-9]+$'))", common("b_src"), judged("b_common", False), "b_per AS (SELECT run, round_even(count(*) FILTER (init_ok) / count(*), 4) AS value FROM b_ok GROUP BY run)")
_TAGGED = "b_src AS (SELECT * REPLACE (string_split(run, '@')[1] AS run), coalesce(string_split(run, '@')[2], '(first)') AS tag FROM b_runs)"
_MULTI = (RUNS, _TAGGED, common("b_src", "tag"), judged("b_common", False), referenced("tag"), f"b_per AS (SELECT *, {_PAIRS} FROM (SELECT run AS system, tag, {_COUNTS}, {_WINS}, {_CALLS} FROM b_ref GROUP BY run, tag))",
          "b_diff AS (SELECT *, accuracy - max(CASE WHEN system = 'alpha' THEN accuracy END) OVER (PARTITION BY tag) AS diff_vs_ref FROM b_per)")
oracle("multi_run_runs", "SELECT * EXCLUDE (n_right, n_initial_right, calls) FROM b_diff", *_MULTI)
_FOUR = ", ".join(f"round_even({x}, 4) AS {name}" for name, x in (
    ("acc_mean", "avg(accuracy)"), ("acc_sd", "stddev_samp(accuracy)"), ("acc_min", "min(accuracy)"), ("acc_max", "max(accuracy)"), ("diff_vs_ref_mean", "avg(diff_vs_ref)"), ("diff_vs_ref_sd", "stddev_samp(diff_vs_ref)"), ("calls", "avg(avg_llm_calls)")))
oracle("multi_run_summary", f"SELECT system, count(*) AS runs, {_FOUR}, sum(fixed)::BIGINT AS fixed_total, sum(broken)::BIGINT AS broken_total FROM b_diff GROUP BY system", *_MULTI)
oracle("check_attribution", f"""SELECT *, {rate('fixed', 'fired', 3)} AS fix_rate, {rate('broken', 'fired', 3)} AS break_rate FROM (SELECT run, check_name AS "check", count(*) AS fired, count(*) FILTER (pos = 0) AS fired_first, count(*) FILTER (qid <> initial_qid) AS changed_answer, count(*) FILTER (NOT init_ok AND ok) AS fixed,
 count(*) FILTER (init_ok AND NOT ok) AS broken, count(*) FILTER (init_ok AND ok) AS kept_right, count(*) FILTER (NOT init_ok AND NOT ok) AS still_wrong FROM b_ok JOIN b_checks ON k % 5 = m WHERE {_live} GROUP BY run, check_name)""", RUNS, CHECK, judged("b_runs", False))
oracle("gold_source_check", """SELECT pattern, count(id) AS mentions FROM (VALUES ('all three agree'), ('gold = agent ≠ search'), ('gold = search ≠ agent'), ('agent = search ≠ gold'), ('all differ')) p(pattern) LEFT JOIN (
 SELECT a.id, CASE WHEN a.qid = a.gold AND s.qid = a.gold THEN 'all three agree' WHEN s.qid = a.gold THEN 'gold = search ≠ agent' WHEN a.qid = a.gold THEN 'gold = agent ≠ search' WHEN a.qid = s.qid THEN 'agent = search ≠ gold' ELSE 'all differ' END AS pattern
 FROM b_runs a JOIN b_runs s ON a.id = s.id WHERE a.run = 'alpha' AND s.run = 'full_beta' AND a.qid <> 'ERROR' AND s.qid <> 'ERROR') USING (pattern) GROUP BY pattern""", RUNS)
_SIDE = "CASE WHEN {0} = 'NIL' THEN 'NIL' ELSE 'QID' END"
oracle("answer_changes", f"SELECT run, id, mention, gold, initial_qid AS initial, qid AS final, gold AS accepted, CASE WHEN ok THEN 'fixed' ELSE 'broken' END AS change, concat({_SIDE.format('initial_qid')}, '→', {_SIDE.format('qid')}) AS kind FROM b_ok WHERE {_live} AND ok <> init_ok", RUNS, judged("b_runs", False))
_NIL_CASES = f"""b_nil AS (SELECT run, id, gold, initial_qid AS initial, qid AS final, concat('Q', c % 50) AS rule, concat('Q', c % 50, '|Q', (c + 3) % 50) AS exact_matches, qid = 'NIL' AS agent_kept_nil,
 qid = gold AS agent_right, concat('Q', c % 50) = gold AS rule_right, qid = concat('Q', c % 50) AS same_answer FROM b_runs WHERE {_live} AND k % 5 IN (2, 3))"""
oracle("nil_rule_analysis", "SELECT * FROM b_nil", RUNS, _NIL_CASES)
oracle("nil_rule_summary", f"""SELECT *, {sign_p('agent_only', 'rule_only')} AS sign_p FROM (SELECT run, count(*) AS fired, count(*) FILTER (agent_kept_nil) AS kept, count(*) FILTER (agent_kept_nil AND agent_right AND NOT rule_right) AS kept_nil_right, count(*) FILTER (agent_kept_nil AND NOT agent_right AND rule_right) AS kept_rule_right,
 count(*) FILTER (agent_kept_nil AND NOT agent_right AND NOT rule_right) AS kept_both_wrong, count(*) FILTER (agent_kept_nil AND agent_right AND rule_right) AS kept_both_right, count(*) FILTER (NOT agent_kept_nil) AS switched,
 count(*) FILTER (NOT agent_kept_nil AND same_answer) AS switched_to_rule, count(*) FILTER (agent_right) AS agent_right, count(*) FILTER (rule_right) AS rule_right, count(*) FILTER (agent_right AND NOT rule_right) AS agent_only, count(*) FILTER (rule_right AND NOT agent_right) AS rule_only
 FROM b_nil GROUP BY run)""", RUNS, _NIL_CASES)
oracle("unseen_initial", """SELECT run, """ + ", ".join(f"""count(*) FILTER ({c}) AS {n}, count(*) FILTER ({c} AND shown AND NOT seen) AS {n}_unseen_initial, count(*) FILTER ({c} AND NOT shown) AS {n}_not_reviewed""" for n, c in (("fixed", "ok"), ("broken", "NOT ok"))) + f"""
 FROM (SELECT o.*, r.id IS NOT NULL AS shown, list_contains(string_split(r.options, '|'), o.initial_qid) AS seen FROM b_ok o LEFT JOIN b_review r ON o.id = r.id WHERE {_live} AND initial_qid <> qid AND ok <> init_ok AND o.id NOT IN (SELECT id FROM b_labels WHERE unclear)) GROUP BY run""",
       RUNS, REVIEW, LABELS, judged("b_runs", True))
oracle("error_summary", "SELECT * FROM (SELECT run, message, mentions, row_number() OVER (PARTITION BY run ORDER BY mentions DESC, message) AS nth FROM (SELECT run, substring(reason, 1, 160) AS message, count(*) AS mentions FROM b_runs WHERE qid = 'ERROR' GROUP BY ALL)) WHERE nth <= 3", RUNS)
oracle("errors_table", """SELECT r.run, r.id, r.gold, coalesce(g.p_name, '') AS gold_label, r.qid AS agent, CASE WHEN a.item IS NULL THEN '' ELSE concat('made as ', a.p_type) END AS agent_desc, list_contains(r.candidates, r.gold) AS gold_in_candidates,
 CASE r.k % 5 WHEN 1 THEN 'TYPE' WHEN 2 THEN 'LABEL,NIL' WHEN 3 THEN 'NIL' WHEN 4 THEN 'TYPE,TYPE,LABEL' ELSE '' END AS checks_fired, coalesce(s.alpha, '') AS alpha, coalesce(s.partial, '') AS partial
 FROM b_wrong r LEFT JOIN b_item g ON r.gold = g.item LEFT JOIN b_item a ON r.qid = a.item LEFT JOIN b_said s ON s.id = r.id""", RUNS.replace("AS (", "AS MATERIALIZED (", 1),
       "b_wrong AS MATERIALIZED (SELECT run, id, k, gold, qid, candidates FROM b_runs WHERE qid <> 'ERROR' AND qid <> gold)", "b_item AS MATERIALIZED (SELECT concat('Q', p_partkey) AS item, p_name, p_type FROM part)",
       "b_said AS MATERIALIZED (SELECT id, max(CASE WHEN run = 'alpha' THEN qid END) AS alpha, max(CASE WHEN run = 'partial' THEN qid END) AS partial FROM b_runs WHERE run IN ('alpha', 'partial') GROUP BY id)")
oracle("bootstrap_ci", "SELECT o_orderpriority, low, high FROM b_src JOIN b_ci USING (wins, losses, n)",
       "b_src AS (SELECT o_orderpriority, count(*) FILTER (o_orderkey % 7 = 0) AS wins, count(*) FILTER (o_orderkey % 7 = 1) AS losses, count(*) AS n FROM orders GROUP BY ALL)", *resampled("b_src"))
oracle("exact_sign_p", f"SELECT g, b, c, round({sign_p('b', 'c')}, 5) AS p FROM (SELECT o_custkey % 100 AS g, count(*) FILTER (o_orderkey % 3 = 0) AS b, count(*) FILTER (o_orderkey % 5 = 0) AS c FROM orders GROUP BY 1)")
oracle("wilson_interval", f"SELECT g, {wilson('k', 'n')} FROM (SELECT o_custkey % 100 AS g, count(*) FILTER (o_orderkey % 3 = 0) AS k, count(*) AS n FROM orders GROUP BY 1)")

# --- text ------------------------------------------------------------------------------------------------------------


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def normal(x: str) -> str:
    marks = f"regexp_replace({x}, {quoted(t.MARKS)}, '', 'g')"
    folded = f"translate({marks}, '{t.FOLD_FROM}', '{t.FOLD_TO}')"
    return "lower(" + strip(f"regexp_replace(regexp_replace({folded}, {quoted(t.PUNCTUATION)}, ' ', 'g'), '\\s+', ' ', 'g')") + ")"


def tokens(x: str) -> str:
    return f"list_transform(list_filter(string_split({normal(x)}, ' '), lambda w: w <> ''), lambda w: CASE WHEN starts_with(w, '{t.ARTICLE}') AND length(w) > 3 THEN substring(w, 3) ELSE w END)"


_LINES = f"b_line AS (SELECT DISTINCT doc_id, translate(line, '{b.LATIN}', '{b.ARABIC_LETTERS}') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '')"
oracle("normalize_text", f"SELECT doc_id, {normal('line')} AS norm FROM b_line", _LINES)
oracle("name_tokens", f"SELECT doc_id, array_to_string({tokens('line')}, '|') AS tokens FROM b_line", _LINES)
oracle("mention_script", f"SELECT {_SCRIPT} AS script, run, count(*) AS mentions FROM b_runs GROUP BY ALL", RUNS)
oracle("norm_gold", "SELECT run, id, CASE WHEN regexp_matches(qid, 'Q[0-9]') THEN qid ELSE 'NIL' END AS gold FROM b_runs", RUNS)
oracle("norm_type", "SELECT id, CASE type WHEN 'PERSON' THEN 'PER' WHEN 'B-GPE' THEN 'GPE' ELSE type END AS type FROM b_mentions", MENTION)
oracle("is_date_mention", "SELECT run, id, type IN ('DATE', 'TIME') OR regexp_matches(mention, '^[0-9]{4}$') AS is_date FROM b_runs", RUNS)
oracle("split_run_tag", "SELECT DISTINCT run, string_split(run, '@')[1] AS config, string_split(run, '@')[2] AS tag, NOT contains(run, '@') OR regexp_matches(run, '@r[0-9]+$') AS main FROM b_runs", RUNS)
oracle("parse_answer", """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'select' WHEN 1 THEN 'select' WHEN 2 THEN 'nil' END AS action, CASE WHEN turn % 4 IN (0, 1) THEN concat('Q', conv_id) WHEN turn % 4 = 2 THEN '' END AS qid,
 CASE WHEN turn % 4 = 1 THEN 'en' WHEN turn % 4 < 3 THEN 'ar' END AS lang, CASE turn % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 END::DOUBLE AS confidence FROM conversations""")
oracle("text_sha1", "SELECT doc_id, sha1(coalesce(text, '')) AS sha1 FROM documents")
oracle("doc_context", """SELECT id, concat(CASE WHEN a > 0 THEN '…' ELSE '' END, substring(text, a + 1, s - a), '⟦', mention, '⟧', substring(text, s + length(mention) + 1, e - s - length(mention)), CASE WHEN e < length(text) THEN '…' ELSE '' END) AS context
 FROM (SELECT *, greatest(0, s - 40) AS a, least(length(text), s + length(mention) + 40) AS e FROM (SELECT *, strpos(text, mention) - 1 AS s FROM b_mentions))""", MENTION)

# --- corpora ---------------------------------------------------------------------------------------------------------

oracle("mentions_from_nested", "SELECT concat(doc_id, '-', row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1) AS id, doc_id, mention, type, gold FROM b_mentions", MENTION)
oracle("mentions_from_flat", "SELECT concat(id, '-0') AS id, mention, type, gold FROM b_mentions", MENTION)
oracle("mentions_without_ids", "SELECT concat(row_number() OVER (ORDER BY doc_id) - 1, '-0') AS id, 'sentence' AS mention, concat('Q', doc_id) AS gold FROM documents")
oracle("last_answers", "SELECT id, CASE WHEN k % 4 = 0 THEN 'Q_new' ELSE qid END AS qid FROM b_runs WHERE run = 'alpha' AND (k % 4 = 0 OR qid <> 'ERROR')", RUNS)
_BIO = """b_tok AS (SELECT doc_id, word, pos - 1 AS pos FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM documents))),
b_tag AS (SELECT *, CASE pos % 7 WHEN 0 THEN 'B-PER' WHEN 1 THEN 'I-PER' WHEN 3 THEN 'I-LOC' WHEN 4 THEN 'E-ORG' WHEN 6 THEN 'S-LOC' ELSE 'O' END AS tag, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b0 FROM b_tok),
b_open AS (SELECT *, sum(CASE WHEN pos % 7 IN (0, 3, 4, 6) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM b_tag WHERE tag <> 'O'),
b_span AS (SELECT doc_id, span, min(b0)::INT AS start, max(b0 + length(word))::INT AS "end", min_by(substring(tag, 3), pos) AS type, string_agg(word, ' ' ORDER BY pos) AS mention, min(CASE WHEN pos % 3 = 0 THEN pos END) AS q FROM b_open GROUP BY doc_id, span)"""
oracle("mentions_from_bio", """SELECT concat(doc_id, '-', span - 1) AS id, CAST(doc_id AS STRING) AS doc_id, mention, type, start, "end", CASE WHEN q IS NULL THEN 'NIL' ELSE concat('Q', q) END AS gold FROM b_span""", _BIO)
oracle("detect_roles", """SELECT 'nested' AS source, type, count(*) AS mentions, count(*) FILTER (gold = 'NIL') AS nil FROM b_mentions GROUP BY type UNION ALL SELECT 'flat', type, count(*), count(*) FILTER (gold = 'NIL') FROM b_mentions GROUP BY type
 UNION ALL SELECT 'bio', type, count(*), count(*) FILTER (q IS NULL) FROM b_span GROUP BY type""", MENTION, _BIO)
oracle("corpus_profile", f"""SELECT measure, round(value, 2) AS value FROM (SELECT 'sentences' AS measure, s.n::DOUBLE AS value FROM s UNION ALL SELECT 'mentions', m.n FROM m UNION ALL SELECT 'share of mentions labeled NIL', round_even(m.nil / m.n, 4) FROM m
 UNION ALL SELECT 'share of mentions in Latin script', round_even(m.latin / m.n, 4) FROM m UNION ALL SELECT 'share of sentences without Arabic script', round_even(s.plain / s.n, 4) FROM s UNION ALL SELECT 'mean sentence length (chars)', round_even(s.chars / s.n, 1) FROM s
 UNION ALL SELECT 'mentions per sentence with mentions', round_even(m.n / m.docs, 3) FROM m UNION ALL SELECT concat('type ', type), round_even(c / m.n, 4) FROM (SELECT type, count(*) AS c FROM b_mentions GROUP BY type ORDER BY c DESC, type LIMIT 10), m)""",
       MENTION, f"m AS (SELECT count(*) AS n, count(*) FILTER (gold = 'NIL') AS nil, count(*) FILTER ({_SCRIPT} <> 'arabic') AS latin, count(DISTINCT doc_id) AS docs FROM b_mentions)",
       "s AS (SELECT count(*) AS n, count(*) FILTER (NOT regexp_matches(text, '[\\x{0600}-\\x{06FF}]')) AS plain, sum(length(text)) AS chars FROM documents WHERE regexp_matches(text, '\\S'))")
_PLAIN = f"{tokens('anchor')} = {tokens('bare')}"
oracle("build_link_set", """SELECT concat(doc_id, '#', k - 1) AS id, doc_id, sha1(substring(text, cut + 1, 900)) AS text, anchor AS mention, (start - cut)::INT AS start, ("end" - cut)::INT AS "end", gold, target AS target_title, CASE WHEN alias THEN 'alias' ELSE 'title' END AS surface
 FROM (SELECT *, CASE WHEN length(text) > 900 THEN greatest(0, least(start - 450, length(text) - 900)) ELSE 0 END AS cut FROM b_four WHERE k <= 4) ORDER BY md5(concat('13-', doc_id)), doc_id, k LIMIT 1500""", b.LINK_SQL,
       f"""b_rows AS (SELECT *, NOT ({_PLAIN}) AS alias, md5(concat_ws('-', '13', doc_id, para, start, anchor)) AS place FROM (SELECT l.*, t.gold, regexp_replace(l.target, '\\s*\\(.*?\\)\\s*$', '') AS bare FROM b_links l JOIN b_titles t ON l.target = t.target WHERE t.gold IS NOT NULL AND right(t.gold, 1) NOT IN ('3', '7')))""",
       """b_toss AS (SELECT *, row_number() OVER (PARTITION BY doc_id, alias ORDER BY toss) AS nth FROM (SELECT doc_id, toss, ('0x' || substring(md5(concat('14-', doc_id, '-', toss)), 1, 8))::BIGINT / 4294967296::DOUBLE < 0.7 AS alias
 FROM (SELECT doc_id, unnest(range(1, count(*) * 2 + 17)) AS toss FROM b_rows GROUP BY doc_id)))""",
       "b_turn AS (SELECT r.*, coalesce(t.toss, r.nth + 1048576) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, alias ORDER BY place) AS nth FROM b_rows) r LEFT JOIN b_toss t USING (doc_id, alias, nth))",
       "b_once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, gold ORDER BY turn, place) AS again FROM b_turn) WHERE again = 1)", "b_four AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn, place) AS k FROM b_once)")
oracle("coverage_check", f"SELECT *, {rate('found', 'sampled')} AS coverage FROM (SELECT count(*) AS sampled, count(*) FILTER (doc_id % 5 <> 0) AS found, count(*) FILTER (doc_id % 5 <> 0 AND (doc_id % 7 <> 0 OR text = 'other')) AS same_text FROM (SELECT DISTINCT doc_id, text FROM labels JOIN documents USING (doc_id)))")
oracle("split_by_doc", """SELECT id, CASE WHEN nth <= greatest(1, CAST(floor(total * 0.2) AS BIGINT)) THEN 'dev' ELSE 'test' END AS part FROM b_mentions JOIN (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('13-', doc_id)), doc_id) AS nth, count(*) OVER () AS total FROM (SELECT DISTINCT doc_id FROM b_mentions)) USING (doc_id)""", MENTION)
oracle("sample_by_doc", "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM b_mentions WHERE gold <> 'NIL') WHERE nth <= 3 ORDER BY md5(concat('13-', doc_id)), doc_id, nth LIMIT 200", MENTION)
oracle("uniform_sample", "SELECT doc_id FROM documents ORDER BY md5(concat('13-', doc_id)), doc_id LIMIT 100")
oracle("label_crosstab", """SELECT type, count(*) AS mentions, count(*) FILTER (year) AS years, count(*) FILTER (gold = 'NIL') AS gold_nil, count(*) FILTER (accepted IS NOT NULL) AS reviewed, count(*) FILTER (unclear) AS unclear, count(*) FILTER (wrong) AS wrong,
 count(*) FILTER (wrong AND gold = 'NIL') AS wrong_nil, count(*) FILTER (wrong AND year) AS wrong_years FROM (SELECT r.type, r.gold, regexp_matches(r.mention, '^[0-9]{4}$') AS year, l.accepted, coalesce(l.unclear, false) AS unclear, coalesce(NOT list_contains(l.accepted, r.gold), false) AS wrong
 FROM b_runs r LEFT JOIN b_labels l ON r.id = l.id WHERE r.run = 'alpha') GROUP BY type""", RUNS, REVIEW, LABELS)

# --- knowledge base --------------------------------------------------------------------------------------------------

oracle("ingest_entities", "SELECT concat('Q', p_partkey) AS qid, p_name AS label_en, concat(p_brand, '|x') AS aliases, concat('T_', p_type) AS p31, concat(900 + p_size, '-02-17') AS born, 2 AS sitelinks, concat('t', p_size) AS arwiki FROM part")
_NAMES = f"b_names AS (SELECT lang, {normal('n')} AS name_norm, array_to_string({tokens('n')}, ' ') AS name_key, qid, is_label, sitelinks FROM (SELECT label AS n, true AS is_label, qid, sitelinks FROM b_kb UNION ALL SELECT alias, false, qid, sitelinks FROM b_kb), (VALUES ('ar'), ('en')) l(lang))"
oracle("name_index", "SELECT * FROM b_names", KB, _NAMES)
_HITS = f"""b_hits AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sitelinks DESC, qid) AS rank FROM (SELECT DISTINCT q.query, n.qid, n.sitelinks FROM (SELECT DISTINCT mention AS query, {normal('mention')} AS q FROM b_asked) q JOIN b_names n ON n.lang = 'ar' AND starts_with(n.name_norm, q.q)))"""
oracle("search_names", "SELECT query, qid, sitelinks, rank FROM b_hits WHERE rank <= 7", KB, ASKED, _NAMES, _HITS)
oracle("link_search_top1", "SELECT a.id, coalesce(h.qid, 'NIL') AS qid FROM b_asked a LEFT JOIN b_hits h ON a.mention = h.query AND h.rank = 1", KB, ASKED, _NAMES, _HITS)
_TITLED = "b_titled AS (SELECT a.id, a.mention, coalesce(m.to_title, a.mention) AS final_title FROM b_asked a LEFT JOIN b_moved m ON a.mention = m.from_title)"
oracle("resolve_titles", "SELECT t.id, t.final_title, CASE WHEN NOT p.is_disambiguation THEN p.qid END AS qid FROM b_titled t LEFT JOIN b_page p ON t.final_title = p.title", ASKED, PAGE, _TITLED)
oracle("disambiguation_links", "SELECT title, qid FROM (SELECT d.title, p.qid, row_number() OVER (PARTITION BY d.title ORDER BY l.pos, l.to_title) AS nth FROM b_page d JOIN b_link l ON d.title = l.from_title JOIN b_page p ON l.to_title = p.title WHERE d.is_disambiguation AND NOT p.is_disambiguation) WHERE nth <= 3", PAGE)
_EXACT = "CASE WHEN a.k % 4 = 0 THEN true WHEN a.k % 4 = 1 THEN true ELSE false END"
oracle("label_match", f"""SELECT a.id, list_contains([{tokens('p.p_name')}, {tokens('p.p_brand')}], {tokens('a.mention')}) AS exact,
 list_has_all({tokens('p.p_name')}, {tokens('a.mention')}) OR list_has_all({tokens('p.p_brand')}, {tokens('a.mention')}) AS loose FROM b_asked a JOIN part p ON a.k = p.p_partkey""", ASKED)
oracle("class_closure", """SELECT class, root FROM walk""", """edge AS (SELECT CAST(p_partkey AS STRING) AS class, CAST(p_partkey // 2 AS STRING) AS parent FROM part WHERE p_partkey <> p_partkey // 2 UNION SELECT '3', '6'),
walk AS (SELECT r AS class, r AS root FROM (VALUES ('3'), ('5'), ('100')) t(r) UNION SELECT e.class, w.root FROM walk w JOIN edge e ON e.parent = w.class)""")
oracle("merged_ids", """SELECT old, coalesce(max(CASE WHEN stop THEN here END), min_by(here, (length(here), here)) FILTER (on_circle)) AS current FROM (
 SELECT w.old, w.here, n.new IS NULL AS stop, c.here IS NOT NULL AS on_circle FROM b_walk w LEFT JOIN b_next n ON w.here = n.old LEFT JOIN b_circle c ON w.here = c.here) GROUP BY old""", b.REDIRECT_SQL,
       "b_next AS (SELECT old, new FROM b_redirect WHERE old <> new)", "b_walk AS (SELECT old, new AS here FROM b_next UNION SELECT w.old, n.new FROM b_walk w JOIN b_next n ON w.here = n.old)", "b_circle AS (SELECT here FROM b_walk WHERE old = here)")
_HELD = "CASE WHEN regexp_matches({0}, '^Q[0-9]+$') AND TRY_CAST(substring({0}, 2) AS BIGINT) IN (SELECT p_partkey FROM part) THEN {0} WHEN {0} LIKE 'Q%' THEN concat('{1}', substring({0}, 2)) ELSE {0} END"
oracle("current_run", f"""SELECT run, id, gold, qid, initial_qid, CASE WHEN list_contains(candidates, qid) THEN array_to_string(candidates, '|') ELSE concat(array_to_string(candidates, '|'), '|', qid) END AS candidates
 FROM (SELECT run, id, {_HELD.format('gold', 'N')} AS gold, CASE WHEN length(id) % 2 = 0 THEN {_HELD.format('qid', 'M')} ELSE qid END AS qid, initial_qid, candidates FROM b_runs)""", RUNS)
_KIND = "CASE a.type WHEN 'PERSON' THEN 'PER' WHEN 'B-ORG' THEN 'ORG' ELSE 'DATE' END"
_IS = "CASE WHEN x.kind NOT IN ('PER', 'ORG') OR p.p_partkey IS NULL THEN NULL ELSE coalesce(c.type = x.kind, false) END"
oracle("is_instance_of", f"SELECT x.id, x.gold AS qid, x.kind AS type, {_IS} AS is_type FROM (SELECT *, {_KIND} AS kind FROM b_asked a) x LEFT JOIN part p ON x.gold = concat('Q', p.p_partkey) LEFT JOIN b_class c ON c.class = concat('T_', p.p_type)", ASKED, CLASS)
oracle("popularity_bucket", "SELECT a.id, CASE WHEN a.gold = 'NIL' THEN 'nil' WHEN coalesce(p.p_size, 0) >= 30 THEN 'head' WHEN coalesce(p.p_size, 0) < 10 THEN 'tail' ELSE 'torso' END AS category, CASE WHEN a.gold <> 'NIL' THEN coalesce(p.p_size, 0) END AS sitelinks FROM b_asked a LEFT JOIN part p ON a.gold = concat('Q', p.p_partkey)", ASKED)
oracle("assign_ner_types", """SELECT o.o_orderkey AS id, CASE h.g WHEN 0 THEN 'PER' WHEN 1 THEN 'LOC' WHEN 2 THEN 'MISC' END AS type FROM orders o LEFT JOIN (SELECT * FROM (SELECT o.o_orderkey, s.g, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY least(s.b, o.o_custkey % 90 + 10) - greatest(s.a, o.o_custkey % 90) DESC, s.ord) AS nth
 FROM orders o JOIN (SELECT l_orderkey, least(l_partkey % 100, l_suppkey % 100) AS a, greatest(l_partkey % 100, l_suppkey % 100) + 1 AS b, l_partkey % 3 AS g, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS ord FROM lineitem) s ON o.o_orderkey = s.l_orderkey AND s.a < o.o_custkey % 90 + 10 AND s.b > o.o_custkey % 90) WHERE nth = 1) h ON o.o_orderkey = h.o_orderkey""")
oracle("first_created", "SELECT concat('Q', user_id) AS qid, min(ts) AS created FROM events GROUP BY user_id")

# --- linking ---------------------------------------------------------------------------------------------------------

_PAIR = f"""b_pair AS (SELECT a.k, a.id, {_KIND} AS kind, pos, p.p_partkey AS pk, concat('Q', p.p_partkey) AS qid, p.p_name, list_contains([{tokens('p.p_name')}, {tokens('p.p_brand')}], {tokens('a.mention')}) AS exact,
 list_has_all({tokens('p.p_name')}, {tokens('a.mention')}) OR list_has_all({tokens('p.p_brand')}, {tokens('a.mention')}) AS loose, coalesce(c.type = {_KIND}, false) AS is_type FROM b_asked a, range(2) t(pos) JOIN part p ON p.p_partkey = a.k + pos LEFT JOIN b_class c ON c.class = concat('T_', p.p_type))"""
_STRONG = "exact AND (kind NOT IN ('PER', 'ORG') OR is_type)"
oracle("apply_nil_rule", f"SELECT a.id, coalesce(s.qid, 'NIL') AS qid, CASE WHEN s.qid IS NULL THEN '' ELSE 'NIL_RULE' END AS fired FROM b_asked a LEFT JOIN (SELECT id, min_by(qid, pos) AS qid FROM b_pair WHERE {_STRONG} GROUP BY id) s ON a.id = s.id", ASKED, CLASS, _PAIR)
_VERIFY = f"""b_ver AS (SELECT a.id, CASE WHEN a.k % 5 = 4 THEN ['FORMAT'] WHEN a.k % 5 = 3 THEN ['CANDIDATE'] WHEN a.k % 5 = 0 THEN CASE WHEN s.id IS NOT NULL THEN ['NIL'] ELSE [] END
 WHEN p.id IS NULL AND a.k % 5 = 2 AND a.k + 1 >= (SELECT count(*) FROM part) THEN list_concat([], CASE WHEN false THEN ['X'] ELSE [] END)
 ELSE list_concat(CASE WHEN p.kind IN ('PER', 'ORG') AND NOT p.is_type THEN ['TYPE'] ELSE [] END, CASE WHEN NOT p.loose AND (a.k % 2 = 0 OR (p.kind IN ('PER', 'ORG') AND NOT p.is_type)) THEN ['LABEL'] ELSE [] END) END AS checks
 FROM b_asked a LEFT JOIN (SELECT DISTINCT id FROM b_pair WHERE {_STRONG}) s ON a.id = s.id LEFT JOIN b_pair p ON a.id = p.id AND p.pos = CASE a.k % 5 WHEN 1 THEN 0 WHEN 2 THEN 1 END)"""
oracle("verify_answers", "SELECT id, array_to_string(checks, '|') AS checks, list_contains(checks, 'FORMAT') OR list_contains(checks, 'CANDIDATE') AS hard FROM b_ver", ASKED, CLASS, _PAIR, _VERIFY)
_OWN = "(k % 5 = 4 OR (k % 5 = 0 AND len(checks) > 0))"  # decided anew, for the mention's own item, in the second round
oracle("correction_loop", f"""SELECT *, qid <> initial_qid AS corrected FROM (SELECT id, CASE WHEN k % 5 = 1 OR {_OWN} THEN concat('Q', k) WHEN k % 5 = 2 THEN concat('Q', k + 1) ELSE 'NIL' END AS qid,
 CASE k % 5 WHEN 1 THEN concat('Q', k) WHEN 2 THEN concat('Q', k + 1) WHEN 3 THEN 'Q999999999' ELSE 'NIL' END AS initial_qid, k % 5 = 3 AS flagged, (CASE WHEN k % 5 = 3 THEN 3 WHEN {_OWN} THEN 2 ELSE 1 END)::INTEGER AS rounds,
 (CASE WHEN k % 5 = 3 THEN 1 ELSE 0 END)::INTEGER AS n_issues FROM (SELECT *, CAST(id AS BIGINT) AS k FROM b_ver))""", ASKED, CLASS, _PAIR, _VERIFY)
oracle("coherence_batches", "SELECT doc_id, count(*) AS n_links, string_agg(gold, '|' ORDER BY pos) AS qids FROM b_mentions WHERE gold <> 'NIL' GROUP BY doc_id HAVING count(*) >= 2", MENTION)
oracle("correction_hints", "SELECT event_type AS id, string_agg(concat('Q', user_id), '|' ORDER BY event_id) AS wrong FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS nth FROM events) WHERE nth <= 3 GROUP BY event_type")
oracle("collect_cases", f"""SELECT run, id, initial_qid AS wrong, qid AS "right", CASE k % 5 WHEN 1 THEN 'TYPE' WHEN 2 THEN 'LABEL,NIL' WHEN 3 THEN 'NIL' WHEN 4 THEN 'TYPE' END AS checks, reason AS why FROM b_runs WHERE {_live} AND qid <> initial_qid AND NOT flagged""", RUNS)
oracle("pending_mentions", "SELECT CAST(o.o_orderkey AS STRING) AS id, CAST(o.o_custkey AS STRING) AS doc_id, d.id IS NOT NULL AS answered FROM orders o LEFT JOIN b_done d ON CAST(o.o_orderkey AS STRING) = d.id WHERE o.o_custkey IN (SELECT o_custkey FROM orders WHERE CAST(o_orderkey AS STRING) NOT IN (SELECT id FROM b_done))",
       RUNS, f"b_done AS (SELECT id FROM b_runs WHERE run = 'alpha' AND {_live})")
oracle("assemble_run", "SELECT CAST(o.o_orderkey AS STRING) AS id, concat('Q', o.o_custkey) AS gold, o.o_orderpriority AS category, coalesce(r.qid, 'ERROR') AS qid, r.initial_qid, r.flagged FROM orders o LEFT JOIN b_runs r ON r.run = 'partial' AND r.id = CAST(o.o_orderkey AS STRING)", RUNS)

# --- reviews ---------------------------------------------------------------------------------------------------------

_SORTED = "array_to_string(list_sort({0}), '|')"
oracle("pooled_labels", f"SELECT id, unclear, {_SORTED.format('accepted')} AS accepted FROM b_labels", REVIEW, LABELS)
_JUDGED = "status = 'done'"
_WRONG = "status = 'done' AND NOT list_contains(string_split(accepted, '|'), gold)"
_WRONG_RATE = f"{rate('gold_wrong', 'reviewed')} AS rate, {wilson('gold_wrong', 'reviewed')}"
oracle("pooled_summary", f'SELECT *, {_WRONG_RATE} FROM (SELECT "group", count(*) AS rows, count(*) FILTER ({_JUDGED}) AS reviewed, count(*) FILTER ({_WRONG}) AS gold_wrong FROM b_review GROUP BY "group")', REVIEW)
_SINGLE_LABELS = """b_one AS (SELECT *, CASE k % 8 WHEN 0 THEN [gold] WHEN 1 THEN [gold] WHEN 2 THEN [agent] WHEN 3 THEN list_distinct([gold, agent]) WHEN 4 THEN CASE WHEN k % 16 = 4 THEN ['Q5'] ELSE []::VARCHAR[] END WHEN 6 THEN [search] END AS acc FROM b_single),
b_labels AS (SELECT id, k % 8 = 5 AS unclear, acc AS accepted FROM b_one WHERE k % 8 <> 7)"""
oracle("reviewed_labels", f"SELECT id, unclear, {_SORTED.format('accepted')} AS accepted FROM b_labels", SINGLE, _SINGLE_LABELS)
_AUDIT = "starts_with(\"group\", '9')"
oracle("reviewed_summary", f"""SELECT *, {rate('gold_wrong', 'reviewed')} AS gold_wrong_rate, {rate('audit_wrong', 'audit_reviewed')} AS audit_error_rate FROM (SELECT count(*) FILTER (NOT {_AUDIT}) AS disagreements, count(*) FILTER (NOT {_AUDIT} AND acc IS NOT NULL) AS reviewed, count(*) FILTER (NOT {_AUDIT} AND list_contains(acc, gold) AND len(acc) = 1) AS gold_right,
 count(*) FILTER (NOT {_AUDIT} AND acc IS NOT NULL AND NOT list_contains(acc, gold)) AS gold_wrong, count(*) FILTER (NOT {_AUDIT} AND list_contains(acc, gold) AND len(acc) > 1) AS both_acceptable, count(*) FILTER (NOT {_AUDIT} AND k % 8 = 5) AS unclear,
 count(*) FILTER ({_AUDIT} AND acc IS NOT NULL) AS audit_reviewed, count(*) FILTER ({_AUDIT} AND acc IS NOT NULL AND NOT list_contains(acc, gold)) AS audit_wrong FROM b_one)""", SINGLE, _SINGLE_LABELS)
oracle("rescore", f"SELECT * EXCLUDE (calls), {_PAIRS} FROM (SELECT run, {_COUNTS}, {_WINS}, {_CALLS} FROM b_ref GROUP BY run)", RUNS, SINGLE, _SINGLE_LABELS, common(exclude=_NOT_UNCLEAR), judged("b_common", True), referenced())
oracle("label_review", f"""SELECT *, {_WRONG_RATE} FROM (SELECT kind, count(*) AS reviewed, count(*) FILTER ({_WRONG}) AS gold_wrong FROM b_kind GROUP BY kind UNION ALL SELECT 'all without dates', count(*), count(*) FILTER ({_WRONG}) FROM b_kind WHERE kind IN ('other NIL', 'other disagreements'))""", REVIEW,
       """b_kind AS (SELECT *, CASE WHEN "group" = 'audit' THEN 'audit of agreements' WHEN gold = 'NIL' AND (type IN ('DATE', 'TIME') OR mention = '1962') THEN 'dates labelled NIL' WHEN gold = 'NIL' THEN 'other NIL' ELSE 'other disagreements' END AS kind FROM b_review WHERE status = 'done')""")
oracle("agreement_sample", "SELECT id, '' AS status, '' AS accepted, options FROM b_review WHERE status = 'done' ORDER BY md5(concat('7-', id)), id LIMIT 60", REVIEW)
_SETS = f"""b_both AS (SELECT k, list_distinct(list_filter(string_split(accepted, '|'), lambda x: x <> '')) AS sa, CASE WHEN k % 4 = 0 THEN [nxt] WHEN k % 13 <= 5 THEN [gold] ELSE []::VARCHAR[] END AS sb, string_split(options, '|') AS o FROM b_review WHERE k % 13 <= 6),
b_opt AS (SELECT k, unnest(list_distinct(list_concat(list_concat(o, sa), sb))) AS q FROM b_both)"""
_PE = "((yes_a / judgements) * (yes_b / judgements) + (1 - yes_a / judgements) * (1 - yes_b / judgements))"
oracle("annotator_agreement", f"""SELECT *, {rate('exact', 'rows')} AS exact_agreement, {rate('equal', 'judgements')} AS observed_agreement, round_even((equal / judgements - {_PE}) / (1 - {_PE}), 4) AS cohen_kappa FROM (SELECT (SELECT count(*) FROM b_both) AS rows, (SELECT count(*) FROM b_both WHERE list_sort(sa) = list_sort(sb)) AS exact, count(*) AS judgements, count(*) FILTER (list_contains(sa, q) = list_contains(sb, q)) AS equal,
 count(*) FILTER (list_contains(sa, q)) AS yes_a, count(*) FILTER (list_contains(sb, q)) AS yes_b FROM b_opt JOIN b_both USING (k))""", REVIEW, _SETS)
_CORR = """b_corr AS (SELECT r.id, r.gold AS gold_original, r.text, CASE WHEN l.unclear THEN NULL ELSE coalesce(l.accepted, [r.gold]) END AS fixed, l.id IS NOT NULL AS judged,
 CASE WHEN l.unclear THEN 'unclear' WHEN l.accepted IS NOT NULL AND NOT list_contains(l.accepted, r.gold) THEN 'corrected' WHEN l.accepted IS NOT NULL AND v."group" = 'audit' THEN 'audited_confirmed'
 WHEN l.accepted IS NOT NULL THEN CASE WHEN len(l.accepted) = 1 THEN 'confirmed' ELSE 'alternatives_acceptable' END WHEN v.id IS NOT NULL THEN 'not_reviewed' ELSE 'unreviewed_agreement' END AS label_status
 FROM b_runs r LEFT JOIN b_review v ON r.id = v.id LEFT JOIN b_labels l ON r.id = l.id WHERE r.run = 'alpha')"""
oracle("corrected_dataset", f"SELECT id, gold_original, {_SORTED.format('fixed')} AS gold_corrected, label_status, CASE WHEN judged THEN 'A' ELSE '' END AS annotator, sha1(text) AS text_sha1 FROM b_corr", RUNS, REVIEW, LABELS, _CORR)
oracle("corrected_labels", f"SELECT id, fixed IS NULL AS unclear, {_SORTED.format('fixed')} AS accepted FROM b_corr", RUNS, REVIEW, LABELS, _CORR)
oracle("restore_texts", "SELECT CAST(doc_id AS STRING) AS doc_id, doc_id % 7 <> 0 AS restored, CASE WHEN doc_id % 7 <> 0 THEN length(text) END AS n_chars FROM documents")
oracle("nil_label_timing", """SELECT w.id, array_to_string(w.qids, '|') AS accepted, coalesce(strftime(min(e.ts), '%Y-%m-%d'), '') AS earliest, CASE WHEN len(w.qids) = 0 THEN 'no QID accepted' WHEN min(e.ts) IS NULL THEN 'creation date unknown' WHEN strftime(min(e.ts), '%Y-%m-%d') < '2024-01-02' THEN 'item existed before cutoff' ELSE 'item created after cutoff' END AS status
 FROM (SELECT id, list_sort(list_filter(string_split(accepted, '|'), lambda x: regexp_matches(x, '^Q[0-9]+$'))) AS qids FROM b_review WHERE status = 'done' AND gold = 'NIL' AND NOT list_contains(string_split(accepted, '|'), 'NIL')) w LEFT JOIN events e ON list_contains(w.qids, concat('Q', e.user_id)) GROUP BY w.id, w.qids""", REVIEW)
_PREV = "CASE s.verdict WHEN 'agent_wrong' THEN 'gold' WHEN 'gold_wrong' THEN 'agent' WHEN 'both_ok' THEN 'gold+agent' ELSE s.verdict END"
oracle("review_sheet", f"""SELECT r.id, r.grp AS "group", r.gold, coalesce(p.p_name, '') AS gold_label, r.qid AS agent, coalesce(r.search, '') AS search, r.initial_qid AS initial,
 CASE r.k % 5 WHEN 1 THEN 'TYPE' WHEN 2 THEN 'LABEL,NIL' WHEN 3 THEN 'NIL' WHEN 4 THEN 'TYPE,TYPE,LABEL' ELSE '' END AS checks_fired, {_PREV} AS verdict, s.correct_qid
 FROM (SELECT * FROM b_grp WHERE qid <> gold UNION ALL SELECT * FROM (SELECT * FROM b_grp WHERE qid = gold ORDER BY md5(concat('13-', id)), id LIMIT 40)) r JOIN b_single s ON r.id = s.id LEFT JOIN part p ON r.gold = concat('Q', p.p_partkey)""",
       RUNS, SINGLE, """b_grp AS (SELECT a.*, s.qid AS search, CASE WHEN a.qid = a.gold THEN '9 audit: gold = agent' WHEN a.gold = 'NIL' THEN '1 gold NIL, agent linked' WHEN a.qid = s.qid THEN '2 agent = search ≠ gold' WHEN a.gold = s.qid THEN '3 gold = search ≠ agent'
 WHEN a.qid = 'NIL' THEN '4 agent NIL, gold linked' ELSE '5 other disagreement' END AS grp FROM b_runs a LEFT JOIN (SELECT * FROM b_runs WHERE run = 'alpha' AND qid <> 'ERROR') s ON a.id = s.id WHERE a.run = 'full_beta' AND a.qid <> 'ERROR')""")
oracle("pooled_review", f"""SELECT id, "group", {_SORTED.format('opts')} AS options, CASE WHEN stays THEN pstatus WHEN taken THEN CASE WHEN v5 THEN 'unclear' ELSE 'done' END ELSE '' END AS status, CASE WHEN stays THEN paccepted WHEN taken THEN CASE WHEN v5 THEN '' ELSE {_SORTED.format('acc')} END ELSE '' END AS accepted,
 CASE WHEN stays THEN pannot WHEN taken THEN 'first_pass' ELSE '' END AS annotator, CASE WHEN stays THEN pcarried WHEN taken THEN 'yes' ELSE '' END AS carried FROM b_pool""",
       RUNS, REVIEW, SINGLE, _SINGLE_LABELS, common(), """b_per AS (SELECT id, min(gold) AS gold, list_distinct(list_append(list(qid), min(gold))) AS opts, bool_or(qid <> gold) AS differs FROM b_common GROUP BY id),
b_picked AS (SELECT p.* FROM b_per p LEFT JOIN b_review r ON p.id = r.id AND r."group" = 'audit' WHERE NOT differs ORDER BY CASE WHEN r.id IS NULL THEN 1 ELSE 0 END, md5(concat('13-', p.id)), p.id LIMIT 40),
b_rows AS (SELECT *, CASE WHEN gold = 'NIL' THEN 'gold NIL' ELSE 'disagreement' END AS "group" FROM b_per WHERE differs UNION ALL SELECT *, 'audit' FROM b_picked),
b_pool AS (SELECT b.*, r.status AS pstatus, r.accepted AS paccepted, r.annotator AS pannot, r.carried AS pcarried, coalesce(list_has_all(string_split(r.options, '|'), b.opts), false) AS stays, o.k % 8 = 5 AS v5, o.acc,
 coalesce(o.k % 8 <> 7 AND list_has_all(list_concat([o.gold, o.agent, o.search], CASE WHEN o.k % 16 = 4 THEN ['Q5'] ELSE []::VARCHAR[] END), b.opts), false) AS taken
 FROM b_rows b LEFT JOIN (SELECT * FROM b_review WHERE status <> '') r ON b.id = r.id LEFT JOIN b_one o ON b.id = o.id)""")

# --- sources and streams ---------------------------------------------------------------------------------------------

oracle("read_runs", """SELECT CASE run WHEN 'alpha' THEN 'alpha' ELSE 'gamma@r2' END AS run, count(*) AS n, count(*) FILTER (qid = 'ERROR') AS errors, count(*) FILTER (k % 5 > 0) AS traced FROM b_runs WHERE run IN ('alpha', 'full_beta') GROUP BY 1""", RUNS)
oracle("sniff_files", "SELECT kind, format, count(*) AS files FROM (SELECT DISTINCT p_partkey % 40 AS nth, ['lines', 'packed', 'pages', 'tokens', 'blank'][CAST(p_partkey % 5 AS INT) + 1] AS kind, ['json', 'gzip', 'html', 'conll', 'empty'][CAST(p_partkey % 5 AS INT) + 1] AS format FROM part) GROUP BY ALL")
oracle("read_rows", "SELECT id, mention, gold FROM b_mentions", MENTION)
oracle("read_records", "SELECT doc_id, length(text) AS n_chars FROM documents")
oracle("read_review", 'SELECT id, "group", options, sources, status, accepted, carried FROM b_review', REVIEW)
ORACLES["stream_profile"] = ORACLES["corpus_profile"]
oracle("stream_runs", "SELECT run, id, CASE WHEN qid <> 'ERROR' THEN qid ELSE 'Q1' END AS qid FROM b_runs UNION ALL SELECT run, id, qid FROM b_runs WHERE qid = 'ERROR' AND k % 3 <> 0", RUNS)
oracle("stream_sample", "SELECT doc_id FROM documents ORDER BY md5(concat('13-', doc_id)), doc_id LIMIT 100")

# --- longer chains ---------------------------------------------------------------------------------------------------

_ART = "CASE WHEN starts_with({0}, 'لل') AND length({0}) > 4 THEN concat('ال', substring({0}, 3)) WHEN length({0}) > 4 AND substring({0}, 1, 1) IN ('ب', 'ك', 'ف') AND substring({0}, 2, 2) = 'ال' THEN substring({0}, 2) END"
_FIRST_SEEN = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_USABLE = "list_filter(list_transform({0}, lambda w: " + strip("w") + "), lambda w: length(w) >= 2)"
oracle("search_variants", f"SELECT id, array_to_string(prim, '|') AS prim, array_to_string(list_filter({_FIRST_SEEN.format('f2')}, lambda x: NOT list_contains(prim, x)), '|') AS fall FROM v4", MENTION,
       f"v0 AS (SELECT id, concat(['', 'و', 'لل', 'بال', 'ل'][CAST(pos % 5 + 1 AS INT)], translate(mention, '{b.LATIN}', '{b.ARABIC_LETTERS}')) AS m FROM b_mentions)",
       f"v1 AS (SELECT id, {strip(f'regexp_replace(regexp_replace({strip(chr(109))}, {quoted(t.LEFT_EDGE)}, {quoted(str())}), {quoted(t.RIGHT_EDGE)}, {quoted(str())})')} AS name FROM (SELECT id, regexp_replace(m, {quoted(t.MARKS)}, '', 'g') AS m FROM v0))",
       "v2 AS (SELECT *, ws[1] AS f, CASE WHEN len(ws) > 1 THEN concat(' ', array_to_string(ws[2:], ' ')) ELSE '' END AS rest, CASE WHEN length(ws[1]) > 3 AND substring(ws[1], 1, 1) IN ('و', 'ف') THEN substring(ws[1], 2) END AS j FROM (SELECT *, list_filter(regexp_split_to_array(name, '\\s+'), lambda w: w <> '') AS ws FROM v1))",
       f"v3 AS (SELECT *, list_filter([f, j, {_ART.format('f')}, {_ART.format('j')}], lambda w: w IS NOT NULL) AS forms FROM v2)",
       f"v4 AS (SELECT id, {_FIRST_SEEN.format('p2')} AS prim, f2 FROM (SELECT id, {_USABLE.format('p1')} AS p2, {_USABLE.format('f1')} AS f2 FROM (SELECT id, list_concat([name], list_transform(forms[2:], lambda w: concat(w, rest))) AS p1, "
       "list_transform(list_filter(forms, lambda w: length(w) > 3 AND substring(w, 1, 1) IN ('ب', 'ل', 'ك') AND NOT starts_with(w, 'ال') AND NOT starts_with(w, 'لل')), lambda w: concat(substring(w, 2), rest)) AS f1 FROM v3)))")
oracle("read_conll", "SELECT len(ws) AS n_tokens, len(list_filter(range(len(ws)), lambda i: i % 7 NOT IN (2, 5))) AS n_tagged, (len(ws) + 2) // 3 AS n_items FROM (SELECT list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM documents) WHERE len(ws) > 0")
_CANDS = (KB, ASKED, PAGE, _NAMES, _HITS, _TITLED, "b_way AS (SELECT DISTINCT mention, final_title FROM b_titled)",
          """b_first AS (SELECT mention, qid, min(rank) AS rank FROM (SELECT query AS mention, qid, rank FROM b_hits WHERE rank <= 7 UNION ALL SELECT w.mention, p.qid, 0 FROM b_way w JOIN b_page p ON w.final_title = p.title WHERE NOT p.is_disambiguation) GROUP BY ALL)""",
          "b_kept AS (SELECT * FROM (SELECT f.mention, row_number() OVER (PARTITION BY f.mention ORDER BY f.rank, f.qid) AS pos, f.qid, k.sitelinks FROM b_first f JOIN b_kb k ON f.qid = k.qid) WHERE pos <= 10)",
          """b_more AS (SELECT w.mention, l.qid, k.sitelinks FROM b_way w JOIN (SELECT * FROM (SELECT d.title, p.qid, row_number() OVER (PARTITION BY d.title ORDER BY l.pos, l.to_title) AS nth FROM b_page d JOIN b_link l ON d.title = l.from_title JOIN b_page p ON l.to_title = p.title WHERE d.is_disambiguation AND NOT p.is_disambiguation) WHERE nth <= 30) l
 ON w.final_title = l.title JOIN b_kb k ON l.qid = k.qid WHERE NOT EXISTS (SELECT 1 FROM b_kept x WHERE x.mention = w.mention AND x.qid = l.qid))""",
          """b_all AS (SELECT mention, pos, qid, sitelinks FROM b_kept UNION ALL SELECT * FROM (SELECT m.mention, coalesce((SELECT max(pos) FROM b_kept x WHERE x.mention = m.mention), 0) + row_number() OVER (PARTITION BY m.mention ORDER BY m.sitelinks DESC, m.qid) AS pos, m.qid, m.sitelinks FROM b_more m) WHERE pos <= 10)""",
          f"""b_match AS (SELECT c.*, list_contains([{tokens('k.label')}, {tokens('k.alias')}], {tokens('c.mention')}) AS exact, list_has_all({tokens('k.label')}, {tokens('c.mention')}) OR list_has_all({tokens('k.alias')}, {tokens('c.mention')}) AS loose FROM b_all c JOIN b_kb k ON c.qid = k.qid)""")
oracle("generate_candidates", "SELECT mention, pos, qid, sitelinks FROM b_all", *_CANDS)
oracle("link_popularity", "SELECT a.id, coalesce(c.qid, 'NIL') AS qid FROM b_asked a LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY sitelinks DESC, pos) AS nth FROM b_all) WHERE nth = 1) c ON a.mention = c.mention", *_CANDS)
oracle("link_exact_popularity", "SELECT a.id, coalesce(c.qid, 'NIL') AS qid FROM b_asked a LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY exact DESC, sitelinks DESC, pos) AS nth FROM b_match) WHERE nth = 1) c ON a.mention = c.mention", *_CANDS)
oracle("needs_expansion", "SELECT m.mention, coalesce(c.n, 0) AS n_candidates, coalesce(c.n, 0) < 3 OR NOT coalesce(c.hit, false) AS weak FROM (SELECT DISTINCT mention FROM b_asked) m LEFT JOIN (SELECT mention, count(*) AS n, bool_or(loose) AS hit FROM b_match GROUP BY mention) c ON m.mention = c.mention", *_CANDS)
oracle("candidate_evidence", f"""SELECT mention, string_agg(concat('[', pos - 1, '] ', qid, ' | ', label, ' | aliases: ', alias, ' | desc: made as ', kind, ' | type: ', lower(kind), ' | {FACTS['P17']}=', lower(kind), ' | wiki-links: ', sitelinks), chr(10) ORDER BY pos) AS evidence
 FROM (SELECT c.*, k.label, k.alias, substring(k.class, 3) AS kind FROM b_all c JOIN b_kb k ON c.qid = k.qid) GROUP BY mention""", *_CANDS)
