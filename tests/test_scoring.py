import numpy as np
import pytest
from pyspark.sql import functions as F

from linkmill.functions.stats import binomial_quantiles, bootstrap_ci, exact_sign_p, resampled_differences, sign_p, wilson_interval
from linkmill.operators import scoring
from linkmill.schemas import RUN

FIELDS = f"run string, ord long, {RUN}"


def runs(spark, rows):
    """rows: dicts of run, id, gold, qid and optional other fields."""
    names = spark.createDataFrame([], FIELDS).schema.names
    full = [tuple({"mention": "m", "initial_qid": r.get("qid"), "flagged": False, "ord": k, **r}.get(c) for c in names) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, FIELDS)


def trace(*checks, msg=""):
    return [{"step": "verify", "issues": [{"check": c, "msg": msg, "hard": False} for c in checks]}]


@pytest.mark.parametrize(("b", "c", "p"), [(0, 0, 1.0), (5, 5, 1.0), (10, 0, round(2 / 2**10, 6)), (8, 2, 0.109375), (13, 3, 0.021271), (0, 16, 3.1e-05)])
def test_sign_test(spark, b, c, p):
    assert sign_p(b, c) == p
    assert spark.createDataFrame([(b, c)], "b long, c long").select(exact_sign_p("b", "c")).first()[0] == p


def test_wilson(spark):
    df = spark.createDataFrame([(39, 640), (0, 40), (51, 51), (0, 0)], "k long, n long")
    assert [tuple(r[0]) for r in df.select(wilson_interval("k", "n")).collect()] == [(0.0449, 0.0822), (0.0, 0.0876), (0.93, 1.0), (None, None)]


def test_bootstrap(spark):
    df = spark.createDataFrame([(13, 3, 838), (0, 0, 838), (0, 0, 0)], "w long, l long, n long")
    got = [tuple(r[0]) for r in df.select(bootstrap_ci()("w", "l", "n")).collect()]
    assert got[0][0] == pytest.approx(0.004, abs=0.002) and got[0][1] == pytest.approx(0.021, abs=0.003)
    assert got[1:] == [(0.0, 0.0), (None, None)]


def test_binomial_quantiles_by_exact_sums():
    from fractions import Fraction
    from math import comb

    rng = np.random.default_rng(1)
    for n, w in ((1, 1), (5, 2), (40, 39), (200, 1), (7, 0), (9, 9), (300, 150)):
        p, u = Fraction(w, n), rng.random(200)
        below = np.cumsum([float(comb(n, k) * p**k * (1 - p) ** (n - k)) for k in range(n + 1)])
        assert binomial_quantiles(n, w / n, u).tolist() == [min(n, int((below <= x).sum())) for x in u]
    assert binomial_quantiles(0, 0.5, np.array([0.3])).tolist() == [0]
    big = binomial_quantiles(10**9, 0.3, np.array([0.0, 0.5, 1 - 2**-52]))
    assert abs(int(big[1]) - 300_000_000) < 5 and abs(int(big[0]) - int(big[1])) < 14 * 14_500 and big[2] > big[1]


def test_resamples_are_like_resampled_pairs():
    pairs = np.array([1] * 40 + [-1] * 25 + [0] * 135)
    rng = np.random.default_rng(2)
    drawn = np.array([rng.choice(pairs, len(pairs)).sum() for _ in range(4000)])
    ours = resampled_differences(40, 25, 200, 4000, 13)
    assert abs(ours.mean() - 15) < 0.6 and abs(ours.std() - drawn.std()) < 0.4
    assert (resampled_differences(40, 25, 200, 100, 13) == ours[:100]).all() and (ours[:100] != resampled_differences(40, 25, 200, 100, 14)).any()


def test_common_mentions_and_pairs(spark):
    rows = [{"run": "a", "id": str(i), "gold": "Q1", "qid": "Q1" if i < 8 else "Q2"} for i in range(10)]
    rows += [{"run": "b", "id": str(i), "gold": "Q1", "qid": "ERROR" if i == 9 else "Q1"} for i in range(10)]
    rows += [{"run": "old", "id": str(i), "gold": "Q1", "qid": "Q1"} for i in range(3)]
    got = {r.run: r for r in scoring.paired_table(runs(spark, rows), "a", n_boot=50).collect()}
    assert set(got) == {"a", "b"} and got["a"].n == got["b"].n == 9
    assert (got["b"].wins, got["b"].losses, got["a"].wins) == (1, 0, 0)
    out = spark.createDataFrame([("0",), ("0",), ("9",), ("x",)], "id string")
    assert [tuple(scoring.common_mention_counts(runs(spark, rows), e).first()) for e in (None, out)] == [(2, 10, 9, 1), (2, 10, 8, 2)]
    assert tuple(scoring.common_mention_counts(runs(spark, rows).limit(0)).first()) == (0, 0, 0, 0)


def test_last_record_counts(spark):
    rows = [{"run": "a", "id": "1", "gold": "Q1", "qid": "Q2"}, {"run": "a", "id": "1", "gold": "Q1", "qid": "Q1"}]
    assert scoring.paired_table(runs(spark, rows), n_boot=0).first().n_right == 1


def test_labels(spark):
    labels = spark.createDataFrame([("1", ["Q5"]), ("2", [])], "id string, accepted array<string>")
    rows = runs(spark, [{"run": "a", "id": i, "gold": "Q1", "qid": q} for i, q in (("1", "Q5"), ("2", "Q1"), ("3", "Q1"))])
    assert {r.id: r.ok for r in scoring.answer_correctness(rows, labels).collect()} == {"1": True, "2": False, "3": True}


def test_attribution(spark):
    rows = runs(spark, [
        {"run": "a", "id": "1", "gold": "Q1", "qid": "Q1", "initial_qid": "Q2", "trace": trace("TYPE", "LABEL")},
        {"run": "a", "id": "2", "gold": "Q1", "qid": "Q2", "initial_qid": "Q2", "trace": trace("TYPE") + trace("TYPE")},
        {"run": "a", "id": "3", "gold": "NIL", "qid": "Q2", "initial_qid": "NIL", "trace": trace("NIL")},
        {"run": "a", "id": "4", "gold": "Q1", "qid": "ERROR", "trace": trace("NIL")}])
    got = {r.check: r for r in scoring.check_attribution(rows).collect()}
    assert (got["TYPE"].fired, got["TYPE"].fixed, got["TYPE"].still_wrong, got["TYPE"].fix_rate) == (2, 1, 1, 0.5)
    assert got["LABEL"].fired_first == 0 and got["NIL"].broken == 1 and got["NIL"].fired == 1


def test_patterns(spark):
    a = runs(spark, [{"run": "a", "id": str(i), "gold": g, "qid": q} for i, (g, q) in enumerate([("Q1", "Q1"), ("Q1", "Q1"), ("Q1", "Q2"), ("Q1", "Q2")])])
    s = runs(spark, [{"run": "s", "id": str(i), "gold": "Q1", "qid": q} for i, q in enumerate(["Q1", "Q2", "Q1", "Q2"])])
    got = {r.pattern: r.mentions for r in scoring.gold_source_check(a, s).collect()}
    assert [got[p] for p in scoring.PATTERNS] == [1, 1, 1, 1, 0]


def test_nil_rule(spark):
    rows = runs(spark, [
        {"run": "a", "id": "1", "gold": "NIL", "qid": "NIL", "initial_qid": "NIL", "trace": trace("NIL", msg="see Q5 (x), Q6")},
        {"run": "a", "id": "2", "gold": "Q7", "qid": "NIL", "initial_qid": "NIL", "trace": trace("NIL", msg="see Q7")},
        {"run": "a", "id": "3", "gold": "Q8", "qid": "Q8", "initial_qid": "NIL", "trace": trace("LABEL") + trace("NIL", msg="see Q8")},
        {"run": "a", "id": "4", "gold": "Q8", "qid": "Q8", "trace": None}])
    cases = scoring.nil_rule_analysis(rows)
    assert {r.id: (r.rule, r.exact_matches) for r in cases.collect()} == {"1": ("Q5", "Q5|Q6"), "2": ("Q7", "Q7"), "3": ("Q8", "Q8")}
    s = scoring.nil_rule_summary(cases).first()
    assert (s.fired, s.kept, s.agent_right, s.rule_right, s.agent_only, s.rule_only, s.sign_p) == (3, 2, 2, 2, 1, 1, 1.0)


def test_repeats_and_groups(spark):
    rows = []
    for tag, right in (("", 6), ("@r2", 8)):
        rows += [{"run": f"ref{tag}", "id": str(i), "gold": "Q1", "qid": "Q1" if i < 5 else "Q2", "category": "x" if i % 2 else None} for i in range(10)]
        rows += [{"run": f"full{tag}", "id": str(i), "gold": "Q1", "qid": "Q1" if i < right else "Q2", "initial_qid": "Q1" if i < 5 else "Q2"} for i in range(10)]
    per, total = scoring.multi_run_summary(runs(spark, rows), "ref")
    full = {r.system: r for r in total.collect()}["full"]
    assert (full.runs, full.acc_mean, full.fixed_total, full.diff_vs_ref_mean) == (2, 0.7, 4, 0.2)
    groups = {(r.run, r.group): r.n for r in scoring.metrics_by(runs(spark, rows), "category").collect()}
    assert groups["ref", "ALL"] == 10 and groups["ref", "x"] == groups["ref", "-"] == 5


def test_results_do_not_depend_on_partitions(spark):
    rows = runs(spark, [{"run": f"r{k}", "id": str(i), "gold": f"Q{i % 3}", "qid": f"Q{(i * k) % 4}"} for k in range(3) for i in range(30)])
    a, b = (sorted(scoring.paired_table(x, "r1", n_boot=100).collect()) for x in (rows, rows.repartition(7).orderBy(F.rand(1))))
    assert a == b
