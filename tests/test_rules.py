"""The fixtures of the SQL checks fire every rule; operators that queries call, on small inputs."""

import datetime
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import history, metrics, models, screen, survival
from tidemark.functions import rules as R
from tidemark.plans import detectors, extraction, screening

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_tables
def test_every_rule_of_the_detectors_fires(spark):
    first = {r[0] for r in detectors.baseline_rules(spark, SF).select(F.regexp_replace("reason", r"(missing|Make target).*", "$1")).distinct().collect()}
    assert len(first) == 13
    got = {tuple(r) for r in detectors.final_rules(spark, SF).select("status", "label_v4", "drift_family_v4", "verification", "reason_v4").distinct().collect()}
    reasons = " ".join(r[4] for r in got)
    for part in ("H1 ", "H2 URL residue or", "H2 URL residue (piped", "H3 ", "H3/H4", "H4 ", "H5 ", "H6 ", "H7 ", "H8 ", "H9 "):
        assert part in reasons, part
    kept = {(r[1], r[2], r[3]) for r in got if r[0] == "kept"}
    for family in ("D1", "D2", "D3", "D4", "D5", "D6", "D7", "D8"):
        assert {x for x, f, _ in kept if f == family} >= {"supported"} and {x for x, f, _ in kept if f == family} & {"drifted_high", "drifted_medium"}, family
    assert {v for _, _, v in kept} == {"verified", "sequence", "external", "uncertain"}
    heads = {tuple(r[:4]) + (r[4].split(":")[0].split("'")[0][:28],) for r in got}
    assert len(heads) >= 58


@needs_tables
def test_every_pattern_of_a_command_is_met(spark):
    got = {tuple(r) for r in extraction.extraction_rules(spark, SF).select("claim_type", "context_type").distinct().collect()}
    assert {k for k, *_ in R.COMMANDS} | {"generic_command", "artifact_ref", "local_link_ref"} == {k for k, _ in got}
    assert {c for _, c in got} == {"fenced_code", "inline_code_command", "section_line_command", "fenced_code_artifact", "inline_code_artifact", "section_line_artifact", "markdown_link"}


@needs_tables
def test_every_reason_of_the_screen_is_given(spark):
    got = {r[0] for r in screening.screened_repositories(spark, SF).select("skip_reason").distinct().collect()}
    assert len(got) == 17 and None in got  # twelve plain tests, four reasons of language, accepted
    assert {r[0] for r in screening.section_classes(spark, SF).select("section").distinct().collect()} >= {"installation", "usage", "test", "deployment", "ci", "development", "build", "other"}
    assert {r[0] for r in screening.commit_states(spark, SF).select("state").distinct().collect()} == {"unknown", "no_claim", "supported", "drift"}


def test_missing_data_is_unknown_not_drift(spark):
    rows = [(True, True, None), (True, None, True), (None, True, True), (True, True, False), (True, True, True), (False, True, False), (True, False, None)]
    df = spark.createDataFrame(rows, "r boolean, s boolean, x boolean")
    got = [r[0] for r in df.select(history.state(F.col("r"), F.col("s"), F.col("x"))).collect()]
    assert got == ["unknown", "no_claim", "unknown", "drift", "supported", "unknown", "no_claim"]


def test_a_commit_without_a_tree_is_unknown(spark):
    cases = spark.createDataFrame([("a/b", "P1", "artifact_ref", "x.py", s) for s in ("1", "2")], "full_name string, case_id string, claim_type string, artifact_or_path string, sha string")
    trees = spark.createDataFrame([("a/b", "1", "y.py")], "full_name string, sha string, path string")
    made = spark.createDataFrame([], "full_name string, sha string, content string")
    out = history.supported_at(cases, trees, made).select("sha", history.state(F.lit(True), F.lit(True), F.col("supported"))).collect()
    assert dict(map(tuple, out)) == {"1": "drift", "2": "unknown"}


def test_numbers_are_those_of_one_sort(spark):
    df = spark.createDataFrame([(f"r{i % 70}x{i}",) for i in range(300)], "full_name string")
    got = metrics.numbered(df, F.md5("full_name"), "full_name", "n", 1)
    want = {n: i + 1 for i, (n,) in enumerate(df.orderBy(F.md5("full_name")).collect())}
    assert {r["full_name"]: r["n"] for r in got.collect()} == want and got.columns == ["full_name", "n"]
    assert metrics.numbered(df.limit(0), F.md5("full_name"), "full_name", "n").count() == 0


def test_search_stops_at_its_target(spark):
    turns = spark.createDataFrame([(i, None if i % 2 else "no") for i in range(1, 10)], "turn long, skip_reason string")
    assert sorted(r["turn"] for r in screen.until_accepted(turns, 3).collect()) == [1, 2, 3, 4, 5]
    assert screen.until_accepted(turns, 6).count() == 9 and screen.until_accepted(turns.limit(0), 3).count() == 0


def test_lists_as_text(spark):
    df = spark.createDataFrame([(["b", "a"],), ([],), (None,)], "x array<string>")
    back = df.select(T.split_list(T.joined_list("x")).alias("x"))
    assert [r["x"] for r in back.collect()] == [["a", "b"], [], []]
    assert spark.range(1).select(T.split_list(F.lit("a || ||  b"))).first()[0] == ["a", "b"]


def test_durations(spark):
    df = spark.createDataFrame([(1.0, 1), (3.0, 1), (8.0, 1), (99.0, 0), (None, 1)], "duration_days double, event_fixed int")
    assert survival.durations(df).first().asDict() == {"fixed": 3, "median_days": 3.0, "mean_days": 4.0, "max_days": 8.0}


def test_walk_takes_the_newest_and_drops_bad_dates(spark):
    rows = [("a/b", str(i), f"2024-01-{i:02d}T00:00:00Z" if i != 3 else "x", -i) for i in range(1, 7)]
    out = history.commit_walk(spark.createDataFrame(rows, "full_name string, sha string, date string, newest_first long"), 4).orderBy("idx").collect()
    assert [(r["sha"], r["idx"], r["date"].replace(tzinfo=None) if r["date"].tzinfo else r["date"]) for r in out] == [(str(i), k, datetime.datetime(2024, 1, i)) for k, i in enumerate((4, 5, 6))]


def model_rows(spark):
    r = np.random.default_rng(5)
    x, z, o = r.normal(size=400), r.normal(size=400), r.normal(size=400) * 0.3
    mu = np.exp(0.4 + 0.7 * x - 0.2 * z + o)
    y = r.poisson(mu * r.gamma(2.0, 0.5, size=400))
    some = (r.random(400) < 1 / (1 + np.exp(-(0.3 + x)))).astype(int)
    data = [*zip(x.tolist(), z.tolist(), o.tolist(), y.tolist(), some.tolist())]
    return data, spark.createDataFrame(data, "x double, z double, o double, y int, some int")


def test_logistic_is_the_maximum(spark):
    data, df = model_rows(spark)
    fit = models.logistic(df, "some", ["x", "z"])
    a = np.array(data)
    design = np.column_stack((np.ones(len(a)), a[:, :2]))

    def like(b, d=design):
        eta = d @ b
        return float(np.sum(a[:, 4] * eta - np.log1p(np.exp(eta))))

    beta = np.zeros(3)
    for _ in range(60):  # plain gradient steps by a halving search, then Newton on numeric derivatives
        grad = np.array([(like(beta + h) - like(beta - h)) / 2e-5 for h in np.eye(3) * 1e-5])
        step = 1.0
        while like(beta + step * grad) < like(beta):
            step /= 2
        beta = beta + step * grad
    assert fit.coefficients == pytest.approx(beta, abs=1e-5) and fit.log_likelihood == pytest.approx(like(fit.coefficients), abs=1e-6)
    p = a[:, 4].mean()
    assert fit.null_log_likelihood == pytest.approx(400 * (p * math.log(p) + (1 - p) * math.log(1 - p)), abs=1e-6) and 0 < fit.pseudo_r2 < 1


def test_negative_binomial_is_the_maximum(spark):
    data, df = model_rows(spark)
    fit = models.negative_binomial(df, "y", ["x", "z"], "o")

    def like(b, alpha, columns):
        total, r = 0.0, 1 / alpha
        for row in data:
            mu = math.exp(b[0] + sum(v * row[c] for v, c in zip(b[1:], columns)) + row[2])
            y = row[3]
            total += math.lgamma(y + r) - math.lgamma(r) - math.lgamma(y + 1) + r * math.log(r / (r + mu)) + y * math.log(mu / (r + mu))
        return total

    b = fit.coefficients.tolist()
    best = like(b, fit.alpha, (0, 1))
    assert fit.log_likelihood == pytest.approx(best, abs=1e-4)
    for i in range(3):  # no step in any direction gains
        for d in (-1e-3, 1e-3):
            assert like([v + d * (j == i) for j, v in enumerate(b)], fit.alpha, (0, 1)) <= best
    assert max(like(b, fit.alpha * f, (0, 1)) for f in (0.998, 1.002)) <= best
    null = max(like([c], a, ()) for c in np.linspace(0.2, 1.4, 61) for a in np.linspace(0.4, 3, 66))
    assert null <= fit.null_log_likelihood <= null + 0.5 and 0 < fit.pseudo_r2 < 1
