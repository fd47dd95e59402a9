"""Statistics against small computations by hand and published properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import history, metrics, models, survival, validation


def test_gini_theil(spark):
    x = [0.0, 0.5, 0.5, 1.0, 0.25]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    s = sorted(x)
    n = len(s)
    assert metrics.gini(df, "v").first()[0] == pytest.approx(2 * sum((i + 1) * v for i, v in enumerate(s)) / (n * sum(s)) - (n + 1) / n)
    mu = np.mean([v for v in x if v > 0])
    assert metrics.theil(df, "v").first()[0] == pytest.approx(sum(v / mu * math.log(v / mu) for v in x if v > 0) / n)


def test_entropy(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    assert metrics.entropy(df, "v").first()[0] == pytest.approx(-(2 / 3) * math.log2(2 / 3) - (1 / 3) * math.log2(1 / 3))


def km(cases):
    out, s, v = [], 1.0, 0.0
    for t in sorted({t for t, _ in cases}):
        n, d = sum(x >= t for x, _ in cases), sum(x == t and e for x, e in cases)
        s *= 1 - d / n
        v += d / (n * (n - d)) if n > d else 0
        se = s * math.sqrt(v)
        out.append((t, n, d, s, max(0, s - 1.96 * se), min(1, s + 1.96 * se)))
    return out


@pytest.mark.parametrize("cases", [[(1, 1), (2, 0), (2, 1), (5, 0), (7, 1)], [(3, 1), (3, 1)], [(0, 0), (1, 1), (1, 1), (4, 0)], [(1, 1), (2, 1)]])
def test_kaplan_meier(spark, cases):
    df = spark.createDataFrame(cases, "duration_days int, event_fixed int")
    got = survival.kaplan_meier(df).orderBy("time_days").collect()
    for g, e in zip(got, km(cases), strict=True):
        assert tuple(g) == pytest.approx(e)


def test_survival_as_of(spark):
    curve = spark.createDataFrame([(2, 0.8), (5, 0.4)], "time_days int, survival double")
    asked = spark.createDataFrame([(1, 0), (2, 2), (3, 4), (4, 9), (5, None)], "id int, d int")
    assert [r["survival"] for r in survival.survival_at(curve, asked, "d").orderBy("id").collect()] == [1.0, 0.8, 0.8, 0.4, None]


def test_grid(spark):
    df = spark.createDataFrame([(100,), (1,), (3,)], "n int").select(history.grid(F.col("n")).alias("g"))
    got = [r["g"] for r in df.collect()]
    assert got[0] == [0, 9, 18, 27, 36, 45, 54, 63, 72, 81, 90, 99] and got[1] == [0] and got[2] == [0, 1, 2]


def test_state_between_grid_points_is_missed(spark):
    rows = [("r", "a", i, "drift" if i == 5 else "supported") for i in range(100)] + [("r", "b", i, "drift" if i >= 12 else "supported") for i in range(100)]
    df = spark.createDataFrame(rows, "full_name string, case_id string, idx int, state string")
    got = {r["case_id"]: r["found"] for r in history.first_on_grid(df, ["drift"]).collect()}
    assert got == {"a": None, "b": 12}


def test_agreement_and_detection(spark):
    rows = [("drifted", "drifted")] * 3 + [("drifted", "supported")] + [("supported", "supported")] * 4 + [("supported", "drifted")] * 2
    df = spark.createDataFrame(rows, "a string, b string")
    po, pe = 0.7, 0.4 * 0.5 + 0.6 * 0.5
    r = validation.agreement(df, "a", "b").first()
    assert (r["accuracy"], r["kappa"]) == pytest.approx((po, (po - pe) / (1 - pe)))
    d = validation.detection(df, "a", "b").first()
    assert (d["precision"], d["recall"], d["f1"]) == pytest.approx((0.6, 0.75, 6 / 9))


def test_bootstrap_counts_a_cluster_once(spark):
    df = spark.createDataFrame([(f"r{i}", 10, i % 2) for i in range(20)], "full_name string, n long, d long")
    low, high = metrics.bootstrap_repo_rate(df, 60).first()
    assert 0 < low < 0.5 < high < 1
    low, high = metrics.bootstrap_claim_rate(df, 60).first()
    assert 0 < low < 0.05 < high < 0.1


def test_models_recover_their_parameters(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=4000)
    y = (r.random(4000) < 1 / (1 + np.exp(-(0.5 + 1.2 * x)))).astype(int)
    fit = models.logistic(spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y int"), "y", ["x"])
    assert fit.coefficients == pytest.approx([0.5, 1.2], abs=0.15) and 0 < fit.pseudo_r2 < 1
    mu = np.exp(0.3 + 0.5 * x)
    counts = r.negative_binomial(2.0, 2.0 / (2.0 + mu))
    nb = models.negative_binomial(spark.createDataFrame(list(zip(x.tolist(), counts.tolist(), [0.0] * 4000)), "x double, y long, o double"), "y", ["x"], "o")
    assert nb.coefficients == pytest.approx([0.3, 0.5], abs=0.08) and nb.alpha == pytest.approx(0.5, abs=0.1)
    z = x + r.normal(size=4000)
    vif = {t: v for t, v in models.inflation(spark.createDataFrame(list(zip(x.tolist(), z.tolist())), "a double, b double"), ["a", "b"]).collect()}
    assert vif["a"] == pytest.approx(1 / (1 - np.corrcoef(x, z)[0, 1] ** 2))


def newton(x, y, rounds=60):
    """Logistic coefficients by Newton's method over all rows at once, for designs that are well conditioned."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (y - p))
    return b


def test_nearly_collinear_covariates(spark):
    """Two covariates that agree to seven digits: the same model in the first and their difference is well conditioned."""
    r = np.random.default_rng(7)
    a = r.normal(size=3000)
    b = a + 1e-7 * r.normal(size=3000)
    d = (b - a) * 1e7  # exact: near numbers subtract without rounding
    y = (r.random(3000) < 1 / (1 + np.exp(-(0.3 + 0.8 * a + 0.5 * d)))).astype(int)
    fit = models.logistic(spark.createDataFrame(list(zip(a.tolist(), b.tolist(), y.tolist())), "a double, b double, y int").repartition(5), "y", ["a", "b"])
    g = newton(np.column_stack([np.ones(3000), a, d]), y)
    want = [g[0], g[1] - 1e7 * g[2], 1e7 * g[2]]
    assert fit.coefficients == pytest.approx(want, rel=1e-8)
    # the normal equations lose what the triangle keeps
    x = np.column_stack([np.ones(3000), a, b])
    assert np.linalg.cond(x) ** 2 > 1e13


def test_triangles_of_many_tasks(spark):
    """More tasks than triangles that reach the driver, some without rows."""
    r = np.random.default_rng(2)
    x = r.normal(size=400)
    y = (r.random(400) < 0.4).astype(int)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y int")
    one, many = (models.logistic(df.repartition(n), "y", ["x"]) for n in (1, 150))
    assert many.coefficients == pytest.approx(one.coefficients, rel=1e-10) and one.coefficients == pytest.approx(newton(np.column_stack([np.ones(400), x]), y), rel=1e-8)
    with pytest.raises(ValueError, match="no rows"):
        models.logistic(df.limit(0), "y", ["x"])
