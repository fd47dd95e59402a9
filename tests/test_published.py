"""Published figures recomputed from published counts.

Fixed values: durations in days with their events (1 fixed, 0 open) and truncation, numbers of
claims by type and of drifted claims by family, confusion matrices (found x gold).
"""

import pytest

from tidemark.operators import metrics, survival, validation

CASES = [
    (3, 0, 0), (413, 0, 0), (1349, 0, 1), (803, 0, 1), (1798, 0, 0), (557, 0, 0), (628, 0, 1), (732, 0, 0), (249, 0, 0), (1449, 0, 1), (31, 1, 0), (30, 0, 1), (636, 0, 1), (156, 0, 1), (196, 1, 1), (192, 0, 0),
    (217, 0, 0), (6, 0, 1), (0, 0, 0), (1344, 0, 0), (3805, 0, 0), (2122, 0, 0), (130, 1, 1), (2203, 0, 0), (1105, 0, 0), (842, 0, 0), (0, 1, 0), (5, 0, 1), (151, 0, 1), (181, 0, 0), (1, 0, 0), (2029, 0, 1),
    (184, 0, 0), (10, 1, 1), (2743, 0, 0), (926, 0, 0), (53, 0, 1), (1705, 1, 0), (1098, 0, 0), (1243, 0, 1), (397, 0, 1), (51, 1, 1), (859, 0, 1), (63, 0, 1), (1639, 0, 0), (136, 0, 0), (190, 0, 1),
]
BY_TYPE = [2348, 855, 755, 609, 396, 323, 268, 260, 251, 162, 151, 144, 94, 76, 70, 59, 40, 34, 31, 25, 13, 13, 12, 10, 9, 8, 3, 3, 3, 3, 1, 1, 1, 1, 1, 1]
BY_FAMILY = {"D8": 146, "D4": 34, "D3": 26, "D2": 22, "D5": 13, "D1": 3, "D6": 2}
NAMES = ["drifted", "not-a-claim", "supported", "uncertain"]
DEVELOPMENT = [[5, 3, 1, 1], [0, 23, 3, 1], [2, 11, 101, 5], [0, 3, 0, 41]]
EVALUATION = [[13, 24, 20, 22], [0, 25, 4, 1], [1, 3, 60, 2], [0, 0, 23, 2]]


def test_persistence_curve(spark):
    cases = spark.createDataFrame(CASES, "duration_days int, event_fixed int, left_truncated int")
    curve = survival.kaplan_meier(cases)
    last = curve.orderBy("time_days", ascending=False).first()
    assert curve.count() == 46
    assert (last["survival"], last["ci_low"], last["ci_high"]) == pytest.approx((0.7263515912044343, 0.4858743144764448, 0.9668288679324236), abs=1e-12)
    year = spark.createDataFrame([(365,)], "d int")
    assert survival.survival_at(curve, year, "d").first()["survival"] == pytest.approx(0.8474101897385066, abs=1e-12)
    whole = survival.survival_summary(survival.kaplan_meier(cases.where("left_truncated = 0"))).first()
    assert whole["median_days"] is None and whole["end_survival"] == pytest.approx(0.764860, abs=1e-6) and whole["events"] == 3


def test_entropies(spark):
    types = spark.createDataFrame([(f"t{i}", n) for i, n in enumerate(BY_TYPE)], "t string, n int").selectExpr("t", "explode(sequence(1, n))")
    families = spark.createDataFrame(list(BY_FAMILY.items()), "f string, n int").selectExpr("f", "explode(sequence(1, n))")
    assert metrics.entropy(types, "t").first()["entropy_bits"] == pytest.approx(3.410048, abs=1e-6)
    assert metrics.entropy(families, "f").first()["entropy_bits"] == pytest.approx(1.853622, abs=1e-6)
    rows = families.selectExpr("f", "'drifted_high' as label")
    assert {r["f"]: r["share_pct"] for r in metrics.family_shares(rows, "f").collect()} == {"D8": 59.3, "D4": 13.8, "D3": 10.6, "D2": 8.9, "D5": 5.3, "D1": 1.2, "D6": 0.8}


@pytest.mark.parametrize("matrix, accuracy, kappa, f1", [(DEVELOPMENT, 0.850, 0.753, 0.588), (EVALUATION, 0.500, 0.324, 0.280)])
def test_detector_scores(spark, matrix, accuracy, kappa, f1):
    rows = [(NAMES[i], NAMES[j]) for i, line in enumerate(matrix) for j, n in enumerate(line) for _ in range(n)]
    df = spark.createDataFrame(rows, "found string, gold string")
    r = validation.agreement(df, "found", "gold").first()
    assert (r["n"], round(r["accuracy"], 3), round(r["kappa"], 3)) == (200, accuracy, kappa)
    assert round(validation.detection(df, "gold", "found").first()["f1"], 3) == f1
