import pytest

from tidemark.operators import validation


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_adjusted_interval_draws_in_arrays(spark):
    rows = [(None if i % 50 == 0 else "ab"[i % 2], i, [None, "drifted", "supported", "not-a-claim"][i * i % 7 % 4]) for i in range(300)]
    sample = spark.createDataFrame(rows, "stratum string, eval_id long, gold string")
    strata = spark.createDataFrame([("a", 700), ("b", 90)], "stratum string, size long")
    out = validation.adjusted_interval(sample, strata, 120)
    assert tuple(out.first()) == pytest.approx(tuple(validation.adjusted_interval(sample, strata, 120, most=0).first()), rel=1e-12)
    assert "FlatMapGroupsInArrow" in plan_of(out) and "md5(" not in plan_of(out)  # no row a draw
