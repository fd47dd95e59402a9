import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import digests
from tidemark.operators import metrics


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("prefix", [b"", b"42:7:", b"x" * 52, b"x" * 60, b"y" * 130, "1:dé:3:".encode()])
def test_picks_are_md5(prefix):
    got = np.concatenate([p for _, p in digests.picks([prefix], 1105, 10**9)])
    assert got.tolist() == [int(hashlib.md5(prefix + str(j).encode()).hexdigest()[:8], 16) % 10**9 for j in range(1105)]


def rollup(spark):
    return spark.range(150).select(F.concat(F.lit("r"), "id").alias("full_name"), (F.col("id") % 7 + 3).alias("n"), (F.col("id") % 3).alias("d"))


@pytest.mark.parametrize("distinct", [False, True])
def test_bootstraps_draw_in_arrays(spark, distinct):
    rows = lambda most: {tuple(r) for r in metrics.round_sums(rollup(spark), 40, 42, distinct, most).select("round", "n", "d").collect()}
    assert rows(metrics.MOST_PLACES) == rows(0) and len(rows(0)) == 40
    of = metrics.bootstrap_repo_rate if distinct else metrics.bootstrap_claim_rate
    assert "FlatMapGroupsInArrow" in plan_of(of(rollup(spark), 40)) and "md5(" not in plan_of(of(rollup(spark), 40))


def test_one_pass_adds_up_in_tasks(spark):
    md5 = lambda name, b: hashlib.md5(f"42:{name}:{b}".encode()).hexdigest()
    want = {}
    for i in range(150):
        for b in range(30):
            u = int(md5(f"r{i}", b // 4)[8 * (b % 4) : 8 * (b % 4) + 8], 16)
            m = sum(u >= t for t in metrics.POISSON)
            n, d = i % 7 + 3, i % 3
            want[b] = [x + y for x, y in zip(want.get(b, [0] * 5), (m, m * n, m * d, m > 0, m > 0 and d > 0))]
    out = metrics.one_pass_rounds(rollup(spark), 30)
    assert {r[0]: list(r[1:]) for r in out.collect()} == want
    assert "Generate" not in plan_of(out)
