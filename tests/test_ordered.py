"""Running values and exact quantiles against numpy, over many partitions and skewed groups."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, ordered, selection, survival


def test_running_values(spark):
    r = random.Random(2)
    rows = [(i // 3 - 40, i, r.choice([None, r.randint(-9, 9)]), r.choice([None, None, None, f"v{i}"])) for i in range(1000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "a int, b int, x int, s string")
    o = ordered.Ordered(df, ["a", "b"], parts=13)
    assert o.rows.select("_part").distinct().count() > 8
    got = o.running(sums={"sum": F.col("x")}, tops={"top": F.col("x")}, carried={"last": F.col("s")}, whole={"all": F.col("x")}).collect()
    total, top, last, want = 0, None, None, {}
    for a, b, x, s in sorted(rows, key=lambda t: t[:2]):
        total += x or 0
        top = x if top is None else top if x is None else max(top, x)
        last = s or last
        want[b] = (total, top, last)
    assert {g["b"]: (g["sum"], g["top"], g["last"]) for g in got} == want and {g["all"] for g in got} == {total}


def test_no_partition_is_large(spark):
    """Ranges of distinct values are even, and no window goes over all rows."""
    df = spark.range(400_000).select(((F.col("id") * 7919) % 1_000_003).alias("v"), F.lit(1).alias("c"))
    o = ordered.Ordered(df, ["v"], parts=16)
    sizes = [x["count"] for x in o.rows.groupBy("_part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 400_000 / 16
    out = o.running(sums={"rank": F.col("c")})
    assert out.agg(F.max("rank"), F.countDistinct("rank")).first()[:] == (400_000, 400_000)


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "a int, x int")
    assert ordered.Ordered(df, ["a"]).running(sums={"s": F.col("x")}).count() == 0
    assert metrics.ecdf(df, "x").count() == 0 and metrics.gini(df, "x").first()[0] is None
    one = ordered.Ordered(spark.createDataFrame([(None, 3)], "a int, x int"), ["a"]).running(sums={"s": F.col("x")}).first()
    assert one["s"] == 3


def test_as_of_over_borders(spark):
    known = [(t, f"k{t}") for t in range(0, 5000, 50)]
    asked = [(i, random.Random(i).randint(-20, 5100)) for i in range(800)] + [(900, None)]
    out = ordered.as_of(spark.createDataFrame(asked, "id int, t long"), "t", spark.createDataFrame(known, "at int, v string"), "at", "v", "found")
    got = {r["id"]: r["found"] for r in out.collect()}
    assert out.columns == ["id", "t", "found"]
    assert got == {i: None if t is None or t < 0 else f"k{min(t, 4999) // 50 * 50}" for i, t in asked}


def test_curves_over_many_values(spark):
    r = np.random.default_rng(3)
    x = r.gamma(0.6, 10.0, 5000).round(2)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    s = np.sort(x)
    n = len(s)
    assert metrics.gini(df, "v").first()[0] == pytest.approx(2 * (np.arange(1, n + 1) * s).sum() / (n * s.sum()) - (n + 1) / n)
    got = {q["v"]: q["share"] for q in metrics.ecdf(df, "v").collect()}
    assert got == pytest.approx({float(v): np.searchsorted(s, v, side="right") / n for v in s})
    days, events = (x * 10).astype(int), (np.arange(n) % 3 == 0).astype(int)
    cases = spark.createDataFrame(list(zip(days.tolist(), events.tolist())), "duration_days int, event_fixed int")
    curve = {c["time_days"]: c for c in survival.kaplan_meier(cases).collect()}
    alive = 1.0
    for t in np.unique(days):
        risk, d = int((days >= t).sum()), int(events[days == t].sum())
        alive *= 1 - d / risk
        assert (curve[t]["at_risk"], curve[t]["events"]) == (risk, d) and curve[t]["survival"] == pytest.approx(alive)


def test_pareto_folds_the_rest(spark):
    df = spark.createDataFrame([(f"k{i % (i % 30 + 1)}",) for i in range(2000)], "k string")
    counts = {}
    for row in df.collect():
        counts[row[0]] = counts.get(row[0], 0) + 1
    order = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))
    out = {r["rank"]: (r["k"], r["n"], r["cumulative"]) for r in metrics.pareto(df, "k", 5).collect()}
    assert len(out) == 6 and out[6][0] == "other" and out[6][1] == sum(n for _, n in order[5:]) and out[6][2] == 1.0
    assert [out[i + 1][:2] for i in range(5)] == order[:5] and out[2][2] == pytest.approx((order[0][1] + order[1][1]) / 2000)
    assert metrics.pareto(df, "k", 500).count() == len(order)


def test_order_number(spark):
    r = random.Random(5)
    bits = [struct.unpack("<d", struct.pack("<Q", r.getrandbits(64)))[0] for _ in range(4000)]
    x = [v for v in bits if v == v] + [0.0, -0.0, 1.0, -1.0, 2.0**-1074, -(2.0**-1074), 2.0**-1022, 2.0**-1022 - 2.0**-1074, 1.7976931348623157e308, math.inf, -math.inf, 0.1, 0.2, 0.1 + 0.2, 0.3]
    x += [2.0**k for k in range(-1074, 1024)] + [math.nextafter(2.0**k, 0) for k in range(-1073, 1024)]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", selection.order_number(F.col("x")).alias("n")).collect()
    for row in got:
        raw = struct.unpack("<q", struct.pack("<d", abs(row["x"])))[0]
        assert row["n"] == (-raw if row["x"] < 0 else raw)
    nan = spark.createDataFrame([(math.nan,)], "x double").select(selection.order_number(F.col("x"))).first()[0]
    assert nan > max(row["n"] for row in got)


@pytest.mark.parametrize("few", [50_000, 0])
def test_quantiles_with_one_skewed_group(spark, few):
    r = np.random.default_rng(1)
    groups = {"big": r.normal(0, 1e3, 20_000), "ties": r.integers(0, 3, 500).astype(float), "one": np.array([4.5]), "two": np.array([-1.0, 1e300]), "wide": 10.0 ** r.integers(-300, 300, 200), None: np.array([1.0, 2.0, 4.0])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("big", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    p = [0.0, 0.025, 0.5, 0.9, 1.0]
    got = {q["g"]: q for q in selection.exact_quantiles(df, "x", p, ["g"], few).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        assert got[g]["n"] == len(x) and got[g]["quantiles"] == pytest.approx(np.quantile(x, p).tolist(), rel=1e-12)
    whole = selection.exact_quantiles(df, "x", [0.5]).first()
    assert whole["n"] == len(rows) - 2 and whole["quantiles"][0] == pytest.approx(np.median([v for _, v in rows if v is not None]))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert selection.exact_quantiles(df, "x", [0.5]).collect()[0][:] == (0, None)
    assert selection.exact_quantiles(df.withColumn("g", F.lit(1)), "x", [0.5], ["g"]).count() == 0
