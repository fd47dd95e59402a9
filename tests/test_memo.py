"""A memo against full runs: what is computed again, what is read back, what a crash leaves."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources import memo as memos
from tidemark.sources.memo import Memo

SCHEMA = "full_name string, path string, size long"


def rows(n, changed=(), gone=()):
    return [(f"r{i}", f"f{k}", 10 * i + k + (1000 if i in changed else 0)) for i in range(n) if i not in gone for k in range(i % 3 + 1)] + [(None, "x", 1)]


def stage(df):
    return df.where("size % 2 = 0").groupBy("full_name").agg(F.sum("size").alias("total"), F.count("*").alias("n"))


@pytest.fixture
def memo(spark, tmp_path):
    return Memo(spark, f"file://{tmp_path}/memo", ["full_name"], stage)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_second_run_computes_what_changed(spark, memo):
    one, two = (spark.createDataFrame(r, SCHEMA) for r in (rows(200), rows(201, changed={7, 100}, gone={3})))
    out, new = memo.run(one)
    assert result(out) == result(stage(one)) and new.count() == 201
    out, new = memo.run(two.repartition(5))
    assert result(out) == result(stage(two)) and {r["full_name"] for r in new.collect()} == {"r7", "r100", "r200"}
    out, new = memo.run(two)
    assert result(out) == result(stage(two)) and new.count() == 0
    # content that changes back is still known
    out, new = memo.run(one)
    assert result(out) == result(stage(one)) and new.count() == 0


def test_a_run_that_stopped_before_its_index(spark, memo, monkeypatch):
    one = spark.createDataFrame(rows(30), SCHEMA)
    memo.run(one.where("full_name < 'r2'"))
    whole = memo.index_path
    memo.index_path = "file:///proc/none/here"
    with pytest.raises(Exception):
        memo.run(one)
    memo.index_path = whole
    out, new = memo.run(one)
    assert result(out) == result(stage(one)) and new.count() > 0


def test_compaction_drops_old_rows_only(spark, memo):
    one, two = (spark.createDataFrame(r, SCHEMA) for r in (rows(60), rows(60, changed={6}, gone={9})))
    memo.run(one)
    memo.run(two)
    before = spark.read.parquet(memo.rows_path).count()
    assert 1 <= memo.compact(two) <= 3 and spark.read.parquet(memo.rows_path).count() < before
    out, new = memo.run(two)
    assert result(out) == result(stage(two)) and new.count() == 0
    assert memo.compact(two) == 0


def test_empty_input(spark, memo):
    none = spark.createDataFrame([], SCHEMA)
    out, new = memo.run(none)
    assert out.count() == 0 and new.count() == 0 and out.columns == ["full_name", "total", "n"]


def test_contents_are_not_shuffled_to_be_found(spark, memo, monkeypatch):
    plans = []
    memo.stage = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stage(df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        one, two = (spark.createDataFrame(r, SCHEMA) for r in (rows(200), rows(200, changed={7})))
        memo.run(one)
        out, new = memo.run(two)
        assert result(out) == result(stage(two)) and new.count() == 1
        assert "Join" not in plans[0] and "BroadcastHashJoin" in plans[1] and "hashpartitioning" not in plans[1]
        monkeypatch.setattr(memos, "MOST_SENT", 0)
        three = spark.createDataFrame(rows(200, changed={8, 9}), SCHEMA)
        out, new = memo.run(three)
        assert result(out) == result(stage(three)) and {r["full_name"] for r in new.collect()} == {"r8", "r9"} and "SortMergeJoin" in plans[2]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
