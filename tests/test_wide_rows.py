import hashlib

from pyspark.sql import functions as F

from tidemark.operators import artifacts, baseline, claims, history, intervals, sampling
from tidemark.plans import detectors, synthetic


def customers(spark, tmp_path, n=9000):
    spark.range(n).select(F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), F.lit("m").alias("c_mktsegment")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def test_a_narrow_table_is_dealt_by_its_rows(spark, tmp_path):
    sf = customers(spark, tmp_path)
    for df in (detectors.tables(spark, sf)["trees"], synthetic.repositories(spark, sf)["readmes"]):
        assert df.rdd.getNumPartitions() >= 3 and df.select("full_name").distinct().count() == 9000


def test_a_probe_has_rows_only_for_claims_whose_rules_read_it(spark):
    rows = spark.createDataFrame([("a", "cd_dir"), ("b", "make_cmd"), (None, None)], "x string, kind string")
    asked = rows.select(F.size(baseline.asked_by(F.col("kind") == "cd_dir", baseline.pairs(("dir", F.col("x"))))).alias("n"))
    assert [r[0] for r in asked.collect()] == [1, 0, 0]


def test_counts_of_paths_do_not_multiply_rows(spark):
    trees = spark.createDataFrame([("r", "a.py", "blob"), ("r", "A.py", "blob"), ("r", "d", "tree"), ("q", "d", "tree")], "full_name string, path string, type string")
    out = artifacts.tree_side(trees)
    assert {tuple(r) for r in out.select("full_name", "file_count", "dir_count").collect()} == {("r", 1, 1), ("q", 0, 1)}
    assert "Expand" not in out._jdf.queryExecution().toString()


def test_claims_are_extracted_once(spark):
    t = "full_name string, line_no int, heading string, section_class string, context_type string, claim_type string, artifact_or_path string, snippet string, evidence_level string, claim_seq long"
    rows = [
        ("r", 1, "h", "usage", "inline_code_artifact", "artifact_ref", "src/A.py", "x", "medium", 1), ("r", 2, "h", "usage", "markdown_link", "local_link_ref", "a.py", "y", "low", 2),
        ("r", 3, "h", "usage", "fenced_code", "make_cmd", None, "make", "high", 3), ("r", 3, "h", "usage", "fenced_code", "make_cmd", None, "Make ", "high", 4), ("r", 4, "h", "usage", "fenced_code", "make_cmd", None, "make", "high", 5),
        ("r", 5, "h", "usage", "markdown_link", "local_link_ref", None, "z", "low", 6), ("r", 6, "h", "usage", "markdown_link", "local_link_ref", None, "z", "low", 7),
    ]
    out = claims.deduplicated(spark.createDataFrame(rows, t))
    assert sorted(r["claim_seq"] for r in out.collect()) == [1, 3, 5, 6, 7]
    assert "Union" not in out._jdf.queryExecution().toString()
    assert out.columns == [c.split()[0] for c in t.split(", ")]


def test_names_nobody_asks_for_make_no_rows(spark):
    paths = spark.createDataFrame([("r", "./Src/a/b.py", 0, 4), ("r", "src/c.py", 3, 9), ("q", "x/y.py", 0, 2), ("q", None, 0, 2)], "full_name string, path string, begin long, end long")
    asked = spark.createDataFrame([("r", "src"), ("q", "y.py"), ("q", "none")], "full_name string, name string")
    assert {tuple(r) for r in intervals.path_names(paths, asked).collect()} == {("r", "src", 0, 9), ("q", "y.py", 0, 2)}
    rows = spark.createDataFrame([("a",), ("b",)], "name string")
    assert history.only_asked(rows, rows.where("name = 'a'")).count() == 1 and history.only_asked(rows, rows, most=1).count() == 2


def test_commits_meet_intervals_once_and_rows_are_dealt_by_number(spark, monkeypatch):
    monkeypatch.setattr(intervals, "tasks_of", lambda count: max(1, -(-count // 40)))
    walk = spark.range(90).selectExpr("cast(id % 9 as string) as full_name", "cast(id as string) as sha", "cast(id div 9 as int) as idx")
    trees = walk.selectExpr("full_name", "sha", "'src/a.py' as path")
    files, makes = walk.selectExpr("full_name", "sha", "'README' as path", "'run' as text"), walk.selectExpr("full_name", "sha", "'all: x' as content")
    cases = walk.where("idx = 0").selectExpr("full_name", "'c' as case_id", "'artifact_ref' as claim_type", "'a.py' as artifact_or_path", "'run' as snippet")
    out = intervals.walk_states(cases, walk, trees, makes, files)
    assert out.count() == 90 and {r[0] for r in out.select("state").distinct().collect()} == {"supported"}
    joins = [x for x in out._jdf.queryExecution().analyzed().toString().splitlines() if "Join" in x and "_block#" in x]
    assert len(joins) == 1  # of points and intervals
    assert intervals.changes_of(trees, walk, tasks=7).select("full_name", "path").distinct().count() == 9


def test_a_sample_ranks_only_the_head_of_a_group(spark):
    rows = spark.range(30000).selectExpr("id as claim_seq", "case when id % 100 = 0 then null when id % 3 = 0 then 'a' when id < 7 then 'c' else 'b' end as claim_type").repartition(4)
    local = [tuple(r) for r in rows.collect()]
    by = lambda seed: lambda r: (hashlib.md5(f"{seed}|{r[0]}".encode()).hexdigest(), r[0])
    types = {t: [r for r in local if r[1] == t] for t in "abc"}
    some = [r for of in types.values() for r in sorted(of, key=by(42))[: max(1, round(50 * len(of) / 30000))]]
    out = sampling.proportional(rows, "claim_type", 50, "claim_seq")
    assert [tuple(r) for r in out.collect()] == sorted(some, key=by("42/all"))[:50]
    out = sampling.per_stratum(rows, "claim_type", {"a": 20, "b": 0, "c": 99}, "claim_seq")
    assert sorted(map(tuple, out.collect())) == sorted(sorted(types["a"], key=by(42))[:20] + types["c"])
    plan = sampling.per_stratum(rows, "claim_type", {"a": 20}, "claim_seq")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("_upto") and plan.count("Window [row_number") == 1
