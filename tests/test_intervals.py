"""Validity intervals against commit-by-commit reading."""

import random

from pyspark.sql import functions as F

from tidemark.operators import history, intervals


def test_blocks_cover_each_point_once(spark):
    r = random.Random(1)
    spans = [(i, b, b + r.randint(0, 300)) for i in range(200) for b in [r.randint(0, 900)]]
    cut = spark.createDataFrame(spans, "i int, b long, e long").select("i", "b", "e", intervals.blocks(F.col("b"), F.col("e"), 11).alias("p")).collect()
    for x in cut:
        covered = [t for p in x["p"] for t in range(p["block"] << p["level"], (p["block"] + 1) << p["level"])]
        assert sorted(covered) == list(range(x["b"], x["e"])) and len(x["p"]) <= 2 * 11


def test_points_in_intervals(spark):
    r = random.Random(4)
    spans = [(r.choice("ab"), b, b + r.randint(1, 60), i) for i in range(80) for b in [r.randint(0, 100)]]
    points = [(k, t) for k in "abc" for t in range(0, 170, 3)]
    got = intervals.at_points(spark.createDataFrame(points, "k string, idx long"), spark.createDataFrame(spans, "k string, begin long, end long, n int"), ["k"], 8).collect()
    want = sorted((k, t, n) for k, t in points for s, b, e, n in spans if s == k and b <= t < e)
    assert sorted((g["k"], g["idx"], g["n"]) for g in got) == want


def test_merged(spark):
    spans = [("x", 0, 3), ("x", 0, 2), ("x", 3, 4), ("x", 6, 9), ("x", 7, 8), ("x", 8, 12), ("y", 1, 2)]
    got = sorted((g["k"], g["begin"], g["end"]) for g in intervals.merged(spark.createDataFrame(spans, "k string, begin long, end long"), ["k"]).collect())
    assert got == [("x", 0, 4), ("x", 6, 12), ("y", 1, 2)]


def histories(seed):
    """trees, README and Makefile versions that change now and then, over 40 commits of five repositories; some commits have no tree."""
    r = random.Random(seed)
    walk, trees, makes, files = [], [], [], []
    names = [f"src/{a}/{b}.py" for a in "xyz" for b in "pq"] + ["Makefile", "docs/a.md"]
    for repo in map(str, range(5)):
        there, make, text = {names[0]}, "all: x\n", "see make all"
        for i in range(40):
            sha = f"{repo}-{i}"
            walk.append((repo, sha, i))
            there ^= {n for n in names if r.random() < 0.08}
            make = r.choice([make] * 8 + ["all: x\n", "# none\n", "lint test: y\n", None])
            text = r.choice([text] * 8 + ["see make all", "nothing here", None])
            if r.random() > 0.15:
                trees += [(repo, sha, f"./{n}") for n in there]
            makes += [(repo, sha, make)] if make is not None else []
            files += [(repo, sha, r.choice(["README", "README.md"]), text)] if text is not None else []
            files += [(repo, sha, "other.md", "x")]
    return walk, trees, makes, files


def test_states_equal_those_commit_by_commit(spark):
    walk, trees, makes, files = histories(6)
    w = spark.createDataFrame(walk, "full_name string, sha string, idx int")
    t = spark.createDataFrame(trees, "full_name string, sha string, path string")
    m = spark.createDataFrame(makes, "full_name string, sha string, content string")
    f = spark.createDataFrame(files, "full_name string, sha string, path string, text string")
    asks = [("p", "artifact_ref", "src/x/p.py", "make"), ("d", "cd_dir", "./src/y", "make all"), ("b", "artifact_ref", "else/q.py", "see"), ("m", "make_target", "all", "make all"), ("n", "make_target", "test", "see make"), ("e", "artifact_ref", "", "see")]
    cases = spark.createDataFrame([(str(k), *a) for k in range(5) for a in asks], "full_name string, case_id string, claim_type string, artifact_or_path string, snippet string")
    held = history.supported_at(cases.join(w, "full_name"), t, m).join(history.readme_at(f), ["full_name", "sha"], "left")
    from tidemark.functions import text as T

    state = history.state(F.col("readme_text").isNotNull(), T.holds_snippet("readme_text", "snippet"), F.col("supported"))
    want = sorted(map(tuple, held.select("full_name", "case_id", "sha", "idx", state.alias("state")).collect()))
    got = sorted(map(tuple, intervals.walk_states(cases, w, t, m, f).select("full_name", "case_id", "sha", F.col("idx").cast("int"), "state").collect()))
    assert got == want and len({g[-1] for g in got}) == 4
    # intervals are as many as changes, and the log read back gives the same ones
    log = intervals.changes_of(t, w)
    ends = w.groupBy("full_name").agg((F.max("idx") + 1).alias("end"))
    spans = intervals.from_changes(log, ends, ["full_name", "path"])
    assert spans.count() == log.where("change = 'A'").count() < t.count() / 4
    covered = intervals.at_points(w, spans, ["full_name"], 6).join(t.select("full_name", "sha").distinct(), ["full_name", "sha"]).select("full_name", "sha", "path")
    assert sorted(map(tuple, covered.collect())) == sorted(set(trees))


def test_a_log_with_repeats(spark):
    log = [("r", 0, "A", "a", "1"), ("r", 2, "A", "a", "1"), ("r", 3, "M", "a", "2"), ("r", 5, "D", "a", None), ("r", 7, "A", "a", "2"), ("r", 1, "D", "b", None), ("r", 4, "A", "b", None)]
    df = spark.createDataFrame(log, "full_name string, idx int, change string, path string, v string")
    ends = spark.createDataFrame([("r", 9)], "full_name string, end int")
    got = sorted((x["path"], x["v"], x["begin"], x["end"]) for x in intervals.from_changes(df, ends, ["full_name", "path"], ["v"]).collect())
    assert got == [("a", "1", 0, 3), ("a", "2", 3, 5), ("a", "2", 7, 9), ("b", None, 4, 9)]


def test_empty_histories(spark):
    w = spark.createDataFrame([], "full_name string, sha string, idx int")
    t = spark.createDataFrame([], "full_name string, sha string, path string")
    m = spark.createDataFrame([], "full_name string, sha string, content string")
    f = spark.createDataFrame([], "full_name string, sha string, path string, text string")
    c = spark.createDataFrame([("r", "c", "make_target", "a", "b")], "full_name string, case_id string, claim_type string, artifact_or_path string, snippet string")
    assert intervals.walk_states(c, w, t, m, f).count() == 0
    one = spark.createDataFrame([("r", "s", 0)], "full_name string, sha string, idx int")
    assert [x["state"] for x in intervals.walk_states(c, one, t, m, f).collect()] == ["unknown"]
