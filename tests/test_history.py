from tidemark.operators import history, validation
from tidemark.sources import tables


def test_supported_at(spark):
    trees = spark.createDataFrame([("r", "1", "src/a.py"), ("r", "1", "Makefile"), ("r", "2", "b.txt")], "full_name string, sha string, path string")
    makefiles = spark.createDataFrame([("r", "1", "all::\n\tx\nlib/x.o: y\n.PHONY: z\nv:=1\n%.o: q\n")], "full_name string, sha string, content string")
    cases = [
        ("p", "artifact_ref", "./src/a.py", "1", True), ("d", "cd_dir", "src", "1", True), ("b", "artifact_ref", "other/a.py", "1", True), ("n", "artifact_ref", "none.py", "1", False),
        ("m", "make_target", "All", "1", True), ("x", "make_target", "test", "1", False), ("y", "make_target", "all", "2", False), ("u", "artifact_ref", "a", "3", None),
    ]
    df = spark.createDataFrame([("r", c, t, a, s) for c, t, a, s, _ in cases], "full_name string, case_id string, claim_type string, artifact_or_path string, sha string")
    got = {r["case_id"]: r["supported"] for r in history.supported_at(df, trees, makefiles).collect()}
    assert got == {c: w for c, _, _, _, w in cases}


def test_commit_walk_takes_the_newest(spark):
    rows = [("r", f"s{i}", f"2024-01-{10 - i:02d}T00:00:00Z", i) for i in range(8)] + [("r", "bad", "nothing", 8)]
    out = history.commit_walk(spark.createDataFrame(rows, "full_name string, sha string, date string, newest_first int"), 3).orderBy("idx").collect()
    assert [(r["sha"], r["idx"]) for r in out] == [("s2", 0), ("s1", 1), ("s0", 2)]


def test_persistence(spark):
    def case(name, states):
        return [("r", name, i, f"2024-01-{i + 1:02d} 12:00:00", s) for i, s in enumerate(states)]

    rows = case("fixed", ["supported", "drift", "drift", "supported"]) + case("open", ["drift", "drift"]) + case("none", ["supported"] * 3) + case("short", ["drift"]) + case("gone", ["supported", "drift", "no_claim"])
    df = spark.createDataFrame(rows, "full_name string, case_id string, idx int, date string, state string").selectExpr("full_name", "case_id", "idx", "cast(date as timestamp) as date", "state")
    got = {r["case_id"]: (r["status"], r["duration_days"], r["event_fixed"], r["left_truncated"], r["fix_mode"]) for r in history.persistence(df).collect()}
    assert got == {
        "fixed": ("ok", 2, 1, 0, "artifact_restored"),
        "open": ("ok", 1, 0, 1, None),
        "none": ("no_detectable_drift", None, None, None, None),
        "short": ("too_few_commits", None, None, None, None),
        "gone": ("ok", 1, 1, 0, "claim_removed"),
    }


def test_evaluation_set(spark):
    sheet = "eval_id string, claim_type string, artifact_or_path string, coder_label string"
    a = spark.createDataFrame([("1", "t", None, "drifted"), ("2", "t", "p", "supported")], sheet)
    b = spark.createDataFrame([("1", "t", None, "drifted"), ("2", "t", "p", "drifted")], sheet)
    key = spark.createDataFrame([("1", "r", "drifted", "kept", "drifted_high"), ("2", "r", "excluded", "excluded", None)], "eval_id string, full_name string, stratum string, status string, label_v4 string")
    consensus = spark.createDataFrame([("2", "not-a-claim")], "eval_id string, consensus_label string")
    labels = spark.createDataFrame([("r", "t", None, "supported"), ("r", "t", "p", "drifted_medium")], "full_name string, claim_type string, artifact_or_path string, label string")
    got = {r["eval_id"]: (r["gold"], r["final"], r["init"]) for r in validation.evaluation_set(a, b, key, consensus, labels).collect()}
    assert got == {"1": ("drifted", "drifted", "supported"), "2": ("not-a-claim", "not-a-claim", "drifted")}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a/b", "README.md", 'line "one"\nline two, ü')], tables.SCHEMAS["readmes"])
    tables.write_csv(df, str(tmp_path / "x"))
    assert tables.read_csv(spark, str(tmp_path / "x"), "readmes").collect() == df.collect()


def test_search_results_and_fallback(spark):
    pages = spark.createDataFrame([("q", '{"items":[{"full_name":"a/b","stargazers_count":3},{"full_name":"c/d"}]}'), ("z", "{bad")], "query string, body string")
    assert [(r["query"], r["position"], r["full_name"]) for r in tables.search_results(pages).orderBy("position").collect()] == [("q", 0, "a/b"), ("q", 1, "c/d")]
    s = "full_name string, path string"
    out = tables.tree_or_fallback(spark.createDataFrame([("a", "x")], s), spark.createDataFrame([("a", "y"), ("b", "z")], s))
    assert sorted(map(tuple, out.collect())) == [("a", "x"), ("b", "z")]
    blob = spark.createDataFrame([("aGVs\nbG/", )], "content string")
    assert tables.file_contents(blob).first()["text"].startswith("hel")


def test_trees_and_makefiles_are_read_once_and_only_for_what_is_asked(spark):
    trees = spark.createDataFrame([("r", "1", "./src/a.py"), ("r", "1", None), ("r", "2", "b/c.py"), ("q", "1", "")], "full_name string, sha string, path string")
    makefiles = spark.createDataFrame([("r", "1", "all:\n"), ("q", "1", "x:\n")], "full_name string, sha string, content string")
    cases = spark.createDataFrame([("r", "1", "p", "artifact_ref", "src"), ("r", "2", "p", "artifact_ref", "src"), ("r", "2", "e", "artifact_ref", ""), ("q", "1", "m", "make_target", "x"), ("q", "2", "m", "make_target", "x")], "full_name string, sha string, case_id string, claim_type string, artifact_or_path string")
    out = history.supported_at(cases, trees.where("sha <> '9'"), makefiles)
    got = {(r["full_name"], r["sha"], r["case_id"]): r["supported"] for r in out.collect()}
    assert got == {("r", "1", "p"): True, ("r", "2", "p"): False, ("r", "2", "e"): False, ("q", "1", "m"): True, ("q", "2", "m"): None}
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("= 9)") == 1  # one pass over the trees
