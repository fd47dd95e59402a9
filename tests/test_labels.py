"""Text to labels on small repositories."""

from tidemark.operators import artifacts, baseline, claims, readme, screen, sequence

README = """# Install
```bash
$ git clone https://host.dev/o/proj.git
cd proj
pip install -r requirements.txt
python missing.py
mkdir results && python results/made.py
make build
make all
```
## Usage
Edit `config/app.yaml`, `docs/none.yml` and `~/x.py`; see [guide](docs/setup.md).
"""
TREE = [("requirements.txt", "blob"), ("Makefile", "blob"), ("config/app.yaml", "blob"), ("config", "tree"), ("docs/setup.md", "blob"), ("docs", "tree")]


def tables(spark):
    elements = readme.elements(spark.createDataFrame([("o/proj", README)], "full_name string, readme_text string"))
    repos = spark.createDataFrame([("o/proj", False)], "full_name string, curated_list_heuristic boolean")
    trees = spark.createDataFrame([("o/proj", p, t) for p, t in TREE], "full_name string, path string, type string")
    configs = spark.createDataFrame([("o/proj", "Makefile", "Makefile", "all:\n\techo\n")], "full_name string, path string, basename string, content string")
    return elements, claims.extract(elements, repos), artifacts.artifact_index(trees, configs), artifacts.path_keys(trees)


def test_labels(spark):
    elements, found, index, keys = tables(spark)
    first = baseline.baseline(found, index, keys)
    rows = {(r["claim_type"], r["artifact_or_path"]): r for r in sequence.final_labels(first, elements, index, keys).collect()}
    say = lambda *k: (rows[k]["label"], rows[k]["status"], rows[k]["label_v4"], rows[k]["verification"], rows[k]["drift_family_v4"])
    assert say("cd_dir", "proj") == ("drifted_high", "kept", "supported", "sequence", "D3")
    assert say("pip_requirements", "requirements.txt") == ("supported", "kept", "supported", "verified", "D1")
    assert say("python_script", "missing.py") == ("drifted_high", "kept", "drifted_high", "verified", "D2")
    assert say("make_target", "build") == ("supported", "kept", "drifted_medium", "verified", "D4")
    assert say("make_target", "all") == ("supported", "kept", "supported", "verified", "D4")
    assert say("artifact_ref", "config/app.yaml") == ("supported", "kept", "supported", "verified", "D8")
    assert say("artifact_ref", "docs/none.yml")[1:3] == ("kept", "drifted_high")
    assert say("local_link_ref", "docs/setup.md")[2] == "supported"
    assert rows[("artifact_ref", "~/x.py")]["reason_v4"].startswith("H3")
    assert rows[("artifact_ref", "~/x.py")]["label_v4"] is None and rows[("artifact_ref", "~/x.py")]["changed"]
    summary = baseline.label_summary(first).first()
    assert summary["total_claims"] == len(rows) and summary["has_any_drift"] == 1


def test_created_targets(spark):
    df = spark.createDataFrame([("mkdir -p a/b && git clone https://h.org/x/y.git z",), ("git clone https://h.org/x/y.git",), (None,)], "s string")
    got = [sorted(r[0]) for r in df.select(sequence.created_targets("s")).collect()]
    assert got == [["a/b", "y", "z"], ["y"], []]


def test_screen_reasons(spark):
    prose = "This project will install and run the server for you. " * 8
    repos = [("o/a", "a tool", "2024-05-01T00:00:00Z"), ("o/awesome-x", "", "2024-05-01T00:00:00Z"), ("o/c", "x", "2020-01-01T00:00:00Z"), ("o/d", "x", None), ("o/e", "x", None), ("o/f", "x", None)]
    readmes = [("o/a", prose), ("o/c", prose), ("o/d", "kurz"), ("o/f", prose)]
    trees = [(r, p, "blob") for r in ("o/a", "o/c", "o/d") for p in ("src/a.py", "src/b.py", "tests/c.py", "Makefile")]
    out = screen.screened(
        spark.createDataFrame(repos, "full_name string, description string, pushed_at string"),
        spark.createDataFrame(readmes, "full_name string, readme_text string"),
        spark.createDataFrame(trees, "full_name string, path string, type string"),
        "2024-06-01T00:00:00Z",
    )
    assert {r["full_name"]: r["skip_reason"] for r in out.collect()} == {
        "o/a": None,
        "o/awesome-x": "excluded_by_name_or_description",
        "o/c": "inactive_repo",
        "o/d": "insufficient_natural_language_for_english_check",
        "o/e": "missing_or_unreadable_readme",
        "o/f": "tree_unavailable",
    }
