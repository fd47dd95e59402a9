"""Extraction looks at a line once and tries a pattern only where it can match; what it finds stays the same."""

import random
import re

from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.functions import text as T
from tidemark.operators import claims, readme


def test_elements_carry_headings_once(spark):
    texts = spark.createDataFrame([("r", "# One\n```py\na\n\nb\n```\n```\n```\nSee `x`\n```\nopen")], "full_name string, readme_text string")
    out = readme.elements(texts)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Window [") == 1
    rows = [(r["line_no"], r["elem_type"], r["content"], r["code_lang"]) for r in out.orderBy("line_no", "elem_no").collect()]
    assert rows == [(1, "heading", "# One", None), (2, "fenced_code", "a\n\nb", "py"), (7, "fenced_code", "", ""), (9, "inline_code", "x", None), (9, "section_line", "See `x`", None)]


def test_a_value_is_kept_without_asking_for_types(spark):
    plan = spark.range(1).select(T.let(F.col("id") + 1, lambda x: x * x).alias("y"))
    assert "element_at" in plan._jdf.queryExecution().analyzed().toString() and plan.first()[0] == 1


def test_every_match_holds_what_is_asked_for_first():
    samples = {"pip_requirements": "pip install -r x", "bash_script": "sh a/b.sh", "pytest_cmd": "py.test", "go_run": "go run a.go", "docker_compose_up": "docker-compose up", "gradle_build": "x./gradlew build", "make_cmd": "MAKE"}
    for kind, pattern, _ in R.COMMANDS:
        for text in [samples[kind]] if kind in samples else []:
            assert re.search(f"(?i){pattern}", text), kind
            for one_of in (claims.starts_of(pattern), claims.words_of(pattern), claims.ends_of(pattern)):
                assert not one_of or any(x in text.lower() for x in one_of), (kind, one_of)
    assert claims.words_of(r"\bdocker(?:\s+compose|-compose)\s+up\b") == ["up"] and claims.words_of(r"\b(?:a\s+b\s+c|d)\s+e") == ["e"]


def test_paths_start_where_a_name_starts():
    r = random.Random(7)
    (plain, quick), = claims.PATH_PATTERN.items()
    hits = 0
    for _ in range(20000):
        text = "".join(r.choice(["a", "B/", ".", "/", "..", "*", "-", " ", ".py", ".yml", "./", ",", "_", "c.json", "x"]) for _ in range(r.randint(1, 14)))
        found = [m[0] for m in re.finditer(f"(?i){plain}", text)]
        assert found == [m[0] for m in re.finditer(f"(?i){quick}", text)], text
        hits += len(found)
    assert hits > 4000


def test_what_a_line_repeats_is_named_once(spark):
    line = "Of src/a.py, src/A.py and ./src/a.py, Dockerfile or dockerfile, B.yml, b.YML. " * 30
    rows = spark.createDataFrame([(line,), (line + "é",), ("no names here.",)], "x string")
    got = [r[0] for r in rows.select(claims.text_artifacts(F.col("x"))).collect()]
    assert got == [["Dockerfile", "src/a.py", "/src/a.py", "a.py", "B.yml"]] * 2 + [[]]
