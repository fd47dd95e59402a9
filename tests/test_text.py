"""Literal cases of the text functions."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.functions import text as T
from tidemark.operators import artifacts, claims, headings


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "given, expected",
    [("./run.sh", "/run.sh"), (".github/workflows/ci.yml", "github/workflows/ci.yml"), ("`a//b`.", "a/b"), ("...", None), (None, None), ("https://x.org//a", "https://x.org//a"), ("a\\b", "a/b")],
)
def test_canonical_path(spark, given, expected):
    assert one(spark, given, T.canonical_path) == expected


@pytest.mark.parametrize(
    "given, expected",
    [("a\nb\n", ["a", "b"]), ("", []), (None, []), ("\n", [""]), ("a\r\nb\u2028c", ["a", "b", "c"]), ("a\n\n", ["a", ""])],
)
def test_lines(spark, given, expected):
    assert one(spark, given, T.lines) == expected


@pytest.mark.parametrize("given, expected", [(">> pip install x", "> pip install x"), ("$ A=1 B='x y' make all", "make all"), ("  ls ", "ls")])
def test_clean_command(spark, given, expected):
    assert one(spark, given, T.clean_command) == expected


@pytest.mark.parametrize("given, expected", [("mid - level", "level"), ("1. Clone the repository", "Clone the repository"), ("Step 3: Run", "Run"), ("Phase II - Build", "Build")])
def test_enumerator(spark, given, expected):
    assert one(spark, given, T.without_enumerator) == expected


@pytest.mark.parametrize(
    "given, expected",
    [("1. Clone the repository", "installation"), ("## How to use", "usage"), ("Docker", "deployment"), ("Open it", "usage"), ("Éloge", "other"), ("[Install](x)", "other"), ("API", "documentation")],
)
def test_section_class(spark, given, expected):
    assert one(spark, given, headings.section_class) == expected


@pytest.mark.parametrize(
    "given, expected",
    [
        ("", "unknown"), ("https://a.b/c.md", "external"), ("#top", "anchor"), ("a/b.PNG?raw=1", "image"), ("README.md#x", "local_doc"), ("src/a.py", "local_artifact"), ("src/", "local_dir"),
        ("Makefile", "local_artifact"), ("docs", "local_doc"), ("a/b", "local_path_other"), ("thing", "local_other"),
    ],
)
def test_link_type(spark, given, expected):
    assert one(spark, given, headings.link_type) == expected


@pytest.mark.parametrize(
    "given, expected",
    [
        ("bash run.sh", [("bash_script", "run.sh"), ("run_shell_script", "run.sh")]),
        ("cd ..", [("generic_command", None)]),
        ("docker build .", [("docker_build", None)]),
        ("make test", [("make_target", "test")]),
        ("make", [("make_cmd", None)]),
        ("python -m pip install numpy", [("pip_install_pkg", "numpy")]),
        ("pip install -r x", [("pip_requirements", "x")]),
        ("cd path/to", [("generic_command", None)]),
        ("git clone https://h.org/a/b.git", [("git_clone", "https://h.org/a/b.git")]),
    ],
)
def test_part_commands(spark, given, expected):
    assert [tuple(r) for r in one(spark, given, claims.part_commands)] == expected


def test_shell_text(spark):
    got = one(spark, "pip install -r x; pip install numpy\nThis is prose.\nmake a wish\n", claims.shell_claims)
    assert [(r[0], r[1], r[2]) for r in got] == [("pip_requirements", "x", "pip install -r x"), ("pip_install_pkg", "numpy", "pip install numpy")]


def test_make_targets(spark):
    text = ".PHONY: a\ntest lint:\n\techo\nX := 1\n%.o: %.c\n# c:\n a: b\nsrc/x: y\nAll : b\n.seconexpansion: q\n.secondexpansion: q\n"
    assert one(spark, text, artifacts.make_targets) == ["test", "lint", "all", ".secondexpansion"]


@pytest.mark.parametrize("given, expected", [('{"scripts":{"test":"exit 0"}}', 0), ('{"scripts":{"test":"jest"}}', 1), ("{bad", 0), ("", 0), (None, 0), ('{"scripts":{}}', 0)])
def test_npm(spark, given, expected):
    assert one(spark, given, T.npm_test_script) == expected


def test_snippet_presence(spark):
    rows = spark.createDataFrame([("A  b\nC", "a b c"), ("x", ""), (None, "a"), ("abc", "z")], "t string, s string")
    assert [r[0] for r in rows.select(T.holds_snippet("t", "s")).collect()] == [True, False, False, False]


def test_prose_and_ascii_ratio_equal_plain_passes(spark):
    r = random.Random(5)
    some = ["`", "```", "\n", "[a]", "[", "](", "(b)", "![", "](c)", "https", "http://x", "://", ")", " ", "# ", "é", "日", "word", "\u00a0", "-"]
    texts = [None, "", "é", "plain text"] + ["".join(r.choice(some) for _ in range(r.randint(0, 12))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.coalesce("t", F.lit(""))
    for pattern in R.PROSE_CUTS:
        plain = F.regexp_replace(plain, pattern, " ")
    ascii_ = F.length(F.regexp_replace("t", r"[^\x00-\x7F]", "")) / F.greatest(F.lit(1), F.length("t"))
    assert df.where(~T.prose("t").eqNullSafe(T.strip(plain)) | ~T.ascii_ratio("t").eqNullSafe(ascii_)).count() == 0
