"""Artifact index (G1 to G8): one row of arrays and flags per repository, and a long table of keys to probe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T


def make_targets(content) -> F.Column:
    """Distinct concrete targets of a Makefile: no recipes, comments, assignments, patterns, paths or special names."""
    rule = r"(?Ud)^([^:#=]+?)\s*:(?![=])"
    lines = F.filter(T.lines(content), lambda x: ~x.rlike(r"^[\t ]") & ~x.rlike(r"(?U)^\s*#") & ~x.rlike(r"(?U)^[A-Za-z0-9_.-]+\s*[:+?]?=") & x.rlike(rule))
    names = F.flatten(F.transform(lines, lambda x: F.split(F.lower(T.strip(F.regexp_extract(x, rule, 1))), r"(?U)\s+")))
    return F.array_distinct(F.filter(names, lambda t: t.rlike(r"^[a-z0-9_.-]+$") & ~t.isin(R.SPECIAL_MAKE_TARGETS)))


def tree_side(trees: DataFrame) -> DataFrame:
    t = trees.select("full_name", T.norm_slashes("path").alias("p"), T.norm_slashes("type").alias("type")).where("p <> ''")
    file, folder = F.col("type") == "blob", F.col("type") == "tree"
    parts = T.path_parts("p")
    top = F.when(file & (F.size(parts) >= 2) | folder & (F.size(parts) >= 1), F.get(parts, 0))
    base = T.basename("p")
    flag = lambda test: F.coalesce(F.max(F.when(test, 1)), F.lit(0))
    has = lambda *names: flag(file & base.isin(*names))
    test_dir = F.exists(F.when(folder, parts).otherwise(F.array_compact(F.array(top))), lambda x: x.isin(R.TEST_DIR_NAMES))
    # the counts are the sizes of the sets: counted as distinct values beside them, each row would be made three
    return t.groupBy("full_name").agg(
        F.size(F.collect_set(F.when(file, F.col("p")))).alias("file_count"),
        F.size(F.collect_set(F.when(folder, F.col("p")))).alias("dir_count"),
        F.array_sort(F.collect_set(F.when(file, F.col("p")))).alias("all_file_paths"),
        F.array_sort(F.collect_set(F.when(file, base))).alias("all_file_basenames"),
        F.array_sort(F.collect_set(F.when(folder, F.col("p")))).alias("all_dir_paths"),
        F.array_sort(F.collect_set(top)).alias("top_level_dirs"),
        has("requirements.txt").alias("has_requirements_txt"),
        has("package.json").alias("has_package_json"),
        has("dockerfile").alias("has_dockerfile"),
        has(*R.COMPOSE_NAMES).alias("has_docker_compose"),
        has("makefile").alias("has_makefile"),
        has("pom.xml").alias("has_pom_xml"),
        has("build.gradle", "build.gradle.kts").alias("has_build_gradle"),
        has("cargo.toml").alias("has_cargo_toml"),
        has("go.mod").alias("has_go_mod"),
        flag(test_dir).alias("has_tests_dir"),
        flag(file & F.col("p").rlike(r"(^|/)test_.*\.py$|(^|/).*_test\.py$")).alias("has_py_test_files"),
        flag(file & F.col("p").endswith("_test.go")).alias("has_go_test_files"),
        flag(file & F.col("p").rlike(r"(^|/).*\.(test|spec)\.(js|jsx|ts|tsx)$")).alias("has_js_ts_test_files"),
        flag(file & F.col("p").rlike(r"(^|/).*test\.java$")).alias("has_java_test_files"),
    )


def config_side(configs: DataFrame) -> DataFrame:
    """Only one kind of rule applies to a file: a Makefile is never a workflow file as well."""
    c = configs.select("full_name", T.norm_slashes("path").alias("p"), T.norm_slashes("basename").alias("b"), "content")
    flow = F.col("p").startswith(".github/workflows/") & ~F.col("b").isin("makefile", "package.json")
    flag = lambda name: F.coalesce(F.max(F.when((F.col("b") == name) & ~flow, 1)), F.lit(0))
    return c.groupBy("full_name").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("b") == "makefile", make_targets("content")))))).alias("make_targets"),
        F.array_sort(F.collect_set(F.when(flow, F.col("p")))).alias("workflow_files"),
        F.coalesce(F.max(F.when(F.col("b") == "package.json", T.npm_test_script("content"))), F.lit(0)).alias("npm_has_test_script"),
        flag("pyproject.toml").alias("has_pyproject_toml"),
        flag("setup.cfg").alias("has_setup_cfg"),
        flag("tox.ini").alias("has_tox_ini"),
        flag("pytest.ini").alias("has_pytest_ini"),
    )


def artifact_index(trees: DataFrame, configs: DataFrame) -> DataFrame:
    """One row per repository of trees; repositories without configuration files have empty arrays and zero flags."""
    none = F.array().cast("array<string>")
    out = tree_side(trees).join(config_side(configs), "full_name", "left")
    flags = ["npm_has_test_script", "has_pyproject_toml", "has_setup_cfg", "has_tox_ini", "has_pytest_ini"]
    return out.fillna(0, flags).withColumns({"make_targets": F.coalesce("make_targets", none), "workflow_files": F.coalesce("workflow_files", none)})


def path_keys(trees: DataFrame) -> DataFrame:
    """full_name, kind, key: what may be looked up in a repository. Rows instead of arrays, so that a probe is a join on its key."""
    t = trees.select("full_name", T.norm_slashes("path").alias("p"), T.norm_slashes("type").alias("type")).where("p <> '' and type in ('blob', 'tree')")
    parts = T.path_parts("p")
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("key"))
    top = F.when((F.col("type") == "tree") & (F.size(parts) >= 1) | (F.size(parts) >= 2), F.get(parts, 0))
    of_file = F.array(key("file", F.col("p")), key("name", T.basename("p")), key("top", top))
    of_dir = F.array(key("dir", F.col("p")), key("dirname", T.basename("p")), key("top", top))
    return t.select("full_name", F.explode(F.when(F.col("type") == "blob", of_file).otherwise(of_dir)).alias("k")).select("full_name", "k.*").where("key is not null").distinct()
