"""Context-free detector (B0 to B13): each claim against its repository's index, no order, no context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T

OK = "Artifact/structure support found."
DEPENDENCY, ENTRY, PATH, BUILD = "D1_dependency_file_drift", "D2_entrypoint_drift", "D3_path_directory_drift", "D5_build_or_test_drift"
TEST, CONTAINER, LOCAL = "D6_test_command_drift", "D7_container_deployment_drift", "D8_local_example_or_artifact_drift"


def probed(claims: DataFrame, keys: DataFrame, probes: dict[str, Column]) -> DataFrame:
    """claims with a boolean column for each probe: is any of its (kind, key) pairs among the repository's keys?

    probes are array<struct<kind,key>> columns. Pairs are rows of one join on
    (full_name, kind, key), so a repository's size does not matter to its claims.
    """

    def named(name: str, keys_of: Column) -> Column:
        return F.transform(keys_of, lambda x: F.struct(F.lit(name).alias("probe"), x["kind"].alias("kind"), x["key"].alias("key")))

    each = F.flatten(F.array(*[named(name, p) for name, p in probes.items()]))
    asked = claims.select("full_name", "claim_seq", F.explode(each).alias("p")).select("full_name", "claim_seq", "p.*").where("key is not null")
    found = asked.join(keys, ["full_name", "kind", "key"], "left_semi")
    flags = found.groupBy("full_name", "claim_seq").agg(*[F.max(F.col("probe") == name).alias(name) for name in probes])
    return claims.join(flags, ["full_name", "claim_seq"], "left").fillna(False, list(probes))


def pairs(*items: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in items])


def asked_by(test: Column, keys: Column) -> Column:
    """The keys of a probe, of the claims that a rule asks it for; none of others, so that the join has only rows that count."""
    return F.when(test, keys).otherwise(F.array().cast("array<struct<kind:string,key:string>>"))


def decided(cases: list[tuple[Column, str | None, str, Column | str]], default: tuple[str, str, str]) -> Column:
    """label, family, reason of the first case that holds."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    names, out = ("label", "family", "reason"), F
    for test, *values in cases:  # one flat CASE
        out = out.when(test, F.struct(*[lit(v).alias(n) for v, n in zip(values, names)]))
    return out.otherwise(F.struct(*[lit(v).alias(n) for v, n in zip(default, names)]))


def baseline(claims: DataFrame, index: DataFrame, keys: DataFrame) -> DataFrame:
    """claims with drift_family, label, reason; claims of repositories without an index are dropped."""
    a, kind = T.norm_slashes("artifact_or_path"), F.col("claim_type")
    low = F.when(a == "", F.lit(None)).otherwise(a)
    dir_of = F.regexp_replace(a, "/+$", "")
    files = asked_by(kind.isin("docker_build", "python_script", "artifact_ref", "local_link_ref"), pairs(("file", low), ("name", T.basename(low))))
    asked = probed(claims, keys, {"_file": files, "_dir": asked_by(kind.isin("cd_dir"), pairs(("dir", dir_of), ("top", dir_of)))})
    flags = ["has_requirements_txt", "has_dockerfile", "has_docker_compose", "has_makefile", "has_pyproject_toml", "has_setup_cfg", "has_tox_ini", "has_pytest_ini", "has_tests_dir", "has_py_test_files"]
    data = asked.join(index.select("full_name", "make_targets", *flags), "full_name")
    lacks = lambda name: F.col(name) == 0
    art = F.col("artifact_or_path")
    named = F.coalesce(art, F.lit("")) != ""
    missing = named & ~F.col("_file")
    target = F.lower(F.regexp_extract(T.strip("snippet"), r"(?U)^\s*make(?:\s+([A-Za-z0-9_.-]+))?\s*$", 1))
    evidence = F.expr("has_tests_dir + has_py_test_files + has_pyproject_toml + has_setup_cfg + has_tox_ini + has_pytest_ini") > 0
    text = lambda prefix, c: F.concat(F.lit(prefix), F.coalesce(c, F.lit("None")))
    is_kind = lambda *names: kind.isin(*names)
    cases = [
        (is_kind("pip_requirements") & lacks("has_requirements_txt"), "drifted_high", DEPENDENCY, "README requires requirements.txt but file is missing"),
        (is_kind("pip_requirements"), "supported", DEPENDENCY, OK),
        (is_kind("docker_build") & missing, "drifted_high", DEPENDENCY, text("docker build references missing file: ", art)),
        (is_kind("docker_build") & ~named & lacks("has_dockerfile"), "drifted_high", DEPENDENCY, "README uses docker build but Dockerfile is missing"),
        (is_kind("docker_build"), "supported", DEPENDENCY, OK),
        (is_kind("python_script") & ~F.col("_file"), "drifted_high", ENTRY, text("Referenced entrypoint missing: ", art)),
        (is_kind("python_script"), "supported", ENTRY, OK),
        (is_kind("cd_dir") & ~T.strip("artifact_or_path").isin(".", "..") & ~F.col("_dir"), "drifted_high", PATH, text("Referenced directory missing: ", T.strip("artifact_or_path"))),
        (is_kind("cd_dir"), "supported", PATH, OK),
        (is_kind("artifact_ref", "local_link_ref") & missing, "drifted_high", LOCAL, text("Referenced local artifact/path missing: ", art)),
        (is_kind("artifact_ref", "local_link_ref"), "supported", LOCAL, OK),
        (is_kind("make_cmd") & lacks("has_makefile"), "drifted_high", BUILD, "README uses make but Makefile is missing"),
        (
            is_kind("make_cmd") & (target != "") & (F.size("make_targets") > 0) & ~F.array_contains("make_targets", target),
            "drifted_medium", BUILD, F.concat(F.lit("Make target '"), target, F.lit("' not found in Makefile")),
        ),
        (is_kind("make_cmd"), "supported", BUILD, OK),
        (is_kind("pytest_cmd") & ~evidence, "drifted_medium", TEST, "README uses pytest but no test/config evidence found"),
        (is_kind("pytest_cmd"), "supported", TEST, OK),
        (is_kind("docker_compose_up") & lacks("has_docker_compose"), "drifted_high", CONTAINER, "README uses docker compose but no compose file found"),
        (is_kind("docker_compose_up"), "supported", CONTAINER, OK),
        (is_kind("poetry_install") & lacks("has_pyproject_toml"), "drifted_high", DEPENDENCY, "README uses poetry install but pyproject.toml is missing"),
        (is_kind("poetry_install"), "supported", DEPENDENCY, OK),
        (is_kind("python_module"), "uncertain", ENTRY, "Python module execution needs package-level semantic resolution beyond current static rules"),
    ]
    out = data.withColumn("_d", decided(cases, ("supported", "unknown", OK)))
    return out.select(*claims.columns, F.col("_d.family").alias("drift_family"), F.col("_d.label").alias("label"), F.col("_d.reason").alias("reason"))


def label_summary(labels: DataFrame, label_col: str = "label") -> DataFrame:
    """full_name, a count for each of the four labels, total_claims, has_any_high_drift, has_any_drift."""
    wide = labels.groupBy("full_name").agg(*[F.count_if(F.col(label_col) == v).alias(v) for v in R.LABELS])
    return wide.select(
        "*",
        F.expr("drifted_high + drifted_medium + supported + uncertain").alias("total_claims"),
        (F.col("drifted_high") > 0).cast("int").alias("has_any_high_drift"),
        (F.expr("drifted_high + drifted_medium") > 0).cast("int").alias("has_any_drift"),
    )
