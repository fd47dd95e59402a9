"""Sequence-aware detector (Q1 to Q10, H1 to H9, V1 to V19).

What a README's steps create is a table of keys with the first claim after which
each exists (0: the README says so somewhere), so "was it created" is one more
probe with an order on it. The working directory a reader would be in never
changes a label (whatever exists below it has a base name that already counts);
``working_directory`` computes it as an operator of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..sources.staged import staged
from .baseline import asked_by, pairs, probed
from .claims import all_matches_of

REFS = ("artifact_ref", "local_link_ref")
SCRIPTS = ("python_script", "streamlit_run", "bash_script", "run_shell_script", "java_jar", "go_run", "node_script")


def created_targets(text: Column | str) -> Column:
    """What the commands in a text create: distinct paths, clones by the name of their URL too."""
    text = T.col(text)
    made = F.transform(all_matches_of(text, R.CREATING), T.strip_lead)
    urls = F.slice(all_matches_of(text, [R.CLONE_URL]), 1, 1)
    clones = F.transform(urls, lambda u: F.regexp_replace(T.basename(T.norm_slashes(F.regexp_replace(u, "/+$", ""))), r"\.git$", ""))
    return F.array_distinct(F.flatten(F.array(made, clones)))


def prose_created(line: Column | str) -> Column:
    return F.transform(all_matches_of(T.col(line), R.PROSE_CREATING), T.strip_lead)


def readme_created(elements: DataFrame) -> DataFrame:
    """full_name, key: all that any line of any element creates, by command or in prose."""
    each = elements.select("full_name", F.explode(T.lines("content")).alias("line"))
    return each.select("full_name", F.explode(F.flatten(F.array(created_targets("line"), prose_created("line")))).alias("key")).distinct()


def ordered(labels: DataFrame, elements: DataFrame) -> DataFrame:
    """labels with claim_order in their repository: line, place in the fenced block, order of extraction."""
    last = F.max_by("content", F.col("elem_no"))
    blocks = elements.where("elem_type = 'fenced_code'").groupBy("full_name", "line_no").agg(last.alias("_block"))
    snippet = F.lower(T.strip("snippet"))
    at = F.instr(F.lower("_block"), snippet) - 1
    place = F.when(F.col("_block").isNull(), 0).when(at >= 0, at).otherwise(10**6)
    order = Window.partitionBy("full_name").orderBy("line_no", "_place", "claim_seq")
    placed = labels.join(blocks, ["full_name", "line_no"], "left").withColumn("_place", place)
    return placed.withColumn("claim_order", F.row_number().over(order)).drop("_block", "_place")


def candidates(path: Column) -> Column:
    """The spellings under which a path may exist."""
    bare = F.regexp_replace(path, "^/+", "")
    return F.when(path == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.when(path.startswith("."), F.array(path, bare)).otherwise(F.array(path, bare, F.concat(F.lit("."), path))))
    )


def lookups(path: Column, exact: str, name: str, more: str | None = None) -> Column:
    def key(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("key"))

    return F.flatten(F.transform(candidates(path), lambda c: F.array(key(exact, c), key(name, T.basename(c)), *([key(more, c)] if more else []))))


def file_probe(path: Column) -> Column:
    return lookups(path, "file", "name")


def dir_probe(path: Column) -> Column:
    return lookups(path, "dir", "dirname", "top")


def created_table(claims: DataFrame, elements: DataFrame) -> DataFrame:
    """full_name, key, since: the claim_order from which a key counts as created."""
    said = readme_created(elements).select("full_name", "key", F.lit(0).alias("since"))
    done = claims.select("full_name", F.explode(created_targets("snippet")).alias("key"), F.col("claim_order").alias("since"))
    return said.unionByName(done).groupBy("full_name", "key").agg(F.min("since").alias("since"))


def with_created(claims: DataFrame, created: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """A boolean for each named array of keys: is one of them created by the claim's turn?"""

    def named(name: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.struct(F.lit(name).alias("probe"), x.alias("key")))

    each = F.flatten(F.array(*[named(n, v) for n, v in keys.items()]))
    asked = claims.select("full_name", "claim_seq", "claim_order", F.explode(each).alias("p")).select("full_name", "claim_seq", "claim_order", "p.*")
    hit = asked.join(created, ["full_name", "key"]).where("since <= claim_order")
    flags = hit.groupBy("full_name", "claim_seq").agg(*[F.max(F.col("probe") == n).alias(n) for n in keys])
    compose = created.where(F.col("key").rlike(R.COMPOSE_NAME)).groupBy("full_name").agg(F.min("since").alias("_compose_since"))
    out = claims.join(flags, ["full_name", "claim_seq"], "left").join(compose, "full_name", "left")
    return out.fillna(False, list(keys)).withColumn("_compose_made", F.coalesce(F.col("_compose_since") <= F.col("claim_order"), F.lit(False))).drop("_compose_since")


def verdict(cases: list[tuple]) -> Column:
    """status, label, family, verification, reason of the first case that holds."""
    names = ("status", "label", "family", "verification", "reason")
    lit = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    out = F
    for test, *values in cases:  # one flat CASE
        out = out.when(test, F.struct(*[lit(v).alias(n) for v, n in zip(values, names)]))
    return out


def final_labels(labels: DataFrame, elements: DataFrame, index: DataFrame, keys: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """labels of the baseline with status, label_v4, drift_family_v4, verification, reason_v4, drifted_v3, drifted_v4, changed.

    Claims of repositories without an index are dropped. keys is path_keys(trees). Claims in
    order and what was asked about them are written as tables on the way (see sources.staged).
    """
    art, snip, kind = F.coalesce("artifact_or_path", F.lit("")), F.coalesce("snippet", F.lit("")), F.col("claim_type")
    a, name, into, segments, dockerfile, editable, test_file, user_path, holder, url, runtime = (
        F.col(f"_{n}") for n in ("a", "base", "into", "segments", "dockerfile", "editable", "test_file", "user_path", "holder", "url", "runtime")
    )
    extract = lambda pattern: F.get(T.all_matches(snip, pattern), 0)
    is_kind = lambda *names: kind.isin(*names)
    # computed once, as columns, for the kinds whose cases read them: the cases below only refer to them
    claims = ordered(labels, elements).withColumns({"_a": T.strip_lead(art), "_dockerfile": F.when(is_kind("docker_build"), extract(R.DOCKERFILE_OF))})
    editable_of = T.strip_lead(F.btrim(F.regexp_replace(extract(R.EDITABLE_OF), R.EXTRAS, ""), F.lit("\"'")))
    test_file_of = F.get(F.regexp_extract_all(snip, F.lit(R.TEST_FILE_OF), F.lit(1)), 0)
    claims = claims.withColumns(
        {
            "_base": T.basename(a),
            "_into": F.regexp_replace(a, "^/+", ""),
            "_segments": F.array_remove(F.split(F.regexp_replace(a, "^/+|/+$", ""), "/"), ""),
            "_editable": F.when(is_kind("pip_install_editable"), editable_of),
            "_test_file": F.when(is_kind("pytest_cmd"), test_file_of),
            "_user_path": a.rlike(f"(?iu){R.USER_PATH}") | a.startswith("~"),
            "_holder": F.when(is_kind(*REFS, *SCRIPTS, "cd_dir"), a.rlike(f"(?iu){R.PLACEHOLDER}")),
            "_url": F.when(is_kind(*REFS, "bash_script", "run_shell_script"), T.is_url_residue(art, snip)),
            "_runtime": F.when(is_kind(*REFS, "cd_dir"), T.is_runtime_like(a)),
        }
    )
    # the probes and the cases read tables, so that what is planned for each stays small
    claims = staged(claims, "ordered")
    local, made = is_kind(*REFS, "pip_install_pkg"), is_kind("conda_env_create", "kubectl_apply")
    # each probe for the kinds whose cases below read it
    probes = {
        "_f": asked_by(local | made | is_kind("pip_requirements", *SCRIPTS), file_probe(a)),
        "_d": asked_by(local, dir_probe(a)),
        "_d0": asked_by(is_kind(*REFS) & (F.size(segments) == 2), dir_probe(F.coalesce(F.get(segments, 0), F.lit("")))),
        "_dt": asked_by(is_kind("cd_dir"), dir_probe(into)),
        "_fd": asked_by(is_kind("docker_build") & dockerfile.isNotNull(), file_probe(T.strip_lead(dockerfile))),
        "_ft": asked_by(is_kind("pytest_cmd") & test_file.isNotNull(), file_probe(T.strip_lead(test_file))),
        "_fe": asked_by(is_kind("pip_install_editable") & editable.isNotNull(), file_probe(editable)),
        "_de": asked_by(is_kind("pip_install_editable") & editable.isNotNull(), dir_probe(editable)),
        "_setup": asked_by(is_kind("pip_install_editable", "pip_install_pkg"), pairs(("name", F.lit("setup.py")))),
        "_cmake": asked_by(is_kind("make_cmd"), pairs(("name", F.lit("cmakelists.txt")))),
    }
    asked = staged(probed(claims, keys, probes), "probed")
    of = lambda test, *values: F.when(test, F.array(*values)).otherwise(F.array().cast("array<string>"))
    created = {"_made": of(made | is_kind("pip_install_pkg"), a), "_made_name": of(is_kind(*SCRIPTS, *REFS), a, name), "_made_into": of(is_kind("cd_dir"), into)}
    # read for both joins, made once
    asked = with_created(asked, staged(created_table(claims, elements), "created"), created)
    flags = ["has_requirements_txt", "has_dockerfile", "has_docker_compose", "has_makefile", "has_pyproject_toml", "has_setup_cfg", "has_tox_ini", "has_pytest_ini", "has_tests_dir", "has_py_test_files"]
    data = staged(asked.join(index.select("full_name", "make_targets", *flags), "full_name"), "asked")
    c = F.col
    has = lambda *names: F.greatest(*[c(n) for n in names], F.lit(0)) == 1
    ref = is_kind(*REFS)
    says = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    no_extension = ~F.coalesce(F.element_at(segments, -1), F.lit("")).rlike(R.FILE_ENDING)
    present, packaged = c("_f") | c("_d"), has("has_pyproject_toml", "has_setup_cfg") | c("_setup")
    repo_name = F.lower(F.element_at(F.split("full_name", "/", 2), -1))
    say = R.FINAL_REASONS
    out_ = lambda test, reason: (test, "excluded", None, None, None, reason)

    def either(test, ok, family, good, bad, miss="drifted_high"):
        """kept and verified, supported or not."""
        return [(test & ok, "kept", "supported", family, "verified", good), (test, "kept", miss, family, "verified", bad)]

    cases = [
        out_(ref & a.rlike(R.NO_NAME), say["h1_empty_punctuation_only_artifact"]),
        out_(ref & (url | a.isin(R.TOOL_NAMES) | name.isin(R.TOOL_NAMES)), say["h2_url_residue_or_tool_product"]),
        out_(ref & user_path, say["h3_user_filesystem_path_outside_repository"]),
        out_(ref & (holder | art.rlike(R.CAPS_PLACEHOLDER)), say["h4_placeholder_templated_path"]),
        out_(ref & (a.rlike(R.NO_PATH) | a.startswith("_.") | F.contains(a, F.lit("/_."))), say["h7_not_a_path_contains_or"]),
        out_(ref & T.strip(art).startswith("/") & no_extension & ~present, say["h8_root_anchored_extensionless_token_api"]),
        out_(
            ref & (F.size(segments) == 2) & no_extension & ~present & ~c("_d0") & ~a.startswith("."),
            say["h9_two_segment_extensionless_identifier_without"],
        ),
        out_(ref & a.rlike(R.COMPOSE_FILE) & snip.rlike(R.DOCKER_COMPOSE), say["h5_duplicate_token_from_docker_compose"]),
        out_((a != "") & ~is_kind("pip_install_pkg", "git_clone", "docker_run", "python_module") & user_path, say["h3_user_filesystem_path_outside_repository"]),
        out_(is_kind("make_cmd") & snip.rlike(R.MAKE_DASH), say["h6_natural_language_make_sentence"]),
        out_(is_kind("make_target") & (a.isin(R.PROSE_MAKE_WORDS) | a.startswith("-")), say["h6_natural_language_make_sentence"]),
        out_(is_kind("bash_script", "run_shell_script") & url, say["h2_url_residue_piped_installer_not"]),
        out_(is_kind("cd_dir") & (user_path | holder | a.rlike(R.ONE_LETTER)), say["h3_h4_cd_to_user_filesystem_or"]),
        *either(
            is_kind("pip_requirements"), has("has_requirements_txt") | (a != "") & c("_f"), "D1", say["requirements_manifest_present"],
            says(say["requirements_file_missing"], F.when(a == "", "requirements.txt").otherwise(a)),
        ),
        *either(is_kind("poetry_install"), has("has_pyproject_toml"), "D1", say["pyproject_toml_present"], say["poetry_install_but_no_pyproject_toml"]),
        *either(is_kind("conda_env_create"), c("_f") | c("_made"), "D1", says(say["env_file_present"], a), says(say["env_file_missing"], a)),
        *either(is_kind("docker_build") & dockerfile.isNotNull(), c("_fd"), "D7", say["dockerfile_present"], says(say["dockerfile_missing"], T.strip_lead(dockerfile))),
        *either(is_kind("docker_build"), has("has_dockerfile"), "D7", say["dockerfile_present"], says(say["dockerfile_missing"], a)),
        *either(is_kind("docker_compose_up", "docker_compose_build"), has("has_docker_compose") | c("_compose_made"), "D7", say["compose_file_present"], say["compose_file_missing"]),
        *either(is_kind("kubectl_apply"), c("_f") | c("_made"), "D7", says(say["manifest_present"], a), says(say["manifest_missing"], a)),
        (is_kind(*SCRIPTS) & (a == ""), "kept", "supported", "D2", "external", say["no_local_artifact_captured"]),
        (is_kind(*SCRIPTS) & holder, "kept", "uncertain", "D2", "uncertain", say["placeholder_in_script_path"]),
        (is_kind(*SCRIPTS) & c("_f"), "kept", "supported", "D2", "verified", say["script_present"]),
        (is_kind(*SCRIPTS) & c("_made_name"), "kept", "supported", "D2", "sequence", say["script_created_by_an_earlier_documented"]),
        (is_kind(*SCRIPTS), "kept", "drifted_high", "D2", "verified", says(say["script_missing"], a)),
        (is_kind("python_module"), "kept", "uncertain", "D2", "uncertain", say["module_resolution_depends_on_installation_state"]),
        (is_kind("cd_dir") & (into.isin("", ".") | into.startswith("..")), "kept", "supported", "D3", "verified", say["relative_navigation"]),
        (
            is_kind("cd_dir") & ((into == repo_name) | into.endswith(F.concat(F.lit("/"), repo_name)) | c("_made_into")),
            "kept", "supported", "D3", "sequence", say["navigation_into_the_freshly_cloned_repository"],
        ),
        (is_kind("cd_dir") & c("_dt"), "kept", "supported", "D3", "verified", say["directory_present"]),
        (is_kind("cd_dir") & runtime, "kept", "uncertain", "D3", "uncertain", says(say["directory_absent_but_runtime_generated_style"], into)),
        (is_kind("cd_dir"), "kept", "drifted_high", "D3", "verified", says(say["directory_missing"], into)),
        (is_kind("make_target") & ~has("has_makefile"), "kept", "drifted_high", "D4", "verified", say["make_target_used_but_no_makefile"]),
        (
            is_kind("make_target") & (F.size("make_targets") > 0) & ~F.array_contains("make_targets", a),
            "kept", "drifted_medium", "D4", "verified", says(say["target"], a, say["not_in_parsed_makefile_targets"]),
        ),
        (is_kind("make_target"), "kept", "supported", "D4", "verified", say["makefile_and_target_present"]),
        *either(is_kind("make_cmd"), has("has_makefile") | c("_cmake"), "D4", say["makefile_present"], say["make_used_but_no_makefile"]),
        *either(
            is_kind("pip_install_editable") & F.coalesce(editable, F.lit(".")).isin("", "."), packaged, "D5", say["packaging_manifest_present"], say["editable_install_but_no_pyproject_setup"], "drifted_medium"
        ),
        *either(is_kind("pip_install_editable"), c("_de") | c("_fe"), "D5", says(say["editable_target_present"], editable), says(say["editable_target_missing"], editable)),
        *either(is_kind("pip_install_pkg") & a.isin(".", ""), packaged, "D5", say["local_install_target_present"], say["local_install_target_missing"], "drifted_medium"),
        *either(
            is_kind("pip_install_pkg") & (a.rlike(R.PACKAGE_FILE) | F.contains(a, F.lit("/")) & ~a.rlike(R.SCHEME)),
            present | c("_made"), "D5", say["local_install_target_present"], say["local_install_target_missing"], "drifted_medium",
        ),
        (is_kind("pip_install_pkg"), "kept", "supported", None, "external", say["package_registry_install_externally_grounded"]),
        (is_kind("pytest_cmd") & c("_ft"), "kept", "supported", "D6", "verified", say["named_test_file_present"]),
        *either(
            is_kind("pytest_cmd"), has("has_tests_dir", "has_py_test_files", "has_pyproject_toml", "has_setup_cfg", "has_tox_ini", "has_pytest_ini"),
            "D6", say["test_evidence_present"], say["pytest_but_no_test_evidence"], "drifted_medium",
        ),
        *either(is_kind("tox_cmd"), has("has_tox_ini", "has_pyproject_toml"), "D6", say["tox_config_present"], say["tox_but_no_tox_ini_pyproject"], "drifted_medium"),
        (ref & present, "kept", "supported", "D8", "verified", say["artifact_present"]),
        (ref & c("_made_name"), "kept", "supported", "D8", "sequence", say["artifact_created_by_an_earlier_documented"]),
        (ref & F.contains(a, F.lit("*")), "kept", "uncertain", "D8", "uncertain", say["glob_pattern"]),
        (ref & (runtime | a.rlike(f"(?iu){R.USER_SUPPLIED}")), "kept", "uncertain", "D8", "uncertain", says(say["absent_but_runtime_generated_or_user"], a)),
        (ref, "kept", "drifted_high", "D8", "verified", says(say["local_artifact_missing"], a)),
        (F.lit(True), "kept", "supported", None, "external", say["externally_grounded_command_no_repository_artifact"]),
    ]
    drifted = lambda x: F.coalesce(x.isin("drifted_high", "drifted_medium"), F.lit(False))
    done = data.withColumn("_v", verdict(cases)).select(
        *labels.columns, c("_v.status").alias("status"), c("_v.label").alias("label_v4"), c("_v.family").alias("drift_family_v4"), c("_v.verification").alias("verification"), c("_v.reason").alias("reason_v4")
    )
    return done.select(
        "*", drifted(c("label")).alias("drifted_v3"), drifted(c("label_v4")).alias("drifted_v4"), ((c("status") == "excluded") | ~c("label").eqNullSafe(c("label_v4"))).alias("changed")
    )


def working_directory(claims: DataFrame, steps: str = "into") -> DataFrame:
    """claims (full_name, line_no, context_type, claim_order, and the directory each step goes into or null) with cwd after each.

    An island is a run of claims with one line and context; the directory starts empty in
    each and the last step so far decides ('' and '..' and '.' lead back to the start).
    """
    repo = Window.partitionBy("full_name").orderBy("claim_order")
    fresh = ~(F.lag("line_no").over(repo).eqNullSafe(F.col("line_no")) & F.lag("context_type").over(repo).eqNullSafe(F.col("context_type")))
    islands = claims.withColumn("_fresh", fresh.cast("int")).withColumn("island", F.sum("_fresh").over(repo)).drop("_fresh")
    upto = Window.partitionBy("full_name", "island").orderBy("claim_order").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col(steps).isin("", ".", ".."), "").otherwise(F.col(steps))
    return islands.withColumn("cwd", F.coalesce(F.last(step, ignorenulls=True).over(upto), F.lit("")))
