"""Commit-history walk (P1 to P8, S17 to S20): states at commits, first state over a coarse grid, durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.staged import staged

README_NAMES = ["README.md", "readme.md", "README.rst", "README.txt", "README", "Readme.md"]


#: Distinct names asked for that are sent to all tasks.
MOST_ASKED = 20_000


def commit_walk(commits: DataFrame, most: int = 300) -> DataFrame:
    """commits (full_name, sha, date, newest_first) to their newest ``most`` a repository, idx ascending by date from 0. Bad dates are dropped."""
    recent = commits.withColumn("_k", F.row_number().over(Window.partitionBy("full_name").orderBy("newest_first"))).where(F.col("_k") <= most)
    dated = recent.withColumn("date", T.utc("date")).where("date is not null")
    return dated.withColumn("idx", F.row_number().over(Window.partitionBy("full_name").orderBy("date", F.desc("newest_first"))) - 1).drop("_k", "newest_first")


def asked_name() -> Column:
    """What a claim's artifact is looked for by: its base name. A path, a directory above one or a base name is in a tree exactly if a path holds that name, as all of them end in it."""
    return T.basename(T.norm_path("artifact_or_path"))


def only_asked(rows: DataFrame, asked: DataFrame, most: int = MOST_ASKED) -> DataFrame:
    """rows (.., name) without names that nothing asks for; if more than ``most`` distinct names are asked for, all rows, as the join that follows then drops the others."""
    names = staged(asked.select("name").distinct(), "asked")
    return rows.join(F.broadcast(names), "name", "left_semi") if names.limit(most + 1).count() <= most else rows


def readme_at(files: DataFrame) -> DataFrame:
    """files (full_name, sha, path, text) to the README of each commit: the first of the known names."""
    rank = F.array_position(F.array(*map(F.lit, README_NAMES)), F.col("path"))
    return files.where(rank > 0).groupBy("full_name", "sha").agg(F.min_by("text", rank).alias("readme_text"))


def make_targets_at(content: Column | str) -> Column:
    """Targets of a Makefile at a commit: single or double colon, paths allowed, no recipes, comments, patterns or variables."""
    rule = r"(?Ud)^([A-Za-z0-9_.\-/ ]+?)\s*::?(?!=)"
    found = F.filter(T.lines(content), lambda x: x.rlike(rule) & ~x.rlike(r"^(?:[\t #]|\.PHONY)"))
    names = F.flatten(F.transform(found, lambda x: F.split(T.strip(F.regexp_extract(x, rule, 1)), r"(?U)\s+")))
    return F.array_distinct(F.transform(F.filter(names, lambda t: (t != "") & ~t.rlike("[%$]")), F.lower))


def supported_at(cases: DataFrame, trees: DataFrame, makefiles: DataFrame) -> DataFrame:
    """cases (full_name, case_id, claim_type, artifact_or_path, sha) with supported: does the tree at the commit hold the artifact?

    trees: full_name, sha, path of files; makefiles: full_name, sha, content. A path, a
    directory above one, or an equal base name counts; a make target counts if a
    Makefile has it, or has none that can be read. Null where the commit has no tree. Trees are
    read once: a path becomes its names that are asked for, and an empty one that says there is a tree.
    """
    at = ["full_name", "sha"]
    asked = cases.select("case_id", *at, F.explode(F.array_distinct(F.array(asked_name(), F.lit("")))).alias("name"))
    names = trees.select(*at, F.explode(F.array_distinct(F.array_append(T.path_parts("path"), F.lit("")))).alias("name"))
    held = asked.join(only_asked(names, asked).distinct(), [*at, "name"]).groupBy("case_id", *at).agg(F.lit(True).alias("_tree"), F.bool_or(F.col("name") != "").alias("_there"))
    a = T.norm_path("artifact_or_path")
    of_make = cases.where("claim_type = 'make_target'").select(*at).distinct()
    made = makefiles.join(of_make, at, "left_semi").groupBy(*at).agg(F.array_distinct(F.flatten(F.collect_set(make_targets_at("content")))).alias("_targets"))
    data = cases.join(held, ["case_id", *at], "left").join(made, at, "left")
    make = F.when(F.col("_targets").isNull(), False).otherwise((F.size("_targets") == 0) | F.array_contains("_targets", a))
    there = F.when(F.col("claim_type") == "make_target", make).otherwise(F.col("_there"))
    return data.withColumn("supported", F.when(F.col("_tree"), there)).drop("_there", "_tree", "_targets")


def state(has_readme: Column, snippet_there: Column, supported: Column) -> Column:
    """A claim's state at a commit: unknown without a README, or where it can't be told whether the artifact is supported (null)."""
    there = lambda c: F.coalesce(c, F.lit(False))
    return F.when(~there(has_readme), "unknown").when(~there(snippet_there), "no_claim").when(supported.isNull(), "unknown").when(supported, "supported").otherwise("drift")


def grid(n: Column, points: int = 12) -> Column:
    """At most ``points`` positions from 0 to n-1, evenly spread, rounded down, each once."""
    step = (n - 1) / F.lit(points - 1)
    inner = F.transform(F.sequence(F.lit(0), F.lit(points - 2)), lambda i: F.floor(i * step).cast("int"))
    return F.array_distinct(F.concat(inner, F.array((n - 1).cast("int"))))


def first_on_grid(states: DataFrame, wanted: list[str], start: str | None = None) -> DataFrame:
    """full_name, case_id, found: where a claim is first found in a wanted state (null if it is not).

    Only grid positions are looked at first; between the hit and the grid position
    before it all are. A state that begins and ends between two grid positions is
    missed: that is the meaning of the walk. states: full_name, case_id, idx, state;
    ``start`` names a column with the first position to consider.
    """
    key = ["full_name", "case_id"]
    rows = states if start is None else states.where(F.col("idx") >= F.col(start))
    base = F.lit(0) if start is None else F.col(start)
    sized = rows.groupBy(*key, base.cast("int").alias("_from")).agg(F.count("*").cast("int").alias("_n"), F.collect_set(F.when(F.col("state").isin(wanted), F.col("idx") - base)).alias("_in"))
    coarse = sized.withColumn("_grid", grid(F.col("_n")))
    hit = F.array_min(F.array_intersect(F.col("_grid").cast("array<bigint>"), F.col("_in").cast("array<bigint>")))
    with_hit = coarse.withColumn("_hit", hit)
    before = F.coalesce(F.array_max(F.filter(F.col("_grid").cast("array<bigint>"), lambda g: g < F.col("_hit"))), F.lit(-1).cast("bigint"))
    found = F.array_min(F.filter(F.col("_in").cast("array<bigint>"), lambda i: (i > before) & (i <= F.col("_hit"))))
    return with_hit.select(*key, (found + F.col("_from")).alias("found"))


def persistence(states: DataFrame) -> DataFrame:
    """states (full_name, case_id, idx, date, state) to one row a case: status, dates, duration in whole days, event, truncation.

    Onset is the first drift on the grid; the fix is the first supported or no_claim
    state on a new grid that begins after it. Cases of one commit are too short; open
    ones are censored at their last commit; an onset at the first commit is left-truncated.
    """
    key = ["full_name", "case_id"]
    ends = states.groupBy(*key).agg(F.count("*").alias("n_commits_checked"), F.min("date").alias("window_start"), F.max("date").alias("window_end"))
    onset = first_on_grid(states, ["drift"]).withColumnRenamed("found", "onset")
    after = states.join(onset.where("onset is not null"), key).withColumn("_start", F.col("onset") + 1)
    fixed = first_on_grid(after, ["supported", "no_claim"], "_start").withColumnRenamed("found", "fix")
    at = lambda name: states.select(*key, F.col("idx").alias(name), F.col("date").alias(f"{name}_date"), F.col("state").alias(f"{name}_state"))
    out = ends.join(onset, key, "left").join(fixed, key, "left").join(at("onset"), [*key, "onset"], "left").join(at("fix"), [*key, "fix"], "left")
    status = F.when(F.col("n_commits_checked") < 2, "too_few_commits").when(F.col("onset").isNull(), "no_detectable_drift").otherwise("ok")
    ok = status == "ok"
    end = F.coalesce("fix_date", "window_end")
    return out.select(
        *key, status.alias("status"), "n_commits_checked", "window_start", "window_end",
        F.when(ok, F.col("onset_date")).alias("first_drift_date"),
        F.when(ok, F.col("fix_date")).alias("first_fix_date"),
        F.when(ok & F.col("fix").isNotNull(), F.when(F.col("fix_state") == "no_claim", "claim_removed").otherwise("artifact_restored")).alias("fix_mode"),
        F.when(ok, T.whole_days("onset_date", end)).alias("duration_days"),
        F.when(ok, F.col("fix").isNotNull().cast("int")).alias("event_fixed"),
        F.when(ok, (F.col("onset") == 0).cast("int")).alias("left_truncated"),
    )
