"""Histories as validity intervals: what holds from one commit to another is one row, not one a commit.

An interval is [begin, end) in commit numbers. Points meet intervals by an equi-join on dyadic
blocks: an interval is cut into at most two blocks a level (a block of level L holds 2^L commits),
a point lies in one block of each level, so an interval of length n makes at most 2 log2(n) rows
and no range condition is left to test. No interval meets a point twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.staged import staged, tasks_of
from . import history


def dealt(rows: DataFrame, tasks: int | None, *key: str) -> DataFrame:
    """rows in so many tasks by key (as Spark deals them, without a number)."""
    return rows.repartition(tasks, *key) if tasks else rows


def from_presence(rows: DataFrame, key: list[str], at: str = "idx", tasks: int | None = None) -> DataFrame:
    """key, begin, end of rows (key, at): runs of commits that follow each other, an extent for each."""
    seen = dealt(rows.select(*key, F.col(at).cast("long").alias("_at")), tasks, *key).distinct()
    run = F.col("_at") - F.row_number().over(Window.partitionBy(*key).orderBy("_at"))
    return seen.withColumn("_run", run).groupBy(*key, "_run").agg(F.min("_at").alias("begin"), (F.max("_at") + 1).alias("end")).drop("_run")


def from_changes(changes: DataFrame, ends: DataFrame | int, key: list[str], value: list[str] | None = None) -> DataFrame:
    """key, value, begin, end of changes (full_name, idx, change, key, value) as a log gives them: A or M sets, D removes; what is never removed holds to the repository's ``end`` in ends (full_name, end), or to one number beyond all commits.

    A change that repeats what held starts nothing new.
    """
    value = value or []
    by_key = Window.partitionBy(*key).orderBy("idx")
    held = F.struct((F.col("change") != "D").alias("there"), *[F.when(F.col("change") != "D", F.col(v)).alias(v) for v in value])
    new = changes.withColumn("_held", held).withColumn("_before", F.lag("_held").over(by_key)).where(~F.col("_held").eqNullSafe(F.col("_before")))
    spans = new.withColumn("_next", F.lead("idx").over(by_key)).where("_held.there")
    ended = spans.withColumn("_end", F.lit(ends)) if isinstance(ends, int) else spans.join(ends.select("full_name", F.col("end").alias("_end")), "full_name")
    return ended.select(*key, *value, F.col("idx").cast("long").alias("begin"), F.coalesce("_next", "_end").cast("long").alias("end")).where("begin < end")


def known_commits(trees: DataFrame, walk: DataFrame, tasks: int | None = None) -> DataFrame:
    """full_name, sha, idx of a walk's commits that have a tree, and its number of rows."""
    sha = ["full_name", "sha"]
    sized = dealt(trees.select(*sha), tasks, *sha).groupBy(*sha).agg(F.count("*").alias("rows"))
    return dealt(walk.select(*sha, F.col("idx").cast("long").alias("idx")), tasks, *sha).distinct().join(sized, sha)


def changes_of(trees: DataFrame, walk: DataFrame, value: list[str] | None = None, known: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """full_name, path, value, idx, change: the log of trees (full_name, sha, path, value) over a walk's commits, A for a new or changed path, D for one that is gone. Commits without a tree change nothing. ``known`` are the ``known_commits``, if they are there already."""
    value = value or []
    known = known_commits(trees, walk) if known is None else known
    by_repo, by_path = Window.partitionBy("full_name").orderBy("idx"), Window.partitionBy("full_name", "path").orderBy("idx")
    steps = known.select("full_name", "idx").distinct().select("full_name", "idx", F.lag("idx").over(by_repo).alias("_prev"), F.lead("idx").over(by_repo).alias("_next"))
    steps = known.select("full_name", "sha", "idx").join(steps, ["full_name", "idx"])
    at = dealt(trees, tasks, "full_name", "sha").join(dealt(steps, tasks, "full_name", "sha"), ["full_name", "sha"]).select("full_name", "path", "idx", "_prev", "_next", *value)
    here = dealt(at, tasks, "full_name", "path").distinct()
    here = here.withColumns({"_was": F.lag("idx").over(by_path), "_will": F.lead("idx").over(by_path), "_old": F.lag(F.struct(F.lit(1).alias("x"), *value)).over(by_path)})
    same = F.col("_was").eqNullSafe(F.col("_prev")) & F.col("_old").eqNullSafe(F.struct(F.lit(1).alias("x"), *value))
    change = lambda idx, what, values: F.struct(*values, idx.alias("idx"), F.lit(what).alias("change"))
    added = F.when(F.col("_was").isNull() | ~same, change(F.col("idx"), "A", [F.col(v) for v in value]))
    gone = F.when(F.col("_next").isNotNull() & ~F.col("_will").eqNullSafe(F.col("_next")), change(F.col("_next"), "D", [F.lit(None).cast(trees.schema[v].dataType).alias(v) for v in value]))
    both = here.select("full_name", "path", F.explode(F.array(added, gone)).alias("_c")).where("_c is not null")
    return both.select("full_name", "path", "_c.*")


def merged(spans: DataFrame, key: list[str]) -> DataFrame:
    """key, begin, end: intervals of a key that overlap or touch as one. Those of one beginning are combined first, so a key has at most as many rows as there are commits."""
    first = spans.groupBy(*key, "begin").agg(F.max("end").alias("end"))
    reach = F.max("end").over(Window.partitionBy(*key).orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    fresh = first.withColumn("_new", F.when(reach >= F.col("begin"), 0).otherwise(1))
    isle = fresh.withColumn("_isle", F.sum("_new").over(Window.partitionBy(*key).orderBy("begin")))
    return isle.groupBy(*key, "_isle").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("_isle")


def blocks(begin: Column, end: Column, levels: int) -> Column:
    """The dyadic blocks (level, block) that make up [begin, end), for commits below 2^levels."""

    def of(level: Column) -> Column:
        size = F.pow(F.lit(2), level).cast("long")
        b, e = F.ceil(begin / size), F.floor(end / size)
        block = lambda x: F.struct(level.alias("level"), x.alias("block"))
        return F.array(F.when((b < e) & (b % 2 == 1), block(b)), F.when((b < e) & (e % 2 == 1), block(e - 1)))

    pieces = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of))
    return F.array_distinct(F.filter(pieces, lambda p: p.isNotNull()))


def at_points(points: DataFrame, spans: DataFrame, key: list[str], levels: int, idx: str = "idx") -> DataFrame:
    """points joined with the intervals of their key that hold their commit: all columns of points, and those of spans but key, begin and end."""
    cut = spans.withColumn("_piece", F.explode(blocks(F.col("begin"), F.col("end"), levels))).select(*[c for c in spans.columns if c not in ("begin", "end")], F.col("_piece.level").alias("_level"), F.col("_piece.block").alias("_block"))
    spread = points.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("_block", F.floor(F.col(idx) / F.pow(F.lit(2), F.col("_level"))))
    return spread.join(cut, [*key, "_level", "_block"]).drop("_level", "_block")


def path_names(paths: DataFrame, asked: DataFrame) -> DataFrame:
    """full_name, name, begin, end: when a path holds a name, as a directory or a file, of path intervals and the names that are asked for."""
    each = paths.select("full_name", "begin", "end", F.explode(F.array_distinct(T.path_parts("path"))).alias("name"))
    return merged(history.only_asked(each, asked), ["full_name", "name"])


def states(cases: DataFrame, walk: DataFrame, paths: DataFrame, makefiles: DataFrame, readmes: DataFrame, known: DataFrame, levels: int) -> DataFrame:
    """A claim's state at each commit of its repository, read from intervals: full_name, case_id, sha, idx, state.

    cases: full_name, case_id, claim_type, artifact_or_path, snippet. paths: full_name, path,
    begin, end; makefiles and readmes: with content, text; known: full_name, begin, end of
    commits that have a tree. Paths, Makefiles and READMEs are looked at once an interval, not once
    a commit; commits meet only what was found, all of it in one join.
    """
    a = T.norm_path("artifact_or_path")
    name, key = ["full_name"], ["full_name", "case_id"]
    asked = cases.select(*key, history.asked_name().alias("name")).where("name <> ''")
    there = merged(asked.join(path_names(paths, asked), [*name, "name"]), key)
    wanted = cases.where("claim_type = 'make_target'").select(*key, a.alias("_a"))
    targets = makefiles.join(wanted.select(*name).distinct(), name, "left_semi").withColumn("_targets", history.make_targets_at("content")).select(*name, "begin", "end", "_targets")
    made = wanted.join(targets, name).select(*key, "begin", "end", F.array_contains("_targets", F.col("_a")).alias("_has"), (F.size("_targets") > 0).alias("_some"))
    rank = F.array_position(F.array(*map(F.lit, history.README_NAMES)), F.col("path"))
    said = cases.select(*key, "snippet").join(readmes.withColumn("_rank", rank).where("_rank > 0"), name)
    said = said.select(*key, "begin", "end", "_rank", F.coalesce(T.holds_snippet("text", "snippet"), F.lit(False)).alias("_said"))
    tree = cases.select(*key).join(known, name).select(*key, "begin", "end", F.lit(True).alias("_tree"))
    spans = there.withColumn("_there", F.lit(True))
    for more in (made, said, tree):
        spans = spans.unionByName(more, allowMissingColumns=True)
    few = tasks_of(walk.count())
    points = dealt(cases.select(*key, "claim_type"), few, *name).join(dealt(walk.select(*name, "sha", F.col("idx").cast("long").alias("idx")), few, *name), name)
    tasks = tasks_of(points.count() * (levels + 1))
    some = lambda c: F.bool_or(c).alias(c)
    found = at_points(dealt(points.select(*key, "idx"), tasks, *key), dealt(spans, tasks, *key), key, levels)
    found = found.groupBy(*key, "idx").agg(some("_there"), some("_has"), some("_some"), some("_tree"), F.min_by("_said", "_rank").alias("_said"))
    all_ = dealt(points, tasks, *key).join(found, [*key, "idx"], "left")
    target = F.coalesce(F.col("_has") | ~F.col("_some"), F.lit(False))
    held = F.when(F.col("claim_type") == "make_target", target).otherwise(F.coalesce("_there", F.lit(False)))
    return all_.select(*key, "sha", "idx", history.state(F.col("_said").isNotNull(), F.col("_said"), F.when(F.col("_tree"), held)).alias("state"))


def walk_states(cases: DataFrame, walk: DataFrame, trees: DataFrame, makefiles: DataFrame, files: DataFrame) -> DataFrame:
    """``states`` from trees and files at every commit (full_name, sha, ...): their changes first, then intervals. Rows are counted and dealt to tasks by their number, as the bytes of a shuffle tell little of rows that compress well."""
    top, commits = walk.agg(F.max("idx"), F.count("*")).first()
    levels = max(int(top or 0) + 1, 1).bit_length()
    key = ["full_name", "path"]
    sha, few = ["full_name", "sha"], tasks_of(commits)
    known = staged(known_commits(trees, walk, few), "known")
    tasks = tasks_of(known.agg(F.sum("rows")).first()[0] or 0)
    changes = changes_of(trees.select("full_name", "sha", "path"), walk, known=known, tasks=tasks)
    paths = from_changes(changes, 2**levels, key)
    at = dealt(walk.select(*sha, "idx"), few, *sha)
    made = from_presence(dealt(makefiles, few, *sha).join(at, sha), ["full_name", "content"], tasks=few)
    named = files.where(F.col("path").isin(history.README_NAMES))
    texts = from_presence(dealt(named, few, *sha).join(at, sha), ["full_name", "path", "text"], tasks=few)
    return states(cases, walk, paths, made, texts, from_presence(known, ["full_name"], tasks=few), levels)
