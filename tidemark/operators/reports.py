"""Text reports (S15): lines of small frames, formatted where the frames are, and what each input file is read as (S11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words of a name that say which input it is, in the order in which they are looked for, and the table each is read as.
ROUTES = {"readme_structure": "readme_structure", "artifact_index": "artifact_index", "readmes": "readmes", "trees": "trees", "configs": "configs", "repos": "repos"}


def score_line(name: Column, accuracy: Column, kappa: Column, tp: Column, fp: Column, fn: Column) -> Column:
    """One detector's scores in a line; a share of nothing reads nan."""
    share = lambda a, b: F.when(b > 0, F.format_string("%.3f", a / b)).otherwise("nan")
    three = lambda x: F.format_string("%.3f", x)
    found, real = tp + fp, tp + fn
    parts = [
        F.lit("["), name, F.lit("] accuracy="), three(accuracy), F.lit(" kappa="), three(kappa),
        F.lit(" drift P="), share(tp, found), F.format_string(" (%d/%d)", tp, found), F.lit(" R="), share(tp, real), F.format_string(" (%d/%d)", tp, real),
        F.lit(" F1="), share(2 * tp, 2 * tp + fp + fn),
    ]
    return F.concat(*parts)


def crosstab_lines(rows: DataFrame, down: str, across: str, words: list[str]) -> DataFrame:
    """place, line: a table of counts as text, one line a word of ``down`` (sorted) after a line of headings; ``words`` are the columns. Only the counts of pairs leave the rows."""
    wide = rows.groupBy(down).pivot(across, words).agg(F.count(F.lit(1))).na.fill(0)
    width = max(len(w) for w in words) + 2
    cells = F.concat(*[F.lpad(F.col(f"`{w}`").cast("string"), width, " ") for w in words])
    body = wide.select(F.coalesce(F.col(down), F.lit("")).alias("place"), F.concat(F.rpad(F.coalesce(F.col(down), F.lit("")), 16, " "), cells).alias("line"))
    head = rows.sparkSession.range(1).select(F.lit(None).cast("string").alias("place"), F.lit(" " * 16 + "".join(w.rjust(width) for w in words)).alias("line"))
    return head.union(body)


def frame_lines(frame: DataFrame, title: str) -> DataFrame:
    """line: a frame's rows as text, ``title: name=value name=value``."""
    values = [F.concat(F.lit(f"{c}="), F.coalesce(F.format_string("%.6g", F.col(c)) if t in ("double", "float") else F.col(c).cast("string"), F.lit("none"))) for c, t in frame.dtypes]
    return frame.select(F.concat(F.lit(f"{title}: "), F.concat_ws(" ", *values)).alias("line"))


def write_report(lines: DataFrame, path: str, order: list[str] | None = None) -> None:
    """The lines, in order, as one text file in a folder: reports are small."""
    (lines.orderBy(*[F.asc_nulls_first(c) for c in order]) if order else lines).coalesce(1).select("line").write.text(path)


def route(name: Column, routes: dict[str, str] = ROUTES) -> Column:
    """The table that a file of this name is read as, by the first word that it holds; null if none."""
    out = F
    for word, table in routes.items():
        out = out.when(F.lower(name).contains(word), table)
    return out.otherwise(None)


def routed(files: DataFrame, routes: dict[str, str] = ROUTES) -> DataFrame:
    """table, path of listed files (path, changed, ...), for each table the newest; files that no word fits are left out."""
    named = files.withColumn("table", route(F.element_at(F.split("path", "/"), -1), routes)).where("table is not null")
    return named.groupBy("table").agg(F.max_by("path", F.struct("changed", "path")).alias("path"))
