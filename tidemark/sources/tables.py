"""Declared schemas, readers and writers (S4 to S15): typed CSV and Parquet in, Parquet, CSV and JSON out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

SCHEMAS = {
    "repos": (
        "full_name string, language string, description string, stars long, forks long, open_issues long, default_branch string, created_at string, updated_at string, pushed_at string, "
        "archived boolean, readme_path string, readme_word_count int, curated_list_heuristic boolean, has_manifest int, has_container int, has_makefile int, has_workflow int, "
        "has_source_dir int, has_test_dir int, selection_reason string"
    ),
    "readmes": "full_name string, readme_path string, readme_text string",
    "trees": "full_name string, path string, type string, size long, sha string",
    "configs": "full_name string, path string, basename string, content string",
    "labels_summary": "full_name string, drifted_high long, drifted_medium long, supported long, uncertain long, total_claims long, has_any_drift int",
    "coder_sheet": "eval_id string, full_name string, claim_type string, artifact_or_path string, snippet string, coder_label string, coder_justification string, artifact_found string",
    "persistence_cases": (
        "case_id string, full_name string, claim_type string, artifact_or_path string, snippet string, first_drift_date string, first_fix_date string, fix_mode string, "
        "duration_days double, event_fixed double, left_truncated double, window_start string, window_end string, n_commits_checked int, status string"
    ),
}
SEARCH = "struct<items: array<struct<full_name: string, language: string, description: string, stargazers_count: bigint, default_branch: string, pushed_at: string>>>"


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A CSV with quoted line ends under a declared schema; rows that do not fit fail."""
    return spark.read.schema(SCHEMAS[table]).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)


def read_matching(spark: SparkSession, folder: str, pattern: str, table: str) -> DataFrame:
    """All Parquet files below a folder whose names match."""
    return spark.read.schema(SCHEMAS[table]).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).parquet(folder)


def listed_files(spark: SparkSession, folder: str, keyword: str, ending: str = ".csv", without: tuple[str, ...] = ("v4",)) -> DataFrame:
    """path, changed, size of the files anywhere below a folder whose names hold the keyword, end so, and hold none of ``without``, in any case. No file is opened."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("modificationTime").alias("changed"), F.col("length").alias("size"))
    return every.where(named_so(F.element_at(F.split("path", "/"), -1), keyword, ending, without))


def named_so(name: Column, keyword: str, ending: str, without: tuple[str, ...]) -> Column:
    low = F.lower(name)
    fits = low.contains(keyword.lower()) & low.endswith(ending.lower())
    for word in without:
        fits = fits & ~low.contains(word.lower())
    return fits


def read_found(spark: SparkSession, folder: str, keyword: str, table: str, ending: str = ".csv", without: tuple[str, ...] = ("v4",), since: str | None = None, newest: bool = False) -> DataFrame:
    """Rows of all such files (CSV or Parquet, by the ending) under a declared schema; of those changed since a time, or only the newest.

    The names are a condition on Spark's file metadata, so files that do not fit are pruned when the scan
    is planned. None that fits is an error, as a missing input would be.
    """
    found = listed_files(spark, folder, keyword, ending, without)
    if since:
        found = found.where(F.col("changed") >= F.to_timestamp(F.lit(since)))
    last = found.agg(F.count("*"), F.max_by("path", F.struct("changed", "path"))).first()
    if not last[0]:
        raise FileNotFoundError(f"no file named *{keyword}*{ending} below {folder}")
    read = spark.read.schema(SCHEMAS[table]).option("recursiveFileLookup", True)
    if ending == ".csv":
        rows = read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(folder)
    else:
        rows = read.parquet(folder)
    rows = rows.where(named_so(F.col("_metadata.file_name"), keyword, ending, without))
    if since:
        rows = rows.where(F.col("_metadata.file_modification_time") >= F.to_timestamp(F.lit(since)))
    if newest:
        rows = rows.where((F.col("_metadata.file_name") == last[1].rsplit("/", 1)[-1]) & F.col("_metadata.file_path").endswith(last[1].split(":", 1)[-1]))
    return rows


def search_results(pages: DataFrame, json_col: str = "body") -> DataFrame:
    """Landed pages of a repository search to one row a repository, with its position."""
    items = pages.select(*[c for c in pages.columns if c != json_col], F.posexplode(F.from_json(json_col, SEARCH).getField("items")).alias("position", "item"))
    return items.select(*[c for c in items.columns if c != "item"], "item.*")


def file_contents(responses: DataFrame, content_col: str = "content") -> DataFrame:
    """Base64 file bodies to text; bytes that are no UTF-8 are replaced."""
    return responses.withColumn("text", T.decoded(content_col)).drop(content_col)


def tree_or_fallback(trees: DataFrame, fallback: DataFrame) -> DataFrame:
    """The default branch's tree rows; for repositories without any, those of the other branch."""
    return trees.unionByName(fallback.join(trees.select("full_name").distinct(), "full_name", "left_anti"))


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays are written as sorted lists with ' || ' between."""
    flat = [T.joined_list(c).alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.option("header", True).option("escape", '"').csv(path)


def with_lists(df: DataFrame, *columns: str) -> DataFrame:
    """Columns that were written as ' || ' lists as arrays again."""
    return df.withColumns({c: T.split_list(c) for c in columns})


def write_metrics(df: DataFrame, path: str) -> None:
    """One JSON object for each row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
