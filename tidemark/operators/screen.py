"""Corpus screening (F1 to F21): one reason column for the first failing test, pools and round robin by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T


def search_queries(languages: DataFrame, today: str) -> DataFrame:
    """language, star_low, star_high, query, stratum: for each row's language every star band with every push window before ``today``. Both lists are fixed and short, so a row is made into eight, not joined."""
    language = F.col("language")
    day = lambda n: F.date_format(F.date_sub(F.to_date(F.lit(today)), n), "yyyy-MM-dd")
    each = []
    for low, high in R.STAR_BANDS:
        for newest, oldest in R.PUSH_WINDOWS:
            query = F.concat(F.lit("language:"), language, F.lit(f" fork:false archived:false stars:{low}..{high} pushed:"), day(oldest), F.lit(".."), day(newest))
            stratum = F.concat(language, F.lit(f"|stars:{low}-{high}|pushed:{newest}-{oldest}d"))
            each.append(F.struct(F.lit(low).cast("long").alias("star_low"), F.lit(high).cast("long").alias("star_high"), query.alias("query"), stratum.alias("stratum")))
    return languages.select("language", F.inline(F.array(*each)))


def language_reason(text: Column | str) -> Column:
    """Why a text does not pass as English prose; null if it does."""
    def reason(p: Column, tokens: Column) -> Column:
        return (
            F.when(F.size(tokens) < R.MIN_ALPHA_TOKENS, "insufficient_natural_language_for_english_check")
            .when(T.ascii_ratio(p) < R.MIN_ASCII_RATIO, "non_english_readme_low_ascii_ratio")
            .when(T.function_ratio(tokens) < R.MIN_FUNCTION_RATIO, "weak_english_function_word_signal")
            .when(T.alpha_ratio(tokens, p) < R.MIN_ALPHA_RATIO, "readme_too_code_or_markup_heavy")
        )

    return T.let(T.prose(text), lambda p: T.let(T.alpha_tokens(p), lambda tokens: reason(p, tokens)))


def excluded_by_name(full_name: Column | str, description: Column | str) -> Column:
    text = F.lower(F.concat(T.col(full_name), F.lit(" "), F.coalesce(T.col(description), F.lit(""))))
    return text.rlike("(?iuU)" + "|".join(R.NAME_PATTERNS + R.DESCRIPTION_PATTERNS))


def is_curated_list(text: Column | str) -> Column:
    t = F.coalesce(T.col(text), F.lit(""))
    links = [F.lit(f"(?imUd){p}") for p in (R.BULLET_LINK, R.NUMBERED_LINK)]
    count = F.regexp_count(t, links[0]) + F.regexp_count(t, links[1])
    return (count >= R.MIN_LIST_LINKS) & ((count > 0) | t.rlike("(?iU)" + "|".join(R.CURATED_PHRASES)))


def tree_summary(trees: DataFrame) -> DataFrame:
    """full_name and what a repository's paths say: counts and 0/1 flags. One aggregation over the tree rows."""
    t = trees.where("path is not null and path <> ''").withColumn("p", F.lower(F.translate("path", "\\", "/")))
    file, folder = F.col("type") == "blob", F.col("type") == "tree"
    name, top = T.basename("p"), F.get(F.split("p", "/"), 0)
    top = F.when(file & ~F.contains("p", F.lit("/")), F.lit(None)).when(file | folder, top)
    flag = lambda test: F.coalesce(F.max(F.when(test, 1)), F.lit(0))
    some_dir = lambda names: flag(top.isin(names) | (folder & F.col("p").isin(names)))
    docs = sum((some_dir([d]) for d in R.DOC_DIRS[1:]), some_dir([R.DOC_DIRS[0]]))
    return (
        t.groupBy("full_name")
        .agg(
            F.count_distinct(F.when(file, F.col("p"))).alias("file_count"),
            F.count_distinct(F.when(folder, F.col("p"))).alias("dir_count"),
            F.count_distinct(F.when(file & F.col("p").endswith(".py"), F.col("p"))).alias("py_file_count"),
            F.count_distinct(F.when(file & F.col("p").endswith(".ipynb"), F.col("p"))).alias("notebook_count"),
            flag(file & name.isin(R.CONFIG_NAMES)).alias("has_manifest"),
            flag(file & name.isin(R.CONTAINER_NAMES)).alias("has_container"),
            flag(file & (name == "makefile")).alias("has_makefile"),
            flag(file & F.col("p").startswith(".github/workflows/")).alias("has_workflow"),
            some_dir(R.SOURCE_DIRS).alias("has_source_dir"),
            some_dir(R.TEST_DIRS).alias("has_test_dir"),
            docs.alias("doc_dir_count"),
        )
        .withColumn("has_python_files", (F.col("py_file_count") > 0).cast("int"))
        .withColumn("has_notebook_only", ((F.col("notebook_count") > 0) & (F.col("py_file_count") == 0)).cast("int"))
        .withColumn("structural_score", F.expr("has_source_dir + has_test_dir + has_manifest + has_workflow + has_container + has_makefile"))
    )


def screened(repos: DataFrame, readmes: DataFrame, trees: DataFrame, now: str) -> DataFrame:
    """repos with skip_reason: the first test that fails, cheap ones first; null if accepted."""
    data = repos.join(readmes.select("full_name", "readme_text"), "full_name", "left").join(tree_summary(trees), "full_name", "left")
    about = F.lower(F.concat("full_name", F.lit(" "), F.coalesce("description", F.lit(""))))
    age = T.whole_days(T.utc("pushed_at"), F.to_timestamp(F.lit(now)))
    tests = [
        (excluded_by_name("full_name", "description"), "excluded_by_name_or_description"),
        (F.coalesce("readme_text", F.lit("")) == "", "missing_or_unreadable_readme"),
        (language_reason("readme_text").isNotNull(), language_reason("readme_text")),
        (is_curated_list("readme_text"), "curated_list_heuristic"),
        (F.col("file_count").isNull(), "tree_unavailable"),
        (age > R.MAX_PUSH_AGE_DAYS, "inactive_repo"),
        (T.word_count("readme_text") < R.MIN_README_WORDS, "readme_too_short"),
        (about.rlike(f"(?iuU){R.NON_PROJECT}"), "non_project_repo_semantics"),
        (F.col("has_notebook_only") == 1, "notebook_only_repo"),
        (F.col("has_python_files") == 0, "no_python_files"),
        ((F.col("py_file_count") < 3) & (F.col("structural_score") < 2), "insufficient_substantive_code"),
        (F.col("structural_score") < 2, "insufficient_software_structure"),
        ((F.col("doc_dir_count") >= 2) & (F.col("structural_score") < 3), "doc_heavy_structure"),
    ]
    reason = F.coalesce(*[F.when(test, value if isinstance(value, Column) else F.lit(value)) for test, value in tests])
    return data.withColumn("skip_reason", reason)


def skip_log(screen: DataFrame) -> DataFrame:
    return screen.where("skip_reason is not null").select("full_name", "skip_reason")


def seeded(seed: int | str, *keys: str) -> Column:
    """A shuffle that every engine can repeat: order by the MD5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *keys))


def candidate_pools(found: DataFrame, cap: int = R.MAX_PER_STRATUM, seed: int = 42) -> DataFrame:
    """found (full_name, stratum, position) without repeats, at most ``cap`` a stratum, with place: the seeded order in it."""
    once = found.withColumn("k", F.row_number().over(Window.partitionBy("full_name").orderBy("stratum", "position"))).where("k = 1").drop("k")
    capped = once.withColumn("k", F.row_number().over(Window.partitionBy("stratum").orderBy("position", "full_name"))).where(F.col("k") <= cap).drop("k")
    return capped.withColumn("place", F.row_number().over(Window.partitionBy("stratum").orderBy(seeded(seed, "full_name"), "full_name")))


def round_robin(pools: DataFrame) -> DataFrame:
    """pools with turn, from 1: the first of each stratum, then the second of each, and so on. Only the sizes of places are added up in one place."""
    sizes = pools.groupBy("place").agg(F.count("*").alias("_n"))
    before = sizes.select("place", F.coalesce(F.sum("_n").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("place").orderBy("stratum", "full_name"))
    return pools.withColumn("_inside", inside).join(before, "place").withColumn("turn", F.col("_before") + F.col("_inside")).drop("_inside", "_before")


def until_accepted(turns: DataFrame, target: int = R.TARGET_ACCEPTED) -> DataFrame:
    """The rows that are looked at before the search stops: turns (turn, skip_reason) up to the one that is the ``target``-th without a reason (all, if there are fewer)."""
    last = turns.where("skip_reason is null").orderBy("turn").limit(target).agg(F.count("*").alias("_n"), F.max("turn").alias("_last"))
    return turns.join(F.broadcast(last), (F.col("_n") < target) | (F.col("turn") <= F.col("_last"))).drop("_n", "_last")


def config_rows(trees: DataFrame) -> DataFrame:
    """Tree rows of configuration files: known names or workflow files."""
    p = F.lower(F.translate("path", "\\", "/"))
    return trees.where((F.col("type") == "blob") & (T.basename(p).isin(R.CONFIG_NAMES) | p.startswith(".github/workflows/")))
