"""Screening, section classes and histories over varied inputs, with the SQL that DuckDB runs beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import headings, history, intervals, screen
from ..sources.memo import Memo
from ..sources.staged import passing_folder, spread, staged, tasks_of
from . import synthetic as S
from .detectors import listed, match, quoted, spark_text, values

GOOD = (
    "This is a small library for the work that you do with tables and files. Install it with one command and run the example to see how it works. "
    "The project is in use at many places, and the tests can be run by hand or by a server. It will not change your files, and it is easy to use from a script or from another package."
)
LINKS = "\n".join(f"{'*' if i % 2 else '3.'} [name {i}](https://host.dev/{i})" for i in range(9))
#: number, suffix of the name, description, README, date of the last push.
REPOS = [
    (0, "", "a tool", GOOD, "2024-01-01T00:00:00Z"), (1, "", "a tool", "", "2024-01-01T00:00:00Z"), (2, "", "a tool", "Read `the code` and ![x](y) nothing else here.", "2024-01-01T00:00:00Z"),
    (3, "", None, GOOD + " " + "日本語" * 60, "2024-01-01T00:00:00Z"), (4, "", "a tool", "zorbal quintex " * 20, "2024-01-01T00:00:00Z"), (5, "", "a tool", GOOD + " 12 34 56" * 30, "2024-01-01T00:00:00Z"),
    (6, "", "a tool", GOOD + "\n" + LINKS, "2024-01-01T00:00:00Z"), (7, "", "a tool", "This is the library for you and it is in the package that you can use with the test of the server and the docs or for the example", "2024-01-01T00:00:00Z"),
    (8, "", "the dataset of it", GOOD, "2024-01-01T00:00:00Z"), (9, "-awesome", "a tool", GOOD, "2024-01-01T00:00:00Z"), (10, "", "a tool", GOOD, "2021-01-01T00:00:00Z"), (11, "", None, GOOD + "\n```\nx = 1\n```\n# More", "2024-05-31T23:00:00Z"),
    (12, "", "Collection of tools", GOOD, "2024-01-01T00:00:00Z"),
]
#: kind of tree, path, type.
TREES = [
    (1, "a.ipynb", "blob"), (1, "b.md", "blob"), (2, "main.go", "blob"), (3, "main.py", "blob"), (4, "a.py", "blob"), (4, "b.py", "blob"), (4, "c.py", "blob"), (4, "lib2", "tree"),
    (5, "a.py", "blob"), (5, "b.py", "blob"), (5, "sub\\c.py", "blob"), (5, "requirements.txt", "blob"), (5, "tests/t.py", "blob"), (5, "docs/a.md", "blob"), (5, "images", "tree"),
    (6, "src/a.py", "blob"), (6, "src/b.py", "blob"), (6, "src/c.py", "blob"), (6, "tests/t.py", "blob"), (6, "Makefile", "blob"), (6, "Dockerfile", "blob"), (6, ".github/workflows/x.yml", "blob"),
    (7, "app", "tree"), (7, "app/a.py", "blob"), (7, "setup.cfg", "blob"), (7, "docs/a.md", "blob"), (7, "assets/x.png", "blob"), (7, "compose.yaml", "blob"), (7, "test", "tree"),
]
REPO_ROWS = f"select concat('owner/repo', cast(c_custkey as string), suffix) as full_name, c_custkey, description, readme_text, pushed_at from customer, {values(REPOS)} as r(no, suffix, description, readme_text, pushed_at) where c_custkey % 13 = no"
TREE_ROWS = f"select full_name, path, type from ({REPO_ROWS}) as x, {values(TREES)} as t(kind, path, type) where c_custkey % 8 = kind"


def screened_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread(S.load(spark, sf_dir, "customer").select("c_custkey")).createOrReplaceTempView("_customer")
    repos, trees = (spark.sql(spark_text(q).replace("from customer", "from _customer")) for q in (REPO_ROWS, TREE_ROWS))
    readmes = repos.select("full_name", "readme_text")
    return screen.screened(repos.drop("readme_text"), readmes, trees, "2024-06-01T00:00:00Z").select("full_name", "skip_reason", "structural_score")


PROSE = "coalesce({x}, '')"
for _pattern in (r"```[\s\S]*?```", r"`[^`\n]+`", r"!\[[^\]]*\]\([^\)]+\)", r"\[[^\]]+\]\([^\)]+\)", r"https?://\S+", r"[#>*_\-~=|]", r"\s+"):
    PROSE = f"regexp_replace({PROSE}, {quoted(_pattern)}, ' ', 'g')"
PROSE = f"trim({PROSE})"
WORDS = r"len(regexp_extract_all({x}, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}]+'))"
REASON = (
    f"case when len(tokens) < {R.MIN_ALPHA_TOKENS} then 'insufficient_natural_language_for_english_check' "
    f"when length(regexp_replace(prose, '[^\\x00-\\x7F]', '', 'g')) / greatest(1, length(prose))::double < {R.MIN_ASCII_RATIO} then 'non_english_readme_low_ascii_ratio' "
    f"when len(list_filter(tokens, lambda x: x in {listed(R.FUNCTION_WORDS)})) / greatest(1, len(tokens))::double < {R.MIN_FUNCTION_RATIO} then 'weak_english_function_word_signal' "
    f"when len(tokens) / greatest(1, len(regexp_extract_all(prose, '\\S+')))::double < {R.MIN_ALPHA_RATIO} then 'readme_too_code_or_markup_heavy' end"
)
TOKENS = "list_transform(regexp_extract_all(prose, '[A-Za-z][A-Za-z\\-'']+'), lambda x: lower(x))"


def prose_of(x: str) -> str:
    return PROSE.replace("{x}", x)


ENGLISH_SQL = (
    f"with p as (select doc_id, text, {prose_of('text')} as prose from documents), t as (select *, {TOKENS} as tokens from p) select doc_id, {REASON} as reason, {WORDS.format(x='text')}::int as words from t"
)


def english_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.load(spark, sf_dir, "documents")
    return d.select("doc_id", screen.language_reason("text").alias("reason"), T.word_count("text").alias("words"))


def some_dir(names: list[str]) -> str:
    return f"coalesce(max((top in {listed(names)} or type = 'tree' and p in {listed(names)})::int), 0)"


def some_file(test: str) -> str:
    return f"coalesce(max((type = 'blob' and {test})::int), 0)"


ABOUT = "lower(full_name || ' ' || coalesce(description, ''))"
SCREENED_SQL = f"""with repos as ({REPO_ROWS}), rows_ as ({TREE_ROWS}), p as (select full_name, type, lower(replace(path, '\\', '/')) as p from rows_),
q as (select *, regexp_extract(p, '[^/]*$') as name, case when type = 'blob' and not contains(p, '/') then null else split_part(p, '/', 1) end as top from p),
s as (select full_name, count(distinct p) filter (where type = 'blob' and p like '%.py') as py, count(distinct p) filter (where type = 'blob' and p like '%.ipynb') as nb,
  {some_dir(R.SOURCE_DIRS)} + {some_dir(R.TEST_DIRS)} + {some_file(f"name in {listed(R.CONFIG_NAMES)}")} + {some_file("p like '.github/workflows/%'")} + {some_file(f"name in {listed(R.CONTAINER_NAMES)}")} + {some_file("name = 'makefile'")} as score,
  {' + '.join(some_dir([d]) for d in R.DOC_DIRS)} as docdirs from q group by 1),
j as (select r.*, s.py, s.nb, s.score, s.docdirs, s.full_name is null as treeless, {prose_of('readme_text')} as prose from repos r left join s using (full_name)),
t as (select *, {TOKENS} as tokens from j),
l as (select *, len(regexp_extract_all(readme_text, '(?m){R.BULLET_LINK}')) + len(regexp_extract_all(readme_text, '(?m){R.NUMBERED_LINK}')) as links, {REASON} as language from t)
select full_name, case when {match(ABOUT, '|'.join(R.NAME_PATTERNS + R.DESCRIPTION_PATTERNS))} then 'excluded_by_name_or_description' when coalesce(readme_text, '') = '' then 'missing_or_unreadable_readme'
  when language is not null then language when links >= {R.MIN_LIST_LINKS} then 'curated_list_heuristic' when treeless then 'tree_unavailable'
  when pushed_at::timestamptz < timestamptz '2024-06-01 00:00:00Z' - interval {R.MAX_PUSH_AGE_DAYS + 1} day + interval 1 microsecond then 'inactive_repo'
  when {WORDS.format(x='readme_text')} < {R.MIN_README_WORDS} then 'readme_too_short' when {match(ABOUT, R.NON_PROJECT)} then 'non_project_repo_semantics' when nb > 0 and py = 0 then 'notebook_only_repo' when py = 0 then 'no_python_files'
  when py < 3 and score < 2 then 'insufficient_substantive_code' when score < 2 then 'insufficient_software_structure' when docdirs >= 2 and score < 3 then 'doc_heavy_structure' end as skip_reason, score as structural_score from l"""

PREFIXES = ["## Install ", "How to use ", "Notes on ", "1. Clone ", "Docker ", "**Step 2:** run ", "III) Tests of ", "[x](y) Deploy ", "> `Build` ", "Appendix - ", "Contributing to ", "CI/CD for ", "Open "]
HEADINGS = f"select p_partkey, concat(prefix, p_name) as h from part, {values(list(enumerate(PREFIXES)))} as x(no, prefix) where p_partkey % {len(PREFIXES)} = no"


def section_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    S.load(spark, sf_dir, "part").createOrReplaceTempView("_part")
    p = spark.sql(spark_text(HEADINGS).replace("from part", "from _part"))
    return p.select("p_partkey", headings.section_class("h").alias("section"), headings.operational_hint("h").alias("hint"))


PLAIN = "lower(trim(h))"
for _pattern, _into in ((r"!\[[^\]]*\]\([^)]*\)", " "), (r"<[^>]+>", " "), (r"\[[^\]]+\]\([^)]*\)", " "), (r"[`*_:#>|]+", " "), (r"^[\W_]*", ""), (r"\s+", " ")):
    PLAIN = f"regexp_replace({PLAIN}, {quoted(_pattern)}, '{_into}', 'g')"
PLAIN = f"trim({PLAIN})"
for _pattern in (r"^(?:step|phase)\s+[ivxlcdm0-9]+\s*[:.)-]\s*", r"^[ivxlcdm]+\s*[:.)-]\s*", r"^\d+\s*[:.)-]\s*"):
    PLAIN = f"regexp_replace({PLAIN}, {quoted(_pattern)}, '')"
#: Class and hint of a plain heading h.
SECTION = (
    "case "
    + " ".join(f"when {match('h', rf'\b(?:{w})\b')} then '{c}'" for c, w in R.SECTION_WORDS.items())
    + " "
    + " ".join(f"when {match('h', rf'^(?:{w})\b')} then '{c}'" for c, w in R.IMPERATIVES.items())
    + f" else 'other' end as section, {match('h', rf'\b(?:{R.OPERATIONAL_WORDS})\b')}::int as hint"
)
SECTION_SQL = f"with h as ({HEADINGS}), n as (select p_partkey, trim({PLAIN}) as h from h) select p_partkey, {SECTION} from n"


def on_grid(name: str, rows: str) -> str:
    """SQL of the first wanted row of each history (full_name, rel from 0, want) over a coarse grid: CTEs that end in ``name`` (full_name, found)."""
    return (
        f"{name}_n as (select full_name, count(*) as n from {rows} group by 1), {name}_g as (select distinct full_name, floor(i * ((n - 1) / 11.0::double))::int as g from {name}_n, range(11) r(i) union select full_name, (n - 1)::int from {name}_n), "
        f"{name}_h as (select g.full_name, min(g.g) as hit from {name}_g g join {rows} s on s.full_name = g.full_name and s.rel = g.g and s.want group by 1), "
        f"{name}_p as (select h.full_name, h.hit, coalesce(max(g.g), -1) as before from {name}_h h left join {name}_g g on g.full_name = h.full_name and g.g < h.hit group by 1, 2), "
        f"{name} as (select p.full_name, min(s.rel) as found from {name}_p p join {rows} s on s.full_name = p.full_name and s.rel > p.before and s.rel <= p.hit and s.want group by 1)"
    )


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


STATES = f"s as (select user_id::varchar as full_name, row_number() over (partition by user_id order by ts, event_id) - 1 as idx, ts, {S.STATE} as state from events)"
PERSISTENCE_SQL = f"""with {STATES}, a as (select full_name, idx as rel, state = 'drift' as want from s), {on_grid('onset', 'a')},
b as (select s.full_name, s.idx - o.found - 1 as rel, s.state in ('supported', 'no_claim') as want from s join onset o using (full_name) where s.idx > o.found), {on_grid('fix', 'b')},
e as (select full_name, count(*) as n, min(ts) as first_, max(ts) as last_ from s group by 1),
j as (select e.*, o.found as onset, o.found + 1 + f.found as fix, case when n < 2 then 'too_few_commits' when o.found is null then 'no_detectable_drift' else 'ok' end as status from e left join onset o using (full_name) left join fix f using (full_name)),
d as (select j.*, x.ts as at_onset, y.ts as at_fix, y.state as fixed_as from j left join s x on x.full_name = j.full_name and x.idx = j.onset left join s y on y.full_name = j.full_name and y.idx = j.fix)
select full_name, 'c' as case_id, status, n as n_commits_checked, {stamp('first_')} as window_start, {stamp('last_')} as window_end, case when status = 'ok' then {stamp('at_onset')} end as first_drift_date, case when status = 'ok' then {stamp('at_fix')} end as first_fix_date,
  case when status = 'ok' and fix is not null then case when fixed_as = 'no_claim' then 'claim_removed' else 'artifact_restored' end end as fix_mode,
  case when status = 'ok' then floor((epoch_us(coalesce(at_fix, last_)) - epoch_us(at_onset)) / 86400000000.0)::bigint end as duration_days, case when status = 'ok' then (fix is not null)::int end as event_fixed, case when status = 'ok' then (onset = 0)::int end as left_truncated from d"""


def persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = ("window_start", "window_end", "first_drift_date", "first_fix_date")
    return history.persistence(S.states(spark, sf_dir)).withColumns({d: F.date_format(d, "yyyy-MM-dd HH:mm:ss.SSSSSS") for d in dates})


# A commit is an order, its tree the lines of the order; README and Makefile depend on the key, and some commits have no tree.
COMMITS = "select cast(o_custkey as string) as full_name, cast(o_orderkey as string) as sha, case when o_orderkey % 97 = 0 then 'never' else concat(cast(cast(o_orderdate as date) as string), 'T00:00:00Z') end as date, cast(o_orderkey as bigint) as newest_first from orders"
FILES = (
    "select cast(o_custkey as string) as full_name, cast(o_orderkey as string) as sha, case o_orderkey % 4 when 0 then 'README.md' when 1 then 'readme.md' when 2 then 'README' else 'notes.md' end as path, "
    "concat('Run  make Build and see ', p_name, '.') as text from orders, lineitem, part where o_orderkey = l_orderkey and l_partkey = p_partkey and l_linenumber = 1"
)
PATHS = "select cast(o_custkey as string) as full_name, cast(o_orderkey as string) as sha, concat('./Src/', replace(p_name, ' ', '/'), '.py') as path from orders, lineitem, part where o_orderkey = l_orderkey and l_partkey = p_partkey and o_orderkey % 5 <> 0"
MAKE = "select cast(o_custkey as string) as full_name, cast(o_orderkey as string) as sha, case when o_orderkey % 3 = 0 then '# none' else concat('Build', cast(o_orderkey % 2 as string), ' lint: x\n\tcc y: z\n.PHONY: all\nV := 1\n%.o: c\n') end as content from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0"
CASES = (
    "select cast(c_custkey as string) as full_name, 'P1' as case_id, case when c_custkey % 4 = 0 then 'make_target' else 'artifact_ref' end as claim_type, case c_custkey % 4 when 0 then 'build1' when 1 then 'src' when 2 then 'red.py' else 'src/blue' end as artifact_or_path, "
    "case c_custkey % 3 when 0 then 'make build' when 1 then 'run' else 'never said' end as snippet from customer"
)


def commit_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits in order, README and tree at each, and the state of a repository's claim."""
    for t in ("orders", "lineitem", "part", "customer"):
        S.load(spark, sf_dir, t).createOrReplaceTempView(f"_{t}")
    sql = lambda q: spark.sql(spark_text(q).replace("from orders, lineitem, part", "from _orders as orders, _lineitem as lineitem, _part as part").replace("from orders", "from _orders").replace("from customer", "from _customer"))
    walk = history.commit_walk(sql(COMMITS), 8)
    cases = staged(sql(CASES).join(walk, "full_name"), "cases")
    held = history.supported_at(cases, sql(PATHS), sql(MAKE)).join(history.readme_at(sql(FILES)), ["full_name", "sha"], "left")
    state = history.state(F.col("readme_text").isNotNull(), T.holds_snippet("readme_text", "snippet"), F.col("supported"))
    return held.select("full_name", "case_id", "sha", F.col("idx").cast("long").alias("idx"), state.alias("state"))


def interval_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same states read from validity intervals of paths, Makefiles and READMEs."""
    for t in ("orders", "lineitem", "part", "customer"):
        S.load(spark, sf_dir, t).createOrReplaceTempView(f"_{t}")
    sql = lambda q: spark.sql(spark_text(q).replace("from orders, lineitem, part", "from _orders as orders, _lineitem as lineitem, _part as part").replace("from orders", "from _orders").replace("from customer", "from _customer"))
    commits = sql(COMMITS)
    walk = staged(history.commit_walk(intervals.dealt(commits, tasks_of(commits.count()), "full_name"), 8), "walk")
    return intervals.walk_states(sql(CASES), walk, sql(PATHS), sql(MAKE), sql(FILES))


COMMIT_SQL = f"""with k as (select *, row_number() over (partition by full_name order by newest_first) as k from ({COMMITS})),
w as (select full_name, sha, row_number() over (partition by full_name order by date, newest_first desc) - 1 as idx from k where k <= 8 and date <> 'never'),
p as (select full_name, sha, regexp_replace(lower(path), '^\\./', '') as p from ({PATHS})),
pre as (select full_name, sha, unnest(list_transform(range(1, len(string_split(p, '/')) + 1), lambda i: array_to_string(string_split(p, '/')[1:i], '/'))) as d from p),
keys as (select full_name, sha, list(distinct d) as ds, list(distinct regexp_extract(d, '[^/]*$')) as bs from pre group by 1, 2),
m as (select full_name, sha, unnest(string_split(content, chr(10))) as line from ({MAKE})),
mt as (select full_name, sha, lower(regexp_extract(line, '^([A-Za-z0-9_.\\-/ ]+?)\\s*::?([^=]|$)', 1)) as names, line from m),
ts as (select full_name, sha, list_distinct(flatten(list(case when regexp_matches(line, '^[A-Za-z0-9_.\\-/ ]+?\\s*::?([^=]|$)') and not regexp_matches(line, '^([\\t #]|\\.PHONY)') then list_filter(string_split(names, ' '), lambda x: x <> '' and not regexp_matches(x, '[%$]')) else [] end))) as ts from mt group by 1, 2),
f as (select full_name, sha, arg_min(text, list_position({history.README_NAMES!r}, path)) as readme from ({FILES}) where list_contains({history.README_NAMES!r}, path) group by 1, 2),
j as (select c.*, w.sha, w.idx, keys.ds, keys.bs, ts.ts, f.readme from ({CASES}) c join w using (full_name) left join keys using (full_name, sha) left join ts using (full_name, sha) left join f using (full_name, sha)),
h as (select *, case when ds is null then null when claim_type = 'make_target' then ts is not null and (len(ts) = 0 or list_contains(ts, artifact_or_path)) else list_contains(ds, artifact_or_path) or list_contains(bs, regexp_extract(artifact_or_path, '[^/]*$')) end as held from j)
select full_name, case_id, sha, idx, case when readme is null then 'unknown' when not contains(lower(regexp_replace(readme, '\\s+', ' ', 'g')), snippet) then 'no_claim' when held is null then 'unknown' when held then 'supported' else 'drift' end as state from h"""

ALTERED = "case when doc_id % 100 = 0 then concat('some more words ', text) else text end"
MEMO_SQL = f"with d as (select doc_id, {ALTERED} as text from documents), t as (select doc_id, text, {prose_of('text')} as prose from d), k as (select *, {TOKENS} as tokens from t) select doc_id, {REASON} as reason, {WORDS.format(x='text')}::int as words, doc_id % 100 = 0 as computed from k"


def remembered_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language screen run again after a hundredth of the texts changed: only those are screened, the rest is read from the memo."""

    def stage(docs: DataFrame) -> DataFrame:
        return docs.select("doc_id", screen.language_reason("text").alias("reason"), T.word_count("text").alias("words"))

    docs = S.load(spark, sf_dir, "documents").select("doc_id", "text")
    memo = Memo(spark, passing_folder(spark, "memo"), ["doc_id"], stage)
    memo.run(docs)
    out, computed = memo.run(docs.withColumn("text", F.expr(ALTERED)))
    return out.join(computed.select("doc_id", F.lit(True).alias("_c")), "doc_id", "left").select("doc_id", "reason", "words", F.coalesce("_c", F.lit(False)).alias("computed"))


QUERIES = {f.__name__: f for f in (screened_repositories, english_screen, section_classes, persistence, commit_states, interval_states, remembered_screen)}
ORACLES = {"screened_repositories": SCREENED_SQL, "english_screen": ENGLISH_SQL, "section_classes": SECTION_SQL, "persistence": PERSISTENCE_SQL, "commit_states": COMMIT_SQL, "interval_states": COMMIT_SQL, "remembered_screen": MEMO_SQL}
