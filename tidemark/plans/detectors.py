"""Both detectors over claims of every kind, with the SQL that DuckDB runs beside them.

Repositories are customers. Which files one has, what its Makefile holds, what its README
creates and which claims it makes follow from its key; each claim below is made by a tenth
of them. The texts of the tables are SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import artifacts, baseline, sequence
from ..sources.staged import spread, staged

#: path, type, and the keys that have it: those that leave a remainder.
PATHS = [
    ("README.md", "blob", 1, 0), ("requirements.txt", "blob", 2, 0), ("pyproject.toml", "blob", 3, 0), ("setup.py", "blob", 5, 0), ("Makefile", "blob", 2, 1),
    ("CMakeLists.txt", "blob", 7, 0), ("Dockerfile", "blob", 3, 1), ("deploy/Dockerfile.dev", "blob", 4, 1), ("docker-compose.yml", "blob", 4, 0), ("environment.yml", "blob", 3, 2),
    ("scripts/run.py", "blob", 2, 0), ("scripts/start.sh", "blob", 3, 0), ("src/main.py", "blob", 1, 0), ("tests/test_a.py", "blob", 4, 2), ("tests", "tree", 4, 2), ("docs", "tree", 2, 1),
    ("docs/setup.md", "blob", 2, 1), ("app", "tree", 3, 1), ("configs/app.yaml", "blob", 5, 1), (".github/workflows/ci.yml", "blob", 4, 3), ("k8s/pod.yaml", "blob", 3, 0),
    ("pkg/core.tar.gz", "blob", 2, 0), ("tox.ini", "blob", 6, 0), ("pytest.ini", "blob", 9, 0), (".hidden/settings.toml", "blob", 2, 0), ("lib/util", "tree", 2, 0), ("bin/tool.jar", "blob", 3, 2),
]
MAKEFILES = [
    ("build: dep\n\tcc a: b\ntest lint:\n\tx\n.PHONY: all\nX := 1\n%.o: %.c\n  # all: no\ndist/out: y\n", 4, 1),
    ("# nothing\nA = b\n", 4, 3),
]
CONFIGS = [("pyproject.toml", 3, 0), ("tox.ini", 6, 0), ("pytest.ini", 9, 0), ("setup.cfg", 8, 0)]
#: elem_type, line_no, elem_no, content, divisor, remainder.
ELEMENTS = [
    ("fenced_code", 10, 1, "bash made.sh\ngit clone https://host.dev/x/tool.git\ncd tool\nmkdir -p out2/made\ncp a.txt made.cfg\nbash late.sh\ntouch late.sh\n", 2, 0),
    ("section_line", 30, 2, "Save it as `local.json` first.", 2, 0),
    ("section_line", 31, 3, "Copy `example.cfg` to `real.cfg`, please.", 3, 0),
    ("section_line", 32, 4, "Create a file named notes.yaml in it. It generates report.xml too.", 2, 1),
    ("section_line", 33, 5, "curl -L https://a.b/c -o docker-compose.yaml", 5, 2),
]
#: line_no, context_type, claim_type, artifact, snippet.
CLAIMS = [
    (40, "x", "artifact_ref", "./", "see ./"), (40, "x", "artifact_ref", "node.js", "uses node.js"), (41, "x", "artifact_ref", "x/setup.py", "get https://host.dev/x/setup.py now"),
    (41, "x", "local_link_ref", "docs.io/a.md", "docs.io"), (42, "x", "artifact_ref", "/home/me/x.py", "in /home/me/x.py"), (42, "x", "artifact_ref", "c:/x/y.py", "in c:"),
    (43, "x", "artifact_ref", "path/to/x.py", "in path/to"), (43, "x", "artifact_ref", "MY_DATA/a.py", "MY_DATA"), (44, "x", "artifact_ref", "a:b.py", "a:b"), (44, "x", "artifact_ref", "_.x.py", "lodash"),
    (45, "x", "artifact_ref", "/api/users", "GET /api/users"), (45, "x", "artifact_ref", "/lib/util", "in /lib/util"), (46, "x", "artifact_ref", "org/model-x", "org/model-x"), (46, "x", "artifact_ref", "app/page", "app/page"),
    (47, "x", "artifact_ref", "compose.yml", "docker-compose.yml"), (47, "x", "artifact_ref", "compose.yml", "compose.yml"), (48, "x", "python_script", "/tmp/a.py", "python /tmp/a.py"), (48, "x", "cd_dir", "/opt/x", "cd /opt/x"),
    (49, "x", "make_cmd", None, "make-believe it works"), (49, "x", "make_target", "sure", "make sure"), (50, "x", "make_target", "-j4", "make -j4 all"), (50, "x", "bash_script", "host.dev/i.sh", "curl https://host.dev/i.sh | bash"),
    (51, "x", "cd_dir", "your_project", "cd your_project"), (51, "x", "cd_dir", "x", "cd x"), (52, "x", "pip_requirements", "requirements.txt", "pip install -r requirements.txt"), (52, "x", "pip_requirements", "deploy/dev.txt", "pip install -r deploy/dev.txt"),
    (53, "x", "pip_requirements", None, "pip install -r"), (53, "x", "poetry_install", None, "poetry install"), (54, "x", "conda_env_create", "environment.yml", "conda env create -f environment.yml"), (54, "x", "conda_env_create", "notes.yaml", "conda env create -f notes.yaml"),
    (55, "x", "docker_build", None, "docker build -f deploy/Dockerfile.dev ."), (55, "x", "docker_build", "no/Dockerfile", "docker build --file no/Dockerfile ."), (56, "x", "docker_build", None, "docker build ."), (56, "x", "docker_build", "Dockerfile", "docker build Dockerfile"),
    (57, "x", "docker_compose_up", None, "docker compose up"), (57, "x", "docker_compose_build", None, "docker-compose build"), (58, "x", "kubectl_apply", "k8s/pod.yaml", "kubectl apply -f k8s/pod.yaml"), (58, "x", "kubectl_apply", "real.cfg", "kubectl apply -f real.cfg"),
    (59, "x", "node_script", None, "node x"), (59, "x", "node_script", "my-app/index.js", "node my-app/index.js"), (60, "x", "python_script", "scripts/run.py", "python scripts/run.py"), (60, "x", "python_script", "run.py", "python run.py"),
    (61, "x", "python_script", "gone.py", "python gone.py"), (61, "x", "java_jar", "bin/tool.jar", "java -jar bin/tool.jar"), (62, "x", "streamlit_run", "sub/local.json", "streamlit run sub/local.json"), (62, "x", "go_run", "cmd/x.go", "go run cmd/x.go"),
    (63, "x", "python_module", "pkg", "python -m pkg"), (63, "x", "cd_dir", ".", "cd ."), (64, "x", "cd_dir", "../other", "cd ../other"), (64, "x", "cd_dir", "{name}", "cd repo"), (65, "x", "cd_dir", "x/{name}", "cd x"), (65, "x", "cd_dir", "tool", "cd tool"),
    (66, "x", "cd_dir", "docs", "cd docs"), (66, "x", "cd_dir", "lib/util/", "cd lib/util/"), (67, "x", "cd_dir", "build", "cd build"), (67, "x", "cd_dir", "missing", "cd missing"), (68, "x", "make_target", "build", "make build"), (68, "x", "make_target", "deploy", "make deploy"),
    (69, "x", "make_cmd", None, "make"), (69, "x", "make_cmd", None, "make lint"), (70, "x", "make_cmd", None, "make nope"), (70, "x", "pip_install_editable", ".", "pip install -e ."), (71, "x", "pip_install_editable", "./lib/util", "pip install -e ./lib/util"),
    (71, "x", "pip_install_editable", "gone", 'pip install --no-deps -e "gone[all]"'), (72, "x", "pip_install_pkg", ".", "pip install ."), (72, "x", "pip_install_pkg", "pkg/core.tar.gz", "pip install pkg/core.tar.gz"), (73, "x", "pip_install_pkg", "sub/dir", "pip install sub/dir"),
    (73, "x", "pip_install_pkg", "numpy", "pip install numpy"), (74, "x", "pytest_cmd", None, "pytest tests/test_a.py"), (74, "x", "pytest_cmd", None, "pytest -q tests/test_b.py"), (75, "x", "pytest_cmd", None, "pytest"), (75, "x", "tox_cmd", None, "tox"),
    (76, "x", "artifact_ref", "src/main.py", "src/main.py"), (76, "x", "local_link_ref", "docs/setup.md", "setup"), (77, "x", "artifact_ref", "local.json", "local.json"), (77, "x", "artifact_ref", "real.cfg", "real.cfg"), (78, "x", "artifact_ref", "src/*.py", "src/*.py"),
    (78, "x", "artifact_ref", "outputs/model.py", "outputs/model.py"), (79, "x", "artifact_ref", "conf/secret.yml", "conf/secret.yml"), (79, "x", "artifact_ref", "scripts/x.py", "scripts/x.py"), (80, "x", "artifact_ref", "hidden/settings.toml", "hidden/settings.toml"),
    (80, "x", "artifact_ref", "github/workflows/ci.yml", "ci"), (81, "x", "docker_run", None, "docker run x"), (81, "x", "git_clone", "https://host.dev/x/tool.git", "git clone https://host.dev/x/tool.git"), (82, "x", "generic_command", None, "wget x"), (82, "x", "npm_test", None, "npm test"),
    (10, "fenced_code", "bash_script", "made.sh", "bash made.sh"), (10, "fenced_code", "git_clone", "https://host.dev/x/tool.git", "git clone https://host.dev/x/tool.git"), (10, "fenced_code", "cd_dir", "tool", "cd tool"), (10, "fenced_code", "generic_command", None, "mkdir -p out2/made"),
    (10, "fenced_code", "bash_script", "late.sh", "bash late.sh"), (10, "fenced_code", "generic_command", None, "touch late.sh"), (10, "fenced_code", "bash_script", "made.cfg", "not in the block"), (83, "x", "cd_dir", "out2/made", "cd out2/made"), (83, "x", "bash_script", "late.sh", "bash late.sh"),
    (84, "x", "generic_command", None, "wget -q https://a.b/c -O got.yml"), (85, "x", "kubectl_apply", "got.yml", "kubectl apply -f got.yml"), (84, "x", "artifact_ref", "docs\\setup.md", "docs\\setup.md"), (84, "x", "run_shell_script", "scripts/start.sh", "./scripts/start.sh"),
    (86, "x", "make_cmd", None, "make nope"), (86, "x", "make_cmd", None, "make nope"), (87, "x", "make_target", "lint", "make lint"), (87, "x", "make_target", "lint", "make lint"),
]


def quoted(v) -> str:
    return "cast(null as string)" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def spark_text(sql: str) -> str:
    """Spark reads backslashes in strings as escapes."""
    return sql.replace("\\", "\\\\")


def values(rows: list[tuple]) -> str:
    return "(values " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"


NAME = "concat('owner/repo', cast(c_custkey as string))"
TREES = f"select {NAME} as full_name, path, type from customer, {values(PATHS)} as p(path, type, d, r) where c_custkey % d = r"
CONFIG_ROWS = (
    f"select {NAME} as full_name, 'Makefile' as path, 'Makefile' as basename, content from customer, {values(MAKEFILES)} as m(content, d, r) where c_custkey % d = r "
    f"union all select {NAME}, name, name, '' from customer, {values(CONFIGS)} as f(name, d, r) where c_custkey % d = r"
)
ELEMENT_ROWS = (
    f"select {NAME} as full_name, elem_type, cast(line_no as int) as line_no, cast(elem_no as int) as elem_no, content from customer, {values(ELEMENTS)} as e(elem_type, line_no, elem_no, content, d, r) where c_custkey % d = r"
)
NUMBERED = [(i, *c) for i, c in enumerate(CLAIMS)]
CLAIM_ROWS = (
    f"select {NAME} as full_name, cast(line_no as int) as line_no, context_type, claim_type, replace(artifact, '{{name}}', {NAME.replace('owner/', '')}) as artifact_or_path, snippet, cast(no as bigint) as claim_seq "
    f"from customer, {values(NUMBERED)} as c(no, line_no, context_type, claim_type, artifact, snippet) where (c_custkey + no) % 10 = 0 or line_no = 10 and c_custkey % 10 < 4"
)


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """trees, configs, elements, claims."""
    spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")).createOrReplaceTempView("_customer")
    sql = {"trees": TREES, "configs": CONFIG_ROWS, "elements": ELEMENT_ROWS, "claims": CLAIM_ROWS}
    return {n: spark.sql(spark_text(q).replace("from customer", "from _customer")) for n, q in sql.items()}


def labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    t = tables(spark, sf_dir)
    claims, index, keys = staged(t["claims"], "claims"), staged(artifacts.artifact_index(t["trees"], t["configs"]), "index"), staged(artifacts.path_keys(t["trees"]), "keys")
    return t["elements"], index, keys, baseline.baseline(claims, index, keys)


def baseline_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir)[3].select("full_name", "claim_seq", "drift_family", "label", "reason")


def final_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, index, keys, labels = labelled(spark, sf_dir)
    out = sequence.final_labels(staged(labels, "labels"), staged(elements, "elements"), index, keys)
    return out.select("full_name", "claim_seq", "status", "label_v4", "drift_family_v4", "verification", "reason_v4", "changed")


# ---- the same in SQL: sets of keys for each repository, one CASE over them -----


def base(x: str) -> str:
    return f"regexp_extract({x}, '[^/]*$')"


def slashed(x: str) -> str:
    return f"lower(replace(trim(coalesce({x}, '')), '\\', '/'))"


def lead(x: str) -> str:
    return f"regexp_replace(regexp_replace({slashed(x)}, '^\\./', ''), '/+$', '')"


def spellings(x: str) -> str:
    bare = f"regexp_replace({x}, '^/+', '')"
    return f"case when coalesce({x}, '') = '' then [] when {x} like '.%' then [{x}, {bare}] else [{x}, {bare}, '.' || {x}] end"


def any_key(x: str, *keys: str) -> str:
    return "list_has_any(ks, flatten([" + ", ".join(f"list_transform({spellings(x)}, lambda c: {k})" for k in keys) + "]))"


def file_there(x: str) -> str:
    return any_key(x, "'file:' || c", f"'name:' || {base('c')}")


def dir_there(x: str) -> str:
    return any_key(x, "'dir:' || c", f"'dirname:' || {base('c')}", "'top:' || c")


def listed(words: list[str]) -> str:
    return "(" + ", ".join(map(quoted, words)) + ")"


def match(x: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({x}, {quoted(pattern)}, '{flags}')"


GIVEN = f"trees as ({TREES}), configs as ({CONFIG_ROWS}), elements as ({ELEMENT_ROWS}), claims as ({CLAIM_ROWS})"
INDEX = f"""{GIVEN},
t as (select full_name, {slashed('path')} as p, type from trees),
keyed as (select full_name, unnest(case when type = 'blob' then ['file:' || p, 'name:' || {base('p')}] || case when p like '%/%' then ['top:' || split_part(p, '/', 1)] else [] end
  else ['dir:' || p, 'dirname:' || {base('p')}, 'top:' || split_part(p, '/', 1)] end) as k from t),
lines as (select full_name, unnest(string_split(content, chr(10))) as x from configs where lower(basename) = 'makefile'),
rules as (select full_name, lower(trim(regexp_extract(x, '^([^:#=]+?)\\s*:([^=]|$)', 1))) as names from lines where not regexp_matches(x, '^[\\t ]') and not regexp_matches(x, '^\\s*#')
  and not regexp_matches(x, '^[A-Za-z0-9_.-]+\\s*[:+?]?=') and regexp_matches(x, '^[^:#=]+?\\s*:([^=]|$)')),
named as (select full_name, unnest(regexp_split_to_array(names, '\\s+')) as n from rules),
targets as (select full_name, list(distinct n) as ts from named where regexp_matches(n, '^[a-z0-9_.-]+$') and n not in {listed(R.SPECIAL_MAKE_TARGETS)} group by 1),
cfg as (select full_name, list(lower(basename)) as cs from configs group by 1),
idx as (select k.full_name, list(distinct k.k) as ks, coalesce(any_value(ts), []) as ts, coalesce(any_value(cs), []) as cs,
  bool_or(split_part(k.k, ':', 1) in ('top', 'dir') and len(list_intersect(string_split(split_part(k.k, ':', 2), '/'), {R.TEST_DIR_NAMES!r})) > 0) as testdirs,
  bool_or(regexp_matches(k.k, '^file:(.*/)?(test_[^/]*|.*_test)\\.py$')) as pytests
  from keyed k left join targets using (full_name) left join cfg using (full_name) group by 1)"""


def has(name: str) -> str:
    """Is there a file of that name?"""
    return f"list_contains(ks, 'name:{name}')"


def configured(name: str) -> str:
    return f"list_contains(cs, '{name}')"


COMPOSE = f"list_has_any(ks, {['name:' + n for n in R.COMPOSE_NAMES]!r})"
EVIDENCE = f"(testdirs or pytests or {' or '.join(configured(n) for n in ('pyproject.toml', 'setup.cfg', 'tox.ini', 'pytest.ini'))})"
ASKED = f"""{INDEX}, asked as (select *, {slashed('artifact_or_path')} as a0, lower(regexp_extract(trim(snippet), '^\\s*make(?:\\s+([A-Za-z0-9_.-]+))?\\s*$', 1)) as target from claims join idx using (full_name)),
probed as (select *, a0 <> '' and (list_contains(ks, 'file:' || a0) or list_contains(ks, 'name:' || {base('a0')})) as f0,
  list_contains(ks, 'dir:' || regexp_replace(a0, '/+$', '')) or list_contains(ks, 'top:' || regexp_replace(a0, '/+$', '')) as d0 from asked)"""


def case(rows: list[tuple[str, ...]], default: str) -> str:
    """A CASE whose values are fields joined by bars; an expression stands in braces."""
    return "case " + " ".join(f"when {test} then " + value(v) for test, v in rows) + f" else {value(default)} end"


def value(v: str) -> str:
    parts = [p if i % 2 else quoted(p) for i, p in enumerate(v.replace("}", "{").split("{"))]
    return " || ".join(p for p in parts if p != "''") or "''"


OK = baseline.OK
NOT_THERE = "coalesce(artifact_or_path, '') <> '' and not f0"
BASELINE_CASES = [
    (f"claim_type = 'pip_requirements' and not {has('requirements.txt')}", f"drifted_high|{baseline.DEPENDENCY}|README requires requirements.txt but file is missing"),
    ("claim_type = 'pip_requirements'", f"supported|{baseline.DEPENDENCY}|{OK}"),
    (f"claim_type = 'docker_build' and {NOT_THERE}", f"drifted_high|{baseline.DEPENDENCY}|docker build references missing file: {{artifact_or_path}}"),
    (f"claim_type = 'docker_build' and coalesce(artifact_or_path, '') = '' and not {has('dockerfile')}", f"drifted_high|{baseline.DEPENDENCY}|README uses docker build but Dockerfile is missing"),
    ("claim_type = 'docker_build'", f"supported|{baseline.DEPENDENCY}|{OK}"),
    ("claim_type = 'python_script' and not f0", f"drifted_high|{baseline.ENTRY}|Referenced entrypoint missing: {{coalesce(artifact_or_path, 'None')}}"),
    ("claim_type = 'python_script'", f"supported|{baseline.ENTRY}|{OK}"),
    ("claim_type = 'cd_dir' and trim(artifact_or_path) not in ('.', '..') and not d0", f"drifted_high|{baseline.PATH}|Referenced directory missing: {{trim(artifact_or_path)}}"),
    ("claim_type = 'cd_dir'", f"supported|{baseline.PATH}|{OK}"),
    (f"claim_type in ('artifact_ref', 'local_link_ref') and {NOT_THERE}", f"drifted_high|{baseline.LOCAL}|Referenced local artifact/path missing: {{artifact_or_path}}"),
    ("claim_type in ('artifact_ref', 'local_link_ref')", f"supported|{baseline.LOCAL}|{OK}"),
    (f"claim_type = 'make_cmd' and not {has('makefile')}", f"drifted_high|{baseline.BUILD}|README uses make but Makefile is missing"),
    ("claim_type = 'make_cmd' and target <> '' and len(ts) > 0 and not list_contains(ts, target)", f"drifted_medium|{baseline.BUILD}|Make target '{{target}}' not found in Makefile"),
    ("claim_type = 'make_cmd'", f"supported|{baseline.BUILD}|{OK}"),
    (f"claim_type = 'pytest_cmd' and not {EVIDENCE}", f"drifted_medium|{baseline.TEST}|README uses pytest but no test/config evidence found"),
    ("claim_type = 'pytest_cmd'", f"supported|{baseline.TEST}|{OK}"),
    (f"claim_type = 'docker_compose_up' and not {COMPOSE}", f"drifted_high|{baseline.CONTAINER}|README uses docker compose but no compose file found"),
    ("claim_type = 'docker_compose_up'", f"supported|{baseline.CONTAINER}|{OK}"),
    (f"claim_type = 'poetry_install' and not {configured('pyproject.toml')}", f"drifted_high|{baseline.DEPENDENCY}|README uses poetry install but pyproject.toml is missing"),
    ("claim_type = 'poetry_install'", f"supported|{baseline.DEPENDENCY}|{OK}"),
    ("claim_type = 'python_module'", f"uncertain|{baseline.ENTRY}|Python module execution needs package-level semantic resolution beyond current static rules"),
]
LABELLED = f"{ASKED}, labels as (select *, {case(BASELINE_CASES, f'supported|unknown|{OK}')} as v from probed)"
BASELINE_SQL = f"with {LABELLED} select full_name, claim_seq, split_part(v, '|', 2) as drift_family, split_part(v, '|', 1) as label, split_part(v, '|', 3) as reason from labels"

CREATED = f"""pats as (select * from (values {', '.join(f"({quoted(p)}, false)" for p in R.CREATING)}, {', '.join(f"({quoted(p)}, true)" for p in R.PROSE_CREATING)}) p(pattern, prose)),
placed as (select l.*, row_number() over (partition by full_name order by line_no, case when b.block is null then 0 when strpos(lower(b.block), lower(trim(snippet))) > 0 then strpos(lower(b.block), lower(trim(snippet))) - 1 else 1000000 end, claim_seq) as ord
  from labels l left join (select full_name, line_no, arg_max(content, elem_no) as block from elements where elem_type = 'fenced_code' group by 1, 2) b using (full_name, line_no)),
said as (select full_name, unnest(string_split(content, chr(10))) as text, 0 as since, true as elem from elements union all select full_name, snippet, ord, false from placed),
cloned as (select full_name, since, regexp_replace(regexp_extract(text, {quoted(R.CLONE_URL)}, 1, 'i'), '/+$', '') as url from said where {match('text', R.CLONE_URL)}),
made as (select full_name, {lead('m')} as key, since from (select full_name, since, unnest(regexp_extract_all(text, pattern, 1, 'i')) as m from said, pats where elem or not prose)
  union all select full_name, regexp_replace({base(slashed('url'))}, '\\.git$', ''), since from cloned),
once as (select full_name, key, min(since) as since from made group by 1, 2),
known as (select full_name, map(list(key), list(since)) as created, min(since) filter (where regexp_matches(key, '^(docker-)?compose\\.ya?ml$')) as compose_at from once group by 1),
b as (select p.*, created, coalesce(compose_at <= ord, false) as compose_made, {lead('artifact_or_path')} as a, coalesce(snippet, '') as snip from placed p left join known using (full_name)),
c as (select *, {base('a')} as name, regexp_replace(a, '^/+', '') as into_, list_filter(string_split(a, '/'), lambda x: x <> '') as seg, nullif(regexp_extract(snip, '(?:-f|--file)[\\s=]+([^\\s`"'']+)', 1, 'i'), '') as dockerfile,
  case when {match('snip', r"pip(?:3)?\s+install\s+(?:-[-a-z]+\s+)*-e\s+([^\s`]+)")} then {lead("trim(regexp_replace(regexp_extract(snip, 'pip(?:3)?\\s+install\\s+(?:-[-a-z]+\\s+)*-e\\s+([^\\s`]+)', 1, 'i'), '\\[.*?\\]', ''), '\"''')")} end as editable,
  nullif(regexp_extract(snip, 'pytest\\s+(?:-[-a-z]+\\s+)*([A-Za-z0-9_./-]+\\.py)', 1), '') as test_file from b),
d as (select *, {file_there('a')} as f, {dir_there('a')} as d, {dir_there("seg[1]")} as d1, {dir_there('into_')} as dt, {match('a', R.USER_PATH)} or a like '~%' as user_path, {match('a', R.PLACEHOLDER)} as holder,
  into_ <> '' and (len(list_filter(regexp_extract_all(snip, 'https?://\\S*', 0, 'i'), lambda u: contains(lower(u), into_))) > 0 or {match("split_part(into_, '/', 1)", R.DOMAIN, "c")}) as url,
  len(seg) > 0 and (seg[1] in {listed(R.RUNTIME_NAMES)} or seg[-1] in {listed(R.RUNTIME_NAMES)} or a like '%.egg-info') as runtime, not {match("coalesce(seg[-1], '')", r"\.[a-z][a-z0-9]{0,5}$", "c")} as plain,
  claim_type in ('artifact_ref', 'local_link_ref') as ref, coalesce(created[a] <= ord, false) as made, coalesce(created[a] <= ord, false) or coalesce(created[name] <= ord, false) as made_name, coalesce(created[into_] <= ord, false) as made_into,
  {configured('pyproject.toml')} or {configured('setup.cfg')} or {has('setup.py')} as packaged, lower(split_part(full_name, '/', 2)) as repo from c)"""


def either(test: str, ok: str, family: str, good: str, bad: str, miss: str = "drifted_high") -> list[tuple[str, str]]:
    return [(f"{test} and ({ok})", f"kept|supported|{family}|verified|{good}"), (test, f"kept|{miss}|{family}|verified|{bad}")]


SCRIPT = f"claim_type in {listed(list(sequence.SCRIPTS))}"
FINAL_CASES = [
    (f"ref and {match('a', '^[./]*$')}", "excluded||||H1 empty/punctuation-only artifact"),
    (f"ref and (url or a in {listed(R.TOOL_NAMES)} or name in {listed(R.TOOL_NAMES)})", "excluded||||H2 URL residue or tool/product name, not a repository artifact"),
    ("ref and user_path", "excluded||||H3 user-filesystem path (outside repository)"),
    (f"ref and (holder or {match('artifact_or_path', R.CAPS_PLACEHOLDER, 'c')})", "excluded||||H4 placeholder / templated path"),
    ("ref and (regexp_matches(a, '[: =(]') or starts_with(a, '_.') or contains(a, '/_.'))", "excluded||||H7 not a path (contains ':' or whitespace: CLI verb, config key, or command)"),
    ("ref and starts_with(trim(artifact_or_path), '/') and plain and not (f or d)", "excluded||||H8 root-anchored extensionless token (API route or slash-command), not a repository path"),
    ("ref and len(seg) = 2 and plain and not (f or d) and not d1 and not starts_with(a, '.')", "excluded||||H9 two-segment extensionless identifier without parent directory (model/namespace id), not verifiable"),
    ("ref and regexp_matches(a, '^compose\\.ya?ml$') and regexp_matches(snip, 'docker-compose\\.ya?ml', 'i')", "excluded||||H5 duplicate token from docker-compose.yml match"),
    ("a <> '' and claim_type not in ('pip_install_pkg', 'git_clone', 'docker_run', 'python_module') and user_path", "excluded||||H3 user-filesystem path (outside repository)"),
    ("claim_type = 'make_cmd' and regexp_matches(snip, '^\\s*make-[a-z]', 'i')", "excluded||||H6 natural-language 'make ...' sentence"),
    (f"claim_type = 'make_target' and (a in {listed(R.PROSE_MAKE_WORDS)} or starts_with(a, '-'))", "excluded||||H6 natural-language 'make ...' sentence"),
    ("claim_type in ('bash_script', 'run_shell_script') and url", "excluded||||H2 URL residue (piped installer), not a repository artifact"),
    ("claim_type = 'cd_dir' and (user_path or holder or regexp_matches(a, '^[a-z]$'))", "excluded||||H3/H4 cd to user-filesystem or placeholder path"),
    *either("claim_type = 'pip_requirements'", f"{has('requirements.txt')} or a <> '' and f", "D1", "requirements manifest present", "requirements file missing: {coalesce(nullif(a, ''), 'requirements.txt')}"),
    *either("claim_type = 'poetry_install'", configured("pyproject.toml"), "D1", "pyproject.toml present", "poetry install but no pyproject.toml"),
    *either("claim_type = 'conda_env_create'", "f or made", "D1", "env file present: {a}", "env file missing: {a}"),
    *either("claim_type = 'docker_build' and dockerfile is not null", file_there(lead("dockerfile")), "D7", "Dockerfile present", f"Dockerfile missing {{{lead('dockerfile')}}}"),
    *either("claim_type = 'docker_build'", has("dockerfile"), "D7", "Dockerfile present", "Dockerfile missing {a}"),
    *either("claim_type in ('docker_compose_up', 'docker_compose_build')", f"{COMPOSE} or compose_made", "D7", "compose file present", "compose file missing"),
    *either("claim_type = 'kubectl_apply'", "f or made", "D7", "manifest present: {a}", "manifest missing: {a}"),
    (f"{SCRIPT} and a = ''", "kept|supported|D2|external|no local artifact captured"),
    (f"{SCRIPT} and holder", "kept|uncertain|D2|uncertain|placeholder in script path"),
    (f"{SCRIPT} and f", "kept|supported|D2|verified|script present"),
    (f"{SCRIPT} and made_name", "kept|supported|D2|sequence|script created by an earlier documented step"),
    (SCRIPT, "kept|drifted_high|D2|verified|script missing: {a}"),
    ("claim_type = 'python_module'", "kept|uncertain|D2|uncertain|module resolution depends on installation state"),
    ("claim_type = 'cd_dir' and (into_ in ('', '.') or starts_with(into_, '..'))", "kept|supported|D3|verified|relative navigation"),
    ("claim_type = 'cd_dir' and (into_ = repo or ends_with(into_, '/' || repo) or made_into)", "kept|supported|D3|sequence|navigation into the freshly cloned repository (clone context)"),
    ("claim_type = 'cd_dir' and dt", "kept|supported|D3|verified|directory present"),
    ("claim_type = 'cd_dir' and runtime", "kept|uncertain|D3|uncertain|directory absent but runtime/generated-style name: {into_}"),
    ("claim_type = 'cd_dir'", "kept|drifted_high|D3|verified|directory missing: {into_}"),
    (f"claim_type = 'make_target' and not {has('makefile')}", "kept|drifted_high|D4|verified|make target used but no Makefile"),
    ("claim_type = 'make_target' and len(ts) > 0 and not list_contains(ts, a)", "kept|drifted_medium|D4|verified|target '{a}' not in parsed Makefile targets"),
    ("claim_type = 'make_target'", "kept|supported|D4|verified|Makefile and target present"),
    *either("claim_type = 'make_cmd'", f"{has('makefile')} or {has('cmakelists.txt')}", "D4", "Makefile present", "make used but no Makefile"),
    *either("claim_type = 'pip_install_editable' and coalesce(editable, '.') in ('', '.')", "packaged", "D5", "packaging manifest present", "editable install but no pyproject/setup", "drifted_medium"),
    *either("claim_type = 'pip_install_editable'", f"{dir_there('editable')} or {file_there('editable')}", "D5", "editable target present: {editable}", "editable target missing: {editable}"),
    *either("claim_type = 'pip_install_pkg' and a in ('.', '')", "packaged", "D5", "local install target present", "local install target missing", "drifted_medium"),
    *either("claim_type = 'pip_install_pkg' and (regexp_matches(a, '\\.(whl|tar\\.gz)$') or contains(a, '/') and not regexp_matches(a, '^[a-z][a-z0-9+.-]*://'))", "f or d or made", "D5", "local install target present", "local install target missing", "drifted_medium"),
    ("claim_type = 'pip_install_pkg'", "kept|supported||external|package registry install (externally grounded)"),
    (f"claim_type = 'pytest_cmd' and test_file is not null and {file_there(lead('test_file'))}", "kept|supported|D6|verified|named test file present"),
    *either("claim_type = 'pytest_cmd'", EVIDENCE, "D6", "test evidence present", "pytest but no test evidence", "drifted_medium"),
    *either("claim_type = 'tox_cmd'", f"{configured('tox.ini')} or {configured('pyproject.toml')}", "D6", "tox config present", "tox but no tox.ini/pyproject", "drifted_medium"),
    ("ref and (f or d)", "kept|supported|D8|verified|artifact present"),
    ("ref and made_name", "kept|supported|D8|sequence|artifact created by an earlier documented step"),
    ("ref and contains(a, '*')", "kept|uncertain|D8|uncertain|glob pattern"),
    (f"ref and (runtime or {match('a', R.USER_SUPPLIED)})", "kept|uncertain|D8|uncertain|absent but runtime-generated or user-supplied style path: {a}"),
    ("ref", "kept|drifted_high|D8|verified|local artifact missing: {a}"),
]
FINAL_SQL = f"""with {LABELLED}, {CREATED}, z as (select *, {case(FINAL_CASES, 'kept|supported||external|externally grounded command; no repository artifact asserted')} as w from d)
select full_name, claim_seq, split_part(w, '|', 1) as status, nullif(split_part(w, '|', 2), '') as label_v4, nullif(split_part(w, '|', 3), '') as drift_family_v4, nullif(split_part(w, '|', 4), '') as verification, split_part(w, '|', 5) as reason_v4,
split_part(w, '|', 1) = 'excluded' or split_part(w, '|', 2) <> split_part(v, '|', 1) as changed from z"""

# ---- the index: every column of it, and the keys that probes look up -----------

ARRAYS = ["all_file_paths", "all_file_basenames", "all_dir_paths", "top_level_dirs", "make_targets", "workflow_files"]


def index_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    out = artifacts.artifact_index(t["trees"], t["configs"].unionByName(package_configs(spark)))
    return out.withColumns({c: F.array_join(c, ",") for c in ARRAYS})


def index_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.path_keys(tables(spark, sf_dir)["trees"])


#: content of a package.json, keys that have it.
PACKAGES = [
    ('{"scripts": {"test": "jest"}}', 9, 1), ('{"scripts": {"test": "exit 0"}}', 9, 2), ('{"scripts": {"build": "x"}}', 9, 3), ("not json", 9, 4), ('{"scripts": {"test": " TRUE "}}', 9, 5),
    ('{"scripts": {"test": ""}}', 9, 6), ('{"name": "x"}', 9, 7),
]
PACKAGE_ROWS = (
    f"select {NAME} as full_name, 'web/package.json' as path, 'package.json' as basename, content from customer, {values(PACKAGES)} as p(content, d, r) where c_custkey % d = r "
    f"union all select {NAME}, '.github/workflows/ci.yml', 'ci.yml', 'on: push' from customer where c_custkey % 4 = 3 union all select {NAME}, '.github/workflows/makefile', 'makefile', 'flow: x' from customer where c_custkey % 10 = 9"
)


def package_configs(spark: SparkSession) -> DataFrame:
    return spark.sql(spark_text(PACKAGE_ROWS).replace("from customer", "from _customer"))


def file_flag(test: str) -> str:
    return f"coalesce(max((type = 'blob' and {test})::int), 0)"


def named_flag(*names: str) -> str:
    return file_flag(f"b in {listed(list(names))}")


def config_flag(name: str) -> str:
    return f"coalesce(max((b = '{name}' and not flow)::int), 0)"


def joined(value: str, test: str) -> str:
    return f"coalesce(array_to_string(list_sort(list(distinct {value}) filter (where {test})), ','), '')"


INDEX_SQL = f"""with {INDEX}, q as (select *, {base('p')} as b, case when type = 'tree' or contains(p, '/') then split_part(p, '/', 1) end as top from t),
a as (select full_name, count(distinct p) filter (where type = 'blob')::int as file_count, count(distinct p) filter (where type = 'tree')::int as dir_count, {joined('p', "type = 'blob'")} as all_file_paths, {joined('b', "type = 'blob'")} as all_file_basenames,
  {joined('p', "type = 'tree'")} as all_dir_paths, {joined('top', 'top is not null')} as top_level_dirs, {named_flag('requirements.txt')} as has_requirements_txt, {named_flag('package.json')} as has_package_json, {named_flag('dockerfile')} as has_dockerfile,
  {named_flag(*R.COMPOSE_NAMES)} as has_docker_compose, {named_flag('makefile')} as has_makefile, {named_flag('pom.xml')} as has_pom_xml, {named_flag('build.gradle', 'build.gradle.kts')} as has_build_gradle, {named_flag('cargo.toml')} as has_cargo_toml,
  {named_flag('go.mod')} as has_go_mod, coalesce(max((len(list_intersect(case when type = 'tree' then string_split(p, '/') else [top] end, {R.TEST_DIR_NAMES!r})) > 0)::int), 0) as has_tests_dir, {file_flag("(b like 'test!_%.py' escape '!' or b like '%!_test.py' escape '!')")} as has_py_test_files,
  {file_flag("p like '%!_test.go' escape '!'")} as has_go_test_files, {file_flag("regexp_matches(b, '.*[.](test|spec)[.](js|jsx|ts|tsx)$')")} as has_js_ts_test_files, {file_flag("p like '%test.java'")} as has_java_test_files from q group by 1),
every as (select * from configs union all select * from ({PACKAGE_ROWS})), e as (select full_name, {slashed('path')} as p, lower(basename) as b, content, {slashed('path')} like '.github/workflows/%' and lower(basename) not in ('makefile', 'package.json') as flow from every),
flows as (select full_name, 'flow' as n from e where b = 'makefile' and content = 'flow: x'), mt as (select full_name, {joined('n', 'true')} as make_targets from (select full_name, unnest(ts) as n from targets union all select * from flows) group by 1),
pk as (select full_name, b, flow, p, case when b = 'package.json' and json_valid(content) then lower(trim(coalesce(json_extract_string(content, '$.scripts.test'), ''))) else '' end as script from e),
c as (select full_name, {joined('p', 'flow')} as workflow_files, max((script not in ('', 'exit 0', 'true'))::int) as npm_has_test_script, {config_flag('pyproject.toml')} as has_pyproject_toml, {config_flag('setup.cfg')} as has_setup_cfg,
  {config_flag('tox.ini')} as has_tox_ini, {config_flag('pytest.ini')} as has_pytest_ini from pk group by 1)
select a.*, coalesce(make_targets, '') as make_targets, coalesce(workflow_files, '') as workflow_files, coalesce(npm_has_test_script, 0) as npm_has_test_script, coalesce(has_pyproject_toml, 0) as has_pyproject_toml, coalesce(has_setup_cfg, 0) as has_setup_cfg,
  coalesce(has_tox_ini, 0) as has_tox_ini, coalesce(has_pytest_ini, 0) as has_pytest_ini from a left join mt using (full_name) left join c using (full_name)"""
KEYS_SQL = f"with {INDEX} select distinct full_name, split_part(k, ':', 1) as kind, split_part(k, ':', 2) as key from keyed"

QUERIES = {"baseline_rules": baseline_rules, "final_rules": final_rules, "index_rules": index_rules, "index_keys": index_keys}
ORACLES = {"baseline_rules": BASELINE_SQL, "final_rules": FINAL_SQL, "index_rules": INDEX_SQL, "index_keys": KEYS_SQL}
