"""Claim extraction from elements of every kind, with the SQL that DuckDB runs beside it.

Repositories are customers; each has a sixth of the elements below, by its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import claims, readme
from ..sources.staged import spread
from . import synthetic as S
from .detectors import NAME, base, listed, match, quoted, spark_text, values

#: elem_type, line_no, heading, section_class, operational_hint, content, code_lang, link_text, link_target, link_target_type.
ELEMENTS = [
    ("fenced_code", 3, "Install", "installation", 1, "$ pip install -r requirements.txt && pip install numpy\n# a comment\npip3 install -e .\npip install --upgrade pip\nconda env create -f env/environment.yml", "bash", None, None, None),
    ("fenced_code", 9, "Usage", "usage", 0, "python scripts/run.py --x 1; python3 -m http.server\npython -m pip install torch\nnode src/index.mjs\nbash run.sh\nsh ./tools/setup.sh\nstreamlit run app.py", "", None, None, None),
    ("fenced_code", 20, "Build", "build", 1, "make\nmake test\nmake -j4 all && cd build\ncd path/to/x\ncd ..\nMODE=1 OTHER='a b' make lint\nmake your changes\nnpm ci\nnpm run build:all\nnpm test\nyarn install\npnpm dev", "sh", None, None, None),
    ("fenced_code", 30, "Deploy", "deployment", 0, "docker build .\ndocker build -f deploy/Dockerfile.dev .\ndocker run x\ndocker compose up -d\ndocker-compose build\nkubectl apply -f k8s/pod.yaml\nhelm install x\nterraform apply", "console", None, None, None),
    ("fenced_code", 40, "Tests", "test", 0, "> pytest -q tests/test_a.py\nPS C:\\x> tox\ncoverage run x\npy.test\ngo test ./...\ngo run cmd/main.go\ncargo build\ncargo run\ncargo test\nmvn test\nmvn package\n./gradlew build\njava -jar target/x.jar\ngradle build", None, None, None, None),
    ("fenced_code", 50, "Clone", "installation", 1, "git clone https://host.dev/a/b.git\ncd b\nflask run\nuvicorn app.main:app\ngunicorn wsgi:app\njupyter lab\npoetry install\nexport X=1\ncurl https://host.dev/install.sh | bash", "zsh", None, None, None),
    ("fenced_code", 60, "Config", "usage", 0, "name: x\nfile: conf/app.yml and (setup.cfg), see src/a/b.py or ./tools/x.sh or app.py or APP.PY\nlogo.png notes.md host.io https://host.dev/x/y.json Dockerfile", "yaml", None, None, None),
    ("fenced_code", 70, "References", "documentation", 0, "python a.py\nsee conf/app.yml", "python", None, None, None),
    ("fenced_code", 71, "References", "documentation", 0, "python a.py", "shell", None, None, None),
    ("fenced_code", 75, "Other", "other", 0, "nothing to run in conf/app.yml", "", None, None, None),
    ("inline_code", 80, "Usage", "usage", 0, "python tools/x.py", None, None, None, None), ("inline_code", 81, "Usage", "usage", 0, "configs/app.yaml", None, None, None, None),
    ("inline_code", 82, "Sample prompts", "usage", 0, "configs/app.yaml", None, None, None, None), ("inline_code", 83, "Usage", "usage", 0, "README.md", None, None, None, None),
    ("inline_code", 84, "Notes", "other", 0, "setup.cfg", None, None, None, None), ("inline_code", 85, "Usage", "usage", 1, "'./.env.py'", None, None, None, None), ("inline_code", 86, "License", "usage", 1, "src/x.py", None, None, None, None),
    ("inline_code", 87, "Usage", "usage", 0, "make the docs", None, None, None, None), ("inline_code", 88, "Usage", "usage", 0, "plainword", None, None, None, None), ("inline_code", 88, "Usage", "usage", 0, "configs/app.yaml", None, None, None, None),
    ("markdown_link", 90, "Usage", "usage", 0, "[setup](docs/setup.md)", None, "setup", "docs/setup.md", "local_doc"), ("markdown_link", 91, "Usage", "usage", 0, "[c](config.yml)", None, "c", "config.yml", "local_artifact"),
    ("markdown_link", 92, "Usage", "usage", 0, "[x](https://host.dev/x.py)", None, "x", "https://host.dev/x.py", "external"), ("markdown_link", 93, "Usage", "usage", 0, "[h](history.md)", None, "h", "history.md", "local_doc"),
    ("markdown_link", 94, "Usage", "usage", 0, "[build status](ci.yml)", None, "build status", "ci.yml", "local_artifact"), ("markdown_link", 95, "Other", "other", 0, "[i](INSTALL.md)", None, "i", "INSTALL.md", "local_doc"),
    ("markdown_link", 96, "Usage", "usage", 1, "[i](INSTALL.md)", None, "i", "INSTALL.md", "local_doc"), ("markdown_link", 97, "Usage", "usage", 1, "[e](examples/a)", None, "e", "examples/a", "local_path_other"),
    ("section_line", 100, "Install", "installation", 1, "Edit configs/app.yaml and main.py first.", None, None, None, None), ("section_line", 101, "Install", "installation", 1, "python run.py", None, None, None, None),
    ("section_line", 102, "Install", "installation", 1, "- put requirements.txt there", None, None, None, None), ("section_line", 103, "Install", "installation", 1, "* pip install x", None, None, None, None),
    ("section_line", 104, "Install", "installation", 1, "https://host.dev/a/b.py is it", None, None, None, None), ("section_line", 105, "Install", "installation", 1, "[a](b/c.py) and [d](e/f.py)", None, None, None, None),
    ("section_line", 106, "Gallery", "usage", 1, "see src/x.py", None, None, None, None), ("section_line", 107, "Misc", "other", 0, "see src/x.py", None, None, None, None), ("section_line", 108, "Usage", "usage", 0, "![badge](a/b.py)", None, None, None, None),
    ("section_line", 109, "Usage", "usage", 0, "   ", None, None, None, None), ("section_line", 110, "Usage", "usage", 0, "run the src/x.py script, then go to lib/y.ts", None, None, None, None), ("heading", 2, "Install", "installation", 1, "# Install", None, None, None, None),
    ("section_line", 81, "Usage", "usage", 0, "Edit configs/app.yaml now", None, None, None, None), ("section_line", 111, "Usage", "usage", 0, "git clone https://host.dev/z.git", None, None, None, None), ("section_line", 112, "Usage", "usage", 0, "+ cd src", None, None, None, None),
]
NUMBERED = [(i, *e) for i, e in enumerate(ELEMENTS)]
COLUMNS = "no, elem_type, line_no, heading, section_class, operational_hint, content, code_lang, link_text, link_target, link_target_type"
ELEMENT_ROWS = (
    f"select {NAME} as full_name, cast(no as int) as elem_no, elem_type, cast(line_no as int) as line_no, heading, section_class, cast(operational_hint as int) as operational_hint, content, code_lang, link_text, link_target, link_target_type "
    f"from customer, {values(NUMBERED)} as e({COLUMNS}) where (c_custkey + no) % 6 = 0"
)


def extraction_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(S.load(spark, sf_dir, "customer").select("c_custkey"))
    c.createOrReplaceTempView("_customer")
    elements = spark.sql(spark_text(ELEMENT_ROWS).replace("from customer", "from _customer"))
    repos = c.select(F.concat(F.lit("owner/repo"), F.col("c_custkey").cast("string")).alias("full_name"), (F.col("c_custkey") % 5 == 0).alias("curated_list_heuristic"))
    return claims.extract(elements, repos).select("full_name", "line_no", "context_type", "claim_type", "claim_family", "artifact_or_path", "snippet", "evidence_level", "claim_seq")


def trimmed(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g')"


def normal(x: str) -> str:
    return f"lower({trimmed(x)})"


def holds(x: str, words: list[str]) -> str:
    return match(x, T.any_of(words), "c")


PROMPT, ENVIRONMENT = (p.replace("(?U)", "") for p in (R.PROMPT, R.ENVIRONMENT))


def parts(x: str) -> str:
    clean = trimmed(f"regexp_replace({trimmed(f'regexp_replace({trimmed(x)}, {quoted(PROMPT)}, {quoted("")})')}, {quoted(ENVIRONMENT)}, '')")
    return f"list_filter(list_transform(regexp_split_to_array({clean}, '\\s*(?:&&|\\|\\||;)\\s*'), lambda p: trim(p)), lambda p: p <> '')"


def shell(x: str) -> str:
    """Is x read as a command?"""
    first = f"coalesce({parts(x)}[1], '')"
    prose = match(f"lower({first})", R.COMMAND_PROSE, "c")
    return f"({trimmed(x)} <> '' and (length({trimmed(x)}) <= {R.LONGEST_COMMAND} or {match(trimmed(x), PROMPT, 'c')}) and {match(first, rf'^(?:{T.any_of(R.COMMAND_STARTERS)})\b')} and not {prose})"


def outside(x: str) -> str:
    return match(normal(x), R.EXTERNAL, "c")


def canonical(x: str) -> str:
    t = f"trim(replace({trimmed(x)}, '\\', '/'), '`''\"()[]{{}}<>.,;:')"
    return f"nullif(case when {outside(t)} then {t} else regexp_replace({t}, '/+', '/', 'g') end, '')"


def extension(x: str, names: str) -> str:
    return match(f"regexp_replace({normal(x)}, '[?#].*$', '')", rf"\.(?:{names})$", "c")


def local(x: str) -> str:
    nothing = f"({outside(x)} or {match(normal(x), rf'^[a-z0-9.-]+\.({R.DOMAIN_ENDINGS})$', 'c')} or {extension(x, R.IMAGE_EXTENSIONS)} or {extension(x, R.CLAIM_DOC_EXTENSIONS)})"
    return f"({x} is not null and not {nothing} and (lower({x}) in {listed(R.LOCAL_WHITELIST)} or contains({x}, '/') or {match(f'lower({x})', rf'^[A-Za-z0-9_.-]+\.({R.CODE_EXTENSIONS})$')}))"


def commands() -> str:
    """The patterns as rows. RE2 looks at no following text, so that what a package's name must not begin with is a test of its own."""
    rows = [(i, kind, pattern.replace("(?!-[A-Za-z-])", ""), -1 if group is None else group) for i, (kind, pattern, group) in enumerate(R.COMMANDS)]
    return values(rows)


def claims_sql(el: str, cur: str) -> str:
    """SQL of the claims of elements (the columns of ELEMENTS, elem_no unique in a repository) and curated flags."""
    return f"""with el as ({el}), cur as ({cur}),
r as (select el.*, curated, {trimmed('content')} as line, {holds(normal('heading'), R.STRONG_NEGATIVE)} as neg, {holds(normal('heading'), R.SOFT_NEGATIVE)} as soft, {normal('section_class')} in {listed(R.RELEVANT_SECTIONS)} or operational_hint = 1 as rel,
  coalesce(lower(code_lang), '') in {listed(R.SHELL_LANGS)} as sh, {shell('content')} as cmd from el join cur using (full_name) where {trimmed('content')} <> '' and not {holds(normal('content'), R.BADGES)}),
b as (select *, curated = 1 and regexp_matches(line, '^\\s*[-*+]\\s+') and not cmd as bullet from r),
src as (select full_name, elem_no, content from b where elem_type = 'fenced_code' and (not neg or sh) or elem_type in ('inline_code', 'section_line') and cmd and not (elem_type = 'section_line' and bullet)),
ln as (select full_name, elem_no, unnest(string_split(content, chr(10))) as l, unnest(range(1, len(string_split(content, chr(10))) + 1)) as i from src),
ps as (select full_name, elem_no, i, unnest({parts('l')}) as p, unnest(range(1, len({parts('l')}) + 1)) as j from ln where {shell('l')}),
pf as (select * from ps where {shell('p')}),
k as (select * from {commands()} as c(kno, kind, pattern, grp)),
m as (select full_name, elem_no, i, j, p, kno, kind, case grp when -1 then case when regexp_matches(p, pattern, 'i') then [''] else [] end when 0 then regexp_extract_all(p, pattern, 0, 'i') else regexp_extract_all(p, pattern, 1, 'i') end as ms from pf, k),
u as (select full_name, elem_no, i, j, p, kno, kind, unnest(ms) as raw, unnest(range(1, len(ms) + 1)) as q from m),
a as (select *, {canonical('raw')} as art0 from u where not (kind = 'pip_install_pkg' and regexp_matches(raw, '^-[A-Za-z-]'))),
f as (select *, case when {outside('art0')} and kind <> 'git_clone' then null else art0 end as art from a where not (kind = 'cd_dir' and coalesce({match('art0', R.PLACEHOLDER_DIR)}, false)) and not (kind = 'pip_install_pkg' and coalesce(art0, 'x') like '-%')
  and not (kind = 'python_module' and (lower(coalesce(art0, 'x')) in ('pip', 'pip3') or coalesce(art0, 'x') like '-%'))),
g as (select *, bool_or(kind = 'make_target') over (partition by full_name, elem_no, i, j) as target, row_number() over (partition by full_name, elem_no, i, j, kind, art order by kno, q) as again from f),
cm as (select full_name, elem_no, i, j, kno, q, kind, art, p from g where again = 1 and (kind <> 'make_cmd' or not target)),
cmd as (select * from cm union all select full_name, elem_no, i, j, 0, 0, 'generic_command', null, p from pf anti join cm using (full_name, elem_no, i, j)),
tx as (select b.* from b where rel and elem_type = 'fenced_code' and (not neg or sh) and not exists (select 1 from cmd where cmd.full_name = b.full_name and cmd.elem_no = b.elem_no)
  or rel and elem_type = 'section_line' and not neg and not bullet and not {outside('line')} and len(regexp_extract_all(content, 'https?://|www\\.', 0, 'i')) + len(regexp_extract_all(content, '\\[([^\\]]+)\\]\\(([^)]+)\\)')) < 2),
pat as (select * from {values(list(enumerate(R.ARTIFACTS)))} as x(kno, pattern)),
ta as (select full_name, elem_no, kno, unnest(regexp_extract_all(content, pattern, 0, 'i')) as raw, unnest(range(1, len(regexp_extract_all(content, pattern, 0, 'i')) + 1)) as q from tx, pat),
tc as (select *, {canonical('raw')} as art from ta), tl as (select *, case when contains(art, '/') then lower(art) else lower({base('art')}) end as key from tc where {local('art')}),
t1 as (select full_name, elem_no, kno, q, art from (select *, row_number() over (partition by full_name, elem_no, key order by kno, q) as again from tl) where again = 1),
ic as (select full_name, elem_no, 0 as kno, 0 as q, {canonical('line')} as art from b where elem_type = 'inline_code' and not cmd and rel and not neg and not soft and {local(canonical('line'))}),
lk as (select *, {canonical('link_target')} as t from b where elem_type = 'markdown_link' and rel and not neg),
lb as (select *, {normal('t')} as low, {base(normal('t'))} as bs from lk where t is not null and not {outside('t')} and not {holds(normal('t'), R.BADGES)} and not {holds(normal('link_text'), R.BADGES)}),
li as (select full_name, elem_no, 0 as kno, 0 as q, t as art from lb where link_target_type = 'local_artifact' or link_target_type in ('local_path_other', 'local_other', 'local_doc')
  and (bs in {listed(R.LOCAL_WHITELIST)} or regexp_replace(bs, '\\.[a-z0-9]+$', '') in {listed(R.OPERATIONAL_DOCS)} or contains(low, '/') and {holds('low', R.OPERATIONAL_DOCS)})),
al as (select full_name, elem_no, 0 as part, i, j, kno, q, kind, art, p as snip from cmd union all select full_name, elem_no, 1, 0, 0, kno, q, null, art, null from (select * from t1 union all select * from ic union all select * from li)),
c1 as (select al.*, b.elem_type, b.line_no, b.heading, b.section_class, b.content, b.line from al join b using (full_name, elem_no)),
c2 as (select full_name, line_no, heading, section_class, part, art as artifact_or_path,
  case when part = 0 then case elem_type when 'fenced_code' then 'fenced_code' when 'inline_code' then 'inline_code_command' else 'section_line_command' end
    else case elem_type when 'fenced_code' then 'fenced_code_artifact' when 'inline_code' then 'inline_code_artifact' when 'markdown_link' then 'markdown_link' else 'section_line_artifact' end end as context_type,
  case when part = 0 then kind when elem_type = 'markdown_link' then 'local_link_ref' else 'artifact_ref' end as claim_type, case when part = 0 then 'command' else 'artifact_reference' end as claim_family,
  case when part = 0 then snip when elem_type = 'fenced_code' then art when elem_type = 'markdown_link' then content else line end as snippet,
  case when part = 0 and elem_type = 'fenced_code' then 'high' when part = 0 or elem_type in ('fenced_code', 'inline_code') then 'medium' else 'low' end as evidence_level,
  row_number() over (partition by full_name order by line_no, (elem_type = 'section_line')::int, elem_no, part, i, j, kno, q) as claim_seq from c1),
c3 as (select *, lower({base(f"coalesce({canonical('artifact_or_path')}, '')")}) as akey from c2),
c4 as (select *, row_number() over (partition by full_name, line_no, heading, section_class, context_type, claim_type, akey, {normal('snippet')} order by claim_seq) as again from c3),
c5 as (select *, row_number() over (partition by full_name, part = 1 and akey <> '', akey order by case evidence_level when 'high' then 3 when 'medium' then 2 else 1 end desc,
  case context_type when 'inline_code_artifact' then 4 when 'fenced_code_artifact' then 3 when 'markdown_link' then 2 else 1 end desc, line_no, claim_seq) as best from c4 where again = 1)
select full_name, line_no, context_type, claim_type, claim_family, artifact_or_path, snippet, evidence_level, claim_seq from c5 where part = 0 or best = 1"""


SQL = claims_sql(ELEMENT_ROWS, f"select {NAME} as full_name, (c_custkey % 5 = 0)::int as curated from customer")

# ---- elements of READMEs that are put together from blocks ---------------------

BLOCKS = [
    (0, "Before any heading, `x.py`."), (1, "# Top\nIntro with `a.py` and [x](docs/a.md).\n"), (2, "Install\n-------\n```bash\npip install x\n# no heading\n\nmake `all`\n```"),
    (3, "## Usage ##\nRun `python a.py`, `b` or see [one](x.py) and [two](http://a.b/c).\n\n- item"), (4, "Title two\n=====\nplain line\n\n   indented `code` ![i](p.png)"),
    (5, "```\nx = [a](b)\n## y\n```\nafter the fence"), (6, "### 1. Tests\nRun them.\n```Python\n```"), (7, "#no heading\n####### seven\n[a]() `` [b](c d)"),
]
README_BLOCKS = f"select {NAME} as full_name, no, block from customer, {values(BLOCKS)} as b(no, block) where (c_custkey + no * no) % 5 < 2"


def readme_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread(S.load(spark, sf_dir, "customer").select("c_custkey")).createOrReplaceTempView("_customer")
    blocks = spark.sql(spark_text(README_BLOCKS).replace("from customer", "from _customer"))
    texts = blocks.groupBy("full_name").agg(F.array_sort(F.collect_list(F.struct("no", "block"))).alias("bs")).select("full_name", F.array_join("bs.block", "\n").alias("readme_text"))
    return readme.elements(texts).select("full_name", "elem_type", "line_no", "elem_no", "heading", "content", "code_lang", "link_text", "link_target")


def parser_sql(texts: str) -> str:
    """SQL of the elements of texts (full_name, x). A fence that never closes is no element and swallows what follows."""
    return rf"""with r as ({texts}),
l as (select full_name, unnest(string_split(x, chr(10))) as line, unnest(range(1, len(string_split(x, chr(10))) + 1)) as n from r),
f as (select *, regexp_matches(line, '^\s*```') as mark, lead(line) over w as following, max(n) over (partition by full_name) as last_ from l window w as (partition by full_name order by n)),
g as (select *, count(*) filter (where mark) over (partition by full_name order by n) as marks from f where not (n = last_ and line = '')),
h as (select *, marks % 2 = 1 or mark as fenced, not (marks % 2 = 1 or mark) and regexp_matches(line, '^\s{{0,3}}(#{{1,6}})\s+(.*?)\s*#*\s*$') as atx,
  not (marks % 2 = 1 or mark) and trim(line) <> '' and not regexp_matches(line, '^\s{{0,3}}#{{1,6}}\s') and coalesce(regexp_matches(following, '^\s*(=\s*=+|-\s*-+|[=-]{{3,}})\s*$'), false) as titled from g),
k as (select *, coalesce(lag(titled) over (partition by full_name order by n), false) as under, case when atx then trim(regexp_extract(line, '^\s{{0,3}}(#{{1,6}})\s+(.*?)\s*#*\s*$', 2)) when titled then trim(line) end as title from h),
t as (select *, coalesce(last_value(title ignore nulls) over (partition by full_name order by n), 'ROOT') as heading from k),
p as (select * from t where not fenced and not atx and not titled and not under),
i as (select full_name, n, heading, line, unnest(regexp_extract_all(line, '`([^`\n]+)`', 1)) as c, unnest(range(len(regexp_extract_all(line, '`([^`\n]+)`', 1)))) as q, from p),
u as (select full_name, n, heading, line, len(regexp_extract_all(line, '`([^`\n]+)`', 1)) as before_, unnest(regexp_extract_all(line, '\[([^\]]+)\]\(([^)]+)\)', 1)) as a, unnest(regexp_extract_all(line, '\[([^\]]+)\]\(([^)]+)\)', 2)) as b,
  unnest(range(len(regexp_extract_all(line, '\[([^\]]+)\]\(([^)]+)\)', 1)))) as q from p),
c as (select full_name, ((marks + 1) // 2) as fence, min(n) as n, min(heading) as heading, coalesce(string_agg(line, chr(10) order by n) filter (where not mark), '') as content, max(case when mark and marks % 2 = 1 then lower(trim(regexp_extract(line, '^\s*```(.*)$', 1))) end) as lang from t where fenced group by 1, 2 having count(*) filter (where mark) = 2)
select full_name, 'heading' as elem_type, n as line_no, 0 as elem_no, heading, line as content, null as code_lang, null as link_text, null as link_target from t where atx or titled
union all select full_name, 'inline_code', n, q, heading, c, null, null, null from i union all select full_name, 'markdown_link', n, before_ + q, heading, trim(line), null, a, b from u
union all select full_name, 'section_line', n, len(regexp_extract_all(line, '`([^`\n]+)`', 1)) + len(regexp_extract_all(line, '\[([^\]]+)\]\(([^)]+)\)', 1)), heading, line, null, null, null from p
union all select full_name, 'fenced_code', n, 0, heading, content, lang, null, null from c"""


README_SQL = parser_sql(f"select full_name, string_agg(block, chr(10) order by no) as x from ({README_BLOCKS}) group by 1")

QUERIES = {"extraction_rules": extraction_rules, "readme_rules": readme_rules}
ORACLES = {"extraction_rules": SQL, "readme_rules": README_SQL}
