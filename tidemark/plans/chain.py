"""SQL of the whole chain from README text to labels: parser, claims, index and both detectors, put together of the parts beside each.

``readmes`` makes the text of the queries' repositories as synthetic.repositories does, for DuckDB.
"""

from __future__ import annotations

from . import detectors, extraction, screening

NAME = "'owner/repo' || c_custkey"
README = (
    "concat_ws(chr(10), '# ' || c_name, 'A tool for people.', 'Install', '-------', '```bash', '$ git clone https://host.dev/x/repo' || c_custkey || '.git', 'cd repo' || c_custkey, "
    "'pip install -r requirements.txt && python scripts/run.py', 'make build', '```', '## Usage', "
    "'Run `python tools/m' || c_custkey % 7 || '.py` or see [setup](docs/setup.md) and [c](config.yml).', 'Edit configs/app.yaml first.', '```', 'not closed')"
)
READMES = f"select {NAME} as full_name, {README} as x from customer"
CURATED = f"select {NAME} as full_name, (c_custkey % 11 = 0)::int as curated from customer"
PATHS = (
    "['README.md', case when c_custkey % 2 = 0 then 'requirements.txt' else 'pyproject.toml' end, case when c_custkey % 3 = 0 then 'scripts/run.py' else 'src/main.py' end, 'tools/m' || c_custkey % 5 || '.py', "
    "case when c_custkey % 4 < 2 then 'Makefile' else 'tests/test_a.py' end, case when c_custkey % 5 = 0 then 'configs/app.yaml' else 'setup.py' end]"
)
TREES = f"select {NAME} as full_name, unnest({PATHS}) as path, 'blob' as type from customer union all select {NAME}, 'docs', 'tree' from customer"
CONFIGS = (
    f"select {NAME} as full_name, 'Makefile' as path, 'Makefile' as basename, case when c_custkey % 8 = 0 then 'build: a' || chr(10) || chr(9) || 'echo' || chr(10) else '.PHONY: all' || chr(10) || 'all:' || chr(10) || chr(9) || 'echo' || chr(10) || 'X := 1' || chr(10) end as content "
    f"from customer where c_custkey % 4 < 2 union all select {NAME}, 'pyproject.toml', 'pyproject.toml', '' from customer where c_custkey % 2 = 1"
)


def elements_sql(texts: str, link_kind: str) -> str:
    """Elements with the class of their section and the kind of their link; elem_no numbers a repository's elements in the order of reading."""
    return (
        f"with e as ({extraction.parser_sql(texts)}), hs as (select distinct heading, heading as h from e), hn as (select heading, trim({screening.PLAIN}) as h from hs), "
        f"hc as (select heading, {screening.SECTION} from hn), lk as (select *, lower(trim(link_target)) as t, split_part(split_part(lower(trim(link_target)), '?', 1), '#', 1) as base from e join hc using (heading)) "
        "select full_name, row_number() over (partition by full_name order by line_no, elem_type = 'section_line', elem_no) as elem_no, elem_type, line_no, heading, case when heading = 'ROOT' then 'other' else section end as section_class, "
        f"case when heading = 'ROOT' then 0 else hint end as operational_hint, content, code_lang, link_text, link_target, case when link_target is not null then {link_kind} end as link_target_type from lk"
    )


def chain(link_kind: str) -> dict[str, str]:
    el = elements_sql(READMES, link_kind)
    claims = extraction.claims_sql(el, CURATED)
    given = f"trees as ({TREES}), configs as ({CONFIGS}), elements as ({el}), claims as ({claims})"
    start = lambda sql: sql.replace(detectors.GIVEN, given, 1)
    count = lambda kind: f"count(*) filter (where elem_type = '{kind}')"
    family = "nullif(split_part(v, '|', 2), '')"
    return {
        "readme_elements": f"select full_name, {count('heading')} - 1 as headings, {count('fenced_code')} as fenced, {count('inline_code')} as inline_code, {count('markdown_link')} as links, {count('section_line')} as lines from ({el}) group by 1",
        "artifact_index": f"with {start(detectors.INDEX)} select full_name, len(list_filter(ks, lambda k: starts_with(k, 'file:')))::int as file_count, len(list_filter(ks, lambda k: starts_with(k, 'dir:')))::int as dir_count, {detectors.has('requirements.txt')}::int as has_requirements_txt, "
        f"{detectors.has('makefile')}::int as has_makefile, testdirs::int as has_tests_dir, {detectors.configured('pyproject.toml')}::int as has_pyproject_toml, array_to_string(list_sort(ts), ',') as targets from idx",
        "extracted_claims": f"select full_name, line_no, context_type, claim_type, artifact_or_path, snippet, evidence_level, claim_seq from ({claims})",
        "baseline_labels": f"with {start(detectors.LABELLED)} select full_name, claim_seq, claim_type, {family} as drift_family, split_part(v, '|', 1) as label, split_part(v, '|', 3) as reason from labels",
        "final_labels": start(detectors.FINAL_SQL).replace("select full_name, claim_seq, split_part(w, '|', 1) as status", "select full_name, claim_seq, claim_type, split_part(w, '|', 1) as status", 1),
    }
