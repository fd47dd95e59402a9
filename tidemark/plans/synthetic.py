"""The analysis's tables made from the supplied ones: repositories are customers, claims are order lines, histories are users' events.

Each expression is plain SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.staged import spread

LABEL = (
    "case when l_returnflag = 'R' and o_orderpriority = '1-URGENT' then 'drifted_high' when l_returnflag = 'A' and o_orderpriority = '1-URGENT' then 'drifted_medium' "
    "when l_returnflag = 'A' and o_orderpriority = '2-HIGH' then 'uncertain' else 'supported' end"
)
VERIFICATION = "case when l_linenumber in (1, 2) then 'verified' when l_linenumber = 3 then 'sequence' when l_linenumber = 4 then 'uncertain' else 'external' end"
STATUS = "case when l_linestatus = 'F' and l_linenumber = 5 then 'excluded' else 'kept' end"
CLAIM_COLUMNS = {
    "full_name": "cast(o_custkey as string)",
    "claim_seq": "l_orderkey * 10 + l_linenumber",
    "line_no": "l_linenumber",
    "label": LABEL,
    "verification": VERIFICATION,
    "status": STATUS,
    "claim_type": "p_type",
    "claim_family": "o_orderstatus",
}
SELECT = ", ".join(f"{e} as {n}" for n, e in CLAIM_COLUMNS.items())
CLAIMS = f"claims as (select {SELECT} from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey)".replace(" as string)", " as varchar)")
STATE = "case event_type when 'error' then 'drift' when 'purchase' then 'no_claim' when 'signup' then 'unknown' else 'supported' end"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders, part = (load(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    joined = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(part, line["l_partkey"] == part["p_partkey"])
    return joined.selectExpr(*[f"{e} as {n}" for n, e in CLAIM_COLUMNS.items()])


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """full_name, case_id, idx, date, state: a user's events in order as a claim's states at commits."""
    e = load(spark, sf_dir, "events")
    e.createOrReplaceTempView("_events")
    return spark.sql(
        "select cast(user_id as string) as full_name, 'c' as case_id, row_number() over (partition by user_id order by ts, event_id) - 1 as idx, ts as date, "
        f"{STATE} as state from _events"
    )


def survival_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case a user: whole days from the first error to the next purchase, else to the last event."""
    load(spark, sf_dir, "events").createOrReplaceTempView("_events")
    return spark.sql(CASES_SQL.format(events="(select user_id, event_type, cast(ts as timestamp) as ts from _events)", micros="unix_micros"))


CASES_SQL = (
    "select o.user_id, floor(({micros}(coalesce(min(case when e.event_type = 'purchase' and e.ts > o.t then e.ts end), max(e.ts))) - {micros}(o.t)) / 86400000000.0) as duration_days, "
    "case when min(case when e.event_type = 'purchase' and e.ts > o.t then e.ts end) is null then 0 else 1 end as event_fixed "
    "from (select user_id, min(ts) as t from {events} where event_type = 'error' group by user_id) o join {events} e on o.user_id = e.user_id group by o.user_id, o.t"
)


def repositories(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """repos, readmes, trees, configs: Markdown, paths and manifests built from parts, orders and customers.

    The text has a known shape: headings of both kinds, a closed fence of commands, links,
    inline code and prose; which of its files exist depends on the keys.
    """
    customer = spread(load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"))
    customer.createOrReplaceTempView("_customer")
    name = "concat('owner/repo', cast(c_custkey as string))"
    readme = (
        "concat_ws('\\n', concat('# ', c_name), 'A tool for people.', 'Install', '-------', '```bash', concat('$ git clone https://host.dev/x/repo', cast(c_custkey as string), '.git'), "
        "concat('cd repo', cast(c_custkey as string)), 'pip install -r requirements.txt && python scripts/run.py', 'make build', '```', '## Usage', "
        "concat('Run `python tools/m', cast(c_custkey % 7 as string), '.py` or see [setup](docs/setup.md) and [c](config.yml).'), 'Edit configs/app.yaml first.', '```', 'not closed')"
    )
    readmes = spark.sql(f"select {name} as full_name, 'README.md' as readme_path, {readme} as readme_text from _customer")
    repos = spark.sql(f"select {name} as full_name, c_mktsegment as description, '2024-01-01T00:00:00Z' as pushed_at, c_custkey % 11 = 0 as curated_list_heuristic from _customer")
    paths = (
        "array('README.md', if(c_custkey % 2 = 0, 'requirements.txt', 'pyproject.toml'), if(c_custkey % 3 = 0, 'scripts/run.py', 'src/main.py'), concat('tools/m', cast(c_custkey % 5 as string), '.py'), "
        "if(c_custkey % 4 < 2, 'Makefile', 'tests/test_a.py'), if(c_custkey % 5 = 0, 'configs/app.yaml', 'setup.py'))"
    )
    trees = spark.sql(f"select full_name, path, 'blob' as type from (select {name} as full_name, explode({paths}) as path from _customer) union all select {name}, 'docs', 'tree' from _customer")
    configs = spark.sql(
        f"select {name} as full_name, 'Makefile' as path, 'Makefile' as basename, if(c_custkey % 8 = 0, 'build: a\\n\\techo\\n', '.PHONY: all\\nall:\\n\\techo\\nX := 1\\n') as content from _customer "
        f"where c_custkey % 4 < 2 union all select {name}, 'pyproject.toml', 'pyproject.toml', '' from _customer where c_custkey % 2 = 1"
    )
    return {"repos": repos, "readmes": readmes, "trees": trees, "configs": configs}
