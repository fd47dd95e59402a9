"""Registered queries of the documentation analysis over the supplied tables, with the SQL that DuckDB runs beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import artifacts, baseline, claims, headings, history, metrics, models, ordered, readme, reports, sampling, screen, selection, sequence, survival, validation
from ..sources import tables, workbook
from ..sources.staged import passing_folder, staged
from . import chain, detectors, extraction, screening
from . import synthetic as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


KEPT = f"with {S.CLAIMS}, kept as (select * from claims where status = 'kept')"
ROLLUP = (
    f"{KEPT}, r as (select full_name, count(*) as n, count(*) filter (where label in ('drifted_high', 'drifted_medium')) as d, count(*) filter (where label = 'supported') as s, "
    "count(*) filter (where label = 'uncertain') as u, count(*) filter (where label = 'drifted_high') as h from kept group by full_name), "
    "rollup_ as (select *, d / n::double as drift, s / n::double as support from r)"
)


def kept(spark, sf):
    return S.claims(spark, sf).where("status = 'kept'")


@query(
    f"{KEPT} select count(*) as claims, count(distinct full_name) as repositories, avg((label in ('drifted_high', 'drifted_medium'))::int) as drift_rate, avg((label = 'supported')::int) as support_rate, "
    "avg((label = 'uncertain')::int) as uncertain_rate, avg((label = 'drifted_high')::int) as strict_rate, avg((label <> 'supported')::int) as lenient_rate, "
    "avg((label = 'supported')::int) - avg((label in ('drifted_high', 'drifted_medium'))::int) as dri from kept"
)
def claim_rates(spark, sf):
    return metrics.claim_rates(kept(spark, sf))


@query(
    f"{ROLLUP} select count(*) as repositories, avg((d > 0)::int) as any_rate, avg((h > 0)::int) as any_strict, avg((d + u > 0)::int) as any_lenient, avg(drift) as drift_mean, "
    "stddev_samp(drift) as drift_sd, median(drift) as drift_median, avg((drift = 0)::int) as share_zero, avg((drift = 1)::int) as share_full, count(*) filter (where drift > 0.5) as over_half from rollup_"
)
def repo_rates(spark, sf):
    return metrics.repo_rates(metrics.repo_rollup(kept(spark, sf)))


@query(
    f"{KEPT} select claim_type, count(*) as n, count(*) filter (where label in ('drifted_high', 'drifted_medium')) as drifted, count(*) filter (where label = 'uncertain') as uncertain, "
    "count(*) filter (where label = 'supported') as supported, count(*) filter (where verification <> 'external') as verified from kept group by claim_type"
)
def claim_type_table(spark, sf):
    return metrics.group_table(kept(spark, sf), "claim_type").drop("drift_rate", "dri")


@query(
    f"{KEPT} select claim_family, round_even(100.0 * count(*) filter (where label in ('drifted_high', 'drifted_medium')) / count(*), 2)::double as drift_rate, "
    "round_even((count(*) filter (where label = 'supported') - count(*) filter (where label in ('drifted_high', 'drifted_medium')))::double / count(*), 4) as dri from kept group by claim_family"
)
def claim_family_rates(spark, sf):
    return metrics.group_table(kept(spark, sf), "claim_family").select("claim_family", "drift_rate", "dri")


@query(
    f"{KEPT}, d as (select claim_family, count(*) as drifted from kept where label in ('drifted_high', 'drifted_medium') group by 1) "
    "select claim_family, drifted, round_even(100.0 * drifted / (select sum(drifted) from d), 1)::double as share_pct from d"
)
def drift_family_shares(spark, sf):
    return metrics.family_shares(kept(spark, sf), "claim_family")


@query(f"{ROLLUP}, k as (select support as x, row_number() over (order by support) as i, count(*) over () as n from rollup_) select 2 * sum(i * x) / (max(n) * sum(x)) - (max(n) + 1.0) / max(n) as gini from k")
def support_gini(spark, sf):
    return metrics.gini(metrics.repo_rollup(kept(spark, sf)), "support")


@query(f"{ROLLUP}, m as (select avg(support) as mu from rollup_ where support > 0) select sum(case when support > 0 then support / mu * ln(support / mu) end) / count(*) as theil from rollup_, m")
def support_theil(spark, sf):
    return metrics.theil(metrics.repo_rollup(kept(spark, sf)), "support")


@query(f"{KEPT}, c as (select claim_type, count(*)::double as c from kept group by 1), p as (select c / sum(c) over () as p from c) select -sum(p * log2(p)) as entropy_bits, count(*) as categories from p")
def claim_type_entropy(spark, sf):
    return metrics.entropy(kept(spark, sf), "claim_type")


@query(
    f"{KEPT}, c as (select claim_type, count(*) as n from kept group by 1), k as (select *, row_number() over (order by n desc, claim_type) as rk from c), "
    "f as (select least(rk, 21) as rank, case when rk <= 20 then claim_type else 'other' end as claim_type, sum(n)::bigint as n from k group by 1, 2) "
    "select rank, claim_type, n, sum(n) over (order by rank) / (sum(n) over ())::double as cumulative from f"
)
def claim_type_pareto(spark, sf):
    return metrics.pareto(kept(spark, sf), "claim_type")


@query(f"{ROLLUP}, c as (select drift, count(*) as c from rollup_ group by 1) select drift, sum(c) over (order by drift) / (sum(c) over ())::double as share from c")
def drift_ecdf(spark, sf):
    return metrics.ecdf(metrics.repo_rollup(kept(spark, sf)), "drift")


@query("with c as (select o_totalprice, count(*) as c from orders group by 1) select o_totalprice, sum(c) over (order by o_totalprice) / (sum(c) over ())::double as share from c")
def price_ecdf(spark, sf):
    return metrics.ecdf(S.load(spark, sf, "orders"), "o_totalprice")


@query(
    "with c as (select o_totalprice, count(*) as c from orders group by 1), e as (select o_totalprice as x, sum(c) over (order by o_totalprice) / (sum(c) over ())::double as y from c), "
    "p as (select *, least(floor((x - 20000.0::double) / ((400000.0::double - 20000.0) / 300)), 299)::int as pixel from e where x between 20000 and 400000) "
    "select distinct pixel, x as o_totalprice, y as share from (select *, row_number() over (partition by pixel order by x) as i, row_number() over (partition by pixel order by x desc) as j from p) where i = 1 or j = 1 "
    "union all select -1, x, y from e where x = (select max(x) from e where x < 20000)"
)
def price_ecdf_frame(spark, sf):
    """The ECDF of prices as a figure 300 pixels wide needs it (a rising curve has its least first and its greatest last)."""
    return metrics.pixel_frame(metrics.ecdf(S.load(spark, sf, "orders"), "o_totalprice"), "o_totalprice", "share", 20000.0, 400000.0, 300)


@query("with k as (select o_totalprice as x, row_number() over (order by o_totalprice) as i, count(*) over () as n from orders) select 2 * sum(i * x) / (max(n) * sum(x)) - (max(n) + 1.0) / max(n) as gini from k")
def price_gini(spark, sf):
    return metrics.gini(S.load(spark, sf, "orders"), "o_totalprice")


@query(
    "with g as (select case when l_orderkey % 3 > 0 then 'all others' else p_brand end as brand, l_extendedprice - 20000 as x from lineitem join part on l_partkey = p_partkey) "
    "select brand, count(*) as n, quantile_cont(x, 0.05) as low, quantile_cont(x, 0.5) as middle, quantile_cont(x, 0.95) as high from g group by 1"
)
def price_quantiles(spark, sf):
    """Exact quantiles by brand; one group holds two thirds of the rows."""
    part = S.load(spark, sf, "part").select("p_partkey", "p_brand")
    rows = S.load(spark, sf, "lineitem").join(part, F.expr("l_partkey = p_partkey")).selectExpr("case when l_orderkey % 3 > 0 then 'all others' else p_brand end as brand", "l_extendedprice - 20000 as x")
    out = selection.exact_quantiles(rows, "x", [0.05, 0.5, 0.95], ["brand"])
    return out.select("brand", "n", *[F.col("quantiles")[i].alias(c) for i, c in enumerate(("low", "middle", "high"))])


@query("select event_id, (select max_by(c.value, c.event_id) from events c where c.event_type = 'error' and c.event_id <= e.event_id) as last_error from events e")
def last_error(spark, sf):
    """As-of lookup: each event with the value of the last error not after it."""
    e = S.load(spark, sf, "events")
    known = e.where("event_type = 'error'").groupBy(F.col("event_id").alias("at")).agg(F.max("value").alias("value"))
    return ordered.as_of(e.select("event_id"), "event_id", known, "at", "value", "last_error")


@query(f"{ROLLUP} select least(floor(drift / ((1.0::double - 0.0) / 20)), 19)::int as bin, count(*) as n from rollup_ group by 1")
def drift_histogram(spark, sf):
    return metrics.histogram(metrics.repo_rollup(kept(spark, sf)), "drift", 0.0, 1.0, 20)


@query(f"{KEPT} select f.claim_family, count(k.claim_family) as n from (values ('F'), ('O'), ('P'), ('X')) f(claim_family) left join kept k on k.claim_family = f.claim_family group by 1")
def family_bars(spark, sf):
    return metrics.reindexed(kept(spark, sf).groupBy("claim_family").agg(F.count("*").alias("n")), "claim_family", ["F", "O", "P", "X"], "n")


@query(
    f"{KEPT} select avg(case when claim_family = 'F' and claim_type not like 'STANDARD%' then (label like 'drifted%')::int end) as command_rate, "
    "avg(case when claim_type like 'STANDARD%' then (label like 'drifted%')::int end) as directory_rate, avg(case when claim_family = 'O' then (label like 'drifted%')::int end) as reference_rate from kept"
)
def conditional_rate(spark, sf):
    family = F.when(F.col("claim_family") == "F", "command").when(F.col("claim_family") == "O", "artifact_reference").otherwise("other")
    named = kept(spark, sf).withColumns({"claim_family": family, "claim_type": F.when(F.col("claim_type").startswith("STANDARD"), "cd_dir").otherwise(F.col("claim_type"))})
    return metrics.command_rates(named)


@query(
    f"with {S.CLAIMS}, v as (select *, label like 'drifted%' as d3, case when status = 'excluded' then false else label = 'drifted_high' end as d4 from claims) select avg(d3::int) as initial_all, "
    "avg(case when status = 'kept' then d3::int end) as initial_kept, avg(case when status = 'kept' then d4::int end) as final_kept, avg((status <> 'kept')::int) as excluded_share from v"
)
def detector_comparison(spark, sf):
    c = S.claims(spark, sf)
    return metrics.detector_comparison(c.withColumns({"drifted_v3": metrics.is_drifted(), "drifted_v4": (F.col("status") == "kept") & (F.col("label") == "drifted_high")}))


@query(f"with {S.CLAIMS} select label, case when status = 'kept' then label end as label_v4, count(*) as n from claims group by 1, 2")
def label_changes(spark, sf):
    return metrics.label_changes(S.claims(spark, sf).withColumn("label_v4", F.when(F.col("status") == "kept", F.col("label"))))


@query(f"{KEPT} select claim_type, count(*) as n, avg((label like 'drifted%')::int) as drift_rate from kept where verification <> 'external' group by 1 having count(*) >= 10")
def verified_types(spark, sf):
    return metrics.verified_types(kept(spark, sf))


@query(f"{KEPT} select claim_type, arg_min(claim_family, claim_seq) as claim_family from kept group by 1")
def first_family(spark, sf):
    return metrics.first_family(kept(spark, sf))


DRAWS = (
    f"{ROLLUP}, numbered as (select *, row_number() over (order by md5(full_name), full_name) - 1 as place, count(*) over () as size from rollup_), "
    "draws as (select b.i as round, (('0x' || substr(md5('42:' || b.i || ':' || j.place), 1, 8))::bigint) % j.size as place from range(2000) b(i), numbered j)"
)


@query(f"{DRAWS}, x as (select round, sum(d) / sum(n)::double as x from draws join numbered using (place) group by round) select quantile_cont(x, 0.025) as ci_low, quantile_cont(x, 0.975) as ci_high from x")
def bootstrap_claim_rate(spark, sf):
    return metrics.bootstrap_claim_rate(metrics.repo_rollup(kept(spark, sf)))


@query(
    f"{DRAWS}, u as (select distinct round, place, d from draws join numbered using (place)), x as (select round, avg((d > 0)::int) as x from u group by round) "
    "select quantile_cont(x, 0.025) as ci_low, quantile_cont(x, 0.975) as ci_high from x"
)
def bootstrap_repo_rate(spark, sf):
    return metrics.bootstrap_repo_rate(metrics.repo_rollup(kept(spark, sf)))


ONE_PASS = (
    f"{ROLLUP}, h as (select full_name, n, d, b.i as block, md5('42:' || full_name || ':' || b.i) as h from rollup_, range(500) b(i)), "
    "u as (select n, d, block * 4 + p.i as round, ('0x' || substr(h, 8 * p.i::int + 1, 8))::bigint as u from h, range(4) p(i)), "
    f"m as (select round, n, d, {metrics.multiplicity('u')} as m from u), o as (select round, sum(m * n) as n, sum(m * d) as d, count(*) as drawn, count(*) filter (where d > 0) as drifted from m where m > 0 group by 1), "
    "one as (select quantile_cont(d / n::double, 0.025) as claim_low, quantile_cont(d / n::double, 0.975) as claim_high, quantile_cont(drifted / drawn::double, 0.025) as repo_low, quantile_cont(drifted / drawn::double, 0.975) as repo_high from o)"
)


@query(f"{ONE_PASS} select * from one")
def one_pass_bootstrap(spark, sf):
    return metrics.one_pass_bootstrap(metrics.repo_rollup(kept(spark, sf)))


@query(
    f"{ONE_PASS}, {DRAWS[len(ROLLUP) + 2 :]}, x as (select round, sum(d) / sum(n)::double as x from draws join numbered using (place) group by round), e as (select quantile_cont(x, 0.025) as l, quantile_cont(x, 0.975) as h from x) "
    "select (claim_low - l) / (h - l) as low_error, (claim_high - h) / (h - l) as high_error from one, e"
)
def bootstrap_error(spark, sf):
    return metrics.bootstrap_error(staged(metrics.repo_rollup(kept(spark, sf)), "rollup"))


@query(
    f"{KEPT}, c as (select full_name, count(*) filter (where label = 'drifted_high') as drifted_high, count(*) filter (where label = 'drifted_medium') as drifted_medium, "
    "count(*) filter (where label = 'supported') as supported, count(*) filter (where label = 'uncertain') as uncertain from kept group by 1) "
    "select *, drifted_high + drifted_medium + supported + uncertain as total_claims, (drifted_high > 0)::int as has_any_high_drift, (drifted_high + drifted_medium > 0)::int as has_any_drift from c"
)
def label_summary(spark, sf):
    return baseline.label_summary(kept(spark, sf))


KM = (
    f"with c as ({S.CASES_SQL.format(events='events', micros='epoch_us')}), t as (select duration_days::int as time_days, count(*) as c, sum(event_fixed)::bigint as events from c group by 1), "
    "r as (select *, (sum(c) over (order by time_days rows between current row and unbounded following))::bigint as at_risk from t), "
    "w as (select *, max((events = at_risk)::int) over (order by time_days) as zero, coalesce(sum(case when events < at_risk then ln(1 - events / at_risk::double) end) over (order by time_days), 0) as ls, "
    "coalesce(sum(case when events < at_risk then events / (at_risk::double * (at_risk - events)) end) over (order by time_days), 0) as v from r), "
    "km as (select time_days, at_risk, events, case when zero = 1 then 0.0 else exp(ls) end as survival, v from w)"
)


@query(f"{KM} select time_days, at_risk, events, survival, greatest(0, survival - 1.96 * survival * sqrt(v)) as ci_low, least(1, survival + 1.96 * survival * sqrt(v)) as ci_high from km")
def kaplan_meier(spark, sf):
    return survival.kaplan_meier(S.survival_cases(spark, sf))


@query(f"{KM} select min(case when survival <= 0.5 then time_days end) as median_days, max_by(survival, time_days) as end_survival, sum(events)::bigint as events from km")
def survival_summary(spark, sf):
    return survival.survival_summary(survival.kaplan_meier(S.survival_cases(spark, sf)))


@query(f"{KM} select o_orderkey, coalesce((select max_by(survival, time_days) from km where time_days <= o_orderkey % 40), 1.0) as survival from orders")
def survival_as_of(spark, sf):
    asked = S.load(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 40).alias("d"))
    return survival.survival_at(survival.kaplan_meier(S.survival_cases(spark, sf)), asked, "d").select("o_orderkey", "survival")


STATES = f"s as (select user_id::varchar as full_name, row_number() over (partition by user_id order by ts, event_id) - 1 as idx, ts, {S.STATE} as state from events)"


@query(
    f"with {STATES}, n as (select full_name, count(*) as n from s group by 1), g as (select distinct full_name, floor(i * ((n - 1) / 11.0::double))::int as g from n, range(11) r(i) union select full_name, (n - 1)::int from n), "
    "h as (select g.full_name, min(g.g) as hit from g join s on s.full_name = g.full_name and s.idx = g.g and s.state = 'drift' group by 1), "
    "p as (select h.full_name, h.hit, coalesce(max(g.g), -1) as before from h left join g on g.full_name = h.full_name and g.g < h.hit group by 1, 2), "
    "f as (select p.full_name, min(s.idx) as found from p join s on s.full_name = p.full_name and s.idx > p.before and s.idx <= p.hit and s.state = 'drift' group by 1) "
    "select n.full_name, f.found from n left join f using (full_name)"
)
def first_drift_on_grid(spark, sf):
    return history.first_on_grid(S.states(spark, sf), ["drift"]).select("full_name", "found")


@query(
    f"with {STATES}, b as (select *, case when lag(state) over (partition by full_name order by idx) is not distinct from state and idx > 0 then 0 else 1 end as fresh from s), "
    "i as (select *, sum(fresh) over (partition by full_name order by idx) as island from b) "
    "select full_name, idx, island::bigint as island, count(*) over (partition by full_name, island order by idx) as run from i"
)
def islands(spark, sf):
    rows = S.states(spark, sf).select("full_name", F.col("state").alias("line_no"), F.lit("x").alias("context_type"), F.col("idx").alias("claim_order"), F.lit(None).cast("string").alias("into"))
    out = sequence.working_directory(rows)
    run = F.count("*").over(Window.partitionBy("full_name", "island").orderBy("claim_order"))
    return out.select("full_name", F.col("claim_order").alias("idx"), "island", run.alias("run"))


@query(
    f"with {S.CLAIMS}, s as (select *, case when status <> 'kept' then 'excluded' when label like 'drifted%' then 'drifted' when label = 'uncertain' then 'uncertain' when verification = 'verified' then 'supported' "
    "when verification in ('sequence', 'external') then 'supported_' || verification end as stratum from claims), "
    "k as (select *, row_number() over (partition by stratum order by md5('42|' || claim_seq), claim_seq) as k from s) select claim_seq, stratum from k where k <= "
    "case stratum when 'drifted' then 80 when 'supported' then 40 when 'supported_sequence' then 15 when 'supported_external' then 10 when 'uncertain' then 25 when 'excluded' then 30 else 0 end"
)
def stratified_sample(spark, sf):
    rows = S.claims(spark, sf).withColumn("label_v4", F.col("label")).withColumn("stratum", sampling.stratum())
    return sampling.per_stratum(rows, "stratum", sampling.STRATUM_SIZES, "claim_seq").select("claim_seq", "stratum")


@query(
    f"{KEPT}, s as (select case when label like 'drifted%' then 'drifted' when label = 'uncertain' then 'uncertain' when verification = 'verified' then 'supported' "
    "when verification in ('sequence', 'external') then 'supported_' || verification end as stratum from kept) select stratum, count(*) as size from s group by 1"
)
def strata_sizes(spark, sf):
    return sampling.strata_sizes(S.claims(spark, sf).withColumn("label_v4", F.col("label")))


@query(
    f"with {S.CLAIMS}, q as (select claim_type, greatest(1, round_even(200 * count(*) / (select count(*) from claims)::double, 0)) as quota from claims group by 1), "
    "k as (select *, row_number() over (partition by claim_type order by md5('42|' || claim_seq), claim_seq) as k from claims) "
    "select claim_seq, k.claim_type from k join q using (claim_type) where k.k <= quota order by md5('42/all|' || claim_seq), claim_seq limit 200"
)
def proportional_sample(spark, sf):
    return sampling.proportional(S.claims(spark, sf), "claim_type", 200, "claim_seq").select("claim_seq", "claim_type")


@query(
    f"with {S.CLAIMS}, o as (select *, row_number() over (partition by full_name order by md5('42|' || claim_seq), claim_seq) as k from claims), "
    "n as (select *, row_number() over (order by md5('42|' || full_name), full_name) as n from o where k = 1) select printf('P%03d', n) as case_id, full_name, claim_seq from n where n <= 100"
)
def cohort(spark, sf):
    return sampling.cohort(S.claims(spark, sf), 100, "claim_seq").select("case_id", "full_name", "claim_seq")


POOL = (
    "f as (select o_custkey::varchar as full_name, o_orderpriority as stratum, o_orderkey as position from orders), o as (select *, row_number() over (partition by full_name order by stratum, position) as k from f), "
    "c as (select *, row_number() over (partition by stratum order by position, full_name) as c from o where k = 1), "
    "p as (select *, row_number() over (partition by stratum order by md5('42|' || full_name), full_name) as place from c where c <= 50)"
)


@query(f"with {POOL} select full_name, stratum, position, place from p")
def candidate_pools(spark, sf):
    found = S.load(spark, sf, "orders").selectExpr("cast(o_custkey as string) as full_name", "o_orderpriority as stratum", "o_orderkey as position")
    return screen.candidate_pools(found, cap=50)


@query(f"with {POOL} select full_name, row_number() over (order by place, stratum) as turn from p")
def round_robin(spark, sf):
    return screen.round_robin(candidate_pools(spark, sf)).select("full_name", "turn")


@query(
    f"{KEPT}, k as (select *, row_number() over (partition by full_name, claim_type order by case label when 'drifted_high' then 3 when 'drifted_medium' then 2 else 1 end desc, claim_seq) as k from kept) "
    "select full_name, claim_type, claim_seq from k where k = 1"
)
def best_per_key(spark, sf):
    rank = F.when(F.col("label") == "drifted_high", 3).when(F.col("label") == "drifted_medium", 2).otherwise(1)
    return claims.best_per_key(kept(spark, sf), ["full_name", "claim_type"], rank.desc(), "claim_seq").select("full_name", "claim_type", "claim_seq")


@query(
    "select doc_id, len(regexp_extract_all(text, '[A-Za-z][A-Za-z\\-'']+')) as alpha, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / greatest(1, length(text))::double as ascii_ratio from documents"
)
def language_signals(spark, sf):
    d = S.load(spark, sf, "documents")
    return d.select("doc_id", F.size(T.alpha_tokens("text")).cast("long").alias("alpha"), T.ascii_ratio("text").alias("ascii_ratio"))


@query(
    "with f as (select l_orderkey::varchar as full_name, 's' || l_linenumber as sha, lower(p_name) as path from lineitem join part on l_partkey = p_partkey), "
    "c as (select distinct full_name, sha, lower(o_orderpriority) as low from f join orders on o_orderkey = full_name::bigint), "
    "r as (select c.full_name, c.sha, bool_or(f.path like '%' || case when c.full_name::bigint % 2 = 0 then 'e' else 'q' end || '%') as x from c join f using (full_name, sha) group by 1, 2) select full_name, sha, x as found from r"
)
def text_at_commit(spark, sf):
    line, part = S.load(spark, sf, "lineitem"), S.load(spark, sf, "part")
    files = line.join(part, line["l_partkey"] == part["p_partkey"]).selectExpr("cast(l_orderkey as string) as full_name", "concat('s', l_linenumber) as sha", "p_name as text", "l_orderkey")
    found = T.holds_snippet("text", F.when(F.col("l_orderkey") % 2 == 0, "E").otherwise("Q"))
    return files.groupBy("full_name", "sha").agg(F.bool_or(found).alias("found"))


LINKS = "select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as target from pages union all select page_id, url from pages"


#: What a link leads to: t is the target, trimmed and in lower case, base the same without query and fragment.
LINK_KIND = (
    "case when t = '' then 'unknown' when t like 'http://%' or t like 'https://%' or t like 'www.%' or t like '%://%' then 'external' when t like '#%' then 'anchor' "
    "when regexp_matches(base, '\\.(png|jpg|jpeg|gif|svg|webp|bmp)$') then 'image' when regexp_matches(base, '\\.(md|rst|adoc|txt)$') then 'local_doc' "
    "when regexp_matches(base, '\\.(py|js|go|jar|yml|yaml|toml|cfg|ini|json|xml|ipynb)$') then 'local_artifact' when base like '%/' then 'local_dir' "
    "when regexp_extract(base, '[^/]*$') in ('dockerfile', 'makefile', 'pipfile', 'go.mod', 'build.gradle', 'build.gradle.kts') then 'local_artifact' "
    "when regexp_extract(base, '[^/]*$') in ('docs', 'doc', 'documentation', 'examples', 'example') then 'local_doc' when base like '%/%' then 'local_path_other' else 'local_other' end"
)


@query(f"with l as ({LINKS}), b as (select page_id, target, lower(trim(target)) as t, split_part(split_part(lower(trim(target)), '?', 1), '#', 1) as base from l) select page_id, target, {LINK_KIND} as kind from b")
def link_types(spark, sf):
    p = S.load(spark, sf, "pages")
    hrefs = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return hrefs.union(p.select("page_id", "url")).select("page_id", "target", headings.link_type("target").alias("kind"))


@query("select event_id, case when (props->>'$.k') is not null then 1 else 0 end as flag, (props->>'$.k') as k from events")
def json_flags(spark, sf):
    k = F.get_json_object("props", "$.k")
    return S.load(spark, sf, "events").select("event_id", F.when(k.isNotNull(), 1).otherwise(0).alias("flag"), k.alias("k"))


CODERS = "c as (select d.doc_id, quality::varchar as a, toxic::varchar as b, lang from labels l join documents d using (doc_id) where quality is not null and toxic is not null)"


def coders(spark, sf):
    joined = S.load(spark, sf, "labels").join(S.load(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return joined.where("quality is not null and toxic is not null").selectExpr("doc_id", "cast(quality as string) as a", "cast(toxic as string) as b", "lang")


@query(
    f"with {CODERS}, o as (select count(*)::bigint as n, avg((a = b)::int) as po from c), e as (select sum(l.n * r.n) / (max(o.n)::double * max(o.n)) as pe from (select a, count(*) as n from c group by 1) l "
    "join (select b, count(*) as n from c group by 1) r on l.a = r.b, o) select n, po as accuracy, (po - pe) / (1 - pe) as kappa from o, e"
)
def coder_agreement(spark, sf):
    return validation.agreement(coders(spark, sf), "a", "b")


@query(
    f"with {CODERS}, t as (select count(*) filter (where a = '1' and b = '1') as tp, count(*) filter (where a <> '1' and b = '1') as fp, count(*) filter (where a = '1' and b <> '1') as fn from c) "
    "select *, tp / (tp + fp)::double as precision, tp / (tp + fn)::double as recall, 2 * tp / (2 * tp + fp + fn)::double as f1 from t"
)
def detection_scores(spark, sf):
    return validation.detection(coders(spark, sf), "a", "b", "1")


GOLD = f"{CODERS}, g as (select lang as stratum, doc_id as eval_id, case when a = '0' then 'drifted' when b = '1' then 'not-a-claim' else 'supported' end as gold from c), z as (select lang as stratum, count(*) as size from documents group by 1)"


def gold(spark, sf):
    rows = coders(spark, sf).selectExpr("lang as stratum", "doc_id as eval_id", "case when a = '0' then 'drifted' when b = '1' then 'not-a-claim' else 'supported' end as gold")
    return rows, S.load(spark, sf, "documents").groupBy(F.col("lang").alias("stratum")).agg(F.count("*").alias("size"))


@query(
    f"with {GOLD}, s as (select stratum, avg((gold = 'drifted')::int) as p, avg((gold <> 'not-a-claim')::int) as q from g group by 1) select sum(size * p) / sum(size * q) as prevalence from s join z using (stratum)"
)
def adjusted_prevalence(spark, sf):
    return validation.adjusted_prevalence(*gold(spark, sf))


@query(
    f"with {GOLD}, n as (select *, row_number() over (partition by stratum order by eval_id) - 1 as place, count(*) over (partition by stratum) as m from g), "
    "d as (select n.stratum, r.i as round, (('0x' || substr(md5('1:' || n.stratum || ':' || r.i || ':' || n.place), 1, 8))::bigint) % n.m as place from n, range(5000) r(i)), "
    "s as (select d.round, d.stratum, avg((n.gold = 'drifted')::int) as p, avg((n.gold <> 'not-a-claim')::int) as q from d join n using (stratum, place) group by 1, 2), "
    "x as (select round, sum(size * p) / sum(size * q) as x from s join z using (stratum) group by round) select quantile_cont(x, 0.025) as ci_low, quantile_cont(x, 0.975) as ci_high from x"
)
def adjusted_interval(spark, sf):
    return validation.adjusted_interval(*gold(spark, sf), 5000)


@query(
    f"{ROLLUP} select variant, claim_rate, repo_rate from (select sum(h) / sum(n)::double as a, avg((h > 0)::int) as b, sum(d) / sum(n)::double as c, avg((d > 0)::int) as e, sum(d + u) / sum(n)::double as f, avg((d + u > 0)::int) as g from rollup_), "
    "lateral (values ('strict', a, b), ('main', c, e), ('lenient', f, g)) v(variant, claim_rate, repo_rate)"
)
def robustness(spark, sf):
    return metrics.robustness(kept(spark, sf))


@query(f"with c as ({S.CASES_SQL.format(events='events', micros='epoch_us')}) select count(*) as fixed, median(duration_days) as median_days, avg(duration_days) as mean_days, max(duration_days)::double as max_days from c where event_fixed = 1")
def fix_durations(spark, sf):
    return survival.durations(S.survival_cases(spark, sf))


@query(
    f"with {POOL}, t as (select *, row_number() over (order by place, stratum) as turn, case when position % 3 = 0 then 'skipped' end as skip_reason from p), "
    "g as (select turn from t where skip_reason is null order by turn limit 20) select full_name, turn, skip_reason from t where turn <= (select max(turn) from g) or (select count(*) from g) < 20"
)
def until_accepted(spark, sf):
    turns = screen.round_robin(candidate_pools(spark, sf)).withColumn("skip_reason", F.when(F.col("position") % 3 == 0, "skipped"))
    return screen.until_accepted(turns, 20).select("full_name", "turn", "skip_reason")


@query(
    "with c as (select event_id, (props->>'$.k')::int % 6 as k from events), s as (select event_id, case k when 0 then 'exit 0' when 1 then ' TRUE ' when 2 then 'pytest' when 3 then '' when 4 then 'jest --ci' end as t from c) "
    "select event_id, case when t is not null and trim(t) <> '' and lower(trim(t)) not in ('exit 0', 'true') then 1 else 0 end as flag from s"
)
def npm_scripts(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int") % 6
    script = F.when(k == 0, "exit 0").when(k == 1, " TRUE ").when(k == 2, "pytest").when(k == 3, "").when(k == 4, "jest --ci")
    content = F.when(script.isNull(), F.lit("not json")).otherwise(F.concat(F.lit('{"scripts": {"test": "'), script, F.lit('"}}')))
    return S.load(spark, sf, "events").select("event_id", T.npm_test_script(content).alias("flag"))


@query(
    "with p as (select o_custkey, o_orderkey, case when o_orderkey % 3 = 0 then ' ' || o_orderpriority when o_orderkey % 7 <> 0 then o_orderpriority else '' end as x from orders) "
    "select o_custkey, list_aggregate(list_sort(list(trim(x)) filter (where trim(x) <> '')), 'string_agg', ',') as items from p group by 1"
)
def joined_lists(spark, sf):
    x = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), "o_orderpriority")).when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).otherwise("")
    lists = S.load(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(x).alias("items"))
    back = lists.select("o_custkey", T.split_list(T.joined_list("items")).alias("items"))
    return back.select("o_custkey", F.when(F.size("items") > 0, F.array_join(F.array_sort("items"), ",")).alias("items"))


MODEL = "m as (select c_custkey, count(*) as n, ln(count(*) + 1) as lc, c_acctbal / 1000.0 as bal, count(*) filter (where o_orderpriority = '1-URGENT') as urgent from customer join orders on c_custkey = o_custkey group by c_custkey, c_acctbal)"


def model_rows(spark, sf):
    joined = S.load(spark, sf, "customer").join(S.load(spark, sf, "orders"), F.expr("c_custkey = o_custkey"))
    return joined.groupBy("c_custkey", "c_acctbal").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent")).selectExpr(
        "c_custkey", "n", "ln(n + 1) as lc", "ln(n) as off", "c_acctbal / 1000.0 as bal", "urgent", "cast(urgent > 2 as int) as some"
    )


@query(f"with {MODEL}, r as (select corr(lc, bal) as r from m) select unnest(['lc', 'bal']) as term, 1 / (1 - r * r) as vif from r")
def variance_inflation(spark, sf):
    return models.inflation(model_rows(spark, sf), ["lc", "bal"])


@query()
def logistic_model(spark, sf):
    return models.logistic(model_rows(spark, sf), "some", ["lc", "bal"]).table(spark)


@query()
def negative_binomial_model(spark, sf):
    return models.negative_binomial(model_rows(spark, sf), "urgent", ["bal"], "off").table(spark)


NEWTON = f"""with recursive {MODEL}, d as (select (urgent > 2)::int as y, lc, bal from m where lc is not null and bal is not null),
it(i, b0, b1, b2) as (select 0, 0.0::double, 0.0::double, 0.0::double union all select i + 1,
  b0 + (g0 * (h11 * h22 - h12 * h12) + g1 * (h02 * h12 - h01 * h22) + g2 * (h01 * h12 - h02 * h11)) / det, b1 + (g0 * (h12 * h02 - h01 * h22) + g1 * (h00 * h22 - h02 * h02) + g2 * (h01 * h02 - h00 * h12)) / det,
  b2 + (g0 * (h01 * h12 - h11 * h02) + g1 * (h01 * h02 - h00 * h12) + g2 * (h00 * h11 - h01 * h01)) / det from (
  select *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) as det from (
  select i, b0, b1, b2, sum(y - p) as g0, sum((y - p) * lc) as g1, sum((y - p) * bal) as g2, sum(w) as h00, sum(w * lc) as h01, sum(w * bal) as h02, sum(w * lc * lc) as h11, sum(w * lc * bal) as h12, sum(w * bal * bal) as h22
  from (select *, p * (1 - p) as w from (select it.*, d.*, 1 / (1 + exp(-(b0 + b1 * lc + b2 * bal))) as p from it, d where i < 20)) group by i, b0, b1, b2))),
f as (select b0, b1, b2 from it where i = 20),
h as (select sum(w) as h00, sum(w * lc) as h01, sum(w * bal) as h02, sum(w * lc * lc) as h11, sum(w * lc * bal) as h12, sum(w * bal * bal) as h22, sum(y * e - ln(1 + exp(e))) as ll, avg(y) as s, count(*) as n
  from (select *, p * (1 - p) as w from (select y, lc, bal, b0 + b1 * lc + b2 * bal as e, 1 / (1 + exp(-(b0 + b1 * lc + b2 * bal))) as p from f, d))),
v as (select *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) as det from h),
t as (select unnest(['const', 'lc', 'bal']) as term, unnest([b0, b1, b2]) as coefficient, unnest([sqrt((h11 * h22 - h12 * h12) / det), sqrt((h00 * h22 - h02 * h02) / det), sqrt((h00 * h11 - h01 * h01) / det)]) as se,
  1 - ll / (n * (s * ln(s) + (1 - s) * ln(1 - s))) as r2 from f, v)
select term, round(coefficient, 6) as coefficient, round(se, 6) as se, round(coefficient / se, 4) as z, round(exp(coefficient), 6) as ratio, round(exp(coefficient - 1.96 * se), 6) as ratio_low, round(exp(coefficient + 1.96 * se), 6) as ratio_high, round(r2, 6) as pseudo_r2 from t"""


@query(NEWTON)
def logistic_coefficients(spark, sf):
    """The fit by triangles beside Newton's method in SQL."""
    fit = models.logistic(model_rows(spark, sf), "some", ["lc", "bal"])
    six = ("coefficient", "se", "ratio", "ratio_low", "ratio_high")
    return fit.table(spark).select("term", *[F.round(c, 6).alias(c) for c in six], F.round("z", 4).alias("z"), F.lit(round(fit.pseudo_r2, 6)).alias("pseudo_r2"))


@query(
    f"with {MODEL}, z as (select unnest(['const', 'bal']) as term, true as at_maximum from (select count(*) as n from m) where n > 0) select * from z"
)
def dispersion_gradient(spark, sf):
    """Is the gradient of the negative binomial likelihood zero at the fit's coefficients? Taken over the rows by SQL, apart from the fit."""
    rows = staged(model_rows(spark, sf).select("urgent", "bal", "off"), "counts")
    fit = models.negative_binomial(rows, "urgent", ["bal"], "off")
    (b0, b1), r = (float(b) for b in fit.coefficients), 1 / fit.alpha
    rows.createOrReplaceTempView("_counts")
    return spark.sql(
        f"with g as (select (urgent - mu) * {r!r} / ({r!r} + mu) as s, bal, urgent from (select *, exp({b0!r} + {b1!r} * bal + off) as mu from _counts)), "
        "a as (select sum(s) as g0, sum(s * bal) as g1, sum(urgent) as n, sum(urgent * abs(bal)) as m from g) select 'const' as term, abs(g0) < 1e-6 * n as at_maximum from a union all select 'bal', abs(g1) < 1e-6 * m from a"
    )


# ---- coder sheets to scores ------------------------------------------------------

SHEETS = (
    "l as (select d.doc_id, lang, source, n_chars, quality, toxic from labels l join documents d on l.doc_id = d.doc_id where quality is not null and toxic is not null), "
    "s as (select cast(doc_id as {s}) as eval_id, concat(lang, '/', source) as full_name, lang as claim_type, case when doc_id % 7 <> 0 then source end as artifact_or_path, doc_id % 5 as line_no, "
    "case when quality = 0 then 'drifted' when doc_id % 3 = 0 then 'uncertain' else 'supported' end as a, case when toxic = 1 then 'drifted' when doc_id % 3 = 0 then 'uncertain' else 'supported' end as b, "
    "case when doc_id % 2 = 0 then 'not-a-claim' else 'drifted' end as c, lang as stratum, case when doc_id % 11 = 0 then 'excluded' else 'kept' end as status, "
    "case n_chars % 4 when 0 then 'drifted_high' when 1 then 'drifted_medium' when 2 then 'uncertain' else 'supported' end as label_v4 from l)"
)
FIRST_LABEL = "select distinct full_name, claim_type, artifact_or_path, case ascii(substr(full_name, 4, 1)) % 3 when 0 then 'drifted_medium' when 1 then 'supported' else 'uncertain' end as label from s where status = 'kept'"


def sheets(spark, sf):
    S.load(spark, sf, "labels").createOrReplaceTempView("_labels")
    S.load(spark, sf, "documents").createOrReplaceTempView("_documents")
    return staged(spark.sql("with " + SHEETS.format(s="string").replace("from labels l join documents", "from _labels l join _documents") + " select * from s"), "sheets")


def first_labels(rows):
    rows.createOrReplaceTempView("_sheet_rows")
    return rows.sparkSession.sql(FIRST_LABEL.replace("from s ", "from _sheet_rows "))


WORD = "case when {x} like 'drifted%' then 'drifted' else {x} end"
EVALUATION = (
    f"with {SHEETS.format(s='varchar')}, f as ({FIRST_LABEL}), e as (select eval_id, s.stratum, a, b, case when a = b then a when eval_id::bigint % 4 = 3 then 'supported' else c end as gold, "
    f"case when status = 'excluded' then 'not-a-claim' else {WORD.format(x='label_v4')} end as final, {WORD.format(x='label')} as init "
    "from s left join f on s.full_name = f.full_name and s.claim_type = f.claim_type and s.artifact_or_path is not distinct from f.artifact_or_path)"
)


def evaluation(spark, sf):
    """Both coders' sheets and the consensus go out as workbooks and are read again; key and labels are tables."""
    rows, folder = sheets(spark, sf), passing_folder(spark, "sheets")
    answers = "eval_id string, claim_type string, artifact_or_path string, coder_label string"
    for name in "ab":
        workbook.write_workbooks(rows.select("eval_id", "claim_type", "artifact_or_path", F.col(name).alias("coder_label")), f"{folder}/{name}", "Answers")
    settled = F.when(F.col("eval_id").cast("long") % 4 == 3, "supported").otherwise(F.col("c"))
    workbook.write_workbooks(rows.where("a <> b").select("eval_id", settled.alias("consensus_label")), f"{folder}/c")
    a, b = (workbook.read_workbooks(spark, f"{folder}/{n}", answers, "Answers") for n in "ab")
    consensus = workbook.read_workbooks(spark, f"{folder}/c", "eval_id string, consensus_label string")
    return validation.evaluation_set(a, b, rows, consensus, first_labels(rows))


@query(f"{EVALUATION} select eval_id, gold, final, init from e")
def evaluation_set(spark, sf):
    return evaluation(spark, sf).select("eval_id", "gold", "final", "init")


def scores(name):
    return (
        f"select '{name}' as detector, count(*) filter (where {name} = 'drifted' and gold = 'drifted') as tp, count(*) filter (where {name} = 'drifted' and gold <> 'drifted') as fp, "
        f"count(*) filter (where gold = 'drifted' and coalesce({name}, '') <> 'drifted') as fn, avg(({name} is not distinct from gold)::int) as accuracy from e"
    )


@query(f"{EVALUATION}, t as ({scores('final')} union all {scores('init')}) select *, tp / nullif(tp + fp, 0)::double as precision, tp / nullif(tp + fn, 0)::double as recall from t")
def evaluation_scores(spark, sf):
    """Sheets to scores: accuracy and drift detection of both detectors against the gold labels."""
    e = staged(evaluation(spark, sf).select("gold", "final", "init"), "evaluation")
    each = []
    for name in ("final", "init"):
        known = e.withColumn(name, F.coalesce(name, F.lit("")))
        found = validation.detection(known, "gold", name).select("tp", "fp", "fn", "precision", "recall")
        each.append(found.join(validation.agreement(e, name, "gold").select("accuracy"), F.lit(True)).select(F.lit(name).alias("detector"), "tp", "fp", "fn", "accuracy", "precision", "recall"))
    return each[0].union(each[1])


def kappa(name):
    return (
        f"select '{name}' as detector, avg((coalesce({name}, '') = gold)::int) as po, (select sum(x.n * y.n) / (select count(*) from e)::double / (select count(*) from e) from (select coalesce({name}, '') as v, count(*) as n from e group by 1) x "
        "join (select gold as v, count(*) as n from e group by 1) y on x.v = y.v) as pe from e"
    )


@query(
    f"{EVALUATION}, t as ({scores('final')} union all {scores('init')}), k as ({kappa('final')} union all {kappa('init')}) select detector, "
    "printf('[%s] accuracy=%.3f kappa=%.3f drift P=%s (%d/%d) R=%s (%d/%d) F1=%s', detector, po, (po - pe) / (1 - pe), case when tp + fp > 0 then printf('%.3f', tp / (tp + fp)::double) else 'nan' end, tp, tp + fp, "
    "case when tp + fn > 0 then printf('%.3f', tp / (tp + fn)::double) else 'nan' end, tp, tp + fn, case when 2 * tp + fp + fn > 0 then printf('%.3f', 2 * tp / (2 * tp + fp + fn)::double) else 'nan' end) as line from t join k using (detector)"
)
def score_report(spark, sf):
    """The lines of the scores' report."""
    e = staged(evaluation(spark, sf).select("gold", "final", "init"), "evaluation").na.fill("", ["final", "init"])
    each = []
    for name in ("final", "init"):
        both = validation.detection(e, "gold", name).select("tp", "fp", "fn").join(validation.agreement(e, name, "gold").select("accuracy", "kappa"), F.lit(True))
        each.append(both.select(F.lit(name).alias("detector"), reports.score_line(F.lit(name), *[F.col(c) for c in ("accuracy", "kappa", "tp", "fp", "fn")]).alias("line")))
    return each[0].union(each[1])


@query(
    f"with {SHEETS.format(s='varchar')}, o as (select full_name, line_no, claim_type, artifact_or_path, min(label_v4) as label, min(status) as status, max(label_v4) as label_v4 from s group by all) "
    f"select eval_id as validation_id, c as gold, case when o.status = 'excluded' then 'not-a-claim' else {WORD.format(x='o.label_v4')} end as final, {WORD.format(x='o.label')} as init "
    "from s left join o on s.full_name = o.full_name and s.line_no = o.line_no and s.claim_type = o.claim_type and s.artifact_or_path is not distinct from o.artifact_or_path"
)
def development_set(spark, sf):
    rows = sheets(spark, sf)
    keys = ["full_name", "line_no", "claim_type", "artifact_or_path"]
    labels = rows.groupBy(*keys).agg(F.min("label_v4").alias("label"), F.min("status").alias("status"), F.max("label_v4").alias("label_v4"), F.min("eval_id").alias("claim_seq"))
    sheet = rows.select(F.col("eval_id").alias("validation_id"), F.concat(F.lit("https://github.com/"), "full_name").alias("repository_url"), "line_no", "claim_type", "artifact_or_path", F.col("c").alias("consensus_label"))
    return validation.development_set(sheet, labels).select("validation_id", "gold", "final", "init")


@query(
    f"{KEPT}, u as (select claim_seq, min(full_name) as full_name, min(claim_type) as claim_type, min(line_no) as line_no from kept group by 1), n as (select *, row_number() over (order by md5('42/blind|' || claim_seq), claim_seq) as n from u) "
    "select printf('EVAL_%03d', n) as eval_id, full_name, claim_type, line_no, '' as coder_label, '' as coder_justification, '' as artifact_found from n"
)
def blinded_sheet(spark, sf):
    """The sheet that coders of all kept claims would get."""
    once = kept(spark, sf).groupBy("claim_seq").agg(*[F.min(c).alias(c) for c in ("full_name", "claim_type", "line_no")])
    return sampling.blinded(once, ["full_name", "claim_type", "line_no"])


@query(
    f"with {S.CLAIMS}, o as (select *, row_number() over (partition by full_name order by md5('42|' || claim_seq), claim_seq) as k from claims), "
    "n as (select *, row_number() over (order by md5('42|' || full_name), full_name) as n from o where k = 1), c as (select printf('P%03d', n) as case_id, full_name, claim_seq from n where n <= 100) "
    "select * from c where claim_seq % 5 in (1, 2)"
)
def confirmed_cases(spark, sf):
    cases = cohort(spark, sf)
    said = F.element_at(F.array(*map(F.lit, ("Yes ", "true", "no", "", "maybe"))), F.when(F.col("claim_seq") % 5 == 0, 5).otherwise(F.col("claim_seq") % 5).cast("int"))
    return sampling.confirmed(cases, cases.select("case_id", said.alias("confirmed")))


# ---- sources over supplied rows ---------------------------------------------------


@query("select doc_id, md5(coalesce(text, '')) as digest, length(coalesce(text, '')) as chars from documents")
def decoded_files(spark, sf):
    """Documents as bodies in Base64, broken into lines as a server sends them, and read back."""
    d = S.load(spark, sf, "documents")
    lines = F.regexp_replace(F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8")), "(.{60})", "$1\n")
    return tables.file_contents(d.select("doc_id", lines.alias("content"))).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"), F.length("text").cast("long").alias("chars"))


@query(
    "with c as (select c_nationkey as query, c_name, c_custkey, c_acctbal, row_number() over (partition by c_nationkey order by c_custkey) - 1 as position from customer) "
    "select query, position, c_name as full_name, c_custkey % 5000 as stargazers_count, case when c_acctbal > 0 then 'main' end as default_branch from c"
)
def search_pages(spark, sf):
    """Customers of a nation as one landed page of a search, and its items as rows again."""
    c = S.load(spark, sf, "customer")
    item = F.struct("c_custkey", F.struct(F.col("c_name").alias("full_name"), (F.col("c_custkey") % 5000).alias("stargazers_count"), F.when(F.col("c_acctbal") > 0, "main").alias("default_branch")).alias("item"))
    items = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"])
    pages = c.groupBy(F.col("c_nationkey").alias("query")).agg(F.to_json(F.struct(items.alias("items"))).alias("body"))
    return tables.search_results(pages).select("query", "position", "full_name", "stargazers_count", "default_branch")


TREE = "select o_custkey::varchar as full_name, lower(p_name) || case o_orderkey % 3 when 0 then '.py' when 1 then '/Makefile' else '/.github/workflows/ci.yml' end as path, o_orderkey % 7 as branch, case when l_linenumber = 1 then 'tree' else 'blob' end as type from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey"


def tree(spark, sf):
    o, line, part = (S.load(spark, sf, t) for t in ("orders", "lineitem", "part"))
    joined = o.join(line, F.expr("l_orderkey = o_orderkey")).join(part, F.expr("p_partkey = l_partkey"))
    path = "concat(lower(p_name), case o_orderkey % 3 when 0 then '.py' when 1 then '/Makefile' else '/.github/workflows/ci.yml' end)"
    return joined.selectExpr("cast(o_custkey as string) as full_name", f"{path} as path", "o_orderkey % 7 as branch", "case when l_linenumber = 1 then 'tree' else 'blob' end as type")


@query(
    f"with t as ({TREE}), d as (select * from t where branch = 0), f as (select * from t where branch = 1) select full_name, path, type from d union all select full_name, path, type from f where full_name not in (select full_name from d)"
)
def tree_fallback(spark, sf):
    """Paths of the default branch; of repositories without any, those of the other."""
    t = tree(spark, sf)
    return tables.tree_or_fallback(t.where("branch = 0"), t.where("branch = 1")).select("full_name", "path", "type")


@query(f"with t as ({TREE}) select full_name, path from t where type = 'blob' and (regexp_extract(lower(path), '[^/]*$') in ({', '.join(repr(n) for n in R.CONFIG_NAMES)}) or lower(path) like '.github/workflows/%')")
def config_rows(spark, sf):
    return screen.config_rows(tree(spark, sf)).select("full_name", "path")


@query(f"select full_name, skip_reason from ({screening.ORACLES['screened_repositories']}) where skip_reason is not null")
def skip_log(spark, sf):
    return screen.skip_log(screening.screened_repositories(spark, sf))


@query(f"{ROLLUP}, x as (select (s - d) / n::double as dri from rollup_) select least(floor((dri + 1.0::double) / (2.0::double / 20)), 19)::int as bin, count(*) as n from x group by 1")
def dri_histogram(spark, sf):
    return metrics.histogram(metrics.repo_rollup(kept(spark, sf)), "dri", -1.0, 1.0, 20)


@query(
    f"with {STATES}, b as (select *, case state when 'drift' then '..' when 'no_claim' then 'dir' || idx when 'unknown' then '' end as step, case when lag(state) over w is not distinct from state or lag(state) over w in ('drift', 'no_claim') and idx > 0 then 0 else 1 end as fresh from s window w as (partition by full_name order by idx)), "
    "i as (select *, sum(fresh) over (partition by full_name order by idx) as island from b), c as (select *, case when step in ('', '.', '..') then '' else step end as into_ from i) "
    "select full_name, idx, island::bigint as island, coalesce(last_value(into_ ignore nulls) over (partition by full_name, island order by idx rows between unbounded preceding and current row), '') as cwd from c"
)
def working_directories(spark, sf):
    """The directory after each step of an island; steps go up, into a directory, back to the start or nowhere."""
    step = F.when(F.col("state") == "drift", "..").when(F.col("state") == "no_claim", F.concat(F.lit("dir"), F.col("idx").cast("string"))).when(F.col("state") == "unknown", "")
    by = Window.partitionBy("full_name").orderBy("idx")
    before = F.lag("state").over(by)
    new = F.when(before.eqNullSafe(F.col("state")) | (F.coalesce(before.isin("drift", "no_claim"), F.lit(False)) & (F.col("idx") > 0)), 0).otherwise(1)
    rows = S.states(spark, sf).withColumn("line_no", new).withColumn("line_no", F.sum("line_no").over(by))
    out = sequence.working_directory(rows.select("full_name", "line_no", F.lit("x").alias("context_type"), F.col("idx").alias("claim_order"), step.alias("into")))
    return out.select("full_name", F.col("claim_order").alias("idx"), "island", "cwd")


# ---- text to labels, over repositories made in the query -----------------------


CHAIN = chain.chain(LINK_KIND)


def analysed(spark, sf):
    """The stages' tables, each written once: later plans start from them."""
    t = S.repositories(spark, sf)
    elements = staged(readme.elements(t["readmes"]), "elements")
    found = staged(claims.extract(elements, t["repos"]), "claims")
    index, keys = staged(artifacts.artifact_index(t["trees"], t["configs"]), "index"), staged(artifacts.path_keys(t["trees"]), "keys")
    return t, elements, found, index, keys


@query(CHAIN["readme_elements"])
def readme_elements(spark, sf):
    e = readme.elements(S.repositories(spark, sf)["readmes"])
    count = lambda kind: F.count_if(F.col("elem_type") == kind)
    return e.groupBy("full_name").agg((count("heading") - 1).alias("headings"), count("fenced_code").alias("fenced"), count("inline_code").alias("inline_code"), count("markdown_link").alias("links"), count("section_line").alias("lines"))


TEXTS = "select 'd' || doc_id as full_name, text as x from documents union all select 'p' || page_id, html from pages"


@query(f"select full_name, elem_type, line_no, heading, section_class, operational_hint, md5(content) as content, link_target, link_target_type from ({chain.elements_sql(TEXTS, LINK_KIND)})")
def parsed_texts(spark, sf):
    """The README parser over all texts of documents and pages."""
    e = readme.elements(supplied_texts(spark, sf))
    return e.select("full_name", "elem_type", "line_no", "heading", "section_class", "operational_hint", F.md5("content").alias("content"), "link_target", "link_target_type")


#: Supplied texts as instructions: what follows a full stop becomes a command, and what a comma ends names a file.
INSTRUCTIONS = "concat('## Install', chr(10), replace(replace(regexp_replace(text, '[^\\x00-\\x7F]', 'x'{all}), '. ', concat('.', chr(10), 'make ')), ', ', ' of src/a.py, '))"
INSTRUCTED = chain.elements_sql(f"select 'd' || doc_id as full_name, {INSTRUCTIONS.format(all=", 'g'")} as x from documents", LINK_KIND)


@query(f"select full_name, line_no, context_type, claim_type, artifact_or_path, md5(snippet) as snippet, evidence_level, claim_seq from ({extraction.claims_sql(INSTRUCTED, "select 'd' || doc_id as full_name, 0 as curated from documents")})")
def instructed_claims(spark, sf):
    """Claims of all documents, read as instructions."""
    d = S.load(spark, sf, "documents")
    texts = d.select(F.concat(F.lit("d"), "doc_id").alias("full_name"), F.expr(INSTRUCTIONS.format(all="").replace("\\", "\\\\")).alias("readme_text"))
    found = claims.extract(staged(readme.elements(texts), "elements"), texts.select("full_name", F.lit(False).alias("curated_list_heuristic")))
    return found.select("full_name", "line_no", "context_type", "claim_type", "artifact_or_path", F.md5("snippet").alias("snippet"), "evidence_level", "claim_seq")


def supplied_texts(spark, sf):
    d, p = S.load(spark, sf, "documents"), S.load(spark, sf, "pages")
    return d.selectExpr("concat('d', doc_id) as full_name", "text as readme_text").union(p.selectExpr("concat('p', page_id)", "html"))


@query(CHAIN["extracted_claims"])
def extracted_claims(spark, sf):
    return analysed(spark, sf)[2].select("full_name", "line_no", "context_type", "claim_type", "artifact_or_path", "snippet", "evidence_level", "claim_seq")


@query(CHAIN["artifact_index"])
def artifact_index(spark, sf):
    t = S.repositories(spark, sf)
    return artifacts.artifact_index(t["trees"], t["configs"]).select("full_name", "file_count", "dir_count", "has_requirements_txt", "has_makefile", "has_tests_dir", "has_pyproject_toml", F.array_join("make_targets", ",").alias("targets"))


@query(CHAIN["baseline_labels"])
def baseline_labels(spark, sf):
    _, _, found, index, keys = analysed(spark, sf)
    return baseline.baseline(found, index, keys).select("full_name", "claim_seq", "claim_type", "drift_family", "label", "reason")


@query(CHAIN["final_labels"])
def final_labels(spark, sf):
    _, elements, found, index, keys = analysed(spark, sf)
    out = sequence.final_labels(staged(baseline.baseline(found, index, keys), "labels"), elements, index, keys)
    return out.select("full_name", "claim_seq", "claim_type", "status", "label_v4", "drift_family_v4", "verification", "reason_v4", "changed")


@query(
    f"with l as (select distinct p_brand as language from part), b as (select * from (values {', '.join(map(str, R.STAR_BANDS))}) b(l, h)), w as (select * from (values {', '.join(map(str, R.PUSH_WINDOWS))}) w(n, o)) "
    "select language, b.l::bigint as star_low, b.h::bigint as star_high, 'language:' || language || ' fork:false archived:false stars:' || b.l || '..' || b.h || ' pushed:' || strftime(date '2024-06-01' - o::int, '%Y-%m-%d') || '..' || strftime(date '2024-06-01' - n::int, '%Y-%m-%d') as query, "
    "language || '|stars:' || b.l || '-' || b.h || '|pushed:' || n || '-' || o || 'd' as stratum from l, b, w"
)
def search_queries(spark, sf):
    """The searches of a corpus in each brand as a language."""
    return screen.search_queries(S.load(spark, sf, "part").select(F.col("p_brand").alias("language")).distinct(), "2024-06-01")


for part in (detectors, extraction, screening):
    QUERIES.update(part.QUERIES)
    ORACLES.update(part.ORACLES)
