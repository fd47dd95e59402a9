"""Stratified and proportional sampling, blinding, cohorts (U1 to U11): ranks by a seeded MD5 that any engine repeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staged import staged
from .metrics import numbered
from .screen import seeded

# Strata of the two validation sets and how many claims each gives.
STRATUM_SIZES = {"drifted": 80, "supported": 40, "supported_sequence": 15, "supported_external": 10, "uncertain": 25, "excluded": 30}
DEVELOPMENT_SIZES = {"drifted": 80, "supported": 80, "uncertain": 40}


def stratum(label: str = "label_v4") -> Column:
    """The stratum of a labelled claim; null for a verification that is none of the known ones."""
    verified = F.when(F.col("verification") == "verified", "supported").when(F.col("verification").isin("sequence", "external"), F.concat(F.lit("supported_"), "verification"))
    return F.when(F.col("status") != "kept", "excluded").when(F.col(label).startswith("drifted"), "drifted").when(F.col(label) == "uncertain", "uncertain").otherwise(verified)


def strata_sizes(labels: DataFrame) -> DataFrame:
    """stratum, size of the kept claims: what the adjusted prevalence is weighted with."""
    return labels.where("status = 'kept'").withColumn("stratum", stratum()).groupBy("stratum").agg(F.count("*").alias("size"))


#: Groups whose bounds are sent to all tasks.
MOST_GROUPS = 20_000


def first_of_group(rows: DataFrame, group: str, order: Column, key: str, quota: Callable[[DataFrame], DataFrame], digits: int = 3) -> DataFrame:
    """The first rows of each group by ``order`` (a hexadecimal text) and key, as many as ``quota`` says: a function of the groups' sizes (group, size) that gives (group, _quota).

    Rows are counted by group and the first digits of the order, which tells how far into the
    order a group's quota reaches; only rows up to there are ranked, which is the quota and about
    1 / 16^digits of a group. No group is sorted or gathered whole.
    """
    part = F.substring(order, 1, digits)
    sizes = staged(rows.groupBy(group, part.alias("_part")).agg(F.count("*").alias("_n")), "sizes")
    groups = sizes.groupBy(group).agg(F.sum("_n").alias("size"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = sizes.join(quota(groups), group).withColumn("_before", before).where("_before < _quota")
    bounds = staged(reached.groupBy(group).agg(F.max("_part").alias("_upto"), F.first("_quota").alias("_quota")), "bounds")
    few = bounds.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS
    some = rows.join(F.broadcast(bounds) if few else bounds, group).where(part <= F.col("_upto")).withColumn("_order", order)
    return some.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy("_order", key))).where("_k <= _quota").select(*rows.columns)


def per_stratum(rows: DataFrame, stratum_col: str, sizes: dict[str, int], key: str, seed: int = 42) -> DataFrame:
    """sizes[s] rows of each stratum s (all, if there are fewer), in a seeded order."""
    quota = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col(stratum_col)), F.lit(0))
    return first_of_group(rows.where(F.col(stratum_col).isin(*sizes)), stratum_col, seeded(seed, key), key, lambda groups: groups.select(stratum_col, quota.alias("_quota")))


def proportional(rows: DataFrame, type_col: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows: of each type its share of n (at least one), then the first n of all in a seeded order."""

    def quota(groups: DataFrame) -> DataFrame:
        total = groups.agg(F.sum("size").alias("_all"))
        return groups.join(total, F.lit(True)).select(type_col, F.greatest(F.lit(1), F.bround(n * F.col("size") / F.col("_all"))).alias("_quota"))

    some = first_of_group(rows, type_col, seeded(seed, key), key, quota)
    return some.orderBy(seeded(f"{seed}/all", key), key).limit(n)


def blinded(sample: DataFrame, claim_columns: list[str], prefix: str = "EVAL_", width: int = 3, seed: int = 42, key: str = "claim_seq") -> DataFrame:
    """Sheets for coders: sequential ids in a seeded order, the claim's columns, empty answers; no labels."""
    return numbered(sample, seeded(f"{seed}/blind", key), key, "_n").select(
        F.format_string(f"{prefix}%0{width}d", "_n").alias("eval_id"), *claim_columns,
        F.lit("").alias("coder_label"), F.lit("").alias("coder_justification"), F.lit("").alias("artifact_found"),
    )


def cohort(cases: DataFrame, repos: int, key: str, seed: int = 42) -> DataFrame:
    """One case each of so many repositories, numbered P001 on."""
    one = cases.withColumn("_k", F.row_number().over(Window.partitionBy("full_name").orderBy(seeded(seed, key), key))).where("_k = 1").drop("_k")
    return numbered(one, seeded(seed, "full_name"), "full_name", "_n").where(F.col("_n") <= repos).select(F.format_string("P%03d", "_n").alias("case_id"), *one.columns)


def confirmed(cases: DataFrame, answers: DataFrame | None) -> DataFrame:
    """The cases a reader has confirmed (yes, y, true, 1); all of them if there are no answers."""
    if answers is None:
        return cases
    yes = answers.where(F.lower(F.trim("confirmed")).isin("yes", "y", "true", "1")).select("case_id").distinct()
    return cases.join(yes, "case_id", "left_semi")
