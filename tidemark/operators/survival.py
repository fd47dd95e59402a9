"""Kaplan-Meier estimation (P9, P10) and the as-of lookup of its curve (J13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered, as_of
from .selection import exact_quantiles


def kaplan_meier(cases: DataFrame, duration: str = "duration_days", event: str = "event_fixed") -> DataFrame:
    """time_days, at_risk, events, survival, ci_low, ci_high for every distinct duration, censored ones too.

    Survival is exp of summed logs with a flag for having reached zero, so that it
    stays zero; Greenwood's variance leaves out the term of a time at which all at
    risk have the event; the band is 1.96 standard errors, cut to [0, 1]. Cases are
    aggregated by time first; running sums go over range partitions of the times.
    """
    t = cases.where(F.col(duration).isNotNull()).groupBy(F.col(duration).cast("int").alias("time_days")).agg(F.count("*").alias("c"), F.sum(F.col(event).cast("long")).alias("events"))
    times = Ordered(t, ["time_days"])
    run = times.running(sums={"upto": F.col("c")}, whole={"all": F.col("c")})
    risk = run.withColumn("at_risk", F.col("all") - F.col("upto") + F.col("c")).drop("all", "upto")
    n, d = F.col("at_risk").cast("double"), F.col("events").cast("double")
    part = F.when(d < n, F.ln(1 - d / n))
    steps = times.running(risk, sums={"log_s": part, "v": F.when(d < n, d / (n * (n - d)))}, tops={"zero": (F.col("events") == F.col("at_risk")).cast("int")})
    s = F.when(F.col("zero") == 1, 0.0).otherwise(F.exp("log_s"))
    half = 1.96 * s * F.sqrt("v")
    return steps.select("time_days", "at_risk", "events", s.alias("survival"), F.greatest(F.lit(0.0), s - half).alias("ci_low"), F.least(F.lit(1.0), s + half).alias("ci_high"))


def survival_summary(curve: DataFrame) -> DataFrame:
    """One row: the median time (null if survival stays over one half) and the survival at the end."""
    return curve.agg(F.min(F.when(F.col("survival") <= 0.5, F.col("time_days"))).alias("median_days"), F.max_by("survival", "time_days").alias("end_survival"), F.sum("events").alias("events"))


def durations(cases: DataFrame, by: str | None = None) -> DataFrame:
    """Median, mean and longest duration of the fixed cases, and how many there are; for each value of ``by`` if it is given."""
    fixed = cases.where("event_fixed = 1 and duration_days is not null").withColumn("duration_days", F.col("duration_days").cast("double"))
    rest = fixed.groupBy(*[by] if by else []).agg(F.count("*").alias("fixed"), F.avg("duration_days").alias("mean_days"), F.max("duration_days").alias("max_days"))
    middle = exact_quantiles(fixed, "duration_days", [0.5], [by] if by else None).select(*[F.col(by).alias("_by")] if by else [], F.col("quantiles")[0].alias("median_days"))
    both = rest.join(middle, F.col(by).eqNullSafe(F.col("_by")) if by else F.lit(True))
    return both.select(*[by] if by else [], "fixed", "median_days", "mean_days", "max_days")


def survival_at(curve: DataFrame, queries: DataFrame, time: str) -> DataFrame:
    """queries with the curve's survival at the last time not after each one's; 1 before the first, null where the time is null."""
    found = as_of(queries, time, curve, "time_days", "survival", "survival")
    return found.withColumn("survival", F.when(F.col(time).isNotNull(), F.coalesce("survival", F.lit(1.0))))
