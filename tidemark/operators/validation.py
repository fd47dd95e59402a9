"""Coder agreement, detector scores, adjusted prevalence (M11 to M17, J8 to J10)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import digests
from ..sources.staged import staged
from . import metrics


def outcome(label: Column, status: Column | None = None) -> Column:
    """The reader's word for a label: drifted, supported, uncertain or, if excluded, not-a-claim."""
    out = F.when(label.isin("drifted_high", "drifted_medium"), "drifted").when(label.isin("supported", "uncertain"), label)
    return out if status is None else F.when(status == "excluded", "not-a-claim").otherwise(out)


def gold(a: Column, b: Column, consensus: Column) -> Column:
    """What both coders say, else the consensus; a missing one is an error."""
    value = F.when(a.eqNullSafe(b), a).otherwise(consensus)
    return F.when(F.assert_true(value.isNotNull(), F.lit("no gold label")).isNull(), value)


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, accuracy and Cohen's kappa of two label columns. Only the counts of pairs are gathered."""
    pairs = rows.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("c"))
    n = pairs.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x").eqNullSafe(F.col("y")), F.col("c")).otherwise(0)).alias("same"))
    left = pairs.groupBy(F.col("x").alias("v")).agg(F.sum("c").alias("l"))
    right = pairs.groupBy(F.col("y").alias("v")).agg(F.sum("c").alias("r"))
    chance = left.join(right, left["v"].eqNullSafe(right["v"])).agg(F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("p"))
    observed, expected = F.col("same") / F.col("n"), F.col("p") / (F.col("n").cast("double") * F.col("n"))
    return n.join(chance, F.lit(True)).select("n", observed.alias("accuracy"), ((observed - expected) / (1 - expected)).alias("kappa"))


def detection(rows: DataFrame, truth: str, found: str, positive: str = "drifted") -> DataFrame:
    """One row: tp, fp, fn, precision, recall and F1 for one label."""
    t, f = F.col(truth) == positive, F.col(found) == positive
    counts = rows.agg(F.count_if(t & f).alias("tp"), F.count_if(~t & f).alias("fp"), F.count_if(t & ~f).alias("fn"))
    return counts.select(
        "*", F.expr("try_divide(tp, tp + fp)").alias("precision"), F.expr("try_divide(tp, tp + fn)").alias("recall"), F.expr("try_divide(2 * tp, 2 * tp + fp + fn)").alias("f1")
    )


def adjusted_prevalence(sample: DataFrame, strata: DataFrame) -> DataFrame:
    """One row: drifted claims over real claims, each stratum's share in the sample weighted by its size.

    sample: stratum, gold; strata: stratum, size. Strata without a sampled claim add nothing.
    """
    shares = sample.groupBy("stratum").agg(F.avg((F.col("gold") == "drifted").cast("int")).alias("p"), F.avg((F.col("gold") != "not-a-claim").cast("int")).alias("q"))
    return shares.join(strata, "stratum").agg((F.sum(F.col("size") * F.col("p")) / F.sum(F.col("size") * F.col("q"))).alias("prevalence"))


#: Rounds that a task draws for a stratum.
ROUNDS_A_GROUP = 50


def drawn_shares(places: DataFrame, rounds: int, seed: int) -> DataFrame:
    """round, stratum, p, q of places (stratum, place, gold), draws as rows that are joined."""
    sizes = places.groupBy("stratum").agg(F.count("*").alias("m"))
    slots = places.select("stratum", F.col("place").alias("slot")).join(sizes, "stratum")
    every = slots.select("*", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "stratum", F.col("round").cast("string"), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("m")
    drawn = every.select("stratum", "round", pick.alias("place")).join(places, ["stratum", "place"])
    return drawn.groupBy("round", "stratum").agg(F.avg((F.col("gold") == "drifted").cast("int")).alias("p"), F.avg((F.col("gold") != "not-a-claim").cast("int")).alias("q"))


def counted_shares(places: DataFrame, rounds: int, seed: int) -> DataFrame:
    """The same; a task holds a stratum's labels as an array of codes and draws some rounds by numpy, so that no draw is shuffled."""
    gold = F.col("gold")
    code = F.when(gold.isNull(), 0).otherwise(4 + F.when(gold == "drifted", 1).otherwise(0) + F.when(gold != "not-a-claim", 2).otherwise(0))  # bits: drifted, a claim, known

    def draw(table):
        (codes,) = metrics.unpacked(table, ["code"])
        first, stratum = table.column("group")[0].as_py() * ROUNDS_A_GROUP, table.column("stratum")[0].as_py()
        numbers = range(first, min(first + ROUNDS_A_GROUP, rounds))
        counts = np.zeros((len(numbers), 8), dtype=np.int64)
        for i, place in digests.picks([f"{seed}:{stratum}:{b}:".encode() for b in numbers], len(codes), len(codes)):
            counts[i] += np.bincount(codes[place], minlength=8)
        with_bit = lambda bit: counts[:, [c for c in range(8) if c & bit]].sum(axis=1)
        return pa.table({"round": pa.array(numbers, pa.int64()), "stratum": [stratum] * len(numbers), "p": with_bit(1), "q": with_bit(2), "known": with_bit(4)})

    packed = metrics.in_groups(places.select("stratum", "place", code.alias("code")), ["stratum"], ["code"], rounds, ROUNDS_A_GROUP)
    sums = packed.groupBy("stratum", "group").applyInArrow(draw, "round long, stratum string, p long, q long, known long")
    return sums.select("round", "stratum", *[F.expr(f"try_divide({c}, known)").alias(c) for c in "pq"])


def adjusted_interval(sample: DataFrame, strata: DataFrame, rounds: int, seed: int = 1, most: int = metrics.MOST_PLACES) -> DataFrame:
    """One row: the interval of the adjusted prevalence when claims are drawn again within strata. sample: stratum, eval_id, gold. Up to ``most`` sampled claims are drawn in arrays."""
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("eval_id")) - 1
    places = staged(sample.where("stratum is not null").select("stratum", place.alias("place"), "gold"), "places")
    shares = (counted_shares if places.count() <= most else drawn_shares)(places, rounds, seed)
    x = shares.join(strata, "stratum").groupBy("round").agg((F.sum(F.col("size") * F.col("p")) / F.sum(F.col("size") * F.col("q"))).alias("x"))
    p = F.percentile("x", F.array(F.lit(0.025), F.lit(0.975)))
    return x.agg(p[0].alias("ci_low"), p[1].alias("ci_high"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join in which missing keys match missing keys."""
    other = right.select(*[F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in right.columns])
    test = F.lit(True)
    for k in keys:
        test = test & left[k].eqNullSafe(other[f"_{k}"])
    return left.join(other, test, how).drop(*[f"_{k}" for k in keys])


def development_set(sheet: DataFrame, labels: DataFrame) -> DataFrame:
    """sheet (validation_id, repository_url, line_no, claim_type, artifact_or_path, consensus_label, ...) with final, init and gold; one row an id."""
    named = sheet.withColumn("full_name", F.replace("repository_url", F.lit("https://github.com/"), F.lit("")))
    keys = ["full_name", "line_no", "claim_type", "artifact_or_path"]
    joined = null_safe_join(named, labels.select(*keys, "label", "status", "label_v4", "claim_seq"), keys)
    first = joined.withColumn("_k", F.row_number().over(Window.partitionBy("validation_id").orderBy("claim_seq"))).where("_k = 1").drop("_k")
    return first.withColumns({"gold": F.col("consensus_label"), "final": outcome(F.col("label_v4"), F.col("status")), "init": outcome(F.col("label"))})


def evaluation_set(a: DataFrame, b: DataFrame, key: DataFrame, consensus: DataFrame, labels: DataFrame) -> DataFrame:
    """Both coders' sheets, the sampling key and the consensus by eval_id, with gold, final and init."""
    sheets = (
        a.select("eval_id", "claim_type", "artifact_or_path", F.col("coder_label").alias("A"))
        .join(b.select("eval_id", F.col("coder_label").alias("B")), "eval_id")
        .join(key.select("eval_id", "full_name", "stratum", "status", "label_v4"), "eval_id")
        .join(consensus.select("eval_id", "consensus_label"), "eval_id", "left")
    )
    keys = ["full_name", "claim_type", "artifact_or_path"]
    with_labels = null_safe_join(sheets, labels.select(*keys, "label").distinct(), keys)
    return with_labels.withColumns(
        {"gold": gold(F.col("A"), F.col("B"), F.col("consensus_label")), "final": outcome(F.col("label_v4"), F.col("status")), "init": outcome(F.col("label"))}
    )


def confirmed_claims(sample: DataFrame, strata: DataFrame) -> DataFrame:
    """One row: how many of the claims found drifted are, by the share among those sampled."""
    share = sample.where("stratum = 'drifted'").agg(F.avg((F.col("gold") == "drifted").cast("int")).alias("p"))
    return strata.where("stratum = 'drifted'").join(share, F.lit(True)).select((F.col("size") * F.col("p")).alias("confirmed"))
