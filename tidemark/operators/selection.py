"""Exact medians and other quantiles of many groups at once, by counting.

A double has a whole number that orders like it (sign, exponent and mantissa read as one number).
Each pass counts values by the next BITS bits of that number within the interval that is still
open, for each group and each rank that is asked for; the bin that holds the rank is the interval
of the next pass. Counts are combined on the way to the shuffle, so a pass moves at most 2^BITS
rows a task, group and open interval, and no value is sorted or held, whatever the group's size.
A bin of one value answers at once; after 64 / BITS passes every bin is one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staged import staged

BITS = 16
SALTS = 16


def order_number(x: Column) -> Column:
    """A long that orders like a double: negative ones below 0, both zeros 0, infinities beyond all others, NaN after them."""
    m = F.abs(x)
    guess = F.floor(F.log2(m)).cast("int")
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    e = F.greatest(F.lit(-1022), guess - F.when(power(guess) > m, 1).otherwise(0) + F.when(power(guess + 1) <= m, 1).otherwise(0))
    one, least = 1 << 52, F.lit(2.0**-1022)
    normal = (e + 1022).cast("long") * F.lit(one) + (m * power(-e) * F.lit(2.0**52)).cast("long")
    size = F.when(F.isnan(x), F.lit(2047 * one + 1)).when(m == F.lit(float("inf")), F.lit(2047 * one)).when(m == 0, F.lit(0)).when(m < least, (m * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")).otherwise(normal)
    return F.when(x < 0, -size).otherwise(size)


def ranked_values(rows: DataFrame, ranks: DataFrame, few: int = 50_000) -> DataFrame:
    """g, k, x: the value of rank k (from 0) of each group. rows: g, x (double, not null); ranks: g, k below the group's size.

    Open intervals are sent to all tasks while there are at most ``few`` of them; beyond that they
    are joined, a group's rows dealt over SALTS tasks by their value. Both ways give the same rows.
    """
    rows = rows.withColumn("n", order_number(F.col("x")))
    still = ranks.select("g", "k", F.lit(None).cast("long").alias("open"), F.col("k").alias("left"))
    found, shift = [], 64
    while True:
        last, shift = shift, shift - BITS
        if last == 64:
            inside = rows.withColumn("open", F.lit(None).cast("long"))
        else:
            intervals = still.select("g", "open").distinct()
            tagged = rows.withColumn("open", F.shiftright("n", last))
            if still.count() <= few:
                inside = tagged.join(F.broadcast(intervals), ["g", "open"])
            else:
                salted = intervals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
                inside = tagged.withColumn("salt", F.pmod(F.xxhash64("n"), F.lit(SALTS)).cast("int")).join(salted, ["g", "open", "salt"])
        bins = inside.groupBy("g", "open", F.shiftright("n", shift).alias("bin")).agg(F.count("*").alias("c"), F.min("x").alias("low"), F.max("x").alias("high"))
        order = Window.partitionBy("g", "open").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        upto = bins.withColumn("upto", F.sum("c").over(order)).withColumn("before", F.col("upto") - F.col("c"))
        u = upto.withColumnsRenamed({"g": "_g", "open": "_open"})
        hit = still.join(u, F.col("g").eqNullSafe(F.col("_g")) & F.col("open").eqNullSafe(F.col("_open")) & (F.col("left") >= F.col("before")) & (F.col("left") < F.col("upto")))
        next_ = staged(hit.select("g", "k", F.col("bin").alias("open"), (F.col("left") - F.col("before")).alias("left"), "low", "high"), "selection")
        one = (F.col("low") == F.col("high")) | F.lit(shift == 0)
        found.append(next_.where(one).select("g", "k", F.col("low").alias("x")))
        still = next_.where(~one).select("g", "k", "open", "left")
        if shift == 0 or still.isEmpty():
            return reduce(DataFrame.union, found)


def exact_quantiles(rows: DataFrame, column: str, probabilities: list[float], by: list[str] | None = None, few: int = 50_000) -> DataFrame:
    """by, n, quantiles (array, one a probability): between the two values around rank p(n-1), in proportion. Nulls are left out; groups without a value have no row; without ``by`` one row, also for an empty table (n 0, null)."""
    by = by or []
    g = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))
    narrow = staged(rows.select(g.alias("g"), F.col(column).cast("double").alias("x")).where("x is not null"), "values")
    sizes = staged(narrow.groupBy("g").agg(F.count("*").alias("size")), "sizes")
    place = [F.lit(float(p)) * (F.col("size") - 1) for p in probabilities]
    asked = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(r), F.least(F.floor(r) + 1, F.col("size") - 1)) for r in place])))
    values = ranked_values(narrow, sizes.select("g", F.explode(asked).alias("k")), few)
    known = values.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("k", "x"))).alias("at"))  # at most two entries a probability
    here = sizes.join(known, "g")
    low = lambda r: F.col("at")[F.floor(r)]
    high = lambda r: F.col("at")[F.least(F.floor(r) + 1, F.col("size") - 1)]
    part = lambda r: r - F.floor(r)
    between = lambda r: F.when(low(r) == high(r), low(r)).otherwise(low(r) * (1 - part(r)) + high(r) * part(r))
    out = here.select("g", F.col("size").alias("n"), F.array(*[between(r) for r in place]).alias("quantiles"))
    if by:
        return out.select("g.*", "n", "quantiles")
    return out.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.first("quantiles").alias("quantiles"))
