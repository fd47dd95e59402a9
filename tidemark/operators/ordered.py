"""Running values over a total order without a task that sees all rows.

Rows are dealt to range partitions once and stored with the number of theirs. A running value is
then one inside the partition, which a window over that partition gives, and what all partitions
before it hold, which is one row a partition: sums are added, a greatest value is compared, a
carried value is taken from the last partition that has one. What is sent to all tasks is that
table, as long as the number of partitions, whatever the number of rows.

Rows that share all of the order stand in one partition: aggregate them first where they may be
many. ``order`` should be total for a defined result; nulls come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staged import staged

PART = "_part"


class Ordered:
    """rows in range partitions of ``order`` (columns of rows, ascending). ``rows`` has the partition's number as ``_part``."""

    def __init__(self, rows: DataFrame, order: list[str], parts: int | None = None):
        self.order = order
        self.parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.rows = staged(rows.repartitionByRange(self.parts, *order).withColumn(PART, F.spark_partition_id()), "ordered")

    def running(
        self, rows: DataFrame | None = None, sums: dict[str, Column] | None = None, tops: dict[str, Column] | None = None, carried: dict[str, Column] | None = None, whole: dict[str, Column] | None = None
    ) -> DataFrame:
        """rows (those dealt, or made of them row by row) with a column for each name.

        sums: the sum up to and with the row, nulls counting as 0. tops: the greatest up to and
        with the row. carried: the last that is not null up to and with the row. whole: the
        sum over all rows.
        """
        rows = self.rows if rows is None else rows
        sums, tops, carried, whole = sums or {}, tops or {}, carried or {}, whole or {}
        at = F.struct(*self.order)
        own = [F.coalesce(F.sum(e), F.lit(0)).alias(n) for n, e in (sums | whole).items()] + [F.max(e).alias(n) for n, e in tops.items()]
        own += [F.max_by(e, F.when(e.isNotNull(), at)).alias(n) for n, e in carried.items()]
        totals = rows.groupBy(PART).agg(*own)
        earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
        before = [F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums] + [F.max(n).over(earlier).alias(f"_b_{n}") for n in tops]
        before += [F.last(n, ignorenulls=True).over(earlier).alias(f"_b_{n}") for n in carried] + [F.sum(n).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(n) for n in whole]
        inside = Window.partitionBy(PART).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        with_own = rows.withColumns(
            {n: F.coalesce(F.sum(e).over(inside), F.lit(0)) for n, e in sums.items()} | {n: F.max(e).over(inside) for n, e in tops.items()} | {n: F.last(e, ignorenulls=True).over(inside) for n, e in carried.items()}
        )
        both = with_own.join(F.broadcast(totals.select(PART, *before)), PART)
        merged = {n: F.col(n) + F.col(f"_b_{n}") for n in sums} | {n: F.greatest(n, f"_b_{n}") for n in tops} | {n: F.coalesce(n, f"_b_{n}") for n in carried}
        return both.withColumns(merged).drop(*[f"_b_{n}" for n in merged])


def as_of(asked: DataFrame, time: str, known: DataFrame, at: str, value: str, name: str) -> DataFrame:
    """asked with ``name``: the value of ``known`` at its last time not after each row's; null before the first and where the time is null.

    Times of both sides are one ordered column and values are carried over it, so neither side
    is a range join; equal times of ``asked`` are looked up once. ``known`` has one row a time.
    """
    kind = asked.schema[time].dataType
    times = asked.select(F.col(time).alias("_t")).where("_t is not null").distinct().select("_t", F.lit(1).alias("_side"), F.lit(None).cast(known.schema[value].dataType).alias("_v"))
    both = times.union(known.select(F.col(at).cast(kind).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v")))
    found = Ordered(both, ["_t", "_side"]).running(carried={"_found": F.col("_v")}).where("_side = 1").select("_t", F.col("_found").alias(name))
    return asked.join(found, asked[time] == found["_t"], "left").drop("_t")
