"""Stages that remember: what a key's content gave once is not computed again.

A memo is a folder with two Parquet tables in buckets of the key: rows that a stage gave, and an
index of what it was run on. Both carry the content's version, so rows stay right whatever comes
after: a key whose content changes gets rows beside the old ones, one whose content changes back
finds its old rows. A run is made of an anti-join that finds (key, version) not yet in the index, the
stage on those alone, an append, and then the index. Rows of a run that stopped before its index
was written are never read. ``compact`` writes those buckets again that hold what is no longer current.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staged import staged

BUCKETS = 64
#: Keys of changed content that are sent to all tasks.
MOST_SENT = 100_000


def versions(inputs: DataFrame, key: list[str]) -> DataFrame:
    """key, _version: a digest of all rows of a key, whatever their order, combined on the way to the shuffle."""
    columns = [F.col(c) for c in sorted(inputs.columns) if c not in key]
    row = F.struct(*columns) if columns else F.lit(1)
    one, two = F.xxhash64(row).cast("decimal(38,0)"), F.xxhash64(F.lit("2"), row).cast("decimal(38,0)")
    return inputs.groupBy(*key).agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.sum(one).cast("string"), F.sum(two).cast("string")), 256).alias("_version"))


def bucket(key: list[str]) -> Column:
    return F.pmod(F.hash(*key), F.lit(BUCKETS)).alias("_bucket")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def matching(left: DataFrame, right: DataFrame, columns: list[str], how: str) -> DataFrame:
    """A join in which null keys match null keys."""
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in columns})
    test = F.lit(True)
    for c in columns:
        test = test & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(other, test, how).drop(*[f"_r_{c}" for c in columns])


class Memo:
    """The memo of one stage. ``stage`` takes rows of whole keys and returns rows that carry the key's columns."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str], stage: Callable[[DataFrame], DataFrame]):
        self.spark, self.key, self.stage = spark, key, stage
        self.rows_path, self.index_path = f"{folder.rstrip('/')}/rows", f"{folder.rstrip('/')}/index"

    def index(self, like: DataFrame) -> DataFrame:
        """key, _version, _run of all finished runs; where two computed the same, the first."""
        columns = [*self.key, "_version"]
        if not exists(self.spark, self.index_path):
            return like.select(*columns, F.lit("").alias("_run")).limit(0)
        return self.spark.read.parquet(self.index_path).groupBy(*columns).agg(F.min("_run").alias("_run"))

    def run(self, inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The stage's rows for all of inputs, and the keys (with _version) that had to be computed for it."""
        current = staged(versions(inputs, self.key), "versions")
        new = staged(matching(current, self.index(current), [*self.key, "_version"], "left_anti"), "changed")
        run = uuid.uuid4().hex
        if not new.isEmpty():
            out = self.stage(self.changed(inputs, new, current))
            out = matching(out, new, self.key, "inner").withColumn("_run", F.lit(run))
            out.select("*", bucket(self.key)).write.mode("append").partitionBy("_bucket").parquet(self.rows_path)
            new.select("*", F.lit(run).alias("_run"), bucket(self.key)).write.mode("append").partitionBy("_bucket").parquet(self.index_path)
        if not exists(self.spark, self.rows_path):
            return self.stage(inputs.limit(0)), new
        return matching(self.spark.read.parquet(self.rows_path), self.live(current), [*self.key, "_version", "_run"], "left_semi").drop("_version", "_run", "_bucket"), new

    def changed(self, inputs: DataFrame, new: DataFrame, current: DataFrame) -> DataFrame:
        """inputs of new keys. Contents stay where they are read: no join if all keys are new, and few new ones go to the contents; only many of more are joined by a shuffle of both."""
        some = new.count()
        if some == current.count():
            return inputs
        keys = new.select(*self.key)
        return matching(inputs, F.broadcast(keys) if some <= MOST_SENT else keys, self.key, "left_semi")

    def live(self, current: DataFrame) -> DataFrame:
        return matching(self.index(current), current, [*self.key, "_version"], "left_semi")

    def compact(self, inputs: DataFrame) -> int:
        """Writes the buckets anew that hold rows of no current version, and no others; returns how many."""
        live = staged(self.live(versions(inputs, self.key)), "live")
        changed = []
        for path, columns in ((self.index_path, [*self.key, "_version", "_run"]), (self.rows_path, [*self.key, "_version", "_run"])):
            if not exists(self.spark, path):
                continue
            table = self.spark.read.parquet(path)
            stale = [r[0] for r in matching(table, live, columns, "left_anti").select("_bucket").distinct().collect()]  # at most BUCKETS
            if stale:
                kept = staged(matching(table.where(F.col("_bucket").isin(stale)), live, columns, "left_semi"), "kept")
                missing = set(stale) - {r[0] for r in kept.select("_bucket").distinct().collect()}
                kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
                for b in missing:
                    place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_bucket={b}")
                    place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
            changed += stale
        return len(set(changed))
