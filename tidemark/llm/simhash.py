"""SimHash near-duplicates by multi-index hashing.

A fingerprint has two halves of 32 bits. Of two fingerprints that differ in at
most four bits, one half differs in at most two, so that some value lies within
one bit of both halves: each fingerprint enters the table under all values of
that small ball (33 a half), those that meet are compared in full.

Copies share a fingerprint and count once here. A table entry returns links to
spanning members only, never all its pairs. Entries of more than ``most``
members take another exact way, linear in their number: fingerprints within two
bits of one centre are all linked with each other, and every linked pair has
such a centre, so a star around each centre's least member links the same.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, row_key, stored, whole_id
from .graph import connected_components

BITS = 4


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    words = (text or "").encode().lower().split()  # ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - size + 1)
    last = ends[-n:] - 1 if len(words) >= size else ends[-1:] - 1
    f = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 14):
        at = zip(starts[lo : min(n, lo + (1 << 14))].tolist(), last[lo : lo + (1 << 14)].tolist())
        h = np.array([f(joined[a:b], seed) for a, b in at], np.uint64)
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """doc_id, key (row_key) and fp (the 64 bits as a long) for each row, duplicates and null ids too. Null, empty or blank texts have 0."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, size) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["doc_id", "key", "fp"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, key long, fp long")


def near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= bits


def spanning(members: pd.DataFrame) -> pd.DataFrame:
    """Links that join what is near within one table entry, at most one less than its members."""
    x = members["fp"].to_numpy().view(np.uint64)
    label = np.arange(len(x))
    pairs = []
    for i in range(len(x)):
        hit = np.flatnonzero(near(x[i + 1 :], x[i], BITS)) + i + 1
        hit = hit[label[hit] != label[i]]
        if len(hit):
            other, first = np.unique(label[hit], return_index=True)
            pairs.append(np.stack([np.full(len(first), x[i]), x[hit[first]]], 1))
            label[np.isin(label, other)] = label[i]
    out = np.concatenate(pairs).view(np.int64) if pairs else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})


def half_balls() -> Column:
    one = [0, *(1 << i for i in range(32))]
    return F.explode(F.array(*[F.struct(F.lit(s).alias("half"), F.lit(m).alias("mask")) for s in (0, 1) for m in one])).alias("k")


def links(fps: DataFrame, most: int = 4096) -> DataFrame:
    """Distinct fp to links (a, b) of at most four differing bits: as many as are needed to connect what is connected."""
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = fps.repartition(parts, F.xxhash64("fp", F.lit(1))).select("fp", half_balls()).select(
        "fp",
        F.expr("(((case when k.half = 0 then shiftrightunsigned(fp, 32) else fp & 4294967295L end) ^ k.mask) | shiftleft(cast(k.half as bigint), 32))").alias("key"),
    )
    sizes = stored(table.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "entries")
    two = sizes.where("n = 2 and bit_count(a ^ b) <= 4").select("a", "b")
    members = table.join(sizes.where("n > 2").select("key", "n").hint("shuffle_hash"), "key")
    few = members.where(F.col("n") <= most).groupBy("key").applyInPandas(spanning, "a long, b long")
    hot = members.where(F.col("n") > most).select("fp").distinct()
    ball = [0] + [sum(1 << b for b in c) for k in (1, 2) for c in combinations(range(64), k)]
    ball = [m - (1 << 64) if m >> 63 else m for m in ball]
    around = hot.select("fp", F.explode(F.array(*map(F.lit, ball))).alias("mask")).select("fp", F.expr("fp ^ mask").alias("centre"))
    stars = around.join(around.groupBy("centre").agg(F.min("fp").alias("a")), "centre").where("fp <> a").select("a", F.col("fp").alias("b"))
    return two.union(few).union(stars)


def first_of(rows: DataFrame, by: str) -> DataFrame:
    """by, doc_id, key of one row of each group: the least id, of rows without ids the least key. Flat columns, so that each task adds up its own rows by hash."""
    return rows.groupBy(by).agg(F.min("doc_id").alias("doc_id"), F.coalesce(F.min_by("key", "doc_id"), F.min("key")).alias("key"))


def grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints (stored), and for each fingerprint its component's first row: fp, doc_id, key.

    Fingerprints without links answer for themselves. The others meet their component's
    first row in a join of two stored tables, which Spark splits where one component is
    much larger than the rest.
    """
    own = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = first_of(own, "fp")
    roots = connected_components(links(fps.select("fp")))
    placed = stored(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc_id", "key", "root"), "placed")
    linked = placed.where("root is not null")
    least = stored(first_of(linked, "root"), "least")
    return own, placed.where("root is null").select("fp", "doc_id", "key").union(linked.select("fp", "root").join(least, "root").select("fp", "doc_id", "key"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable over links) for each row of docs.

    Rows with null ids take part and may have a null component_id if no other id is
    reachable. Repeated rows stay rows. Empty texts share fingerprint 0 and are linked
    like any other. Whole texts of any length. An empty table gives an empty one; other
    columns are not read.
    """
    own, named = grouped(docs, id_col, text_col)
    return own.join(named.select("fp", F.col("doc_id").alias("component_id")), "fp", "left").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns of docs: that of the least id (a null id comes last), of repeated rows any."""
    _, named = grouped(docs, id_col, text_col)
    i, k = fresh(docs, "id", "key")
    keys = named.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias(i), F.col("key").alias(k)).distinct()
    return docs.withColumns({i: whole_id(id_col), k: row_key(id_col, text_col)}).join(keys, [i, k], "left_semi").dropDuplicates([i, k]).select(*docs.columns)


def simhash_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
