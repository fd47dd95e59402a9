"""Exact deduplication by recipes of content-defined chunks, in DataFrame operations only.

A text's bytes are cut where the last five of them fall into five fixed classes, at the
earliest after LEAST bytes and at the latest after MOST: the cut depends on nothing but what
stands before it, so texts that share passages share chunks. A chunk's fingerprint is 64 bits.
Chunks meet once, combined on the way, to be compared byte for byte: a fingerprint whose least
and greatest chunk are the same stands for one chunk, and is its verified identifier. The others
get a number besides. A text's recipe is the ordered list of its chunks' identifiers; equal
recipes are equal texts. Only recipes are grouped and joined after that, some 8 bytes for 700.

A group's size and its last row are aggregated on the way to the shuffle, so that a text that
a third of all rows hold is a row a task; its rows then meet one row of the answer in a join
that Spark splits where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, row_key, stored, whole_id

LEAST, MOST, WINDOW = 256, 8192, 5


def byte_class(place: int) -> str:
    """A quarter of all byte values, another one for each place of the window."""
    return "[" + "".join(f"\\x{b:02x}" for b in range(256) if (b * (2 * place + 167) + 31 * place >> 3) % 4 == 0) + "]"


#: Shortest run of LEAST bytes or more that ends in the window's classes; else up to MOST bytes.
CUT = f"(?s).{{{LEAST},{MOST - 1}}}?(?<={''.join(map(byte_class, range(WINDOW)))})|.{{1,{MOST}}}"


def chunks(text: str = "text") -> Column:
    """A text's chunks in order, as strings of one character a byte; null and empty texts have none."""
    return F.regexp_extract_all(F.decode(F.col(text).cast("string").cast("binary"), "ISO-8859-1"), F.lit(CUT), F.lit(0))


def chunk_bytes(chunk: Column) -> Column:
    return F.encode(chunk, "ISO-8859-1")


def chunk_fingerprint(chunk: Column) -> Column:
    return F.xxhash64(chunk_bytes(chunk))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprint=chunk_fingerprint) -> DataFrame:
    """One row for each row of docs: doc_id, key, row (a number of its own), n_bytes, text_sha256, recipe (fingerprints in order), marks.

    marks is null but for texts with a chunk whose fingerprint stands for several chunks: there it
    lists (position, number of the chunk among those). recipe and marks together identify a text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        row_key(id_col, text_col).alias("key"),
        F.monotonically_increasing_id().alias("row"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.sha2(text.cast("binary"), 256).alias("text_sha256"),
        F.coalesce(F.transform(chunks(text_col), fingerprint), F.array().cast("array<bigint>")).alias("recipe"),
    )
    rows = stored(rows, "recipes")  # numbers of rows are drawn once
    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), F.posexplode(chunks(text_col)).alias("at", "chunk"))
    pieces = pieces.select("doc_id", "key", "at", chunk_bytes(F.col("chunk")).alias("chunk"), fingerprint(F.col("chunk")).alias("fp"))
    doubtful = pieces.groupBy("fp").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most")).where("least <> most").select("fp")
    doubtful = stored(doubtful, "doubtful")
    none = F.lit(None).cast("array<struct<at:int,number:int>>")
    if doubtful.isEmpty():
        return rows.withColumn("marks", none)
    unsure = pieces.join(doubtful, "fp", "left_semi")
    several = unsure.select("fp", "chunk").distinct()
    numbers = several.withColumn("number", F.expr("row_number() over (partition by fp order by chunk)"))
    placed = unsure.join(numbers, ["fp", "chunk"]).select(F.coalesce("doc_id", F.lit(0)).alias("_id"), "key", "at", "number").distinct()
    marks = placed.groupBy("_id", "key").agg(F.array_sort(F.collect_list(F.struct("at", "number"))).alias("marks")).withColumnRenamed("key", "_key")
    joined = rows.join(marks, (F.coalesce(rows["doc_id"], F.lit(0)) == F.col("_id")) & (rows["key"] == F.col("_key")), "left")
    return stored(joined.select(*rows.columns, "marks"), "recipes")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprint=chunk_fingerprint) -> DataFrame:
    """For each row of docs: doc_id, key, n_bytes, n_chunks, text_sha256, keep_id, group_size, kept.

    Rows of one group have the same bytes; null and empty texts are one group. The row of the
    greatest id stays; among rows that repeat it one, and a null id only stays if no row of the
    group has another. Extra columns are not read; an empty table gives an empty one.
    """
    rows = recipes(docs, id_col, text_col, fingerprint)
    rows = rows.withColumn("marks", F.coalesce("marks", F.array().cast("array<struct<at:int,number:int>>")))
    last = rows.groupBy("recipe", "marks").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("last"))
    last = stored(last.select(F.col("recipe").alias("r"), F.col("marks").alias("m"), "group_size", F.col("last.doc_id").alias("keep_id"), F.col("last.row").alias("keep_row")), "groups")
    out = rows.join(last, (F.col("recipe") == F.col("r")) & (F.col("marks") == F.col("m")))
    return out.select("doc_id", "key", "n_bytes", F.size("recipe").cast("long").alias("n_chunks"), "text_sha256", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all their columns; of rows that repeat an id with its text one."""
    i, k, r = fresh(docs, "id", "key", "row")
    kept = exact_groups(docs).where("kept").select(F.coalesce("doc_id", F.lit(0)).alias(i), F.col("key").alias(k)).distinct()
    there = docs.withColumns({i: whole_id(), k: row_key()}).join(kept, [i, k], "left_semi")
    once = there.groupBy(i, k).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(r))
    return once.select(f"{r}.*")


def exact_digest(docs: DataFrame) -> DataFrame:
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_bytes", "n_chunks")
