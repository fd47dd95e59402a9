"""Helpers shared by the training-data operators.

Row identity: two rows of a table may carry the same or no doc_id, so operators
that leave a document and come back to it join on the id (``whole_id``, null as 0)
together with ``row_key`` (a 64-bit hash of id and text). Rows that agree in both have
the same text, and hence the same answer, but for one in 2^64 of those that repeat an id.
"""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staged import ship  # noqa: F401


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset a local one, which only a local master may use."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors. The table goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """For operators that run Python on the executors. Texts may be long: bound what one Arrow batch holds by rows and by bytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def whole_id(id_col: str = "doc_id") -> Column:
    """The id as a long, null as 0: the key beside it tells the two apart."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until df has none of them in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name)
        out.append(name)
    return out


def text_slices(texts: pa.Array, limit: int = 4 << 20):
    """(first row, end row) of runs of texts that hold about ``limit`` bytes; a longer text is a run of its own."""
    offsets = offsets_of(texts)
    lo, n = 0, len(texts)
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def offsets_of(texts: pa.Array) -> np.ndarray:
    """n+1 byte offsets of an Arrow string array into its data buffer."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    buf = texts.buffers()[1]
    if buf is None or len(texts) == 0:
        return np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(buf, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def bytes_of(texts: pa.Array) -> np.ndarray:
    buf = texts.buffers()[2]
    return np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)


def batches(out: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in schema], schema=schema)
